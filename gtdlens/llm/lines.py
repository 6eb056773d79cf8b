"""Line dedup by content-defined chunks, in DataFrame operations only.

Each line gets a hash. A rolling hash over the last lines' hashes decides where a chunk of lines ends, so a boundary depends on
the lines around it and not on their place in the document: a passage that moved is cut alike. Chunks of several lines
whose hash occurs more than once anywhere are candidates; those are compared by their bytes, the first one (smallest id,
then first place) stays and the others are removed.

With `bounded` a chunk has two lines at least that are not blank, where the text has two, and three at most, so that each can
take part: it ends where the rolling hash is least among its neighbours, and what lies between two such ends is cut
into pairs, also a run of equal lines. Blank lines belong to the chunk before them.

The shuffles: chunk hashes (partly counted before), the candidates per document, the texts by id. The texts' shuffle is
planned once and reused by the byte comparison and the final removal. Hot chunks are counted before the shuffle, and their
minimum is taken before it too, so no task gathers a group.

Defined results: a null text stays null with no lines; an empty text is one empty line; rows without an id are kept whole
and take no part; repeated rows share an id and get the same result. A chunk takes part if two of its lines at least hold
something other than blanks. The other columns stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gtdlens.session import write_once

WINDOW = 2
DIVISOR = 3
PRIME = 1_000_000_007
PIECE = 2


def line_array(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_hashes(lines: Column) -> Column:
    return F.transform(lines, lambda line: F.pmod(F.xxhash64(line), F.lit(PRIME)))


def chunk_ends(hashes: Column, window: int = WINDOW, divisor: int = DIVISOR) -> Column:
    """Index of the last line of each chunk."""

    def rolled(i: Column) -> Column:
        total: Column = F.lit(0).cast("long")
        for back in range(window):
            total = total * 31 + F.coalesce(F.get(hashes, i - back), F.lit(0).cast("long"))
        return F.xxhash64(total)

    last = F.size(hashes) - 1
    return F.filter(F.sequence(F.lit(0), last), lambda i: (i == last) | (F.pmod(rolled(i), F.lit(divisor)) == 0))


def _bounded(rows: DataFrame) -> DataFrame:
    """Add `__ends` of chunks of two or three lines that are not blank; the steps are columns for the reason in `_cut`."""
    n, at, rolled, cuts = F.size("__at"), F.col("__at"), F.col("__rolled"), F.col("__cuts")

    def roll(_: Column, j: Column) -> Column:
        total: Column = F.lit(0).cast("long")
        for back in range(WINDOW):
            total = total * 31 + F.coalesce(F.get("__hashes", F.get(at, j - back)), F.lit(0).cast("long"))
        return F.xxhash64(total)

    def is_cut(j: Column) -> Column:
        least = (F.get(rolled, j) < F.get(rolled, j - 1)) & (F.get(rolled, j) <= F.get(rolled, j + 1))
        return (j == n - 1) | ((j >= 1) & (j <= n - 3) & least)

    def pieces(end: Column, k: Column) -> Column:
        first = F.coalesce(F.get(cuts, k - 1) + 1, F.lit(0))
        count = F.greatest(F.lit(1), F.floor((end - first + 1) / PIECE).cast("int"))
        return F.transform(F.sequence(F.lit(1), count), lambda q: F.when(q == count, end).otherwise(first + q * PIECE - 1))

    last_line = F.size("__lines") - 1
    ends = F.transform("__pieces", lambda j: F.when(j == n - 1, last_line).otherwise(F.get(at, j)))
    places = F.sequence(F.lit(0), last_line)
    return (
        rows.withColumn("__at", F.filter(places, lambda i: F.trim(F.get("__lines", i)) != ""))
        .withColumn("__rolled", F.transform("__at", roll))
        .withColumn("__cuts", F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), is_cut))
        .withColumn("__pieces", F.flatten(F.transform("__cuts", pieces)))
        .withColumn("__ends", F.when(n == 0, F.array(last_line)).otherwise(ends))
        .drop("__at", "__rolled", "__cuts", "__pieces")
    )


def chunk_array(lines: Column, ends: Column) -> Column:
    """Chunks as (number, first line, lines, bytes)."""

    def chunk(end: Column, k: Column) -> Column:
        first = F.coalesce(F.get(ends, k - 1) + 1, F.lit(0))
        size = end - first + 1
        return F.struct(
            k.alias("chunk"),
            first.alias("first"),
            size.alias("size"),
            F.array_join(F.slice(lines, first + 1, size), "\n").alias("bytes"),
        )

    return F.transform(ends, chunk)


def _cut(rows: DataFrame, text: Column, bounded: bool) -> DataFrame:
    """Add the lines, their hashes and the chunk ends. Each is a column of its own: a lambda that held the whole
    expression would evaluate it again for every line."""
    with_lines = rows.withColumn("__lines", line_array(text))
    with_hashes = with_lines.withColumn("__hashes", line_hashes(F.col("__lines")))
    if bounded:
        return _bounded(with_hashes)
    return with_hashes.withColumn("__ends", chunk_ends(F.col("__hashes")))


def _chunks(rows: DataFrame, bounded: bool, *carried: str) -> DataFrame:
    """One row per chunk with two lines at least that are not blank."""
    cut = _cut(rows.where("__text is not null and __id is not null"), F.col("__text"), bounded)
    exploded = cut.select("__id", *carried, F.explode(chunk_array(F.col("__lines"), F.col("__ends"))).alias("c"))
    several = F.size(F.filter(F.split("c.bytes", "\n", -1), lambda line: F.trim(line) != "")) >= 2
    return exploded.where(several)


def repeated_chunks(rows: DataFrame, bounded: bool = False) -> DataFrame:
    """Per id the numbers of its chunks that equal a chunk found earlier, and the lines they hold."""
    keyed = write_once(
        _chunks(rows, bounded).select(
            "__id", F.col("c.chunk").alias("__chunk"), F.xxhash64("c.bytes").alias("__hash"), F.length("c.bytes").alias("__n")
        ),
        "chunks",
    )
    # Written, so that the join below reads plain shuffles and a hot chunk's rows can be split.
    found_twice = write_once(keyed.groupBy("__hash", "__n").count().where("count > 1").select("__hash", "__n"), "twice")
    candidates = (
        keyed.join(found_twice, ["__hash", "__n"]).groupBy("__id").agg(F.collect_set("__chunk").alias("__candidates"))
    )
    texts = _chunks(rows.join(candidates, "__id"), bounded, "__candidates").where(F.array_contains("__candidates", F.col("c.chunk")))
    place = F.struct(F.col("__id"), F.col("c.chunk").alias("__chunk"))
    named = texts.select(place.alias("__place"), F.col("c.size").alias("__size"), F.col("c.bytes").alias("__bytes"))
    # Grouped by the bytes themselves; only a digest of them travels on.
    first = (
        named.groupBy("__bytes")
        .agg(F.min("__place").alias("__first"))
        .select(F.sha2("__bytes", 256).alias("__digest"), "__first")
    )
    later = (
        named.select("__place", "__size", F.sha2("__bytes", 256).alias("__digest"))
        .join(first, "__digest")
        .where("__place <> __first")
    )
    return later.groupBy(F.col("__place.__id").alias("__id")).agg(
        F.collect_set("__place.__chunk").alias("__gone"),
    )


def without_repeated_chunks(
    df: DataFrame, id_column: str = "doc_id", text_column: str = "text", bounded: bool = False
) -> DataFrame:
    """All rows and columns, the text without the repeated chunks, and `removed_lines`, `removed_chunks`."""
    others = [c for c in df.columns if c not in (text_column, "removed_lines", "removed_chunks")]
    # The other columns travel in one, so none can clash with the names used here.
    rows = df.select(
        F.struct(*[F.col(f"`{c}`") for c in others]).alias("__row"),
        F.col(f"`{id_column}`").alias("__id"),
        F.col(f"`{text_column}`").cast("string").alias("__text"),
    )
    joined = rows.join(repeated_chunks(rows.select("__id", "__text"), bounded), "__id", "left")
    cut = (
        _cut(joined, F.when(F.col("__gone").isNotNull(), F.col("__text")), bounded)
        .withColumn("__chunks", chunk_array(F.col("__lines"), F.col("__ends")))
        .withColumn("__left", F.filter("__chunks", lambda c: ~F.array_contains(F.col("__gone"), c["chunk"])))
    )
    left_lines = F.aggregate("__left", F.lit(0), lambda n, c: n + c["size"])
    kept = F.array_join(F.transform("__left", lambda c: c["bytes"]), "\n")
    return cut.select(
        *[F.col("__row").getField(c).alias(c) for c in others],
        F.when(F.col("__gone").isNull(), F.col("__text")).otherwise(kept).alias(text_column),
        F.coalesce(F.size("__lines") - left_lines, F.lit(0)).cast("long").alias("removed_lines"),
        F.coalesce(F.size("__gone"), F.lit(0)).cast("long").alias("removed_chunks"),
    )


def line_digest(
    df: DataFrame, id_column: str = "doc_id", text_column: str = "text", bounded: bool = False
) -> DataFrame:
    """One row per document: lines, lines and chunks removed, and the digest of the text that stays."""
    narrow = df.select(F.col(f"`{id_column}`").cast("long").alias("doc_id"), F.col(f"`{text_column}`").alias("text"))
    n_lines = F.coalesce(F.size(line_array(F.col("text"))), F.lit(0)) + F.col("removed_lines")
    whole_gone = (F.col("text") == "") & (F.col("removed_lines") > 0)
    return without_repeated_chunks(narrow, bounded=bounded).select(
        "doc_id",
        F.when(F.col("text").isNull(), 0).when(whole_gone, F.col("removed_lines")).otherwise(n_lines).cast("long").alias("n_lines"),
        F.col("removed_lines").alias("n_removed_lines"),
        F.col("removed_chunks").alias("n_removed_chunks"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"),
    )
