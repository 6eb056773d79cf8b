"""MinHash near-dedup with b-bit signatures.

1. Each text becomes the set of its word shingles. Documents with equal sets form a class; its smallest id stands for it.
2. 128 minima a set: groups of them give the band buckets, and the low bits of each are packed into a signature.
3. Candidates are pairs of classes that share a bucket. First each member meets the bucket's pivot (the class with most
   copies), which joins most of a group of copies; then only members of different components meet, so a group that is
   already connected costs no pairs. A large bucket that is not connected is cut into blocks of bounded size, and
   pairs of blocks compare their sets at once and pass on only a spanning forest.
4. The similarity of a candidate pair is estimated from the number of equal lanes of the two signatures (bit counts),
   corrected for lanes that agree by chance. Only pairs clearly below the limit are dropped.
5. The others are confirmed on the full shingle sets, and the links' connected components are the groups.

With 32 bands of 4 minima a pair at the limit of 0.8 meets in no bucket with probability 5e-8; the estimate's margin is
more than five standard deviations.

Defined results: a null or empty text has no shingles and is linked with nothing; fewer words than a shingle make one
shingle of the whole sequence; rows that repeat an id share their group; a row without an id has no component and
is kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gtdlens.llm.common import narrowed, per_batch
from gtdlens.llm.components import connected_components
from gtdlens.llm.text_arrays import SMALL_SLICE_BYTES, Words, mixed, signed, slices
from gtdlens.session import write_once

BANDS, ROWS, BITS = 32, 4, 4
LANES = BANDS * ROWS
PER_LONG = 64 // BITS
MARGIN = 0.2  # below the limit, the estimate may not be trusted to drop a pair
LARGE_BUCKET = 64  # classes; larger unconnected buckets meet in blocks
BLOCK_CLASSES, BLOCK_SHINGLES = 512, 150_000

MULTIPLIERS = mixed(np.arange(1, LANES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def shingle_sets(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of all rows as (row, hash), sorted by row. ASCII letters count in lower case."""
    words = Words(texts, lower=True)
    hashes = words.hashes()
    starts, found = words.window_hashes(hashes, size)
    rows = words.rows[starts]
    short = np.flatnonzero((words.counts > 0) & (words.counts < size))
    if len(short):
        whole = [mixed(np.array([_fold(hashes[words.first[r] : words.first[r + 1]])], np.uint64))[0] for r in short]
        found, rows = np.concatenate([found, np.array(whole, np.uint64)]), np.concatenate([rows, short])
    keys = mixed(found ^ mixed(rows.astype(np.uint64) + np.uint64(1)))
    _, index = np.unique(keys, return_index=True)
    index = index[np.argsort(rows[index], kind="stable")]
    return rows[index], found[index]


def _fold(hashes: np.ndarray) -> int:
    total = len(hashes)
    for h in hashes.tolist():
        total = (total * 0x9E3779B97F4A7C15 + h) & ((1 << 64) - 1)
    return total


def signatures(df: DataFrame, shingle: int) -> DataFrame:
    """Per row: set size, 128 bits that name the set, the packed signature and the band buckets."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in slices(batch, size=SMALL_SLICE_BYTES):
            n = part.num_rows
            rows, found = shingle_sets(part.column("text"), shingle)
            count = np.bincount(rows, minlength=n)
            filled = np.flatnonzero(count)
            first = np.concatenate([[0], np.cumsum(count[filled])])[:-1]
            minima = np.zeros((n, LANES), np.uint64)
            names = np.zeros((2, n), np.uint64)
            if len(filled):
                for lane, factor in enumerate(MULTIPLIERS):
                    minima[filled, lane] = np.minimum.reduceat(found * factor, first)
                names[0, filled] = np.add.reduceat(mixed(found + np.uint64(1)), first)
                names[1, filled] = np.add.reduceat(mixed(found ^ np.uint64(0x5555555555555555)), first)
            low = mixed(minima) >> np.uint64(64 - BITS)
            shifts = np.arange(PER_LONG, dtype=np.uint64) * np.uint64(BITS)
            sketch = np.bitwise_or.reduce(low.reshape(n, -1, PER_LONG) << shifts, axis=2)
            bucket = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (n, BANDS))
            for row in range(ROWS):
                bucket = mixed(bucket + minima.reshape(n, BANDS, ROWS)[:, :, row])
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    pa.array(count, pa.int64()),
                    pa.array(signed(names[0])),
                    pa.array(signed(names[1])),
                    _lists(sketch),
                    _lists(bucket),
                ],
                ["doc_id", "n", "name1", "name2", "sketch", "buckets"],
            )

    schema = "doc_id long, n long, name1 long, name2 long, sketch array<long>, buckets array<long>"
    return per_batch(df, run, schema)


def _lists(table: np.ndarray) -> pa.Array:
    bounds = np.arange(len(table) + 1, dtype=np.int32) * table.shape[1]
    return pa.ListArray.from_arrays(pa.array(bounds), pa.array(signed(table.ravel())))


def estimated_similarity(one: str, other: str) -> Column:
    """Share of equal lanes, less what lanes agree on by chance."""
    ones = int("1".zfill(BITS) * PER_LONG, 2)
    differing: Column = F.lit(0)
    for i in range(LANES // PER_LONG):
        folded = x = F.get(F.col(one), F.lit(i)).bitwiseXOR(F.get(F.col(other), F.lit(i)))
        for shift in range(1, BITS):
            folded = folded.bitwiseOR(F.shiftrightunsigned(x, shift))
        differing = differing + F.bit_count(folded.bitwiseAND(F.lit(ones).cast("long")))
    chance = 1 / (1 << BITS)
    return (1 - differing / F.lit(float(LANES)) - chance) / (1 - chance)


def _plausible(one: str, other: str, percent: int) -> Column:
    """Sizes that allow the similarity, and an estimate that does not rule it out."""
    smaller, larger = F.least(f"{one}.n", f"{other}.n"), F.greatest(f"{one}.n", f"{other}.n")
    estimate = estimated_similarity(f"{one}.sketch", f"{other}.sketch")
    return (smaller * 100 >= larger * percent) & (estimate >= percent / 100 - MARGIN)


def confirmed(pairs: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are similar enough."""
    joined = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a").join(
        texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b"
    )

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in slices(batch, "text_a", SMALL_SLICE_BYTES // 2):
            n = part.num_rows
            keys, sizes = [], []
            for column in ("text_a", "text_b"):
                rows, found = shingle_sets(part.column(column), shingle)
                sizes.append(np.bincount(rows, minlength=n))
                keys.append((rows, mixed(found ^ mixed(rows.astype(np.uint64) + np.uint64(1)))))
            rows, one = keys[0]
            shared = np.bincount(rows[np.isin(one, keys[1][1])], minlength=n)
            linked = 100 * shared >= percent * (sizes[0] + sizes[1] - shared)
            yield part.select(["a", "b"]).filter(pa.array(linked & (shared > 0)))

    return per_batch(joined.select("a", "b", "text_a", "text_b"), run, "a long, b long")


def _links_in_blocks(members: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Links that connect the members of large buckets: pairs of blocks compare all their sets at once.

    members: bucket, node, component, n, blocks. A block holds a bounded number of classes and shingles, and a task one
    pair of blocks; of the links it finds it passes on a spanning forest.
    """
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    met = (
        members.withColumn("block", block)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("pair", F.struct(F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")))
        .select("bucket", "pair", "node", "component")
    )
    with_text = met.join(texts.withColumnRenamed("doc_id", "node"), "node")

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        nodes = table.column("node").to_numpy()
        rows, found = shingle_sets(table.column("text").combine_chunks(), shingle)
        label = _spanning(rows, found, len(nodes), percent)
        link = np.flatnonzero(label != np.arange(len(nodes)))
        return pa.table({"a": pa.array(nodes[label[link]], pa.int64()), "b": pa.array(nodes[link], pa.int64())})

    return with_text.groupBy("bucket", "pair").applyInArrow(run, "a long, b long").where("a <> b")


def _spanning(rows: np.ndarray, found: np.ndarray, n: int, percent: int) -> np.ndarray:
    """For each set the first one it is connected with by links among these sets."""
    letters, column = np.unique(found, return_inverse=True)
    order = np.argsort(column, kind="stable")
    rows, column = rows[order], column[order]
    shared = np.zeros((n, n), np.float32)
    width = 4096
    bounds = np.searchsorted(column, np.arange(0, len(letters) + width, width))
    for k, (a, b) in enumerate(zip(bounds, bounds[1:])):
        dense = np.zeros((n, width), np.float32)
        dense[rows[a:b], column[a:b] - k * width] = 1
        shared += dense @ dense.T
    size = np.bincount(rows, minlength=n)
    linked = (100 * shared >= percent * (size[:, None] + size[None, :] - shared)) & (shared > 0)
    label = np.arange(n)
    while True:
        least = np.minimum(label, np.where(linked, label[None, :], n).min(axis=1))
        least = least[least]
        if (least == label).all():
            return label
        label = least


def near_duplicates(
    df: DataFrame, shingle: int = 5, percent: int = 80, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """One row per document: set size, the smallest id its group reaches, and whether it stands for the group."""
    docs = narrowed(df, id_column, text_column)
    signed_docs = write_once(signatures(docs, shingle), "signatures")
    named = ["name1", "name2", "n"]
    usable = signed_docs.where("doc_id is not null and n > 0")
    classes = write_once(
        usable.groupBy(*named).agg(F.min("doc_id").alias("node"), F.count("*").alias("copies")), "classes"
    )
    stands = usable.join(classes.withColumnRenamed("node", "doc_id"), [*named, "doc_id"])
    reps = write_once(
        stands.select(F.col("doc_id").alias("node"), "copies", "n", "sketch", "buckets").dropDuplicates(["node", "n", "sketch"]),
        "representatives",
    )
    members = write_once(_bucket_members(reps), "buckets")
    wanted = members.select(F.col("node").alias("doc_id")).distinct()
    texts = write_once(docs.join(wanted, "doc_id"), "texts")

    described = reps.select("node", F.struct("n", "sketch").alias("set"))
    star = members.where("node <> pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct()
    first = write_once(confirmed(_estimated(star, described, percent), texts, shingle, percent).distinct(), "links")

    groups = connected_components(first)
    placed = members.join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    spread = placed.groupBy("bucket").agg(
        F.min("component").alias("low"),
        F.max("component").alias("high"),
        F.count("*").alias("size"),
        F.sum("n").alias("shingles"),
    )
    apart = write_once(placed.join(spread.where("low < high").drop("low", "high"), "bucket"), "apart")
    few = apart.where(F.col("size") <= LARGE_BUCKET).join(described, "node").select("bucket", "node", "component", "set")
    crossing = (
        few.alias("x")
        .join(few.alias("y"), "bucket")
        .where((F.col("x.node") < F.col("y.node")) & (F.col("x.component") != F.col("y.component")))
        .where(_plausible("x.set", "y.set", percent))
        .select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))
        .distinct()
    )
    blocks = F.greatest(F.ceil(F.col("size") / BLOCK_CLASSES), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    many = apart.where(F.col("size") > LARGE_BUCKET).withColumn("blocks", blocks)
    links = (
        first.unionByName(confirmed(crossing, texts, shingle, percent))
        .unionByName(_links_in_blocks(many, texts, shingle, percent))
        .distinct()
    )
    final = connected_components(links)
    of_class = classes.join(final, "node", "left").select(*named, F.coalesce("component", "node").alias("component_id"))
    # Written, so that the join below reads plain shuffles and a class with very many copies can be split.
    of_class = write_once(of_class, "components")
    found = signed_docs.join(of_class, named, "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return found.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )


def _bucket_members(reps: DataFrame) -> DataFrame:
    """Members of each bucket with two classes at least, and the bucket's pivot: most copies, then the smallest id."""
    rows = reps.select("node", "copies", "n", F.explode("buckets").alias("bucket"))
    # The pivot's order as two plain numbers, so that the partial aggregation keeps them in place.
    most = rows.groupBy("bucket").agg(F.count("*").alias("size"), F.max("copies").alias("most")).where("size > 1")
    shared = rows.join(most, "bucket")
    pivots = shared.where("copies = most").groupBy("bucket").agg(F.min("node").alias("pivot"))
    return shared.join(pivots, "bucket").select("bucket", "node", "n", "pivot")


def _estimated(pairs: DataFrame, described: DataFrame, percent: int) -> DataFrame:
    one = described.select(F.col("node").alias("a"), F.col("set").alias("x"))
    other = described.select(F.col("node").alias("b"), F.col("set").alias("y"))
    return pairs.join(one, "a").join(other, "b").where(_plausible("x", "y", percent)).select("a", "b")
