"""Substring dedup by De Bruijn compaction.

A window of `window` words is an edge of the De Bruijn graph between its first and its last words. Neighbouring edges that
share a minimiser (the smallest hash among the runs of `seed` words inside a window, the leftmost of equals) are compacted
into one path record: the words they span, named by a hash of their own. Two windows with equal words have the same
minimiser at the same place, so equal edges lie in records of the same seed.

* Records with the same seed and path are copies of one nonbranching path: all but the first are repeated from end to end.
* The first record of a path is opened up again into single edges only where its seed has other paths too, which is
  where the graph branches. Edges are named by two independent hashes, and all but the first of a name are repeated.

The source coordinates (id, start) of records and edges decide which is first; joined back to the texts they give the
words to remove. Copies found within one task are settled there, and their records leave under a seed of their own,
so that a group of copies that holds a third of all rows sends one record of each path per task and never fills one task.

The shuffles: the least and largest path of each seed (a seed branches where they differ), path records (16 bytes of
hashes each, one per about six words), those that share their seed by seed and path, those that are repeated or
branch, the texts by id (planned once, reused), the opened edges. No shuffle gathers a seed: a phrase that many documents
share in different surroundings is one row a task in the first, and spreads by path and by edge in the others.

Defined results: a null or empty text has no words and the digest of nothing; rows without an id take no part and
are kept whole; rows that repeat an id are the same document and get the same result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gtdlens.llm.common import narrowed, per_batch
from gtdlens.llm.text_arrays import SMALL_SLICE_BYTES, Words, mixed, sequence_hashes, signed, slices
from gtdlens.session import write_once

WINDOW = 20
SEED_WORDS = 8
RECORDS = "seed long, path long, doc_id long, start int, n int, later boolean"
SPANS = "array<struct<start: int, n: int>>"


def _settled(key1, key2, doc, start, n) -> pa.RecordBatch:
    """Records of one batch: those whose path occurs earlier in the batch are later copies, joined to runs per document."""
    order = np.lexsort((start, doc, key2, key1))
    key1, key2, doc, start, n = key1[order], key2[order], doc[order], start[order], n[order]
    fresh = np.ones(len(doc), bool)
    fresh[1:] = (key1[1:] != key1[:-1]) | (key2[1:] != key2[:-1])
    first = np.maximum.accumulate(np.where(fresh, np.arange(len(doc)), 0))
    later = (doc != doc[first]) | (start != start[first])
    # Runs of later copies in a document become one record each, under a seed that spreads them.
    run_doc, run_start, run_n = doc[later], start[later], n[later]
    order = np.lexsort((run_start, run_doc))
    run_doc, run_start, run_n = run_doc[order], run_start[order], run_n[order]
    begins = np.ones(len(run_doc), bool)
    begins[1:] = (run_doc[1:] != run_doc[:-1]) | (run_start[1:] > run_start[:-1] + run_n[:-1])
    at = np.flatnonzero(begins)
    run_end = np.maximum.reduceat(run_start + run_n, at) if len(at) else run_start
    own = signed(mixed(run_doc[at].astype(np.uint64) * np.uint64(31) + run_start[at].astype(np.uint64)))
    kept = ~later
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.concatenate([signed(key1[kept]), own])),
            pa.array(np.concatenate([signed(key2[kept]), own])),
            pa.array(np.concatenate([doc[kept], run_doc[at]])),
            pa.array(np.concatenate([start[kept], run_start[at]]).astype(np.int32)),
            pa.array(np.concatenate([n[kept], run_end - run_start[at]]).astype(np.int32)),
            pa.array(np.concatenate([np.zeros(kept.sum(), bool), np.ones(len(at), bool)])),
        ],
        ["seed", "path", "doc_id", "start", "n", "later"],
    )


def path_records(docs: DataFrame, window: int, seed_words: int) -> DataFrame:
    """Compacted paths of all documents: seed, path, document, first word, edges."""
    choices = window - seed_words + 1

    def of(part: pa.RecordBatch):
        words = Words(part.column("text"))
        hashes = words.hashes()
        edges = words.window_starts(window)
        if not len(edges):
            return None
        at, found = words.window_hashes(hashes, seed_words)
        seeds = np.full(len(hashes), np.iinfo(np.uint64).max, np.uint64)
        seeds[at] = found
        chosen = edges + sliding_window_view(seeds, choices)[edges].argmin(axis=1)
        rows = words.rows[edges]
        begins = np.flatnonzero(np.concatenate([[True], (chosen[1:] != chosen[:-1]) | (rows[1:] != rows[:-1])]))
        n = np.diff(np.concatenate([begins, [len(edges)]]))
        first = edges[begins]
        path = sequence_hashes(hashes, first, first + n + window - 1, 3)
        ids = np.asarray(part.column("doc_id"))[words.rows[first]]
        return seeds[chosen[begins]], path, ids, first - words.first[words.rows[first]], n

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        parts = [found for part in slices(batch, size=SMALL_SLICE_BYTES) if (found := of(part))]
        if parts:
            yield _settled(*map(np.concatenate, zip(*parts)))

    return per_batch(docs, run, RECORDS)


def opened_edges(branching: DataFrame, window: int) -> DataFrame:
    """The single edges of branching records: rows (doc_id, text, spans) to records of one edge each."""

    def of(part: pa.RecordBatch):
        words = Words(part.column("text"))
        hashes = words.hashes()
        row, start, n = span_arrays(part.column("spans"))
        if not len(n):
            return None
        place = np.repeat(words.first[row] + start, n) + _counted(n)
        ids = np.repeat(np.asarray(part.column("doc_id"))[row], n)
        one, two = (sequence_hashes(hashes, place, place + window, s) for s in (5, 6))
        return one, two, ids, np.repeat(start, n) + _counted(n), np.ones(len(place), np.int64)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        parts = [found for part in slices(batch, size=SMALL_SLICE_BYTES) if (found := of(part))]
        if parts:
            yield _settled(*map(np.concatenate, zip(*parts)))

    return per_batch(branching, run, RECORDS)


def _counted(n: np.ndarray) -> np.ndarray:
    """0, 1, ... for each of the counts in turn."""
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def span_arrays(spans: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, start and length of all spans; a null list has none."""
    sizes = np.array([0 if s is None else s for s in spans.value_lengths().to_pylist()], np.int64)
    flat = spans.flatten()
    start, n = (np.asarray(flat.field(i)).astype(np.int64) for i in (0, 1))
    return np.repeat(np.arange(len(spans)), sizes), start, n


def repeated_spans(docs: DataFrame, window: int, seed_words: int) -> DataFrame:
    """Per document the spans (first word, edges) whose windows all start earlier too: (doc_id, spans)."""
    records = path_records(docs, window, seed_words)
    # Combined before the shuffle, so a seed that a third of all records share is one row a task. The records are made
    # again below: their seeds do not depend on how a scan was cut, and it moves less than writing them.
    seeds = records.groupBy("seed").agg(F.min("path").alias("low"), F.max("path").alias("high"), F.count("*").alias("n"))
    seeds = write_once(seeds.where("n > 1").select("seed", F.expr("low < high").alias("other")), "seeds")
    copies = Window.partitionBy("seed", "path").orderBy("doc_id", "start")
    # A record alone with its seed goes first. The written table's size decides how it meets the records; where it
    # is shuffled, a hot seed is split as a skewed key, and the next shuffle deals it out by path.
    met = records.join(seeds, "seed", "left").where("later or other is not null").repartition("seed", "path")
    marked = met.withColumn("later", F.col("later") | (F.rank().over(copies) > 1)).where("later or other")
    marked = write_once(marked.select("doc_id", "start", "n", "later"), "paths")
    opened = _listed(marked.where("not later"))
    edges = opened_edges(docs.join(opened, "doc_id").select("doc_id", "text", "spans"), window)
    edges = edges.withColumn("later", F.col("later") | (F.rank().over(copies) > 1))
    later = marked.where("later").select("doc_id", "start", "n")
    return _listed(later.unionByName(edges.where("later").select("doc_id", "start", "n")))


def _listed(spans: DataFrame) -> DataFrame:
    return spans.groupBy("doc_id").agg(F.collect_list(F.struct("start", "n")).alias("spans"))


def _kept_words(part: pa.RecordBatch, window: int) -> Iterator[tuple[list[bytes], np.ndarray]]:
    """Words of each row and which of them stay."""
    texts = part.column("text").fill_null("").to_pylist()
    row, start, n = span_arrays(part.column("spans"))
    bounds = np.searchsorted(row, np.arange(len(texts) + 1))
    for i, text in enumerate(texts):
        # bytes.split() cuts at the same six characters that bound a word.
        words = text.encode().split()
        edge = np.zeros(len(words) + 1, np.int64)
        a, b = bounds[i], bounds[i + 1]
        np.add.at(edge, start[a:b], 1)
        np.add.at(edge, start[a:b] + n[a:b] + window - 1, -1)
        yield words, np.cumsum(edge[:-1]) == 0


def _with_spans(docs: DataFrame, window: int, seed_words: int) -> DataFrame:
    """Documents with an id and the spans to remove from them, null where there are none."""
    return docs.join(repeated_spans(docs.select("doc_id", "text"), window, seed_words), "doc_id", "left")


def dedup_digest(
    df: DataFrame, window: int = WINDOW, seed_words: int = SEED_WORDS, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """One row per document: words, words removed, digest of the kept words joined by one space."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in slices(batch, size=SMALL_SLICE_BYTES):
            sizes, removed, digests = [], [], []
            for words, stays in _kept_words(part, window):
                kept = words if stays.all() else [w for w, s in zip(words, stays.tolist()) if s]
                sizes.append(len(words))
                removed.append(len(words) - len(kept))
                digests.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string())],
                ["doc_id", "n_words", "n_removed", "kept_sha256"],
            )

    docs = narrowed(df, id_column, text_column)
    known = _with_spans(docs.where("doc_id is not null"), window, seed_words)
    unknown = docs.where("doc_id is null").withColumn("spans", F.lit(None).cast(SPANS))
    rows = known.select("doc_id", "text", "spans").unionByName(unknown)
    return per_batch(rows, run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def without_repeats(
    df: DataFrame, window: int = WINDOW, seed_words: int = SEED_WORDS, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """All rows and columns; where words were removed the text is what is left of them, joined by one space."""
    docs = narrowed(df, id_column, text_column).where("doc_id is not null")
    # All columns travel in one, so none can clash with the names used here.
    rows = df.select(
        F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(f"`{id_column}`").cast("long").alias("doc_id")
    )
    joined = rows.join(repeated_spans(docs, window, seed_words), "doc_id", "left").select("row", "spans")
    columns = df.columns
    place = columns.index(text_column)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        whole = pa.RecordBatch.from_struct_array(batch.column("row")).append_column("\0spans", batch.column("spans"))
        for part in slices(whole, text_column, SMALL_SLICE_BYTES):
            texts = part.column(text_column).to_pylist()
            two = pa.RecordBatch.from_arrays([part.column(text_column), part.column("\0spans")], ["text", "spans"])
            for i, (words, stays) in enumerate(_kept_words(two, window)):
                if not stays.all():
                    texts[i] = b" ".join([w for w, s in zip(words, stays.tolist()) if s]).decode()
            yield part.set_column(place, text_column, pa.array(texts, pa.string())).select(columns)

    return per_batch(joined, run, df.schema)
