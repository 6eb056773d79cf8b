"""Packing into optimal length buckets.

Documents are cut into pieces of at most `max_tokens` words (every word stays). The lengths of all pieces make one global
histogram, at most `max_tokens + 1` rows, and dynamic programming over it chooses the bucket boundaries that minimise padding:
a piece is padded to the boundary of its bucket. Inside each bucket batches are filled with pieces up to a token budget,
by id; the numbering is a distributed sort, so a bucket that holds a third of all pieces is shared by many tasks.

Defined results: a null or empty text is one piece of no words in the first bucket; a null id keeps its rows and
sorts first; repeated rows get pieces of their own; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gtdlens.llm.common import narrowed, per_batch
from gtdlens.llm.text_arrays import Words, slices
from gtdlens.operators.ranking import global_rank
from gtdlens.session import write_once

MAX_TOKENS = 2_048
BUCKETS = 8
BATCH_TOKENS = 16_384


def lengths(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Words of each document."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in slices(batch):
            counts = Words(part.column("text")).counts
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(counts, pa.int64())], ["doc_id", "n_words"])

    return per_batch(narrowed(df, id_column, text_column), run, "doc_id long, n_words long")


def pieces(counted: DataFrame, max_tokens: int) -> DataFrame:
    """One row per piece: its number in the document, first word and length."""
    most = F.greatest(F.col("n_words") - 1, F.lit(0))
    return (
        counted.withColumn("piece", F.explode(F.sequence(F.lit(0), F.floor(most / max_tokens).cast("int"))))
        .withColumn("first_word", F.col("piece").cast("long") * max_tokens)
        .withColumn("n_tokens", F.least(F.col("n_words") - F.col("first_word"), F.lit(max_tokens)).cast("int"))
    )


def best_boundaries(histogram: dict[int, int], buckets: int) -> list[int]:
    """Upper bounds of the buckets with the least padding; of equal choices the one with the smaller bounds.

    The least cost of covering the shortest lengths with k buckets is, over the lengths the last of them takes, the
    cost of the rest with k - 1 buckets plus the padding in the last.
    """
    sizes = np.array(sorted(histogram), np.int64)
    n = len(sizes)
    if not n:
        return []
    count = np.array([histogram[int(s)] for s in sizes], np.int64)
    counts = np.concatenate([[0], np.cumsum(count)])
    totals = np.concatenate([[0], np.cumsum(count * sizes)])
    # padding[i, j]: lengths i..j of the list together in one bucket, whose bound is length j.
    padding = (sizes * (counts[None, 1:] - counts[:-1, None]) - (totals[None, 1:] - totals[:-1, None])).astype(float)
    padding[np.tril_indices(n, -1)] = np.inf
    cost, first = padding[0], []
    for _ in range(1, min(buckets, n)):
        table = np.concatenate([[np.inf], cost[:-1]])[:, None] + padding
        first.append(table.argmin(axis=0))
        cost = table.min(axis=0)
    bounds, end = [int(sizes[-1])], n - 1
    for choice in reversed(first):
        end = int(choice[end]) - 1
        bounds.append(int(sizes[end]))
    return bounds[::-1]


def packed(
    df: DataFrame,
    buckets: int = BUCKETS,
    max_tokens: int = MAX_TOKENS,
    batch_tokens: int = BATCH_TOKENS,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """One row per piece: its bucket, the bucket's padded length, its batch in the bucket and place in the batch."""
    spark = df.sparkSession
    cut = write_once(pieces(lengths(df, id_column, text_column), max_tokens).drop("n_words"), "pieces")
    histogram = {r["n_tokens"]: r["count"] for r in cut.groupBy("n_tokens").count().collect()}
    bounds = best_boundaries(histogram, buckets)
    if not bounds:
        bounds = [max_tokens]
    inside = [sum(c for n, c in histogram.items() if low < n <= high) for low, high in zip([-1, *bounds], bounds)]
    table = [
        (b, high, max(1, batch_tokens // max(1, high)), sum(inside[:b])) for b, high in enumerate(bounds)
    ]
    # One row per bucket.
    described = F.broadcast(spark.createDataFrame(table, "bucket int, bucket_tokens int, batch_rows int, first long"))
    bucket = F.lit(0)
    for bound in bounds[:-1]:
        bucket = bucket + (F.col("n_tokens") > bound).cast("int")
    ranked, _ = global_rank(cut.withColumn("bucket", bucket), ["bucket", "doc_id", "piece"], "place")
    within = F.col("place") - F.col("first")
    return ranked.join(described, "bucket").select(
        "doc_id",
        "piece",
        "first_word",
        "n_tokens",
        "bucket",
        "bucket_tokens",
        F.floor(within / F.col("batch_rows")).alias("batch"),
        (within % F.col("batch_rows")).cast("int").alias("slot"),
    )
