"""Embedding whitening with a covariance weighted by multiplicity.

Each vector becomes whole numbers x = floor(scale * c) + shift, and equal x vectors one class with its number of copies. The
classes are the fit list: each weighs its copies (`weights="copies"`, the covariance of all vectors) or one
(`weights="one"`, of the distinct ones). Sums of x are whole numbers and exact. The covariance is a weighted matrix product of the
centred vectors, added up inside each task, so dimension squared numbers leave a task. Its unit eigenvectors by falling
eigenvalue are the components (the driver holds one matrix of dimension squared). Each class is whitened once and joined back to
its vectors: the at most `HOT_CLASSES` classes that hold more than 1 / `HOT_CLASSES` of all vectors are broadcast, the others
meet their vectors in an equality join in which no key holds more than that share.

The identity error is measured, not derived: a second pass over the whitened classes takes their mean and their centred
covariance, and the largest distance of an entry from the identity is returned with every row.

Defined results: vectors that are null or hold a null, NaN or infinite entry take no part, nor do empty ones and those with an
entry of 2 ** 52 or more. A deviation that no long holds is null. Of vectors of
several lengths those of the commonest length take part (of equally common ones the longest). Repeated rows and null ids
stay, each with its rows. A component without variance (equal vectors, fewer vectors than dimensions) has whitened and explained
0 and is left out of the identity error. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gtdlens.llm.common import per_batch
from gtdlens.session import write_once

SCALE, SHIFT = 1024, 100_000
LARGEST = float(1 << 52)  # from here on floor(scale * c) is no longer a whole number that a double or a long holds
COMPONENTS = 8
HOT_CLASSES = 64
BLOCK = 4_096  # vectors of one matrix product


@dataclass(frozen=True)
class Fit:
    """n vectors with sums S; components as columns with their eigenvalues; trace of the covariance."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float

    @property
    def scales(self) -> np.ndarray:
        """One over the deviation of each component, 0 where there is no variance beyond rounding."""
        least = len(self.sums) * np.finfo(float).eps * max(self.trace, 0.0)
        varied = self.eigenvalues > least
        return np.where(varied, 1 / np.sqrt(np.where(varied, self.eigenvalues, 1.0)), 0.0)


def _vectors(column: pa.Array, kind: type) -> np.ndarray:
    """Equal long arrays without nulls as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False)
    return flat.reshape(len(column), -1)


def whole_numbers(df: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(vec_id, x) of the vectors that take part."""
    entries = F.col(f"`{vector_column}`").cast("array<double>")
    finite = F.forall(entries, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(LARGEST)))
    x = F.transform(entries, lambda c: F.floor(F.lit(float(SCALE)) * c) + F.lit(SHIFT).cast("long"))
    kept = df.select(F.col(f"`{id_column}`").cast("long").alias("vec_id"), F.when(finite & (F.size(entries) > 0), x).alias("x"))
    kept = kept.where("x is not null")
    # One row per length of vector.
    length = kept.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return kept.where(F.size("x") == (length["d"] if length else 0))


def classes(vectors: DataFrame) -> DataFrame:
    """(x, copies): equal vectors as one, counted before the shuffle."""
    return vectors.groupBy("x").agg(F.count("*").alias("copies"))


def _weight(weights: str) -> Column:
    if weights not in ("copies", "one"):
        raise ValueError(f"unknown weights: {weights}")
    return F.col("copies") if weights == "copies" else F.lit(1).cast("long")


def fit(distinct: DataFrame, weights: str = "copies", components: int = COMPONENTS) -> Fit | None:
    """Exact sums first, then the centred weighted products, divisor n; nothing where there is no vector."""
    weighted = distinct.select("x", _weight(weights).alias("w"))
    n = weighted.agg(F.sum("w")).first()[0]
    if not n:
        return None
    by_place = weighted.select("w", F.posexplode("x").alias("place", "v")).groupBy("place")
    # One row per dimension.
    sums = [int(r[1]) for r in by_place.agg(F.sum(F.col("w") * F.col("v").cast("decimal(38,0)"))).orderBy("place").collect()]
    n, d = int(n), len(sums)
    whole = np.array([s // n for s in sums], np.int64)
    rest = np.array([s % n / n for s in sums])

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d))
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                centred = (_vectors(part.column("x"), np.int64) - whole) - rest
                total += (centred * part.column("w").to_numpy()[:, None]).T @ centred
        if total.any():
            rows, columns = np.triu_indices(d)
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows.astype(np.int32)), pa.array(columns.astype(np.int32)), pa.array(total[rows, columns])], ["i", "j", "v"]
            )

    parts = weighted.mapInArrow(products, "i int, j int, v double")
    covariance = np.zeros((d, d))
    # d (d + 1) / 2 rows.
    for r in parts.groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        covariance[r["i"], r["j"]] = covariance[r["j"], r["i"]] = r["v"] / n
    values, axes = np.linalg.eigh(covariance)
    order = np.argsort(-values, kind="stable")[:components]
    return Fit(n, np.array(sums, object), axes[:, order], values[order], float(np.trace(covariance)))


def whitened_classes(distinct: DataFrame, found: Fit) -> DataFrame:
    """(x, copies, deviation, whitened): each class once."""
    n, sums = found.n, found.sums
    whole = np.array([s // n for s in sums], np.int64)
    left = np.array([s % n for s in sums], np.int64)
    rest = left / n
    projection = found.components * found.scales

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for at in range(0, batch.num_rows, BLOCK):
            part = batch.slice(at, BLOCK)
            x = _vectors(part.column("x"), np.int64) - whole
            z = (x - rest) @ projection
            # n x - S: in longs where their squares' sum surely fits, else in whole numbers of any size.
            fits = (float(np.abs(x).max(initial=0)) + 1) * n * np.sqrt(x.shape[1]) < 2**31
            exact = (x if fits else x.astype(object)) * n - left
            deviation = [v if v < 1 << 63 else None for v in map(int, (exact**2).sum(1))]
            columns = [
                part.column("x"),
                part.column("copies"),
                pa.array(deviation, pa.int64()),
                pa.FixedSizeListArray.from_arrays(pa.array(z.reshape(-1)), z.shape[1]).cast(pa.list_(pa.float64())),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["x", "copies", "deviation", "whitened"])

    return per_batch(distinct, run, "x array<long>, copies long, deviation long, whitened array<double>")


def identity_error(white: DataFrame, found: Fit, weights: str = "copies") -> float:
    """Largest distance of an entry of the whitened vectors' covariance from the identity, from the vectors themselves."""
    varied = [k for k, s in enumerate(found.scales) if s > 0]
    if not varied:
        return 0.0
    w, z = _weight(weights), [F.col("whitened")[k] for k in varied]
    means = white.agg(*[F.sum(w * c) / found.n for c in z]).first()
    centred = [c - F.lit(m) for c, m in zip(z, means)]
    pairs = [(a, b) for a in range(len(z)) for b in range(a, len(z))]
    entries = white.agg(*[F.sum(w * centred[a] * centred[b]) / found.n for a, b in pairs]).first()
    return max(abs(v - (a == b)) for v, (a, b) in zip(entries, pairs))


def whitened(
    df: DataFrame,
    components: int = COMPONENTS,
    weights: str = "copies",
    id_column: str = "vec_id",
    vector_column: str = "embedding",
) -> DataFrame:
    """One row per vector and component."""
    vectors = write_once(whole_numbers(df, id_column, vector_column), "whole-vectors")
    distinct = write_once(classes(vectors), "vector-classes")
    found = fit(distinct, weights, components)
    if found is None:
        return vectors.select(
            "vec_id", F.lit(0).alias("component"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("deviation"),
            F.lit(0.0).alias("whitened"), F.lit(0.0).alias("explained"), F.lit(0.0).alias("identity_error"),
        )
    white = write_once(whitened_classes(distinct, found), "white-classes")
    error = identity_error(white, found, weights)
    total = white.agg(F.sum("copies")).first()[0]
    hot = F.col("copies") * HOT_CLASSES > total
    answer = F.struct("deviation", "whitened").alias("answer")
    # Fewer than HOT_CLASSES rows by their definition; their vectors need no shuffle.
    quick = F.broadcast(white.where(hot).select("x", answer.alias("quick")))
    met = vectors.join(quick, "x", "left")
    slow = met.where("quick is null").drop("quick").join(white.where(~hot).select("x", answer), "x")
    joined = slow.select("vec_id", "answer").unionByName(met.where("quick is not null").select("vec_id", F.col("quick").alias("answer")))
    share = found.eigenvalues / found.trace if found.trace > 0 else np.zeros(len(found.eigenvalues))
    explained = F.array(*[F.lit(float(s) if k > 0 else 0.0) for s, k in zip(share, found.scales)])
    return joined.select("vec_id", F.col("answer.deviation").alias("deviation"), F.posexplode("answer.whitened").alias("at", "whitened")).select(
        "vec_id",
        (F.col("at") + 1).cast("int").alias("component"),
        F.lit(found.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(explained, F.col("at")).alias("explained"),
        F.lit(float(error)).alias("identity_error"),
    )
