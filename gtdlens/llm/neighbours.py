"""Approximate nearest neighbours by multiprobe p-stable hashing.

The measure is the inner product. Vectors are scaled by the largest norm and get one more component that makes all norms
equal, so that the largest inner product is the smallest Euclidean distance. A table hashes a point by several
projections on normally distributed (2-stable) directions, cut into cells of a fixed width. A query visits, in each table,
its own bucket and perturbed ones in the order of their estimated chance of holding neighbours: the sum of squared
distances from the query to the walls that are crossed. The candidates of all tables merge, and their inner products are
computed again in double precision on the original vectors.

Equal vectors are one point in the index and come back as their members. Buckets are dealt to cells of rows, and a cell
with many rows or queries is cut into blocks, so no task holds an unbounded group; a task passes on only the best
few of each query. Queries that found too few candidates are compared with all points, in the same blocks.

Defined results: vectors that are null, zero, of another length than most, or hold null or non-finite components
take no part, nor do rows without an id; an id that repeats counts once per different vector; with fewer
candidates than asked for, all are returned.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gtdlens.llm.common import per_batch
from gtdlens.llm.text_arrays import mixed, signed
from gtdlens.session import write_once


@dataclass(frozen=True)
class Index:
    """Settings of the hash tables. More probes or wider cells find more and cost more."""

    tables: int = 4
    projections: int = 5
    width: float = 1.75
    probes: int = 80
    seed: int = 11
    cell_rows: int = 4_096
    block_queries: int = 4_096

    def directions(self, dimension: int) -> tuple[np.ndarray, np.ndarray]:
        rng = np.random.default_rng(self.seed)
        lines = rng.normal(size=(dimension, self.tables * self.projections))
        return lines, rng.uniform(0, self.width, self.tables * self.projections)

    def places(self, points: np.ndarray) -> np.ndarray:
        """Point, table, projection: the place on each projection, in widths."""
        lines, shifts = self.directions(points.shape[1])
        return ((points @ lines + shifts) / self.width).reshape(len(points), self.tables, self.projections)

    def perturbations(self) -> np.ndarray:
        return np.array(list(product((0, -1, 1), repeat=self.projections)))

    def probe_cells(self, places: np.ndarray) -> np.ndarray:
        """Point, table, probe, projection: the cells to visit, the likeliest first."""
        base = np.floor(places)
        inside = places - base
        moves = self.perturbations()
        cost = np.zeros((*places.shape[:2], len(moves)))
        for j in range(self.projections):
            # Of a move by 0, 1 or -1 (which is 2 modulo 3).
            walls = np.stack([np.zeros_like(inside[..., j]), 1 - inside[..., j], inside[..., j]], axis=-1)
            cost += (walls**2)[..., moves[:, j] % 3]
        order = np.argsort(cost, axis=2, kind="stable")[:, :, : self.probes]
        return base[:, :, None, :] + moves[order]

    def names(self, cells: np.ndarray, table: np.ndarray) -> np.ndarray:
        """One number for a bucket: its table and cells."""
        name = mixed(table.astype(np.uint64) + np.uint64(1))
        for j in range(self.projections):
            name = mixed(name + cells[..., j].astype(np.int64).view(np.uint64))
        return name


VECTOR = "array<double>"


def usable_vectors(df: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """(vec_id, vector) of the rows that take part."""
    vector = F.col(f"`{vector_column}`").cast(VECTOR)
    rows = df.select(F.col(f"`{id_column}`").cast("long").alias("vec_id"), vector.alias("vector"))
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where("vec_id is not null and vector is not null").where(~bad)
    rows = rows.where(F.exists("vector", lambda x: x != 0))
    sizes = rows.groupBy(F.size("vector").alias("size")).count().orderBy(F.desc("count"), "size").limit(1).collect()
    return rows.where(F.size("vector") == (sizes[0]["size"] if sizes else 0))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(flat.flatten()).reshape(len(flat), -1)


def _lists(values: pa.Array, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), values)


def _vectors(table: np.ndarray) -> pa.ListArray:
    return _lists(pa.array(table.ravel()), np.full(len(table), table.shape[1]))


def nearest(
    df: DataFrame, every: int = 20, k: int = 20, index: Index = Index(), id_column="vec_id", vector_column="embedding"
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found for each row whose id is divisible by `every`."""
    rows = write_once(usable_vectors(df, id_column, vector_column), "vectors")
    points = write_once(rows.groupBy("vector").agg(F.min("vec_id").alias("point")), "points")
    # A point's members: only the k + 1 smallest ids of it can be among the k nearest of a query.
    place = F.row_number().over(Window.partitionBy("vector").orderBy("vec_id"))
    listed = rows.distinct().withColumn("place", place).where(F.col("place") <= k + 1)
    members = write_once(listed.join(points, "vector").select("point", "vec_id"), "members")
    queries = write_once(
        rows.where(F.col("vec_id") % every == 0).distinct().withColumnsRenamed({"vec_id": "query_id", "vector": "query"}),
        "queries",
    )
    stats = points.agg(
        F.count("*").alias("n"), F.max(F.aggregate("vector", F.lit(0.0), lambda t, x: t + x * x)).alias("square")
    ).first()
    if not stats["n"]:
        return rows.select(
            F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.lit(0.0).alias("score")
        )
    found = write_once(_candidates(points, queries, k, index, stats["n"], float(stats["square"])), "candidates")
    best = write_once(_reranked(found, points, members, queries, k), "nearest")
    # Queries with fewer than k although there are more: compared with all points.
    total = rows.select("vec_id").distinct().count()
    counts = queries.select("query_id").join(best.groupBy("query_id").count(), "query_id", "left")
    short = counts.where(F.coalesce("count", F.lit(0)) < min(k, total - 1)).select("query_id")
    if short.limit(1).count():
        few = queries.join(short, "query_id")
        rest = _reranked(_compared_with_all(points, few, k, index, stats["n"]), points, members, few, k)
        best = best.join(short, "query_id", "left_anti").unionByName(rest)
    return best


def _reranked(found: DataFrame, points: DataFrame, members: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The k nearest members of the candidate points, by the inner product of the original vectors."""
    product_of = F.aggregate(F.zip_with("query", "vector", lambda a, b: a * b), F.lit(0.0), lambda t, x: t + x)
    scored = (
        found.join(points, "point").join(queries, "query_id").select("query_id", "point", product_of.alias("score"))
    )
    of_query = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        scored.join(members, "point")
        .where("vec_id <> query_id")
        .dropDuplicates(["query_id", "vec_id"])
        .withColumn("rank", F.row_number().over(of_query))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def _candidates(points, queries, k: int, index: Index, n: int, square: float) -> DataFrame:
    """(query_id, point): for each query the best few points of all buckets it visits."""
    groups = -(-n // index.cell_rows)

    def unit(vectors: np.ndarray, query: bool) -> np.ndarray:
        scale = np.sqrt(np.einsum("ij,ij->i", vectors, vectors)) if query else np.full(len(vectors), np.sqrt(square))
        scaled = vectors / scale[:, None]
        rest = np.sqrt(np.maximum(0.0, 1 - np.einsum("ij,ij->i", scaled, scaled)))
        return np.concatenate([scaled, (np.zeros(len(rest)) if query else rest)[:, None]], axis=1)

    def filed(batch: pa.RecordBatch):
        vectors = _matrix(batch.column("vector"))
        cells = np.floor(index.places(unit(vectors, query=False)))
        tables = np.broadcast_to(np.arange(index.tables), cells.shape[:2])
        names = index.names(cells, tables)
        copies = np.repeat(np.arange(len(vectors)), index.tables)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(tables.ravel().astype(np.int32)),
                pa.array((names.ravel() % np.uint64(groups)).astype(np.int32)),
                pa.array(signed(names.ravel())),
                batch.column("point").take(pa.array(copies)),
                _vectors(vectors[copies]),
            ],
            ["table", "group", "bucket", "point", "vector"],
        )

    def probing(batch: pa.RecordBatch):
        vectors = _matrix(batch.column("query"))
        cells = index.probe_cells(index.places(unit(vectors, query=True)))
        tables = np.broadcast_to(np.arange(index.tables)[None, :, None], cells.shape[:3])
        names = index.names(cells, tables)
        # One row for each group of buckets that a query visits in a table.
        query = np.broadcast_to(np.arange(len(vectors))[:, None, None], names.shape).ravel()
        table, name = tables.ravel(), names.ravel()
        group = (name % np.uint64(groups)).astype(np.int64)
        order = np.lexsort((group, table, query))
        query, table, group, name = query[order], table[order], group[order], name[order]
        begins = np.flatnonzero(
            np.concatenate([[True], (query[1:] != query[:-1]) | (table[1:] != table[:-1]) | (group[1:] != group[:-1])])
        )
        sizes = np.diff(np.concatenate([begins, [len(query)]]))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(table[begins].astype(np.int32)),
                pa.array(group[begins].astype(np.int32)),
                _lists(pa.array(signed(name)), sizes),
                batch.column("query_id").take(pa.array(query[begins])),
                _vectors(vectors[query[begins]]),
            ],
            ["table", "group", "buckets", "query_id", "query"],
        )

    rows = per_batch(points, filed, f"table int, group int, bucket long, point long, vector {VECTOR}")
    probes = per_batch(queries, probing, f"table int, group int, buckets array<long>, query_id long, query {VECTOR}")
    return _merged(_best_in_cells(rows, probes, ["table", "group"], k, index), k)


def _compared_with_all(points: DataFrame, queries: DataFrame, k: int, index: Index, n: int) -> DataFrame:
    """(query_id, point): the best few of all points, for the queries whose buckets held too little."""
    groups = -(-n // index.cell_rows)
    rows = points.select(
        F.pmod(F.xxhash64("point"), F.lit(groups)).cast("int").alias("group"), F.lit(0).cast("long").alias("bucket"), "point", "vector"
    )
    everywhere = queries.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).withColumn(
        "buckets", F.array(F.lit(0).cast("long"))
    )
    return _merged(_best_in_cells(rows, everywhere, ["group"], k, index), k)


def _best_in_cells(rows: DataFrame, probes: DataFrame, cell: list[str], k: int, index: Index) -> DataFrame:
    """(query_id, found): the best few points of each query in each block of each cell it visits.

    A cell's rows and queries are cut into blocks by their numbers, so a hot bucket is shared by many tasks.
    """
    row_blocks = F.ceil(F.count("*") / index.cell_rows / 2).cast("int").alias("row_blocks")
    query_blocks = F.ceil(F.count("*") / index.block_queries).cast("int").alias("query_blocks")
    blocks = rows.groupBy(*cell).agg(row_blocks).join(probes.groupBy(*cell).agg(query_blocks), cell)
    dealt_rows = (
        rows.join(blocks, cell)
        .withColumn("row_block", F.pmod(F.xxhash64("point"), F.col("row_blocks").cast("long")))
        .withColumn("query_block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("query_blocks").cast("long") - 1)))
        .drop("row_blocks", "query_blocks")
    )
    dealt_probes = (
        probes.join(blocks, cell)
        .withColumn("query_block", F.pmod(F.xxhash64("query_id"), F.col("query_blocks").cast("long")))
        .withColumn("row_block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("row_blocks").cast("long") - 1)))
        .drop("row_blocks", "query_blocks")
    )
    keys = [*cell, "row_block", "query_block"]

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        empty = pa.table({"query_id": pa.array([], pa.int64()), "found": pa.array([], pa.list_(FOUND))})
        if not left.num_rows or not right.num_rows:
            return empty
        vectors, points = _matrix(left["vector"]), np.asarray(left["point"])
        buckets = np.asarray(left["bucket"])
        order = np.argsort(buckets, kind="stable")
        vectors, points, buckets = vectors[order], points[order], buckets[order]
        known, first = np.unique(buckets, return_index=True)
        last = np.concatenate([first[1:], [len(buckets)]])
        keep, parts = k + 4, []
        for part in (right.slice(at, 256) for at in range(0, right.num_rows, 256)):
            part = part.combine_chunks()
            lists = part["buckets"].combine_chunks()
            owner = np.repeat(np.arange(len(lists)), np.asarray(lists.value_lengths()))
            wanted = np.asarray(lists.flatten())
            at = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
            hit = known[at] == wanted
            owner, at = owner[hit], at[hit]
            score = np.full((len(lists), len(points)), -np.inf)
            query = _matrix(part["query"])
            by_bucket = np.argsort(at, kind="stable")
            owner, at = owner[by_bucket], at[by_bucket]
            for b, low, high in zip(*_groups(at)):
                asked = owner[low:high]
                score[asked, first[b] : last[b]] = query[asked] @ vectors[first[b] : last[b]].T
            few = min(keep, len(points))
            top = np.argpartition(-score, few - 1, axis=1)[:, :few]
            value = np.take_along_axis(score, top, axis=1)
            real = np.isfinite(value)
            entries = pa.StructArray.from_arrays(
                [pa.array(-value[real]), pa.array(points[top[real]])], fields=list(FOUND)
            )
            parts.append(pa.table({"query_id": part["query_id"], "found": _lists(entries, real.sum(axis=1))}))
        return pa.concat_tables(parts)

    schema = "query_id long, found array<struct<less: double, point: long>>"
    return dealt_rows.groupBy(*keys).cogroup(dealt_probes.groupBy(*keys)).applyInArrow(compare, schema)


FOUND = pa.struct([pa.field("less", pa.float64()), pa.field("point", pa.int64())])


def _groups(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Value, first and end of each run of equal values."""
    if not len(values):
        return values, values, values
    first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    return values[first], first, np.concatenate([first[1:], [len(values)]])


def _merged(found: DataFrame, k: int) -> DataFrame:
    """The best few different points of each query over all cells: at most a few entries per visited block are gathered."""
    one = F.transform("entries", lambda e: e["point"])
    best = F.slice(F.array_distinct(one), 1, 2 * k)
    gathered = found.groupBy("query_id").agg(F.array_sort(F.flatten(F.collect_list("found"))).alias("entries"))
    return gathered.select("query_id", F.explode(best).alias("point"))
