"""Exact nearest neighbours of a large table of points.

Space is cut into cells and each cell remembers the box around its points. A point
looks in its own cell first; the distance found there rules out every cell whose box
lies farther away, and only the remaining cells are searched. Cells are worked through
in blocks of bounded size: a product of matrices rules most pairs out, and the others
are measured exactly. A task hands on the few nearest points only, never all
pairs.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from gtdlens.session import write_once

# The tasks below carry their code with them, so executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Large cells and blocks: a point travels once for every block it meets, and a block of 64 dimensions is 8 MB.
CELL_POINTS = 16_384
# The boxes that go to every executor: two numbers per cell and dimension, 64 MB at most. Beyond
# that the cells hold more points, which are still searched block by block.
MAX_BOX_NUMBERS = 8_000_000
BLOCK_POINTS = 16_384
# Columns of which the least is taken together when a block is searched.
RUN = 64
SAMPLE_PER_CELL = 8

NEAR = "array<struct<distance:double,point_id:bigint,copies:bigint>>"


@dataclass(frozen=True)
class Cells:
    """Binary splits of space: node i goes left where x[dimension] <= threshold."""

    dimension: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    cell: np.ndarray

    def of(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), dtype=np.int64)
        rows = np.arange(len(x))
        while True:
            inner = self.cell[node] < 0
            if not inner.any():
                return self.cell[node]
            at, row = node[inner], rows[inner]
            goes_left = x[row, self.dimension[at]] <= self.threshold[at]
            node[inner] = np.where(goes_left, self.left[at], self.right[at])


def split_cells(sample: np.ndarray, cells: int) -> Cells:
    """Split the sample at the middle of its widest dimension until there are enough cells."""
    dimension, threshold, left, right, cell = [], [], [], [], []
    count = 0

    def add(points: np.ndarray, wanted: int) -> int:
        nonlocal count
        me = len(cell)
        for column in (dimension, left, right, cell):
            column.append(-1)
        threshold.append(0.0)
        spread = np.ptp(points, axis=0) if len(points) else np.zeros(1)
        widest = int(spread.argmax())
        if wanted <= 1 or spread[widest] == 0:
            cell[me] = count
            count += 1
            return me
        values = points[:, widest]
        # A cut below the maximum leaves points on both sides.
        cut = min(float(np.median(values)), float(values[values < values.max()].max()))
        low = values <= cut
        dimension[me], threshold[me] = widest, cut
        left[me] = add(points[low], wanted // 2)
        right[me] = add(points[~low], wanted - wanted // 2)
        return me

    add(sample, cells)
    ints = [np.array(c, dtype=np.int64) for c in (dimension, left, right, cell)]
    return Cells(ints[0], np.array(threshold), ints[1], ints[2], ints[3])


def nearest_in_block(
    queries: np.ndarray, query_ids: np.ndarray, points: np.ndarray, point_ids: np.ndarray, k: int
) -> tuple[np.ndarray, np.ndarray]:
    """Per query: the distances and positions of its k nearest points, itself left out.

    Equal distances are ordered by point id. Where there are fewer than k the distance is infinite.
    """
    by_id = np.argsort(point_ids, kind="stable")
    points, ids = points[by_id], point_ids[by_id]
    width = min(k, len(points))
    gaps_found = np.full((len(queries), width), np.inf)
    places = np.zeros((len(queries), width), dtype=np.int64)
    if not width:
        return gaps_found, places
    # Squares by a product of matrices, about the points' middle, are near the true ones; they only rule points out.
    known = np.isfinite(points).all(axis=1)
    middle = points[known].mean(axis=0) if known.any() else 0.0
    with np.errstate(over="ignore", invalid="ignore"):
        moved = points - middle
        lengths = (moved**2).sum(axis=1)
        moved = np.where(known[:, None], moved, 0.0)
        longest = lengths[known].max(initial=0.0)
    step = max(1, 4_000_000 // max(len(points), 1))
    for start in range(0, len(queries), step):
        part = queries[start : start + step]
        with np.errstate(over="ignore", invalid="ignore"):
            shifted = part - middle
            own = (shifted**2).sum(axis=1)
            squares = shifted @ moved.T
            squares *= -2
            squares += lengths
            squares += own[:, None]
            slack = 16 * (points.shape[1] + 4) * np.finfo(float).eps * (own + longest)
        # Lengths that overflow rule nothing out.
        squares[~np.isfinite(own + longest)] = 0.0
        squares[:, ~known] = np.inf
        first, last = (np.searchsorted(ids, query_ids[start : start + step], side) for side in ("left", "right"))
        for row in np.nonzero(last > first)[0]:
            squares[row, first[row] : last[row]] = np.inf
        near = squares <= (_kth_least(squares, width) + 2 * np.nan_to_num(slack, posinf=0.0))[:, None]
        near &= np.isfinite(squares)
        _nearest_of(part, points, near, gaps_found[start : start + step], places[start : start + step])
    return gaps_found, by_id[places]


def _kth_least(squares: np.ndarray, k: int) -> np.ndarray:
    """Of each row a bound that k entries at least do not exceed: the k-th of the least entries of its runs."""
    n, columns = squares.shape
    runs = columns // RUN
    if runs < 4 * k:
        return np.partition(squares, k - 1, axis=1)[:, k - 1]
    least = squares[:, : runs * RUN].reshape(n, RUN, runs).min(axis=1)
    return np.partition(least, k - 1, axis=1)[:, k - 1]


def _nearest_of(
    queries: np.ndarray, points: np.ndarray, near: np.ndarray, gaps_found: np.ndarray, places: np.ndarray
) -> None:
    """The nearest of each row's marked points by their exact distances, which are measured in bounded parts."""
    width, upto = gaps_found.shape[1], np.cumsum(near.sum(axis=1))
    start = 0
    while start < len(queries):
        done = upto[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(upto, done + 2_000_000 // points.shape[1], "right")))
        row, at = np.nonzero(near[start:end])
        with np.errstate(over="ignore", invalid="ignore"):
            gaps = np.sqrt(((queries[start + row] - points[at]) ** 2).sum(axis=1))
        # The points stand in the order of their ids, which decides among equals.
        order = np.lexsort((at, gaps, row))
        row, at, gaps = row[order], at[order], gaps[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        kept = rank < width
        gaps_found[start + row[kept], rank[kept]] = gaps[kept]
        places[start + row[kept], rank[kept]] = at[kept]
        start = end


def _matrix(lists: pa.ChunkedArray) -> np.ndarray:
    flat = lists.combine_chunks()
    return np.asarray(flat.flatten()).reshape(len(flat), -1)


def _search(queries: DataFrame, points: DataFrame, k: int) -> DataFrame:
    """k nearest points of each (query, cell), block against block."""

    def block(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["distance", "point_id", "copies"]
        if not left.num_rows or not right.num_rows:
            struct = pa.struct(list(zip(names, [pa.float64(), pa.int64(), pa.int64()])))
            return pa.table({"point_id": pa.array([], pa.int64()), "near": pa.array([], pa.list_(struct))})
        ids, copies = (right[c].to_numpy() for c in ("point_id", "copies"))
        asked = left["query_id"].to_numpy()
        gaps, at = nearest_in_block(_matrix(left["query_x"]), asked, _matrix(right["x"]), ids, k)
        there = np.isfinite(gaps)
        entries = pa.StructArray.from_arrays(
            [pa.array(gaps[there]), pa.array(ids[at[there]]), pa.array(copies[at[there]])], names=names
        )
        bounds = pa.array(np.concatenate([[0], np.cumsum(there.sum(axis=1))]), pa.int32())
        return pa.table({"point_id": asked, "near": pa.ListArray.from_arrays(bounds, entries)})

    sizes = points.groupBy("cell").agg(F.count("*").alias("__points"))
    asked = queries.groupBy("cell").agg(F.count("*").alias("__queries"))
    # At most one row per cell.
    blocks = F.broadcast(
        sizes.join(asked, "cell").select(
            "cell",
            F.ceil(F.col("__points") / BLOCK_POINTS).cast("int").alias("__pblocks"),
            F.ceil(F.col("__queries") / BLOCK_POINTS).cast("int").alias("__qblocks"),
        )
    )

    def spread(rows: DataFrame, own: str, other: str) -> DataFrame:
        """Give each row one block of its own kind and a copy for each block it meets."""
        return rows.join(blocks, "cell").select(
            *rows.columns,
            F.pmod(F.xxhash64(rows.columns[0]), F.col(own)).cast("int").alias(f"{own}_at"),
            F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(f"{other}_at"),
        )

    keys = ["cell", "__pblocks_at", "__qblocks_at"]
    asking = queries.select(
        F.col("point_id").alias("query_id"), F.col("x").alias("query_x"), F.col("cell").alias("cell")
    )
    left = spread(asking, "__qblocks", "__pblocks")
    right = spread(points.select("point_id", "x", "copies", "cell"), "__pblocks", "__qblocks")
    return (
        left.groupBy(*keys)
        .cogroup(right.groupBy(*keys))
        .applyInArrow(block, f"point_id bigint, near {NEAR}")
    )


def _boxes(placed: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Exact bounds of the points of each cell: cell numbers, lower and upper corners."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bounds: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for cell, group in batch.groupby("cell")["x"]:
                x = np.stack(group)
                lower, upper = bounds.get(cell, (x[0], x[0]))
                bounds[cell] = np.minimum(lower, x.min(axis=0)), np.maximum(upper, x.max(axis=0))
        rows = [(c, d, lo[d], hi[d]) for c, (lo, hi) in bounds.items() for d in range(len(lo))]
        yield pd.DataFrame(rows, columns=["cell", "dimension", "low", "high"])

    corners = (
        placed.select("cell", "x")
        .mapInPandas(partial, "cell int, dimension int, low double, high double")
        .groupBy("cell", "dimension")
        .agg(F.min("low").alias("low"), F.max("high").alias("high"))
        .toPandas()
        .sort_values(["cell", "dimension"])
    )
    cells = corners["cell"].unique()
    shape = (len(cells), -1)
    return cells, corners["low"].to_numpy().reshape(shape), corners["high"].to_numpy().reshape(shape)


def _merged(parts: DataFrame, k: int) -> DataFrame:
    """The k nearest over all searched cells; each part brings k rows at most."""
    every = F.array_sort(F.flatten(F.collect_list("near")))
    return parts.groupBy("point_id").agg(F.slice(every, 1, k).alias("near"))


def nearest_points(
    points: DataFrame, queries: DataFrame, k: int, cell_points: int = CELL_POINTS
) -> DataFrame:
    """For each query point, its k nearest other points as (distance, point_id, copies).

    ``points`` is a written table (point_id, x: array<double>, copies) of distinct
    points, and ``queries`` holds the point_id of those to look up.
    """
    spark = points.sparkSession
    total = points.count()
    width = len(points.select("x").first()["x"])
    cells = int(max(1, min(MAX_BOX_NUMBERS // (2 * width), -(-total // cell_points))))
    wanted = cells * SAMPLE_PER_CELL
    # The sample only shapes the cells; every point is searched whatever it holds. A hash draws it,
    # so neither the order of the rows nor their layout matters.
    chance = F.pmod(F.xxhash64("point_id"), F.lit(1 << 30)) < F.lit(
        int(min(1.0, 2 * wanted / max(total, 1)) * (1 << 30))
    )
    drawn = points.where(chance).orderBy(F.xxhash64("point_id"), "point_id").limit(wanted)
    sample = drawn.select("x").toPandas()["x"]
    tree = split_cells(np.array(list(sample), dtype=float).reshape(-1, width), cells)

    @pandas_udf("int")
    def cell_of(x: pd.Series) -> pd.Series:
        return pd.Series(tree.of(np.stack(x)).astype("int32")) if len(x) else pd.Series([], dtype="int32")

    placed = write_once(points.select("point_id", "x", "copies", cell_of("x").alias("cell")), "placed")
    asked = placed.join(queries.select("point_id"), "point_id", "left_semi")
    if cells == 1:
        return _merged(_search(asked, placed, k), k)
    shared = spark.sparkContext.broadcast(_boxes(placed))
    home = write_once(_search(asked, placed, k), "near")
    first = _merged(home, k)
    reach = F.when(F.size("near") >= k, F.element_at("near", -1)["distance"])
    bounded = asked.join(first.select("point_id", reach.alias("reach")), "point_id", "left")

    @pandas_udf("array<int>")
    def other_cells(x: pd.Series, own: pd.Series, reach: pd.Series) -> pd.Series:
        cell, lower, upper = shared.value
        step, found = max(1, 4_000_000 // lower.size), []
        for start in range(0, len(x), step):
            here = slice(start, start + step)
            at = np.stack(x.iloc[here])[:, None, :]
            outside = np.maximum(np.maximum(lower - at, at - upper), 0)
            gap = np.sqrt((outside**2).sum(axis=2))
            far = reach.iloc[here].fillna(np.inf).to_numpy(dtype=float) * (1 + 1e-12)
            visited = (gap <= far[:, None]) & (cell[None, :] != own.iloc[here].to_numpy()[:, None])
            found += [cell[row].astype("int32") for row in visited]
        return pd.Series(found, dtype=object)

    # Only the cells' numbers come back from Python.
    visits = bounded.withColumn("cell", F.explode(other_cells("x", "cell", "reach"))).select("point_id", "x", "cell")
    away = _search(visits, placed, k)
    return _merged(home.unionByName(away), k)
