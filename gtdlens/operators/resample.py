"""Minority over-sampling by interpolation between near minority rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gtdlens.functions.columns import uniform
from gtdlens.operators.neighbours import nearest_points
from gtdlens.operators.ranking import global_rank
from gtdlens.session import write_once


def balanced(
    train: DataFrame,
    key: Sequence[str],
    label: str = "label",
    features: str = "features",
    neighbours: int = 5,
    seed: int = 42,
) -> DataFrame:
    """Training rows plus synthetic minority rows, so that both classes end equal.

    Each synthetic row lies on the line between a minority row and one of its nearest
    minority neighbours, all features included: a 0/1 flag may become a fraction. Every
    minority row is drawn equally often, up to one; ``key`` names the columns that
    identify a row and so seed its draws. The originals are kept as they are. The result
    is a written table, ready for the many passes of a fit.
    """
    counts = {r[label]: r["count"] for r in train.groupBy(label).count().collect()}
    if len(counts) != 2:
        raise ValueError(f"two classes needed, found {sorted(counts)}")
    (minority, few), (_, many) = sorted(counts.items(), key=lambda c: (c[1], c[0]))
    original = train.select(features, label).withColumn("synthetic", F.lit(False))
    if few == many:
        return write_once(original, "balanced")
    if few <= neighbours:
        raise ValueError(f"{few} minority rows, more than {neighbours} needed")
    x = vector_to_array(features)
    rows = train.where(F.col(label) == minority).select(
        F.concat_ws(":", *[F.col(c).cast("string") for c in key]).alias("row_key"),
        F.md5(x.cast("string")).alias("point_key"),
        x.alias("x"),
    )
    ranked, _ = global_rank(rows, [uniform(F.lit(seed), "row_key")], "place")
    draws = _draws(ranked, few, many - few, neighbours, seed)
    synthetic = _interpolated(draws, _points(ranked), neighbours).select(
        array_to_vector("x").alias(features),
        F.lit(minority).cast(train.schema[label].dataType).alias(label),
        F.lit(True).alias("synthetic"),
    )
    return write_once(original.unionByName(synthetic), "balanced")


def _points(rows: DataFrame) -> DataFrame:
    """Equal rows become one point, so many copies of a row cost no more than one.

    The point's number comes from its values, so points at equal distances are taken in the same
    order however the rows are laid out.
    """
    distinct = rows.groupBy("point_key").agg(
        F.first("x").alias("x"), F.count("*").alias("copies")
    )
    return write_once(
        distinct.withColumn("point_id", F.xxhash64("point_key")), "points"
    )


def _draws(rows: DataFrame, few: int, missing: int, neighbours: int, seed: int) -> DataFrame:
    """One row per synthetic row: its start, which neighbour, and how far towards it.

    Every minority row gets the whole part of ``missing / few`` draws, and the remainder
    goes to the first rows of the shuffled order.
    """
    each, extra = divmod(missing, few)
    times = F.lit(each) + (F.col("place") < extra).cast("int")
    turn = F.explode(F.sequence(F.lit(1), times)).alias("turn")

    def chance(use: str) -> Column:
        return uniform(F.lit(seed), F.lit(use), "row_key", "turn")

    return (
        rows.where(times > 0)
        .select("row_key", "point_key", "x", turn)
        .select(
            "point_key",
            "x",
            F.floor(chance("neighbour") * neighbours).cast("int").alias("pick"),
            chance("step").alias("step"),
        )
    )


def _interpolated(draws: DataFrame, points: DataFrame, neighbours: int) -> DataFrame:
    """Resolve the neighbour of each draw and move towards it.

    The nearest neighbours of a row are its own further copies, then the other points,
    each as often as it has copies. A point with more copies than neighbours therefore
    meets only itself and needs no search.
    """
    lonely = points.where(F.col("copies") <= neighbours)
    asked = lonely.join(draws.select("point_key").distinct(), "point_key", "left_semi")
    near = nearest_points(points, asked, neighbours)
    known = near.join(points.select("point_id", "point_key", "copies"), "point_id").select(
        "point_key", "copies", "near"
    )
    ordinal = F.col("pick") - (F.col("copies") - 1)
    # Walk along the neighbours until their copies reach the wanted ordinal.
    start = F.struct(
        F.lit(0).cast("bigint").alias("seen"), F.lit(None).cast("bigint").alias("hit")
    )

    def step(state: Column, n: Column) -> Column:
        seen = state["seen"] + n["copies"]
        hit = F.coalesce(state["hit"], F.when(seen > ordinal, n["point_id"]))
        return F.struct(seen.alias("seen"), hit.alias("hit"))

    other = F.when(ordinal >= 0, F.aggregate("near", start, step)["hit"])
    chosen = draws.join(known, "point_key", "left").select("x", "step", other.alias("point_id"))
    goal = points.select("point_id", F.col("x").alias("goal"))
    towards = F.coalesce("goal", "x")
    moved = F.zip_with("x", towards, lambda a, b: a + F.col("step") * (b - a))
    return chosen.join(goal, "point_id", "left").select(moved.alias("x"))
