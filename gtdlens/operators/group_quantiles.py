"""Exact quantiles of many groups at once: one rank search whose passes all groups share."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gtdlens.operators.quantiles import GATHER_LIMIT, SKETCH_ACCURACY, as_number
from gtdlens.session import write_once

# A sketch proposes the values at these many equal steps; a pass leaves a few steps around each rank.
STEPS = 1000
X = "__x"


def grouped_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: Column | str,
    probabilities: Sequence[float],
    output: str = "quantiles",
    gather_limit: int = GATHER_LIMIT,
) -> DataFrame:
    """One row per group: its keys and an array with one quantile per probability.

    Quantiles are exact, with linear interpolation; missing values are ignored, and a group
    without any gets an array of nulls. A null key is a group of its own.

    Groups of up to ``gather_limit`` values take Spark's exact ``percentile``, in one
    aggregation. Longer ones are searched by rank, all together: a sketch of each group
    proposes two values around each rank, a count tells on which side of them the rank lies, until few enough values are
    left to sort. The state of the search is a written table of one row per long group and rank. The number of
    passes depends on the longest group, not on how many there are, and no pass
    shuffles the values where the state is small enough to be broadcast.
    """
    # A constant stands in where there are no keys: one group of all rows.
    names = [f"__key{i}" for i in range(len(keys) or 1)]
    given = [F.col(f"`{k}`") for k in keys] or [F.lit(0)]
    values = df.select(*[g.alias(n) for g, n in zip(given, names)], as_number(value).alias(X))
    sizes = write_once(values.groupBy(*names).agg(F.count(X).alias("__n")), "sizes")
    long = sizes.where(F.col("__n") > gather_limit)
    wanted = F.array(*[F.lit(float(p)) for p in probabilities])
    nothing = F.array(*[F.lit(None).cast("double") for _ in probabilities])
    any_long = not long.isEmpty()
    short = values.join(long, _same(values, long, names), "left_anti") if any_long else values
    found = short.groupBy(*names).agg(F.coalesce(F.percentile(X, wanted), nothing).alias(output))
    if any_long:
        found = found.unionByName(_searched(values, long, names, probabilities, output, gather_limit))
    return found.select(*[F.col(n).alias(k) for n, k in zip(names, keys)], output)


def _same(left: DataFrame, right: DataFrame, names: Sequence[str]) -> Column:
    return reduce(and_, [left[n].eqNullSafe(right[n]) for n in names])


def _place(p: float) -> Column:
    return F.lit(float(p)) * (F.col("__n") - 1)


def _searched(
    values: DataFrame, long: DataFrame, names: list[str], probabilities: Sequence[float], output: str, limit: int
) -> DataFrame:
    ranks = F.array(*[f(_place(p)).cast("long") for p in probabilities for f in (F.floor, F.ceil)])
    unknown = F.lit(None).cast("double")
    searches = long.select(
        *names,
        F.explode(F.array_distinct(ranks)).alias("__rank"),
        F.lit(0).cast("long").alias("__below"),
        F.col("__n").alias("__inside"),
        unknown.alias("__low"),
        unknown.alias("__high"),
        unknown.alias("__found"),
    )
    searches = write_once(searches, "ranks")
    wide = F.col("__found").isNull() & (F.col("__inside") > limit)
    while not searches.where(wide).isEmpty():
        narrowed = _narrowed(values, searches.where(wide), names)
        searches = write_once(narrowed.unionByName(searches.where(~wide)), "ranks")
    narrow = searches.where(F.col("__found").isNull())
    # At most ``limit`` values per rank are left.
    at = (F.col("__rank") - F.col("__below") + 1).cast("int")
    gathered = _met(values, narrow, names).groupBy(*names, "__rank", "__below").agg(F.sort_array(F.collect_list(X)).alias("__left"))
    gathered = gathered.select(*names, "__rank", F.element_at("__left", at).alias("__found"))
    settled = searches.where(F.col("__found").isNotNull()).select(*names, "__rank", "__found")
    by_rank = settled.unionByName(gathered).groupBy(*names).agg(
        F.map_from_entries(F.collect_list(F.struct("__rank", "__found"))).alias("__by_rank")
    )
    joined = long.join(by_rank, _same(long, by_rank, names)).select(*[long[n] for n in names], "__n", "__by_rank")
    return joined.select(*names, F.array(*[_between(_place(p)) for p in probabilities]).alias(output))


def _between(place: Column) -> Column:
    low, high = (F.element_at("__by_rank", f(place).cast("long")) for f in (F.floor, F.ceil))
    return low + (high - low) * (place - F.floor(place))


def _met(values: DataFrame, brackets: DataFrame, names: Sequence[str]) -> DataFrame:
    """The values strictly inside the brackets of their groups, with the columns of the brackets."""
    x = F.col(X)
    above = F.col("__low").isNull() | (x > F.col("__low"))
    under = F.col("__high").isNull() | (x < F.col("__high"))
    met = values.where(x.isNotNull()).join(brackets, _same(values, brackets, names) & above & under)
    return met.select(*[values[n] for n in names], X, *[c for c in brackets.columns if c not in names])


def _narrowed(values: DataFrame, searches: DataFrame, names: list[str]) -> DataFrame:
    """One sketch pass and one counting pass for all open searches."""
    bracket = [*names, "__low", "__high"]
    steps = F.array(*[F.lit(i / STEPS) for i in range(STEPS + 1)])
    grid = F.percentile_approx(X, steps, SKETCH_ACCURACY).alias("__grid")
    # Ranks that share a bracket share its sketch.
    theirs = {c: f"{c}_of" for c in bracket}
    sketched = _met(values, searches.select(*bracket).distinct(), names).groupBy(*bracket).agg(grid).withColumnsRenamed(theirs)
    same = reduce(and_, [searches[c].eqNullSafe(sketched[of]) for c, of in theirs.items()])
    step = (F.col("__rank") - F.col("__below")) / F.col("__inside") * STEPS
    first = F.greatest(F.floor(step).cast("int") - 1, F.lit(0)) + 1
    last = F.least(F.ceil(step).cast("int") + 1, F.lit(STEPS)) + 1
    proposed = searches.join(sketched, same).select(
        *[searches[c] for c in searches.columns],
        F.element_at("__grid", first).alias("__e1"),
        F.element_at("__grid", last).alias("__e2"),
    )
    proposed = write_once(proposed, "edges")
    x = F.col(X)
    edges = [c for c in proposed.columns if c not in names]
    counted = _met(values, proposed, names).groupBy(*names, *edges).agg(
        *[F.count(F.when(x < F.col(f"__e{i}"), 1)).alias(f"__under{i}") for i in (1, 2)],
        *[F.count(F.when(x <= F.col(f"__e{i}"), 1)).alias(f"__upto{i}") for i in (1, 2)],
    )
    rank, below = F.col("__rank"), F.col("__below")
    under = {i: below + F.col(f"__under{i}") for i in (1, 2)}
    upto = {i: below + F.col(f"__upto{i}") for i in (1, 2)}
    at = {i: (under[i] <= rank) & (rank < upto[i]) for i in (1, 2)}
    start = F.when(upto[2] <= rank, upto[2]).when(upto[1] <= rank, upto[1]).otherwise(below)
    end = F.when(rank < under[1], under[1]).when(rank < under[2], under[2]).otherwise(below + F.col("__inside"))
    return counted.select(
        *names,
        "__rank",
        start.alias("__below"),
        (end - start).alias("__inside"),
        F.when(upto[2] <= rank, F.col("__e2")).when(upto[1] <= rank, F.col("__e1")).otherwise(F.col("__low")).alias("__low"),
        F.when(rank < under[1], F.col("__e1")).when(rank < under[2], F.col("__e2")).otherwise(F.col("__high")).alias("__high"),
        F.when(at[1], F.col("__e1")).when(at[2], F.col("__e2")).alias("__found"),
    )
