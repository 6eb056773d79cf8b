"""Exact quantiles that never gather a whole column in one task."""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Values one task may sort per rank. Longer columns are narrowed around each rank first.
GATHER_LIMIT = 500_000
SKETCH_ACCURACY = 10_000


@dataclass
class _Search:
    """The value at one rank of a series, known to lie strictly between two edges."""

    series: str
    rank: int
    inside: int
    below: int = 0
    low: float | None = None
    high: float | None = None
    found: float | None = None

    def within(self, x: Column) -> Column:
        condition = F.lit(True)
        if self.low is not None:
            condition = condition & (x > self.low)
        if self.high is not None:
            condition = condition & (x < self.high)
        return F.when(condition, x)


def exact_quantiles(
    df: DataFrame,
    value: Column | str,
    probabilities: Sequence[float],
    gather_limit: int = GATHER_LIMIT,
) -> list[float | None]:
    """Quantiles of one column with linear interpolation, ignoring missing values."""
    return quantiles_of(df, {"value": value}, probabilities, gather_limit)["value"]


def quantiles_of(
    df: DataFrame,
    series: Mapping[str, Column | str],
    probabilities: Sequence[float],
    gather_limit: int = GATHER_LIMIT,
) -> dict[str, list[float | None]]:
    """Exact quantiles of several columns, sharing the scans.

    Spark's exact ``percentile`` keeps every distinct value in one task, so it is used
    only for short columns. A longer column is searched by rank: a sketch proposes two
    values around each rank, a count tells on which side of them the rank lies, and
    this repeats until few enough values are left to sort. Each pass is one scan with
    map-side combine for all ranks of all columns, and the answer is exact.
    """
    values = df.select(*[as_number(value).alias(name) for name, value in series.items()])
    totals = values.agg(*[F.count(name).alias(name) for name in series]).first()
    found: dict[str, list[float | None]] = {name: [None] * len(probabilities) for name in series}
    short = [name for name in series if 0 < totals[name] <= gather_limit]
    if short:
        wanted = F.array(*[F.lit(float(p)) for p in probabilities])
        row = values.agg(*[F.percentile(name, wanted).alias(name) for name in short]).first()
        found |= {name: list(row[name]) for name in short}
    places = {
        name: [p * (totals[name] - 1) for p in probabilities]
        for name in series
        if totals[name] > gather_limit
    }
    ranks = {(n, f(place)) for n in places for place in places[n] for f in (math.floor, math.ceil)}
    searches = {(n, rank): _Search(n, rank, totals[n]) for n, rank in sorted(ranks)}
    _run(values, list(searches.values()), gather_limit)
    for name, wanted_places in places.items():
        found[name] = []
        for place in wanted_places:
            low, high = (searches[name, f(place)].found for f in (math.floor, math.ceil))
            found[name].append(low + (high - low) * (place - math.floor(place)))
    return found


def as_number(value: Column | str) -> Column:
    """The value as a double, with NaN taken as missing."""
    number = (F.col(value) if isinstance(value, str) else value).cast("double")
    return F.when(~F.isnan(number), number)


def _run(values: DataFrame, searches: list[_Search], gather_limit: int) -> None:
    while wide := [s for s in searches if s.found is None and s.inside > gather_limit]:
        _narrow(values, wide)
    narrow = [s for s in searches if s.found is None]
    if not narrow:
        return
    # At most ``gather_limit`` values per rank are left.
    sorted_values = [
        F.element_at(F.sort_array(F.collect_list(s.within(F.col(s.series)))), s.rank - s.below + 1)
        for s in narrow
    ]
    row = values.agg(*[v.alias(f"v{i}") for i, v in enumerate(sorted_values)]).first()
    for s, value in zip(narrow, row):
        s.found = value


def _narrow(values: DataFrame, searches: list[_Search]) -> None:
    """One sketch pass and one counting pass for all open searches."""
    slack = 4.0 / SKETCH_ACCURACY
    brackets: dict[tuple, list[_Search]] = defaultdict(list)
    for s in searches:
        brackets[s.series, s.low, s.high].append(s)
    sketches = []
    for i, group in enumerate(brackets.values()):
        shares = [(s.rank - s.below) / s.inside for s in group]
        around = [min(max(share + d, 0.0), 1.0) for share in shares for d in (-slack, slack)]
        value = group[0].within(F.col(group[0].series))
        sketches.append(F.percentile_approx(value, around, SKETCH_ACCURACY).alias(f"e{i}"))
    row = values.agg(*sketches).first()
    edges = {}
    for group, proposed in zip(brackets.values(), row):
        for j, s in enumerate(group):
            edges[s.series, s.rank] = proposed[2 * j : 2 * j + 2]
    wanted = sorted({(s.series, edge) for s in searches for edge in edges[s.series, s.rank]})
    counts = []
    for i, (name, edge) in enumerate(wanted):
        x = F.col(name)
        counts.append(F.count(F.when(x < edge, 1)).alias(f"under{i}"))
        counts.append(F.count(F.when(x <= edge, 1)).alias(f"upto{i}"))
    counted = values.agg(*counts).first()
    place = {key: (counted[f"under{i}"], counted[f"upto{i}"]) for i, key in enumerate(wanted)}
    for s in searches:
        start, end = s.below, s.below + s.inside
        for edge in edges[s.series, s.rank]:
            under, upto = place[s.series, edge]
            if under <= s.rank < upto:
                s.found = edge
            elif start <= upto <= s.rank:
                start, s.low = upto, edge
            elif s.rank < under <= end:
                end, s.high = under, edge
        s.below, s.inside = start, end - start
