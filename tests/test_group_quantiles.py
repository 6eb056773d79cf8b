"""Quantiles of many groups in shared passes equal one search a group."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gtdlens.operators import group_quantiles as G
from gtdlens.operators import metrics as M
from gtdlens.operators.quantiles import exact_quantiles

SHARES = [0.0, 0.25, 0.5, 0.9, 1.0]


def groups(seed=3):
    rng = random.Random(seed)
    made = {
        ("a", 1): [rng.gauss(0, 100) for _ in range(900)],
        ("a", 2): [float(rng.randrange(4)) for _ in range(700)],
        ("b", None): [5.0] * 400,
        (None, None): [rng.expovariate(1) for _ in range(301)],
        ("c", 1): [1.0, 4.0],
        ("c", 2): [-7.5],
        ("d", 1): [],
    }
    rows = [(k, n, x) for (k, n), xs in made.items() for x in [*xs, None, float("nan")]]
    rng.shuffle(rows)
    return made, rows


@pytest.mark.parametrize("limit", [1, 7, 350, 10_000])
def test_same_as_numpy(spark, limit):
    made, rows = groups()
    df = spark.createDataFrame(rows, "kind string, `n.o` int, x double").repartition(5)
    found = G.grouped_quantiles(df, ["kind", "n.o"], "x", SHARES, gather_limit=limit).collect()
    assert len(found) == len(made)
    for kind, number, quantiles in found:
        values = made[kind, number]
        expected = np.quantile(values, SHARES) if values else [None] * len(SHARES)
        assert quantiles == pytest.approx(list(expected), rel=1e-12, abs=1e-12) if values else quantiles == list(expected)


def test_same_as_one_search_a_group_in_a_few_passes(spark, monkeypatch):
    df = spark.range(120_000).select(
        (F.col("id") % 40).alias("g"), (F.hash("id") % 10_007 / 7).alias("x")
    )
    passes = []
    narrowed = G._narrowed
    monkeypatch.setattr(G, "_narrowed", lambda *a: passes.append(1) or narrowed(*a))
    found = {r["g"]: r["quantiles"] for r in G.grouped_quantiles(df, ["g"], "x", [0.5, 0.75], gather_limit=50).collect()}
    assert len(found) == 40
    # As many as the longest group needs, however many groups there are.
    assert len(passes) <= 3
    for g in (0, 17, 39):
        assert found[g] == exact_quantiles(df.where(F.col("g") == g), "x", [0.5, 0.75], gather_limit=50)


def test_no_rows_and_no_keys(spark):
    empty = spark.createDataFrame([], "g int, x double")
    assert G.grouped_quantiles(empty, ["g"], "x", [0.5]).collect() == []
    df = spark.createDataFrame([(1, 2.0), (1, 4.0)], "g int, x double")
    assert G.grouped_quantiles(df, [], "x", [0.5]).collect()[0]["quantiles"] == [3.0]
    assert G.grouped_quantiles(df, [], "x", [0.5], gather_limit=1).collect()[0]["quantiles"] == [3.0]


def test_objectives_together_equal_one_by_one(spark):
    from gtdlens.operators import tuning

    scored = spark.range(3_000).select(
        (F.col("id") % 6).alias("trial_id"),
        (F.hash("id") % 3).alias("fold"),
        (F.hash("id", F.lit(1)) % 2 == 0).cast("double").alias("actual"),
        (F.hash("id", F.lit(2)) % 2 == 0).cast("double").alias("prediction"),
    )
    for one, together in tuning.TOGETHER.items():
        found = {r["trial_id"]: r["score"] for r in together(scored, ["trial_id"]).collect()}
        assert found == {t: pytest.approx(one(scored.where(F.col("trial_id") == t))) for t in range(6)}


def test_medians_of_errors(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0), (1, 1.0, 5.0), (2, None, 1.0)], "g int, actual double, p double")
    found = {r["g"]: r["score"] for r in M.median_absolute_errors(df, ["g"], "actual", "p").collect()}
    assert found == {1: 2.5, 2: None}
