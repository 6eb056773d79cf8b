from datetime import date, timedelta

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gtdlens.operators import splits
from gtdlens.operators.quantiles import exact_quantiles, quantiles_of
from gtdlens.operators.ranking import global_rank


def sizes(df):
    return [r["count"] for r in df.groupBy("fold").count().orderBy("fold").collect()]


@pytest.mark.parametrize("rows, k, expected", [(23, 10, [3, 3, 3] + [2] * 7), (20, 5, [4] * 5), (3, 5, [1] * 3)])
def test_contiguous_sizes(spark, rows, k, expected):
    folds = splits.contiguous_folds(spark.range(rows), ["id"], k)
    assert sizes(folds) == expected
    ordered = [r["fold"] for r in folds.orderBy("id").collect()]
    assert ordered == sorted(ordered)


def test_ranks_with_a_hot_key_and_copies(spark):
    # A third of the rows share one key, and a third are plain copies of one row.
    rows = spark.range(9000).select(
        F.when(F.col("id") % 3 == 0, 500).otherwise(F.col("id")).alias("key"),
        F.when(F.col("id") % 3 == 1, 7).otherwise(F.col("id")).alias("other"),
    ).withColumn("key", F.when(F.col("other") == 7, 100).otherwise(F.col("key")))
    ranked, total = global_rank(rows, ["key"], "n")
    found = ranked.select("n", "key").toPandas().sort_values("n")
    assert total == 9000 and list(found["n"]) == list(range(9000))
    assert found["key"].is_monotonic_increasing


def test_shuffled_folds_are_even_and_repeatable(spark):
    a = splits.shuffled_folds(spark.range(103), ["id"], 10)
    b = splits.shuffled_folds(spark.range(103).repartition(3), ["id"], 10)
    assert sizes(a) == [11] * 3 + [10] * 7
    assert a.exceptAll(b).isEmpty()
    assert not splits.shuffled_folds(spark.range(103), ["id"], 10, seed=1).exceptAll(a).isEmpty()


def test_hashed_folds_do_not_shuffle(spark, capsys):
    folds = splits.hashed_folds(spark.range(10_000), ["id"], 10)
    assert all(850 < n < 1150 for n in sizes(folds))
    folds.explain()
    assert "Exchange" not in capsys.readouterr().out


def test_schedule_drifts_after_a_short_month():
    windows = splits.rolling_windows(date(2023, 7, 30), date(2024, 5, 1))
    assert [w.valid_start for w in windows] == [
        date(2023, 7, 30), date(2023, 8, 30), date(2023, 9, 30), date(2023, 10, 30),
        date(2023, 11, 30), date(2023, 12, 30), date(2024, 1, 30), date(2024, 2, 29),
        date(2024, 3, 29), date(2024, 4, 29),
    ]
    first = windows[0]
    assert (first.train_start, first.train_end) == (date(2022, 8, 30), date(2023, 7, 29))
    assert first.valid_end == date(2023, 8, 29)
    assert first.label == "2022-08-30_to_2023-08-29"
    # The day before as_of still starts a window; as_of itself does not.
    assert len(splits.rolling_windows(date(2024, 1, 1), date(2024, 2, 1))) == 1
    assert len(splits.rolling_windows(date(2024, 1, 1), date(2024, 2, 2))) == 2


def test_each_day_is_validated_once(spark):
    windows = splits.rolling_windows(date(2023, 1, 31), date(2024, 6, 1))
    first, last = windows[0].valid_start, windows[-1].valid_end
    days = spark.range((last - first).days + 1).select(
        F.expr(f"date_add(date'{first}', cast(id as int))").alias("start_date_local")
    )
    assigned = splits.assign_windows(days, windows)
    valid = assigned.where("role = 'valid'").groupBy("start_date_local").count()
    assert valid.count() == (last - first).days + 1
    assert valid.where("count <> 1").isEmpty()
    starts = splits.schedule_table(spark, windows).select("window_id", "valid_start")
    late = assigned.where("role = 'train'").join(starts, "window_id")
    assert late.where("start_date_local >= valid_start").isEmpty()
    for w in windows:
        assert w.train_end + timedelta(days=1) == w.valid_start


def test_windows_are_joined_by_equality(spark, small, capsys):
    windows = splits.rolling_windows(date(1996, 1, 30), date(2001, 1, 1))
    rows = spark.range(10).select(F.expr("date_add(date'1997-01-01', cast(id as int)) as start_date_local"))
    splits.assign_windows(rows, windows).explain()
    plan = capsys.readouterr().out
    assert "NestedLoop" not in plan and "Cartesian" not in plan


VALUES = st.lists(
    st.one_of(st.sampled_from([0.0, 1.0, 7.5]), st.floats(-1e6, 1e6, allow_nan=False)), min_size=1, max_size=200
)


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(VALUES, st.lists(st.floats(0, 1), min_size=1, max_size=3), st.integers(1, 30))
def test_quantiles_by_search(spark, values, probabilities, limit):
    df = spark.createDataFrame([(v,) for v in values], "x double")
    found = exact_quantiles(df, "x", probabilities, gather_limit=limit)
    assert np.allclose(found, np.quantile(values, probabilities), rtol=1e-9, atol=1e-9)


def test_quantiles_of_a_hot_value(spark):
    rows = spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, 5.0).otherwise(F.rand(3) * 10).alias("x"),
        F.col("id").cast("double").alias("y"),
        F.lit(None).cast("double").alias("nothing"),
    ).persist()
    series = {"x": "x", "y": "y", "nothing": "nothing"}
    probabilities = [0.0, 0.25, 0.5, 0.75, 1.0]
    searched = quantiles_of(rows, series, probabilities, gather_limit=100)
    gathered = quantiles_of(rows, series, probabilities)
    assert searched == gathered and gathered["nothing"] == [None] * 5
