from datetime import datetime

import pytest
from pyspark.sql import functions as F

from gtdlens.functions import columns as C


def one(spark, expression, **values):
    """Value of an expression over one row of typed SQL literals."""
    row = ", ".join(f"{text} as {name}" for name, text in values.items()) or "1 as one"
    return spark.sql(f"select {row}").select(expression.alias("v")).first()["v"]


def ts(text):
    return f"timestamp_ntz'{text}'"


def test_weekday_counts_from_sunday(spark):
    # 7 January 2024 was a Sunday.
    numbers = [one(spark, C.weekday_number("t"), t=ts(f"2024-01-{7 + i:02d} 10:00:00")) for i in range(7)]
    names = [one(spark, C.weekday_name("t"), t=ts(f"2024-01-{7 + i:02d} 10:00:00")) for i in range(7)]
    assert numbers == list(range(7))
    assert tuple(names) == C.WEEKDAYS
    assert one(spark, C.weekday_name("t"), t="cast(null as timestamp_ntz)") is None


@pytest.mark.parametrize(
    "hour, name",
    [(0, "dawn"), (5, "dawn"), (6, "morning"), (11, "morning"), (12, "afternoon"),
     (17, "afternoon"), (18, "evening"), (23, "evening")],
)
def test_period(spark, hour, name):
    at = ts(f"2024-01-01 {hour:02d}:59:59")
    assert one(spark, C.period_of_day("t"), t=at) == name
    for other in ("dawn", "morning", "afternoon", "evening"):
        assert one(spark, C.in_period("t", other), t=at) == (other == name)


def test_missing_time_is_dawn_but_never_matches(spark):
    missing = "cast(null as timestamp_ntz)"
    assert one(spark, C.period_of_day("t"), t=missing) == "dawn"
    assert one(spark, C.in_period("t", "dawn"), t=missing) is None


def test_unknown_weekday_matches_nothing(spark):
    assert one(spark, C.on_weekday("t", "domingo"), t=ts("2024-01-07 00:00:00")) is None
    assert one(spark, C.on_weekday("t", "sunday"), t=ts("2024-01-07 00:00:00")) is True


@pytest.mark.parametrize(
    "value, expected", [("2.5", 3), ("3.5", 4), ("-2.5", -3), ("2.4999", 2), ("null", None)]
)
def test_whole_rounds_half_up(spark, value, expected):
    assert one(spark, C.whole("x"), x=f"cast({value} as double)") == expected


@pytest.mark.parametrize("value, expected", [("1.005", 1.01), ("2.675", 2.68), ("-1.005", -1.01)])
def test_money_rounds_half_up(spark, value, expected):
    assert one(spark, C.money("x"), x=f"cast({value} as double)") == expected


@pytest.mark.parametrize(
    "overlay, gtd, expected",
    [("-5.0", "20.0", 25.0), ("5.0", "0.0", 0.0), ("5.0", "null", 0.0), ("null", "20.0", None)],
)
def test_overlay_percent(spark, overlay, gtd, expected):
    found = one(
        spark, C.overlay_percent("o", "g"), o=f"cast({overlay} as double)", g=f"cast({gtd} as double)"
    )
    assert found == expected


@pytest.mark.parametrize("overlay, expected", [("-3", 0.0), ("0", 1.0), ("12.5", 12.5), ("null", None)])
def test_overlay_label(spark, overlay, expected):
    assert one(spark, C.overlay_label("o"), o=f"cast({overlay} as double)") == expected


@pytest.mark.parametrize(
    "result, expected", [("-0.01", True), ("0", False), ("null", False), ("'NaN'", False)]
)
def test_predicted_overlay(spark, result, expected):
    assert one(spark, C.predicted_overlay("r"), r=f"cast({result} as double)") is expected


def test_ratio_by_zero_is_missing(spark):
    assert one(spark, C.ratio("a", "b"), a="1.0d", b="0.0d") is None
    assert one(spark, C.ratio("a", "b"), a="6.0d", b="4.0d") == 1.5


def test_texts(spark):
    assert one(spark, C.is_yes("a"), a="'Sim'") is True
    assert one(spark, C.is_yes("a"), a="'Nao'") is False
    assert one(spark, C.is_yes("a"), a="cast(null as string)") is False
    assert one(spark, C.class_text("p"), p="1.0d") == "PREVISÃO DE LUCRO"
    assert one(spark, C.class_text("p"), p="0.0d") == "PREVISÃO DE PREJUIZO"
    label = C.period_label("a", "b")
    assert one(spark, label, a="date'2023-01-02'", b="date'2023-12-01'") == "2023-01-02_to_2023-12-01"
    assert one(spark, C.longer_than("d"), d="'00:05:00'") is False
    assert one(spark, C.longer_than("d"), d="'00:05:01'") is True


def test_uniform_is_repeatable_and_in_range(spark):
    rows = spark.range(2000).select(C.uniform(F.lit(42), "id").alias("u"))
    low, high, mean, distinct = rows.agg(
        F.min("u"), F.max("u"), F.avg("u"), F.count_distinct("u")
    ).first()
    assert 0 <= low < 0.01 and 0.99 < high < 1 and abs(mean - 0.5) < 0.03 and distinct == 2000
    assert rows.exceptAll(spark.range(2000).select(C.uniform(F.lit(42), "id").alias("u"))).isEmpty()


def test_form_dates_are_not_shifted(spark):
    at = one(spark, F.col("t"), t=ts("2024-01-07 23:30:00"))
    assert at == datetime(2024, 1, 7, 23, 30)
