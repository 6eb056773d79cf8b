"""Column expressions shared by the extracts, lookups and reports.

Everything here is a built-in Spark expression, so it stays inside whole-stage
code generation and can be pushed down where Spark knows how to.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Day 0 is Sunday.
WEEKDAYS = ("sunday", "monday", "tuesday", "wednesday", "thursday", "friday", "saturday")
# First and last hour of each period; every other hour is "dawn".
PERIOD_HOURS = {"morning": (6, 11), "afternoon": (12, 17), "evening": (18, 23)}
DAWN = "dawn"
# Texts shown for a predicted class.
PROFIT_TEXT = "PREVISÃO DE LUCRO"
LOSS_TEXT = "PREVISÃO DE PREJUIZO"


def as_column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def weekday_number(ts: Column | str) -> Column:
    """0 for Sunday to 6 for Saturday (Spark itself counts from 1)."""
    return F.dayofweek(as_column(ts)) - 1


def weekday_name(ts: Column | str, names: tuple[str, ...] = WEEKDAYS) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in names]), F.dayofweek(as_column(ts)))


def on_weekday(ts: Column | str, name: str) -> Column:
    """True on the named day; an unknown name matches nothing."""
    if name not in WEEKDAYS:
        return F.lit(None).cast("boolean")
    return weekday_number(ts) == WEEKDAYS.index(name)


def period_of_day(ts: Column | str) -> Column:
    """Bucket of the hour. A missing time falls in the last bucket, ``dawn``."""
    hour = F.hour(as_column(ts))
    named = [(hour.between(lo, hi), name) for name, (lo, hi) in PERIOD_HOURS.items()]
    bucket = F.when(*named[0])
    for condition, name in named[1:]:
        bucket = bucket.when(condition, name)
    return bucket.otherwise(DAWN)


def in_period(ts: Column | str, period: str) -> Column:
    """Filter form of :func:`period_of_day`; unlike it, a missing time never matches."""
    hour = F.hour(as_column(ts))
    if period in PERIOD_HOURS:
        return hour.between(*PERIOD_HOURS[period])
    return hour < PERIOD_HOURS["morning"][0]


def exact(value: Column | str) -> Column:
    """Fixed-point form, so that rounding does not depend on binary fractions."""
    return as_column(value).cast("decimal(18,6)")


def money(value: Column | str) -> Column:
    """Amount rounded half-up to cents."""
    return F.round(exact(value), 2).cast("double")


def whole(value: Column | str) -> Column:
    """Integer cast that rounds half-up, as the warehouse does, instead of truncating."""
    return F.round(exact(value), 0).cast("int")


def ratio(amount: Column | str, base: Column | str) -> Column:
    """``amount / base``; NULL where the base is zero or missing."""
    return F.try_divide(as_column(amount), as_column(base))


def overlay_percent(overlay: Column | str, guarantee: Column | str) -> Column:
    overlay, guarantee = as_column(overlay), as_column(guarantee)
    return F.when(guarantee != 0, F.abs(overlay / guarantee * 100)).otherwise(0.0)


def overlay_label(overlay: Column | str) -> Column:
    """0 for a shortfall, 1 for none; a positive amount passes through unchanged."""
    overlay = as_column(overlay)
    return F.when(overlay < 0, 0.0).when(overlay == 0, 1.0).otherwise(overlay)


def predicted_result(prediction: Column | str, guarantee: Column | str = "gtd") -> Column:
    return as_column(prediction) - as_column(guarantee)


def predicted_overlay(result: Column | str) -> Column:
    """True where the predicted result is negative; a missing result counts as no overlay."""
    return F.coalesce(as_column(result) < 0, F.lit(False))


def class_text(prediction: Column | str) -> Column:
    return F.when(as_column(prediction) == 1, PROFIT_TEXT).otherwise(LOSS_TEXT)


def late_registration(blind_up_seconds: Column | str, level: Column | str) -> Column:
    return as_column(blind_up_seconds) * as_column(level)


def is_yes(answer: Column | str, yes: str = "Sim") -> Column:
    return F.coalesce(as_column(answer) == yes, F.lit(False))


def absolute_error(actual: Column | str, predicted: Column | str) -> Column:
    return F.abs(as_column(actual) - as_column(predicted))


def period_label(start: Column | str, end: Column | str) -> Column:
    return F.concat_ws("_to_", as_column(start).cast("string"), as_column(end).cast("string"))


def longer_than(duration: Column | str, limit: str = "00:05:00") -> Column:
    """Zero-padded ``HH:MM:SS`` texts sort like the times they name, and the plain
    comparison reaches the Parquet scan."""
    return as_column(duration) > limit


def uniform(*parts: Column | str) -> Column:
    """Repeatable number in [0, 1) drawn from the md5 of the parts."""
    text = F.concat_ws(":", *[as_column(p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(16**13))


def day_from_text(text: Column | str) -> Column:
    """A date typed as ``yyyy-MM-dd``; anything else is NULL."""
    return F.to_date(F.try_to_timestamp(F.col(text) if isinstance(text, str) else text, F.lit("yyyy-MM-dd")))
