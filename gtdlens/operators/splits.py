"""Fold assignment and rolling calendar windows."""

from __future__ import annotations

import calendar
from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gtdlens.functions.columns import period_label
from gtdlens.operators.ranking import global_rank

# A calendar row is a date, a number and a short text: about 100 MB in a broadcast at most.
BROADCAST_DAYS = 1_000_000

SCHEDULE = T.StructType(
    [
        T.StructField("window_id", T.IntegerType()),
        T.StructField("train_start", T.DateType()),
        T.StructField("train_end", T.DateType()),
        T.StructField("valid_start", T.DateType()),
        T.StructField("valid_end", T.DateType()),
    ]
)


def _cut(ranked: DataFrame, total: int, k: int, fold: str) -> DataFrame:
    """Equal runs of consecutive ranks; the first ``total % k`` folds hold one row more."""
    size, larger = divmod(total, k)
    edge = larger * (size + 1)
    rank = F.col("__rank")
    number = F.when(rank < edge, F.floor(rank / (size + 1))).otherwise(
        larger + F.floor((rank - edge) / max(size, 1))
    )
    return ranked.withColumn(fold, number.cast("int")).drop("__rank")


def contiguous_folds(
    df: DataFrame, order: Sequence[Column | str], k: int = 10, fold: str = "fold"
) -> DataFrame:
    """k runs of rows in the given order, with sizes that differ by at most one."""
    ranked, total = global_rank(df, order, "__rank")
    return _cut(ranked, total, k, fold)


def shuffle_key(key: Sequence[str], seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in key]))


def shuffled_folds(
    df: DataFrame, key: Sequence[str], k: int = 10, seed: int = 42, fold: str = "fold"
) -> DataFrame:
    """Like :func:`contiguous_folds` in a repeatable shuffled order."""
    return contiguous_folds(df, [shuffle_key(key, seed)], k, fold)


def hashed_folds(
    df: DataFrame, key: Sequence[str], k: int = 10, seed: int = 42, fold: str = "fold"
) -> DataFrame:
    """Repeatable random folds without any shuffle; sizes are equal up to chance.

    Rows with the same key share a fold, so the key should identify a row.
    """
    prefix = F.conv(F.substring(shuffle_key(key, seed), 1, 8), 16, 10).cast("bigint")
    drawn = {"folds": {"key": list(key), "number": k, "seed": seed}}
    return df.withColumn(fold, (prefix % k).cast("int")).withMetadata(fold, drawn)


def has_hashed_folds(df: DataFrame, key: Sequence[str], k: int = 10, seed: int = 42, fold: str = "fold") -> bool:
    """Whether the column holds the folds that :func:`hashed_folds` gives; it says so itself, also once it was written."""
    drawn = {"key": list(key), "number": k, "seed": seed}
    return fold in df.columns and df.schema[fold].metadata.get("folds") == drawn


def add_months(day: date, months: int) -> date:
    """Same day of another month, or its last day where the month is shorter."""
    index = day.year * 12 + day.month - 1 + months
    year, month = divmod(index, 12)
    last = calendar.monthrange(year, month + 1)[1]
    return date(year, month + 1, min(day.day, last))


@dataclass(frozen=True)
class CalendarWindow:
    window_id: int
    train_start: date
    train_end: date
    valid_start: date
    valid_end: date

    @property
    def label(self) -> str:
        return f"{self.train_start}_to_{self.valid_end}"


def rolling_windows(
    start: date, as_of: date, train_months: int = 11, valid_months: int = 1, step_months: int = 1
) -> list[CalendarWindow]:
    """Windows whose validation starts on or before the day before ``as_of``.

    Each start is one step after the previous one, so the day of month stays at the
    last day it was cut to by a short month.
    """
    windows, current, last = [], start, as_of - timedelta(days=1)
    one_day = timedelta(days=1)
    while current <= last:
        windows.append(
            CalendarWindow(
                len(windows),
                add_months(current, -train_months),
                current - one_day,
                current,
                add_months(current, valid_months) - one_day,
            )
        )
        current = add_months(current, step_months)
    return windows


def schedule_table(spark: SparkSession, windows: Sequence[CalendarWindow]) -> DataFrame:
    rows = [
        (w.window_id, w.train_start, w.train_end, w.valid_start, w.valid_end) for w in windows
    ]
    return spark.createDataFrame(rows, SCHEDULE).withColumn(
        "label", period_label("train_start", "valid_end")
    )


def window_calendar(spark: SparkSession, windows: Sequence[CalendarWindow]) -> DataFrame:
    """One row per (day, window, role). Both ends of each interval belong to it.

    With the days listed, rows meet their windows in an equality join instead of a
    comparison with every interval.
    """
    schedule = schedule_table(spark, windows)

    def days(start: str, end: str, role: str) -> DataFrame:
        listed = F.explode(F.sequence(F.col(start), F.col(end))).alias("__day")
        return schedule.select(listed, "window_id", F.lit(role).alias("role"))

    listed = days("train_start", "train_end", "train").unionByName(
        days("valid_start", "valid_end", "valid")
    )
    total = sum(
        (w.train_end - w.train_start).days + (w.valid_end - w.valid_start).days + 2 for w in windows
    )
    return F.broadcast(listed) if total <= BROADCAST_DAYS else listed


def assign_windows(
    df: DataFrame, windows: Sequence[CalendarWindow], day: str = "start_date_local"
) -> DataFrame:
    """Each row once per window whose training or validation interval holds its day."""
    listed = window_calendar(df.sparkSession, windows)
    return df.join(listed, F.col(day) == F.col("__day")).drop("__day")
