"""Start slots: how many tournaments share a (date, hour), alone and with its neighbours."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from gtdlens.session import write_once

SLOT_KEY = ["start_date_local", "start_hour_local"]
HOURS_PER_DAY = 24


def selected(
    fact: DataFrame,
    kind: str,
    classes: Sequence[str],
    first_day: date | None = None,
    last_day: date | None = None,
) -> DataFrame:
    """Rows of one tournament type and some classes, inside a closed date range."""
    rows = fact.where(
        (F.col("match_type_detail_name") == kind) & F.col("class_match").isin(list(classes))
    )
    if first_day is not None:
        rows = rows.where(F.col("start_date_local") >= F.lit(first_day))
    if last_day is not None:
        rows = rows.where(F.col("start_date_local") <= F.lit(last_day))
    return rows


def hour_slot_counts(rows: DataFrame) -> DataFrame:
    """Tournaments per (date, hour), combined map-side. A timestamp counts for its date."""
    day = F.col("start_date_local").cast("date").alias("start_date_local")
    return rows.groupBy(day, "start_hour_local").agg(F.count("*").alias("same_hour_game"))


def hour_band_counts(counts: DataFrame) -> DataFrame:
    """Add the tournaments of the hour before, the hour itself and the hour after.

    The frame stays inside one date, so each window holds one row per hour. A missing
    hour has no neighbours.
    """
    band = Window.partitionBy("start_date_local").orderBy("start_hour_local").rangeBetween(-1, 1)
    near = F.sum("same_hour_game").over(band)
    return counts.withColumn(
        "one_hour_window_game", F.when(F.col("start_hour_local").isNotNull(), near)
    )


def hour_band_counts_joined(counts: DataFrame) -> DataFrame:
    """Same result as :func:`hour_band_counts` through a self join with an hour band."""
    left, right = counts.alias("slot"), counts.alias("near")
    hour, near_hour = F.col("slot.start_hour_local"), F.col("near.start_hour_local")
    in_band = (F.col("slot.start_date_local") == F.col("near.start_date_local")) & (
        near_hour.between(hour - 1, hour + 1)
    )
    return (
        left.join(right, in_band, "left")
        .groupBy("slot.start_date_local", "slot.start_hour_local", "slot.same_hour_game")
        .agg(F.sum("near.same_hour_game").alias("one_hour_window_game"))
        .select(*SLOT_KEY, "same_hour_game", "one_hour_window_game")
    )


def hour_slot_lookup(counts: DataFrame) -> DataFrame:
    """Both counts for every slot with a tournament in it or next to it.

    Unlike :func:`hour_band_counts` it also answers for an hour that is still empty. Each
    count is passed on to the hours it is a neighbour of, so no self join is needed.
    """
    hour = F.col("start_hour_local")
    reached = counts.where(hour.isNotNull()).select(
        "start_date_local",
        F.explode(F.sequence(hour - 1, hour + 1)).alias("reached"),
        hour,
        "same_hour_game",
    )
    at_home = F.col("reached") == hour
    return (
        reached.where(F.col("reached").between(0, HOURS_PER_DAY - 1))
        .groupBy("start_date_local", "reached")
        .agg(
            F.coalesce(F.sum(F.when(at_home, F.col("same_hour_game"))), F.lit(0)).alias("n"),
            F.sum("same_hour_game").alias("one_hour_window_game"),
        )
        .select(
            "start_date_local",
            F.col("reached").alias("start_hour_local"),
            F.col("n").alias("same_hour_game"),
            "one_hour_window_game",
        )
    )


def with_slot_counts(rows: DataFrame, slots: DataFrame) -> DataFrame:
    """Attach the slot counts to each row; rows without a slot keep NULL counts.

    The slots are written first, so the plan knows their real size: a table below Spark's
    broadcast threshold is broadcast and the wide rows are never shuffled, a larger one is
    joined by shuffle, where AQE splits a hot slot. Hours and periods of any extent get the
    same answer either way.
    """
    key = {"start_date_local": "__slot_day", "start_hour_local": "__slot_hour"}
    written = write_once(slots.withColumnsRenamed(key), "slots")
    met = (F.col("start_date_local").cast("date") == F.col("__slot_day")) & (
        F.col("start_hour_local") == F.col("__slot_hour")
    )
    return rows.join(written, met, "left").drop(*key.values())
