"""What-if rows and features: planned tournaments as a fitted model expects them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gtdlens.functions import columns as C
from gtdlens.operators import encoding as E
from gtdlens.schemas import FORM_VOCABULARY
from gtdlens.session import write_once

COUNTS = ["same_hour_game", "one_hour_window_game"]


def scenario_rows(scenarios: DataFrame, slots: DataFrame | None = None) -> DataFrame:
    """The form's fields with the numbers derived from them, ready for ``score``.

    ``slots`` is a slot lookup by date and hour (see ``hour_slot_lookup``). A scenario
    with no tournament near it gets zero counts; its own start is not counted. An hour
    outside the day is left out.
    """
    hour = F.floor("hour").cast("int")
    rows = scenarios.withColumn("start_hour_local", F.when(hour.between(0, 23), hour))
    if slots is None:
        rows = rows.withColumns({c: F.lit(0).cast("bigint") for c in COUNTS})
    else:
        rows = _with_counts(rows, slots)
    return rows.select(
        "scenario_id",
        "start_date_local",
        "start_hour_local",
        *[c for c in FORM_VOCABULARY if c != "start_hour_local"],
        "level_reject",
        "mtt_blind_up_time_sec",
        C.late_registration("mtt_blind_up_time_sec", "level_reject").alias("late_registration_time"),
        "earlybird",
        C.is_yes("has_rebuy").alias("has_rebuy"),
        C.is_yes("has_addon").alias("has_addon"),
        "mtt_customer_buy_in",
        "mtt_customer_rebuy",
        "mtt_customer_addon",
        "gtd",
        C.ratio("gtd", "mtt_customer_buy_in").alias("buyin_gtd_rate"),
        *COUNTS,
    )


def _with_counts(rows: DataFrame, slots: DataFrame) -> DataFrame:
    """Slot counts, zero where there is no slot.

    The slots are limited to the scenarios' dates and written, so their real size decides
    on a broadcast. Scenarios without an hour or date meet no slot and stay out of the join.
    """
    key = ["start_date_local", "start_hour_local"]
    near = slots.join(rows.select("start_date_local").distinct(), "start_date_local", "left_semi")
    written = write_once(near.select(*key, *COUNTS), "slots")
    placed = F.col("start_date_local").isNotNull() & F.col("start_hour_local").isNotNull()
    counted = rows.where(placed).join(written, key, "left").fillna(0, COUNTS)
    none = {c: F.lit(0).cast("bigint") for c in COUNTS}
    return counted.unionByName(rows.where(~placed).withColumns(none))


def scenario_features(scenarios: DataFrame, slots: DataFrame | None = None) -> DataFrame:
    """The numbers and the 48 flags of the closed vocabularies, one column each."""
    rows = scenario_rows(scenarios, slots)
    categories = [c for c in FORM_VOCABULARY if c != "start_hour_local"]
    numbers = [c for c in rows.columns if c not in FORM_VOCABULARY and c != "start_date_local"]
    return rows.select(
        *numbers,
        *E.hour_flags("start_hour_local"),
        *[flag for c in categories for flag in E.value_flags(c, FORM_VOCABULARY[c])],
    )
