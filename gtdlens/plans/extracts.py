"""Training and scoring extracts."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gtdlens.functions import columns as C
from gtdlens.operators import slots as S
from gtdlens.sources.tables import run_sql_file

REGRESSOR_SQL = Path(__file__).with_name("regressor_extract.sql")

# The defaults of the regressor and classifier extracts.
HOLDEM = "MTT-NLH"
SMALL_CLASSES = ("Micro", "Low")
HOME_UNION = 113
EXCLUDED_NAMES = ("HG", "LIVE", "PVD", "PVT", "CLASS")
SHORTEST = "00:05:00"


def regressor_extract(
    fact: DataFrame,
    first_day: date | None,
    last_day: date | None,
    kind: str = HOLDEM,
    classes: Sequence[str] = SMALL_CLASSES,
    by_join: bool = False,
) -> DataFrame:
    """One row per tournament of the period, with the two slot counts. Either end may be open.

    The counts cover whole dates, so limiting them to the period as well changes no
    row; Spark cannot always carry the limit across the join, so it is stated twice.
    ``by_join`` takes the self-join form of the neighbour count.
    """
    rows = S.selected(fact, kind, classes, first_day, last_day)
    counts = S.hour_slot_counts(rows)
    bands = S.hour_band_counts_joined(counts) if by_join else S.hour_band_counts(counts)
    return S.with_slot_counts(rows, bands).select(
        "match_id",
        "start_date_local",
        "start_hour_local",
        "day_of_week_local",
        "ko_type",
        "mtt_pool_allocation_description",
        C.whole("level_reject").alias("level_reject"),
        "estrutura_blinds",
        "mtt_blind_up_time_sec",
        "late_registration_time",
        "earlybird",
        "has_rebuy",
        "has_addon",
        "mtt_customer_buy_in",
        "mtt_customer_rebuy",
        "mtt_customer_addon",
        "gtd",
        "has_overlay",
        "overlay",
        "mtt_result",
        "collected",
        "normalized_mtt_result",
        "normalized_collected",
        "buyin_gtd_rate",
        "same_hour_game",
        "one_hour_window_game",
    )


def regressor_extract_sql(fact: DataFrame, first_day: date, last_day: date) -> DataFrame:
    """The same extract from its SQL text, with the period as parameters."""
    period = {"init_date": first_day, "end_date": last_day}
    return run_sql_file(fact.sparkSession, REGRESSOR_SQL, period, tournaments=fact)


def constrained_extract(
    fact: DataFrame,
    *,
    kind: str = HOLDEM,
    classes: Sequence[str] | None = None,
    gtd_range: tuple[float, float] | None = None,
    ratio_range: tuple[float, float] | None = None,
    last_day: date | None = None,
    positive_buy_in: bool = True,
    stored_norms: bool = False,
    with_level: bool = False,
) -> DataFrame:
    """Extract without slot counts, limited by guarantee, by ratio, by date or not at all.

    The ratio is always computed here, also where the table stores one.
    """
    buy_in = F.col("mtt_customer_buy_in")
    rows = fact.where(F.col("match_type_detail_name") == kind)
    if classes is not None:
        rows = rows.where(F.col("class_match").isin(list(classes)))
    if positive_buy_in:
        rows = rows.where(buy_in > 0)
    if gtd_range is not None:
        rows = rows.where(F.col("gtd").between(*gtd_range))
    if last_day is not None:
        rows = rows.where(F.col("start_date_local") <= F.lit(last_day))
    rate = C.ratio("gtd", buy_in)
    if ratio_range is not None:
        rows = rows.where(rate.between(*ratio_range))
    if stored_norms:
        result, collected = F.col("normalized_mtt_result"), F.col("normalized_collected")
    else:
        result, collected = C.ratio("mtt_result", buy_in), C.ratio("collected", buy_in)
    level = [C.whole("level_reject").alias("level_reject")] if with_level else []
    return rows.select(
        "match_id",
        "start_hour_local",
        "day_of_week_local",
        "ko_type",
        "mtt_pool_allocation_description",
        *level,
        "estrutura_blinds",
        F.col("mtt_blind_up_time_sec").alias("time_blind_match_mtt"),
        "earlybird",
        "has_rebuy",
        "has_addon",
        "mtt_customer_buy_in",
        "mtt_customer_rebuy",
        "mtt_customer_addon",
        "gtd",
        "has_overlay",
        "overlay",
        "mtt_result",
        "collected",
        result.alias("normalized_result"),
        collected.alias("normalized_collected"),
        rate.alias("buyin_gtd_rate"),
    )


def product_facts(
    products: DataFrame, keep: Column, with_start: bool = False, more: Sequence[str] = ()
) -> DataFrame:
    """Distinct products with their buckets, rounded amounts and label, and ``more`` columns."""
    start = F.col("date_start_time_match_utc_local")
    return (
        products.where(keep)
        .select(
            "id_match",
            "match_type_detail_name",
            "class_match",
            "total_players",
            *([start] if with_start else []),
            C.weekday_name(start).alias("day_of_week"),
            C.period_of_day(start).alias("period"),
            C.whole("gtd_match").alias("gtd_match"),
            C.money("buyin_value").alias("buyin_earned"),
            C.money("rebuy_value").alias("rebuy_earned"),
            C.money("addon_value").alias("addon_earned"),
            "overlay_match",
            C.overlay_percent("overlay_match", "gtd_match").alias("overlay_perc"),
            C.overlay_label("overlay_match").alias("overlay_match_bi"),
            "duration_match",
            *more,
        )
        .distinct()
    )


def price_rows(prices: DataFrame) -> DataFrame:
    return prices.select(
        "id_match",
        F.col("value_buyin").alias("buyin_price"),
        F.col("value_rebuy").alias("rebuy_price"),
        F.col("value_addon").alias("addon_price"),
    )


def in_order(joined: DataFrame, facts: DataFrame) -> DataFrame:
    """The prices after the first four columns of the facts."""
    prices = ["buyin_price", "rebuy_price", "addon_price"]
    return joined.select(*facts.columns[:4], *prices, *facts.columns[4:])


def classifier_extract(products: DataFrame, prices: DataFrame) -> DataFrame:
    """Paid tournaments of the home union that lasted, with prices, buckets and label.

    One product may have several prices. Both sides are made distinct first, with
    map-side combine, so repeated rows never reach the join, and a pair of distinct rows
    is itself distinct.
    """
    keep = (
        F.col("match_type_detail_name").startswith("MTT")
        & (F.col("buyin_value") > 0)
        & (F.col("grand_union") == HOME_UNION)
        & ~F.col("name_match").isin(*EXCLUDED_NAMES)
        & C.longer_than("duration_match", SHORTEST)
    )
    facts = product_facts(products, keep)
    return in_order(facts.join(price_rows(prices).distinct(), "id_match"), facts)
