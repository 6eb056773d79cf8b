"""The package's tables expressed over the sample star schema (events, orders, lineitem).

The real tables are private, so tests, bench and the registered queries use these
views. Every row of the sample tables is kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gtdlens.functions import columns as C

# Local weekday names, Sunday first.
LOCAL_WEEKDAYS = ("Domingo", "Segunda", "Terça", "Quarta", "Quinta", "Sexta", "Sábado")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(index: Column, *values: str) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def _tournament_columns(
    df: DataFrame,
    *,
    match_id: Column,
    day: Column,
    hour: Column,
    kind: Column,
    group: Column,
    small: Column,
    amount: Column,
) -> DataFrame:
    """Fill the tournament schema from an id, a start, a kind, two integers and an amount."""
    base = df.select(
        match_id.alias("match_id"),
        kind.alias("match_type_detail_name"),
        pick(group % 4, "Micro", "Low", "Medium", "High").alias("class_match"),
        day.alias("start_date_local"),
        hour.cast("int").alias("start_hour_local"),
        C.weekday_name(day, LOCAL_WEEKDAYS).alias("day_of_week_local"),
        F.when(group % 5 == 0, "KO")
        .when(group % 5 == 1, "Mystery Bounty")
        .when(group % 5 == 2, "Progressive KO")
        .otherwise("Regular")
        .alias("ko_type"),
        pick(match_id % 4, "-", "10%", "15% Flat", "20%").alias("mtt_pool_allocation_description"),
        (small % 12 + 1).cast("int").alias("level_reject"),
        pick(match_id % 3, "Hyper", "Turbo", "Standard - no ante").alias("estrutura_blinds"),
        (60 * (group % 10 + 1)).cast("int").alias("mtt_blind_up_time_sec"),
        ((small % 3) / 10.0).cast("double").alias("earlybird"),
        (small % 2 == 0).alias("has_rebuy"),
        (group % 3 == 0).alias("has_addon"),
        (1 + small % 20).cast("double").alias("mtt_customer_buy_in"),
        (20 + 2 * (group % 100)).cast("double").alias("gtd"),
        F.round(amount.cast("decimal(18,2)") + 5 * (1 + small % 20), 2)
        .cast("double")
        .alias("collected"),
    )
    buy_in = F.col("mtt_customer_buy_in")
    result = F.round(C.exact("collected") - C.exact("gtd"), 2).cast("double")

    def per_buy_in(value: str) -> Column:
        return F.round(C.exact(value) / C.exact(buy_in), 6).cast("double")

    derived = base.withColumns(
        {
            "late_registration_time": C.late_registration("mtt_blind_up_time_sec", "level_reject"),
            "mtt_customer_rebuy": F.when(F.col("has_rebuy"), buy_in).otherwise(0.0),
            "mtt_customer_addon": F.when(F.col("has_addon"), 2 * buy_in).otherwise(0.0),
            "mtt_result": result,
            "normalized_collected": per_buy_in("collected"),
            "buyin_gtd_rate": per_buy_in("gtd"),
        }
    )
    return derived.withColumns(
        {
            "overlay": F.least("mtt_result", F.lit(0.0)),
            "has_overlay": F.col("mtt_result") < 0,
            "normalized_mtt_result": per_buy_in("mtt_result"),
        }
    )


def _k() -> Column:
    return F.get_json_object("props", "$.k").cast("int")


def _event_kind() -> Column:
    return (
        F.when(F.col("event_type") == "click", "MTT-NLH")
        .when(F.col("event_type") == "view", "MTT-PLO4")
        .when(F.col("event_type") == "purchase", "MTT-PLO5")
        .when(F.col("event_type") == "signup", "MTT-PLO6")
        .otherwise("CASH")
    )


def tournaments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One tournament per event: a month of starts with a real hour of day."""
    return _tournament_columns(
        table(spark, sf_dir, "events"),
        match_id=F.col("event_id"),
        day=F.col("ts").cast("date"),
        hour=F.hour("ts"),
        kind=_event_kind(),
        group=F.col("user_id"),
        small=_k(),
        amount=F.col("value"),
    )


def yearly_tournaments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One tournament per order: several years of days, for the rolling windows."""
    return _tournament_columns(
        table(spark, sf_dir, "orders"),
        match_id=F.col("o_orderkey"),
        day=F.col("o_orderdate").cast("date"),
        hour=F.col("o_custkey") % 24,
        kind=F.lit("MTT-NLH"),
        group=F.col("o_custkey"),
        small=F.col("o_orderkey") % 100,
        amount=F.col("o_totalprice") % 500,
    )


def predicted(df: DataFrame) -> DataFrame:
    """Add a given prediction, so that reports can be checked without a model."""
    shift = (F.col("match_id") * 7) % 61 - 30
    prediction = (C.exact("collected") + shift).cast("double")
    return df.withColumn("prediction", prediction)


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    event, user = F.col("event_id"), F.col("user_id")
    value = C.exact("value")
    k = F.col("k")
    return table(spark, sf_dir, "events").withColumn("k", _k()).select(
        event.alias("id_match"),
        _event_kind().alias("match_type_detail_name"),
        pick(user % 4, "Micro", "Low", "Medium", "High").alias("class_match"),
        (user + 2).cast("int").alias("total_players"),
        F.col("ts").alias("date_start_time_match_utc_local"),
        ((k % 10) * 25.5).cast("double").alias("gtd_match"),
        value.cast("double").alias("buyin_value"),
        (value / 2).cast("double").alias("rebuy_value"),
        (value / 3).cast("double").alias("addon_value"),
        F.when(event % 11 == 0, F.lit(None))
        .when(event % 3 == 0, -(k * 1.25))
        .when(event % 3 == 1, 0)
        .otherwise(k * 0.5)
        .cast("double")
        .alias("overlay_match"),
        F.concat(F.lit("00:"), F.lpad((event % 60).cast("string"), 2, "0"), F.lit(":00")).alias(
            "duration_match"
        ),
        F.when(user % 2 == 0, 113).otherwise(7).alias("grand_union"),
        F.when(event % 8 == 7, F.lit(None))
        .otherwise(pick(event % 8, "HG", "LIVE", "PVD", "PVT", "CLASS", "OPEN", "MAIN", "-"))
        .alias("name_match"),
    )


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    buy_in = (
        F.when(F.col("l_returnflag") == "A", 5.5).when(F.col("l_returnflag") == "N", 11.0).otherwise(22.0)
    )
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("id_match"),
        buy_in.alias("value_buyin"),
        F.when(F.col("l_linestatus") == "F", 0.0).otherwise(11.0).alias("value_rebuy"),
        buy_in.alias("value_addon"),
    )


def scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planned tournaments as a user would type them, one per event."""
    k, user, event = F.col("k"), F.col("user_id"), F.col("event_id")
    return table(spark, sf_dir, "events").withColumn("k", _k()).select(
        event.alias("scenario_id"),
        F.col("ts").cast("date").alias("start_date_local"),
        (k % 27 - 1 + F.lit(0.5)).cast("double").alias("hour"),
        pick(k % 8, *LOCAL_WEEKDAYS, "Feriado").alias("day_of_week_local"),
        pick(user % 4, "KO", "Mystery Bounty", "Progressive KO", "Regular").alias("ko_type"),
        pick(
            event % 8, "-", "10%", "10% Flat", "10% Plus", "15%", "15% Flat", "20%", "20% Flat"
        ).alias("mtt_pool_allocation_description"),
        pick(
            event % 5, "Hyper", "Hyper - no ante", "Standard - no ante", "Turbo", "Turbo - no ante"
        ).alias("estrutura_blinds"),
        (k % 12 + 1).cast("double").alias("level_reject"),
        (60 * (user % 10 + 1)).cast("double").alias("mtt_blind_up_time_sec"),
        ((k % 3) / 10.0).cast("double").alias("earlybird"),
        F.when(k % 2 == 0, "Sim").otherwise("Nao").alias("has_rebuy"),
        F.when(user % 3 == 0, "Sim").otherwise("Nao").alias("has_addon"),
        (k % 20).cast("double").alias("mtt_customer_buy_in"),
        (k % 20).cast("double").alias("mtt_customer_rebuy"),
        (2 * (k % 20)).cast("double").alias("mtt_customer_addon"),
        (20 + 2 * (user % 100)).cast("double").alias("gtd"),
    )
