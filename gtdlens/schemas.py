"""Table schemas, feature lists and the fixed vocabularies."""

from __future__ import annotations

from pyspark.sql import types as T

TOURNAMENTS = T.StructType(
    [
        T.StructField("match_id", T.LongType()),
        T.StructField("match_type_detail_name", T.StringType()),
        T.StructField("class_match", T.StringType()),
        T.StructField("start_date_local", T.DateType()),
        T.StructField("start_hour_local", T.IntegerType()),
        T.StructField("day_of_week_local", T.StringType()),
        T.StructField("ko_type", T.StringType()),
        T.StructField("mtt_pool_allocation_description", T.StringType()),
        T.StructField("level_reject", T.DoubleType()),
        T.StructField("estrutura_blinds", T.StringType()),
        T.StructField("mtt_blind_up_time_sec", T.DoubleType()),
        T.StructField("late_registration_time", T.DoubleType()),
        T.StructField("earlybird", T.DoubleType()),
        T.StructField("has_rebuy", T.BooleanType()),
        T.StructField("has_addon", T.BooleanType()),
        T.StructField("mtt_customer_buy_in", T.DoubleType()),
        T.StructField("mtt_customer_rebuy", T.DoubleType()),
        T.StructField("mtt_customer_addon", T.DoubleType()),
        T.StructField("gtd", T.DoubleType()),
        T.StructField("has_overlay", T.BooleanType()),
        T.StructField("overlay", T.DoubleType()),
        T.StructField("mtt_result", T.DoubleType()),
        T.StructField("collected", T.DoubleType()),
        T.StructField("normalized_mtt_result", T.DoubleType()),
        T.StructField("normalized_collected", T.DoubleType()),
        T.StructField("buyin_gtd_rate", T.DoubleType()),
    ]
)

PRODUCTS = T.StructType(
    [
        T.StructField("id_match", T.LongType()),
        T.StructField("match_type_detail_name", T.StringType()),
        T.StructField("class_match", T.StringType()),
        T.StructField("total_players", T.IntegerType()),
        T.StructField("date_start_time_match_utc_local", T.TimestampNTZType()),
        T.StructField("gtd_match", T.DoubleType()),
        T.StructField("buyin_value", T.DoubleType()),
        T.StructField("rebuy_value", T.DoubleType()),
        T.StructField("addon_value", T.DoubleType()),
        T.StructField("overlay_match", T.DoubleType()),
        T.StructField("duration_match", T.StringType()),
        T.StructField("grand_union", T.IntegerType()),
        T.StructField("name_match", T.StringType()),
    ]
)

PRICES = T.StructType(
    [
        T.StructField("id_match", T.LongType()),
        T.StructField("value_buyin", T.DoubleType()),
        T.StructField("value_rebuy", T.DoubleType()),
        T.StructField("value_addon", T.DoubleType()),
    ]
)

IMPORTANCES = T.StructType(
    [T.StructField("feature", T.StringType()), T.StructField("value", T.DoubleType())]
)

# Input of the what-if form: what a user types for one planned tournament.
SCENARIOS = T.StructType(
    [
        T.StructField("scenario_id", T.LongType()),
        T.StructField("start_date_local", T.DateType()),
        T.StructField("hour", T.DoubleType()),
        T.StructField("day_of_week_local", T.StringType()),
        T.StructField("ko_type", T.StringType()),
        T.StructField("mtt_pool_allocation_description", T.StringType()),
        T.StructField("estrutura_blinds", T.StringType()),
        T.StructField("level_reject", T.DoubleType()),
        T.StructField("mtt_blind_up_time_sec", T.DoubleType()),
        T.StructField("earlybird", T.DoubleType()),
        T.StructField("has_rebuy", T.StringType()),
        T.StructField("has_addon", T.StringType()),
        T.StructField("mtt_customer_buy_in", T.DoubleType()),
        T.StructField("mtt_customer_rebuy", T.DoubleType()),
        T.StructField("mtt_customer_addon", T.DoubleType()),
        T.StructField("gtd", T.DoubleType()),
    ]
)

# Results of a tournament: known only afterwards, so never a model input.
REGRESSOR_OUTCOMES = (
    "has_overlay",
    "overlay",
    "mtt_result",
    "collected",
    "normalized_mtt_result",
    "normalized_collected",
)
REGRESSOR_LABEL = "collected"
REGRESSOR_KEYS = ("match_id", "start_date_local")
REGRESSOR_CATEGORIES = (
    "start_hour_local",
    "day_of_week_local",
    "ko_type",
    "mtt_pool_allocation_description",
    "estrutura_blinds",
)
REGRESSOR_NUMBERS = (
    "level_reject",
    "mtt_blind_up_time_sec",
    "late_registration_time",
    "earlybird",
    "has_rebuy",
    "has_addon",
    "mtt_customer_buy_in",
    "mtt_customer_rebuy",
    "mtt_customer_addon",
    "gtd",
    "buyin_gtd_rate",
    "same_hour_game",
    "one_hour_window_game",
)

CLASSIFIER_UNUSED = (
    "id_match",
    "total_players",
    "buyin_earned",
    "rebuy_earned",
    "addon_earned",
    "overlay_match",
    "overlay_perc",
    "duration_match",
)
CLASSIFIER_LABEL = "overlay_match_bi"
CLASSIFIER_CATEGORIES = ("match_type_detail_name", "class_match", "day_of_week", "period")
CLASSIFIER_NUMBERS = ("buyin_price", "rebuy_price", "addon_price", "gtd_match")

# The closed vocabularies of the what-if form, in feature order.
FORM_VOCABULARY = {
    "start_hour_local": [str(hour) for hour in range(24)],
    "day_of_week_local": [
        "Domingo", "Quarta", "Quinta", "Segunda", "Sexta", "Sábado", "Terça",
    ],
    "ko_type": ["KO", "Mystery Bounty", "Progressive KO", "Regular"],
    "mtt_pool_allocation_description": [
        "-", "10%", "10% Flat", "10% Plus", "15%", "15% Flat", "20%", "20% Flat",
    ],
    "estrutura_blinds": [
        "Hyper", "Hyper - no ante", "Standard - no ante", "Turbo", "Turbo - no ante",
    ],
}
