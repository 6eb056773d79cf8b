from datetime import date

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from gtdlens import schemas
from gtdlens.operators import slots as S
from gtdlens.plans import extracts as X
from gtdlens.plans import lookups as L
from gtdlens.plans.scenario import scenario_features
from gtdlens.sources import sample_views as V
from gtdlens.sources.tables import conform, typed_rows

DAY, NEXT = date(2024, 1, 1), date(2024, 1, 2)


def starts(spark, rows):
    return spark.createDataFrame(rows, "start_date_local date, start_hour_local int")


def as_dict(df):
    return {(r[0], r[1]): tuple(r[2:]) for r in df.collect()}


def test_neighbour_counts_stay_inside_a_date(spark):
    rows = starts(spark, [(DAY, 0), (DAY, 0), (DAY, 1), (DAY, 3), (DAY, 23), (NEXT, 0), (NEXT, None)])
    counts = S.hour_slot_counts(rows)
    expected = {
        (DAY, 0): (2, 3), (DAY, 1): (1, 3), (DAY, 3): (1, 1), (DAY, 23): (1, 1),
        (NEXT, 0): (1, 1), (NEXT, None): (1, None),
    }
    assert as_dict(S.hour_band_counts(counts)) == expected
    assert as_dict(S.hour_band_counts_joined(counts)) == expected


def test_lookup_also_answers_for_empty_hours(spark):
    counts = S.hour_slot_counts(starts(spark, [(DAY, 0), (DAY, 0), (DAY, 2), (DAY, 23), (DAY, None)]))
    assert as_dict(S.hour_slot_lookup(counts)) == {
        (DAY, 0): (2, 2), (DAY, 1): (0, 3), (DAY, 2): (1, 1), (DAY, 3): (0, 1),
        (DAY, 22): (0, 1), (DAY, 23): (1, 1),
    }


def test_forms_agree_on_random_starts(spark):
    rows = spark.range(3000).select(
        F.expr("date_add(date'2024-01-01', cast(hash(id) % 20 as int))").alias("start_date_local"),
        F.expr("cast(pmod(hash(id, 1), 24) as int)").alias("start_hour_local"),
    )
    counts = S.hour_slot_counts(rows)
    a, b = S.hour_band_counts(counts), S.hour_band_counts_joined(counts)
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def one_tournament(**values):
    row = {
        "match_id": 1, "match_type_detail_name": "MTT-NLH", "class_match": "Micro",
        "start_date_local": DAY, "start_hour_local": 5, "level_reject": 2.5,
        "mtt_customer_buy_in": 2.0, "gtd": 100.0, "mtt_result": 5.0, "collected": 105.0,
    }
    return {**row, **values}


def fact(spark, *rows):
    return typed_rows(spark, rows, schemas.TOURNAMENTS)


def test_extract_edges(spark):
    rows = fact(
        spark,
        one_tournament(),
        one_tournament(match_id=2, start_hour_local=None),
        one_tournament(match_id=3, class_match="High"),
        one_tournament(match_id=4, start_date_local=NEXT),
        one_tournament(match_id=5, start_date_local=date(2024, 1, 3)),
    )
    found = {
        r["match_id"]: (r["level_reject"], r["same_hour_game"], r["one_hour_window_game"])
        for r in X.regressor_extract(rows, DAY, NEXT).collect()
    }
    # Both ends of the period belong to it; a missing hour meets no slot.
    assert found == {1: (3, 1, 1), 2: (3, None, None), 4: (3, 1, 1)}


def test_hours_outside_the_day_count_like_others(spark):
    rows = fact(
        spark,
        one_tournament(match_id=1, start_hour_local=23),
        one_tournament(match_id=2, start_hour_local=24),
        one_tournament(match_id=3, start_hour_local=-1),
    )
    for period in ((DAY, NEXT), (date(1800, 1, 1), date(2300, 1, 1)), (None, None)):
        for by_join in (False, True):
            found = X.regressor_extract(rows, *period, by_join=by_join).collect()
            counts = {r["match_id"]: (r["same_hour_game"], r["one_hour_window_game"]) for r in found}
            assert counts == {1: (1, 2), 2: (1, 2), 3: (1, 1)}


def test_long_period_gives_the_same_rows(spark, small):
    rows = V.tournaments(spark, small)
    near, far = date(2024, 1, 1), date(2024, 12, 31)
    short = X.regressor_extract(rows, near, far)
    long = X.regressor_extract(rows, date(1900, 1, 1), far)
    assert short.exceptAll(long).isEmpty() and long.exceptAll(short).isEmpty()
    assert X.regressor_extract_sql(rows, date(1900, 1, 1), far).exceptAll(short).isEmpty()


def test_small_slots_leave_the_wide_rows_unshuffled(spark, small):
    extract = X.regressor_extract(V.tournaments(spark, small), date(2024, 1, 1), date(2024, 12, 31))
    plan = extract._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1")
    try:
        large = X.regressor_extract(V.tournaments(spark, small), date(2024, 1, 1), date(2024, 12, 31))
        assert "SortMergeJoin" in large._jdf.queryExecution().executedPlan().toString()
        assert large.exceptAll(extract).isEmpty() and extract.exceptAll(large).isEmpty()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_extract_plan(spark, small, capsys):
    X.regressor_extract(V.tournaments(spark, small), date(2023, 1, 1), date(2024, 12, 31)).explain()
    plan = capsys.readouterr().out
    # One scan of the table and one of the written slots, which are broadcast: no wide row is shuffled.
    assert plan.count("FileScan parquet") == 2 and "BroadcastHashJoin" in plan
    assert "Exchange hashpartitioning" not in plan and "SortMergeJoin" not in plan
    assert "PushedFilters: [IsNotNull(ts)" in plan


def test_constrained_by_zero_buy_in(spark):
    rows = fact(
        spark,
        one_tournament(),
        one_tournament(match_id=2, mtt_customer_buy_in=0.0),
        one_tournament(match_id=3, mtt_customer_buy_in=None),
    )
    free = X.constrained_extract(rows, positive_buy_in=False, ratio_range=(33, 1593))
    assert [r["match_id"] for r in free.collect()] == [1]
    row = X.constrained_extract(rows).collect()
    assert [(r["match_id"], r["normalized_result"], r["buyin_gtd_rate"]) for r in row] == [(1, 2.5, 50.0)]


def product(**values):
    from datetime import datetime

    row = {
        "id_match": 1, "match_type_detail_name": "MTT-NLH", "class_match": "Low", "total_players": 9,
        "date_start_time_match_utc_local": datetime(2024, 1, 5, 7), "gtd_match": 50.0,
        "buyin_value": 10.0, "rebuy_value": 5.0, "addon_value": 3.333333, "overlay_match": -5.0,
        "duration_match": "01:00:00", "grand_union": 113, "name_match": "OPEN",
    }
    return {**row, **values}


def price(id_match=1, buyin=5.5, rebuy=0.0, addon=5.5):
    return {"id_match": id_match, "value_buyin": buyin, "value_rebuy": rebuy, "value_addon": addon}


def test_classifier_rows(spark):
    products = typed_rows(
        spark,
        [
            product(), product(),  # a copy: one row
            product(total_players=10),  # same id, other value: its own row
            product(id_match=2, name_match=None),  # NULL is not "not in the list"
            product(id_match=3, name_match="HG"),
            product(id_match=4, duration_match="00:05:00"),
            product(id_match=5, buyin_value=0.0),
            product(id_match=6, grand_union=7),
            product(id_match=7, match_type_detail_name="CASH"),
            product(id_match=8),  # without a price
        ],
        schemas.PRODUCTS,
    )
    ids = range(1, 8)
    prices = typed_rows(
        spark, [price(i) for i in ids] + [price(i) for i in ids] + [price(1, buyin=11.0)], schemas.PRICES
    )
    found = X.classifier_extract(products, prices)
    assert sorted((r["id_match"], r["total_players"], r["buyin_price"]) for r in found.collect()) == [
        (1, 9, 5.5), (1, 9, 11.0), (1, 10, 5.5), (1, 10, 11.0),
    ]
    row = found.first()
    assert (row["day_of_week"], row["period"], row["overlay_perc"], row["overlay_match_bi"]) == (
        "friday", "morning", 10.0, 0.0,
    )


def test_lookups(spark):
    products = typed_rows(spark, [product(), product(id_match=2, gtd_match=60.0)], schemas.PRODUCTS)
    prices = typed_rows(spark, [price(1), price(2), price(1, buyin=9.0)], schemas.PRICES)
    scenario = L.Scenario("MTT", "Low", "friday", "morning", 5.5, 0.0, 5.5, 50.0)
    exact = L.exact_matches(products, prices, scenario).collect()
    assert [(r["id_match"], r["buyin_price"]) for r in exact] == [(1, 5.5)]
    similar = L.similar_matches(products, prices, scenario, L.Ranges(gtd_match=(50, 60))).collect()
    assert sorted((r["id_match"], r["buyin_price"]) for r in similar) == [(1, 5.5), (1, 9.0), (2, 5.5)]
    again = L.similar_matches(products, prices, scenario, L.Ranges(gtd_match=(50, 60)), measured=True)
    assert sorted(again.collect()) == sorted(similar)
    # User text is no pattern and no SQL.
    for text in ("%", "MTT' OR '1'='1"):
        assert L.exact_matches(products, prices, L.Scenario(text, "Low", "friday", "morning")).isEmpty()


def test_scenario_flags(spark):
    form = {
        "scenario_id": 1, "start_date_local": DAY, "hour": 5.9, "day_of_week_local": "Terça",
        "ko_type": "Mystery Bounty", "mtt_pool_allocation_description": "10% Flat",
        "estrutura_blinds": "Turbo - no ante", "level_reject": 10.0, "mtt_blind_up_time_sec": 120.0,
        "has_rebuy": "Sim", "has_addon": "Nao", "mtt_customer_buy_in": 4.0, "gtd": 100.0,
    }
    rows = typed_rows(
        spark, [form, {**form, "scenario_id": 2, "hour": 24.0, "ko_type": "?"}], schemas.SCENARIOS
    )
    slots = S.hour_slot_lookup(S.hour_slot_counts(starts(spark, [(DAY, 4), (DAY, 5), (DAY, 5)])))
    first, second = scenario_features(rows, slots).orderBy("scenario_id").collect()
    flags = {k for k, v in first.asDict().items() if v is True}
    assert flags == {
        "has_rebuy", "start_hour_local_5", "day_of_week_local_Terça", "ko_type_Mystery Bounty",
        "mtt_pool_allocation_description_10% Flat", "estrutura_blinds_Turbo - no ante",
    }
    assert (first["late_registration_time"], first["buyin_gtd_rate"]) == (1200.0, 25.0)
    assert (first["same_hour_game"], first["one_hour_window_game"]) == (2, 3)
    assert not any(second[c] for c in second.asDict() if c.startswith(("start_hour", "ko_type")))
    assert (second["same_hour_game"], second["one_hour_window_game"]) == (0, 0)
    assert len(first) == 14 + 48


def test_conform_checks_columns(spark):
    rows = spark.sql("select 1 as ID_MATCH, 2 as value_buyin, 3.0 as value_rebuy, '4' as value_addon")
    assert conform(rows, schemas.PRICES).first() == (1, 2.0, 3.0, 4.0)
    with pytest.raises(ValueError, match="value_addon"):
        conform(rows.drop("value_addon"), schemas.PRICES)
