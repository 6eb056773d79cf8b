from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from gtdlens import schemas
from gtdlens.operators import metrics as M
from gtdlens.plans import reports as R
from gtdlens.sources import tables

D1, D2 = date(2024, 1, 1), date(2024, 1, 2)


@pytest.fixture(scope="module")
def scored(spark):
    rows = [
        (1, D1, 100.0, 90.0, -10.0, True, 95.0),
        (2, D1, 100.0, 130.0, 30.0, False, 120.0),
        (3, D1, 100.0, 120.0, 20.0, False, None),
        (4, D2, 100.0, 0.0, -100.0, True, 50.0),
        (5, D2, 100.0, 110.0, 10.0, False, 99.0),
    ]
    columns = (
        "match_id int, start_date_local date, gtd double, collected double, mtt_result double, "
        "has_overlay boolean, prediction double"
    )
    return R.with_outcome(spark.createDataFrame(rows, columns))


def test_outcome(scored):
    assert [r["has_overlay_pred"] for r in scored.orderBy("match_id").collect()] == [
        True, False, False, True, True,
    ]


def test_day_without_a_kept_tournament_is_skipped(scored):
    days = {r["start_date_local"]: tuple(r)[1:] for r in R.daily_result_gap(scored).collect()}
    assert days == {D1: (40.0, 50.0, -10.0), D2: (-90.0, None, None)}
    assert R.result_gap_total(scored).first()[0] == -10.0


def test_daily_breakdown(scored):
    days = {r["start_date_local"]: r.asDict() for r in R.daily_profit_breakdown(scored).collect()}
    assert (days[D1]["total_overlay_actual"], days[D1]["total_overlay_pred"]) == (-10.0, -10.0)
    assert (days[D1]["profit_actual"], days[D1]["profit_pred"], days[D1]["dif_profit"]) == (50.0, 50.0, 0.0)
    assert (days[D2]["profit_actual"], days[D2]["profit_pred"], days[D2]["dif_profit"]) == (10.0, 0.0, 10.0)
    assert days[D1]["profit_dif_total"] == 50.0 and days[D2]["profit_dif_total"] is None


def test_confusion_has_all_cells(spark, scored):
    cells = {(r["actual"], r["predicted"]): r["rows"] for r in R.overlay_confusion(scored).collect()}
    assert cells == {(0, 0): 2, (0, 1): 1, (1, 0): 0, (1, 1): 2}
    odd = spark.createDataFrame([(0.5, 1.0), (2.0, 2.0), (None, 1.0), (1.0, 1.0)], "a double, p double")
    assert [r["rows"] for r in M.confusion_matrix(odd, "a", "p").collect()] == [0, 0, 0, 1]


def test_errors_of_zero_actual(scored):
    row = M.with_errors(scored, "collected").where("match_id = 4").first()
    assert (row["absolute_difference"], row["squared_difference"]) == (50.0, 2500.0)
    assert row["error_percentage"] is None and row["absolute_error_percentage"] is None


def report(spark, pairs):
    df = spark.createDataFrame(pairs, "a int, p int")
    return {r["label"]: tuple(r)[1:] for r in M.classification_report(df, "a", "p").collect()}


def test_classification_report(spark):
    found = report(spark, [(0, 0)] * 3 + [(0, 1)] + [(1, 1)] * 4 + [(1, 0)] * 2)
    assert found["0"] == (0.6, 0.75, pytest.approx(2 / 3), 4)
    assert found["1"] == (0.8, pytest.approx(2 / 3), pytest.approx(8 / 11), 6)
    assert found["accuracy"] == (None, None, 0.7, 10)
    assert found["macro avg"][2] == pytest.approx((2 / 3 + 8 / 11) / 2)
    assert found["weighted avg"][1] == pytest.approx(0.7)


def test_class_that_never_occurs_scores_zero(spark):
    found = report(spark, [(1, 1), (1, 1)])
    assert found["0"] == (0.0, 0.0, 0.0, 0) and found["1"] == (1.0, 1.0, 1.0, 2)
    df = spark.createDataFrame([(0, 1, 1), (1, 0, 0)], "fold int, a int, p int")
    scores = M.fold_scores(df, "fold", f1=M.class_f1("a", "p"))
    f1 = {r["fold"]: r["f1"] for r in scores.collect()}
    assert f1 == {0: 0.0, 1: 1.0}


def test_folds_count_once_whatever_their_size(spark):
    rows = [(0, 1.0, 2.0)] + [(1, 1.0, 4.0)] * 3
    df = spark.createDataFrame(rows, "fold int, a double, p double")
    scores = M.fold_scores(
        df, "fold", mae=M.mean_absolute_error("a", "p"), mse=M.mean_squared_error("a", "p")
    )
    means = M.mean_of_folds(scores, "mae", "mse").first()
    assert (means["mean_mae"], means["mean_mse"]) == (2.0, 5.0)


def test_r_squared_is_not_the_squared_correlation(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (3.0, 6.0)], "a double, p double")
    assert df.agg(M.r_squared("a", "p")).first()[0] == pytest.approx(1 - 14 / 2)
    flat = spark.createDataFrame([(1.0, 2.0), (1.0, 4.0)], "a double, p double")
    assert flat.agg(M.r_squared("a", "p")).first()[0] is None


def test_min_max(spark):
    df = spark.createDataFrame([(5.0,), (10.0,), (None,), (7.5,)], "x double")
    assert [r["s"] for r in M.min_max_scaled(df, "x", "s").collect()] == [0.0, 100.0, None, 50.0]
    flat = spark.createDataFrame([(5.0,), (5.0,)], "x double")
    assert [r["s"] for r in M.min_max_scaled(flat, "x", "s").collect()] == [None, None]


def test_box(spark):
    values = [1.0, 2.0, 3.0, 4.0, 100.0]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    row = M.box_statistics(df, {"x": F.col("x"), "none": F.lit(None).cast("double")}).collect()
    assert tuple(row[0]) == ("x", 22.0, 3.0, 2.0, 4.0, 1.0, 4.0)
    assert tuple(row[1]) == ("none", None, None, None, None, None, None)
    assert np.quantile(values, 0.25) == 2.0


def test_chart_rows(scored):
    long = R.chart_rows(scored, ["match_id"], ["collected", "prediction"])
    assert long.count() == 10 and set(long.columns) == {"match_id", "series", "value"}


def test_importances_from_csv(spark, tmp_path):
    path = tmp_path / "importances.csv"
    path.write_text(",0\nBUYIN_PRICE,0.2\nPERIOD_dawn,0.5\nGTD_MATCH,0.1\nADDON_PRICE,0.2\n")
    ranked = R.importances_from_csv(spark, str(path))
    assert ranked.columns == ["Feature Importance", "Value"]
    assert [r[0] for r in ranked.collect()] == ["PERIOD_dawn", "ADDON_PRICE", "BUYIN_PRICE", "GTD_MATCH"]


def test_best_trial(spark):
    trials = spark.createDataFrame(
        [(0, 3.0), (1, 1.0), (2, 1.0), (3, None)], "trial_id int, score double"
    )
    assert R.best_trial(trials, "score").first()["trial_id"] == 1
    assert R.best_trial(trials, "score", largest=True).first()["trial_id"] == 0


def test_csv_keeps_values(spark, tmp_path, scored):
    path = str(tmp_path / "scored")
    tables.write_csv(scored, path)
    back = tables.read_csv(spark, path, scored.schema)
    assert back.exceptAll(scored).isEmpty() and scored.exceptAll(back).isEmpty()


def test_tables_are_read_in_schema_order(spark, tmp_path):
    path = str(tmp_path / "importances")
    spark.sql("select 1 as VALUE, 'a' as feature, 2 as other").write.parquet(path)
    assert tables.read_table(spark, path, schemas.IMPORTANCES).first() == ("a", 1.0)
    assert len(tables.read_table(spark, path).columns) == 3


def test_sql_parameters(spark, scored):
    text = "select match_id from {rows} where gtd >= :low and start_date_local = :day"
    found = tables.run_sql(spark, text, {"low": 100.0, "day": D2}, rows=scored)
    assert sorted(r[0] for r in found.collect()) == [4, 5]
