"""The model queries' schedules, without fitting a model."""

import pytest
from pyspark.sql import functions as F

from gtdlens.checks import queries, value_queries
from gtdlens.operators import splits
from gtdlens.plans import training as Tr


def validated_once(data, windows):
    """Every row from the first validation day on is in exactly one validation interval."""
    roles = splits.assign_windows(data.select("match_id", "start_date_local"), windows).where("role = 'valid'")
    due = data.where(F.col("start_date_local") >= F.lit(windows[0].valid_start)).select("match_id")
    assert [w.window_id for w in windows] == list(range(len(windows))) and len(windows) > 60
    assert sorted(r.match_id for r in roles.collect()) == sorted(r.match_id for r in due.collect())


@pytest.mark.parametrize("query", ["temporal_cv", "temporal_search", "window_tuning"])
def test_monthly_windows_reach_every_row(spark, small, monkeypatch, query):
    seen = {}

    def windowed(data, fit, windows, *rest):
        seen.update(data=data, windows=windows)
        return data, None

    def tuned(data, trials, folds=0, windows=(), **rest):
        seen.update(data=data, windows=windows)
        return Tr.Tuned(None, [], None, None)

    def per_window(data, encoder, windows, trials, root, folds):
        seen.update(data=data, windows=windows, folds=folds)
        return [], data

    monkeypatch.setattr(queries.Mo, "out_of_window", windowed)
    monkeypatch.setattr(queries.Tr, "tune", tuned)
    monkeypatch.setattr(queries.Tr, "tune_windows", per_window)
    getattr(queries, query)(spark, small)
    validated_once(seen["data"], seen["windows"])
    assert seen.get("folds", 5) == 5


@pytest.mark.parametrize("query, folds", [("cv_oof", 10), ("tune_and_refit", 10), ("classifier_cv_f1", 10), ("classifier_search", 10)])
def test_folds(spark, small, monkeypatch, query, folds):
    seen = {}

    def out_of_fold(data, fit, parts):
        seen.update(folds=len(parts), found=data.select("fold").distinct().count())
        return data.withColumns({"actual": F.col("label"), "prediction": F.col("label")}), None

    def tuned(data, trials, folds, **rest):
        seen.update(folds=folds, found=data.select("fold").distinct().count(), **rest)
        return Tr.Tuned(None, [], None, None)

    monkeypatch.setattr(queries.Mo, "out_of_fold", out_of_fold)
    monkeypatch.setattr(queries.Mo, "training_parts", lambda data, folds, *rest: dict.fromkeys(range(folds)))
    monkeypatch.setattr(queries.Tr, "tune", tuned)
    getattr(queries, query)(spark, small)
    assert seen["folds"] == seen["found"] == folds
    if query == "classifier_search":
        assert seen["objective"] is queries.tuning.mean_fold_f1 and seen["largest"] and seen["resample"]


def test_all_monthly_windows_get_a_model(spark, small, monkeypatch):
    seen = {}

    def per_window(data, encoder, windows, trials, root, folds):
        seen.update(data=data, windows=windows)
        columns = {"window_id": F.lit(0), "period": F.lit(""), "actual": F.col("label"), "prediction": F.col("label")}
        return [], data.withColumns(columns)

    monkeypatch.setattr(value_queries.Tr, "tune_windows", per_window)
    value_queries.stump_all_window_models(spark, small)
    validated_once(seen["data"], seen["windows"])
