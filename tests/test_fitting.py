"""The pool of fits, the ledger that lets a killed search go on, and trials scored by one staged fit."""

import random
import threading
import time
from datetime import date

import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from gtdlens.checks import queries as Q
from gtdlens.operators import fitting
from gtdlens.operators import modeling as Mo
from gtdlens.operators import splits, tuning
from gtdlens.plans import extracts as X
from gtdlens.plans import training as Tr
from gtdlens.sources import models as saved
from gtdlens.sources import sample_views as V

TRIALS = [{"trial_id": i, "n_estimators": n, "max_depth": 2, "learning_rate": 0.3} for i, n in enumerate((2, 1, 3))]


@pytest.fixture(scope="module")
def yearly(spark):
    tournaments = V.yearly_tournaments(spark, "/root/testdata/sf0.001")
    extract = X.regressor_extract(tournaments, date(1995, 1, 1), date(2001, 12, 31), classes=Q.ALL_CLASSES)
    data, encoder, _ = Tr.prepared_regressor_data(extract, 2, by_day=True)
    return data, encoder, splits.rolling_windows(date(1999, 1, 31), date(1999, 4, 5))


def test_pool_runs_what_results_make_possible_and_stops_at_a_failure(spark):
    begun = []

    def task(n):
        def run():
            begun.append(n)
            time.sleep(random.random() / 50)
            if n == 99:
                raise RuntimeError("no")
            return n

        return run

    found = fitting.run_pool(spark, [task(n) for n in range(5)], lambda n: [task(n + 10)] if n < 5 else [], 3)
    assert sorted(found) == [*range(5), *range(10, 15)]
    begun.clear()
    with pytest.raises(RuntimeError, match="no"):
        fitting.run_pool(spark, [task(99), *[task(n) for n in range(100, 300)]], parallelism=2)
    assert len(begun) < 200


def test_predictions_are_one_scan_and_finished_partitions_stay(spark, tmp_path):
    made = []

    def part(k):
        made.append(k)
        return spark.range(k).withColumn("v", F.lit(k))

    root = str(tmp_path)
    for _ in range(2):
        table = fitting.kept_by_partition(spark, root, "unit", {k: lambda k=k: part(k) for k in range(1, 7)})
    assert sorted(made) == list(range(1, 7)) and table.count() == 21
    plan = table._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Union" not in plan


def test_a_killed_search_goes_on(spark, yearly, tmp_path, monkeypatch):
    data, encoder, windows = yearly
    whole = Tr.tune_windows(data, encoder, windows, TRIALS, str(tmp_path / "whole"), folds=2)
    predicted, calls = Mo.SearchBooster.predicted, []

    def failing(self, train, rows):
        calls.append(1)
        if len(calls) == 4:
            raise KeyboardInterrupt("the driver is lost")
        return predicted(self, train, rows)

    root = str(tmp_path / "killed")
    monkeypatch.setattr(Mo.SearchBooster, "predicted", failing)
    with pytest.raises(KeyboardInterrupt):
        Tr.tune_windows(data, encoder, windows, TRIALS, root, folds=2, parallelism=1)
    scores = [e for e in fitting.Ledger(spark, f"{root}/ledger", _search(spark, root)).entries if e.startswith("score")]
    assert 3 <= len(scores) < 6
    models, scored = Tr.tune_windows(data, encoder, windows, TRIALS, root, folds=2)
    # Three windows of two folds: the fits before the failure are not repeated.
    assert len(calls) == 1 + 3 * 2
    assert scored.drop("period").exceptAll(whole[1].drop("period")).isEmpty() and scored.count() == whole[1].count() > 0
    assert [m.best for m in models] == [m.best for m in whole[0]]
    monkeypatch.setattr(Mo, "fit_regressor", None)
    assert Tr.tune_windows(data, encoder, windows, TRIALS, root, folds=2)[1].count() == scored.count()
    with pytest.raises(ValueError, match="another search"):
        Tr.tune_windows(data, encoder, windows, TRIALS[:2], root, folds=2)


def _search(spark, root):
    return spark.read.json(f"{root}/ledger").first()["search"]


def test_window_scores_are_the_mean_fold_errors(spark, yearly, tmp_path):
    data, encoder, windows = yearly
    models, _ = Tr.tune_windows(data, encoder, windows[:1], TRIALS, str(tmp_path), folds=2)
    w = windows[0]
    train = splits.hashed_folds(data.drop("fold"), ["match_id"], 2).where(
        F.col("start_date_local").between(F.lit(w.train_start), F.lit(w.train_end))
    )
    alone = []
    for trial in TRIALS:
        scored, _ = Mo.out_of_fold(train, lambda t: Mo.fit_regressor(Mo.fitting_rows(t, 1), trial), Mo.training_parts(train, 2))
        alone.append(tuning.mean_fold_mae(scored))
    ledger = spark.read.schema(fitting.Ledger.SCHEMA).json(f"{tmp_path}/ledger").where("fold is not null")
    means = {r[0]: r[1] for r in ledger.groupBy("trial_id").agg(F.avg("score")).collect()}
    assert [means[i] for i in range(3)] == pytest.approx(alone)
    assert models[0].best.score == pytest.approx(min(alone))


@pytest.mark.parametrize("fit", [Mo.fit_regressor, Mo.fit_classifier])
def test_first_rounds_equal_a_shorter_fit(spark, fit):
    rows = [([float(i % 7), float(i % 3)], float((i * i) % 11 > 4), i % 2) for i in range(300)]
    df = spark.createDataFrame(rows, "x array<double>, label double, fold int").select(array_to_vector("x").alias("features"), "label", "fold")
    drawn = {"max_depth": 3, "learning_rate": 0.3, "subsample": 0.7, "colsample_bytree": 0.6}
    long, short = fit(df, drawn | {"n_estimators": 5}), fit(df, drawn | {"n_estimators": 2})
    cut = Mo.first_rounds(long, 2)
    assert cut.getNumTrees == 2 and long.getNumTrees == 5 and Mo.first_rounds(long, 5) is long
    assert cut.transform(df).select("prediction").collect() == short.transform(df).select("prediction").collect()
    trials = [{"trial_id": i, "n_estimators": n} | drawn for i, n in enumerate((4, 1, 4, 2))]
    objective = tuning.mean_fold_f1 if fit is Mo.fit_classifier else tuning.pooled_median_error
    together = Tr.tune(df, trials, 2, fit=fit, objective=objective, refit="last_fold")
    for trial, outcome in zip(trials, together.outcomes):
        alone = Tr.tune(df, [trial], 2, fit=fit, objective=objective)
        assert outcome.trial == trial and outcome.score == pytest.approx(alone.best.score, abs=1e-12)
    assert together.model.getNumTrees == together.best.trial["n_estimators"]


def test_staged_draws_share_all_but_the_rounds(spark):
    trials = Tr.trial_rows(tuning.trial_table(spark, 40, tuning.LARGE_SPACE, stages=5))
    groups = tuning.staged_groups(trials)
    assert len(trials) == 40 and [len(g) for g in groups] == [5] * 8
    assert all(g[-1]["n_estimators"] == max(t["n_estimators"] for t in g) for g in groups)
    assert len({t["learning_rate"] for t in trials}) == 8 and len({t["n_estimators"] for t in trials}) > 20
    plain = Tr.trial_rows(tuning.trial_table(spark, 40))
    assert len(tuning.staged_groups(plain)) == 40


def test_window_sizes(spark):
    days = [date(2020, 1, d) for d in (1, 1, 5, 9, 31)] + [date(2020, 2, 3), None]
    df = spark.createDataFrame([(d,) for d in days], "start_date_local date")
    windows = splits.rolling_windows(date(2020, 2, 1), date(2020, 2, 2), 1, 1) + splits.rolling_windows(date(2030, 1, 1), date(2030, 1, 2))
    assert Mo.window_sizes(df, windows) == [(5, 1), (0, 0)]


def test_equal_rows_as_one_give_the_same_model(spark):
    rng = random.Random(4)
    rows = [([float(rng.randrange(3)), float(rng.randrange(4))], rng.uniform(0, 9)) for _ in range(600)]
    df = spark.createDataFrame(rows, "x array<double>, label double").select(array_to_vector("x").alias("features"), "label")
    one = Mo.equal_rows_as_one(df, [])
    assert one.count() == 12 and one.agg(F.sum(Mo.WEIGHT)).first()[0] == 600
    trial = {"n_estimators": 3, "max_depth": 2, "learning_rate": 0.3}
    found = [[r[0] for r in Mo.fit_regressor(t, trial).transform(df).select("prediction").collect()] for t in (df, one)]
    assert found[0] == pytest.approx(found[1], abs=1e-9)
    missing = df.withColumn("label", F.when(F.rand(1) > 0.01, F.col("label")))
    assert Mo.equal_rows_as_one(missing, []).where("label is null").count() > 0
    assert Mo.takes_weights(trial) and not Mo.takes_weights(trial | {"subsample": 0.5})
    assert not Mo.takes_weights(trial | {"min_child_weight": 2})


def test_window_fits_read_equal_rows_once(spark, yearly, tmp_path, monkeypatch):
    """Copies of all rows leave the rows of a fit as they are, and the scores too; fits that draw rows read them all."""
    data, encoder, windows = yearly
    predicted, seen = Mo.SearchBooster.predicted, []

    def counting(self, train, rows):
        seen.append(train.count())
        return predicted(self, train, rows)

    monkeypatch.setattr(Mo.SearchBooster, "predicted", counting)
    shifted = F.col("match_id") + 0
    copies = data.unionByName(data.withColumn("match_id", shifted))
    found = []
    for name, rows, trial in (("one", data, TRIALS[0]), ("two", copies, TRIALS[0]), ("drawn", copies, TRIALS[0] | {"subsample": 0.9})):
        models, scored = Tr.tune_windows(rows, encoder, windows[:1], [trial], str(tmp_path / name), folds=2)
        found.append((sorted(seen), models[0].best.score, scored.count()))
        seen.clear()
    assert found[0][0] == found[1][0] and found[0][1] == pytest.approx(found[1][1]) and found[1][2] == 2 * found[0][2]
    assert sum(found[2][0]) >= 2 * sum(found[1][0])


def test_tasks_of_a_large_table_stay_bounded(spark, monkeypatch):
    """Files of the layout by day hold few rows, and a fit of many rows does not join its partitions."""
    monkeypatch.setattr(Mo, "ROWS_PER_FILE", 100)
    tournaments = V.yearly_tournaments(spark, "/root/testdata/sf0.001")
    extract = X.regressor_extract(tournaments, date(1995, 1, 1), date(2001, 12, 31), classes=Q.ALL_CLASSES)
    data, _, _ = Tr.prepared_regressor_data(extract, 2, by_day=True)
    assert max(r[0] for r in data.groupBy(F.input_file_name()).count().select("count").collect()) <= 100
    wide = spark.range(100, numPartitions=40)
    assert Mo.fitting_rows(wide, Mo.ROWS_PER_TASK + 1).rdd.getNumPartitions() == 40
    assert Mo.fitting_rows(wide, Mo.ROWS_PER_TASK).rdd.getNumPartitions() == 1


def test_window_fold_sizes(spark):
    rows = [(date(2020, 1, d), f) for d, f in ((1, 0), (1, 1), (5, 1), (31, 2))] + [(date(2020, 2, 3), 0), (None, 1)]
    df = spark.createDataFrame(rows, "start_date_local date, fold int")
    windows = splits.rolling_windows(date(2020, 2, 1), date(2020, 2, 2), 1, 1)
    assert Mo.window_fold_sizes(df, windows, 3) == ([4], [[1], [2], [1]])


def test_large_fits_take_turns(spark, monkeypatch):
    """The more rows a fit has, the fewer are at work at a time; small ones share the whole pool."""
    rows = [([float(i % 7)], float(i % 5), i % 6) for i in range(300)]
    df = spark.createDataFrame(rows, "x array<double>, label double, fold int").select(array_to_vector("x").alias("features"), "label", "fold")
    lock, now, most = threading.Lock(), [0], [0]

    def fit(train, trial, **others):
        with lock:
            now[0] += 1
            most[0] = max(most[0], now[0])
        time.sleep(0.2)
        model = Mo.fit_regressor(train, trial, **others)
        with lock:
            now[0] -= 1
        return model

    trial = {"trial_id": 0, "n_estimators": 1, "max_depth": 2}
    Tr.tune(df, [trial], 6, fit=fit)
    assert most[0] > 2
    monkeypatch.setattr(fitting, "ROWS_AT_WORK", 500)
    most[0] = 0
    tuned = Tr.tune(df, [trial], 6, fit=fit)
    assert most[0] <= 2 and tuned.out_of_fold.count() == 300
    most[0] = 0
    found, _ = Mo.out_of_fold(df.withColumn("match_id", F.lit(1)), lambda t: fit(t, trial), Mo.training_parts(df, 6))
    assert most[0] <= 2 and found.count() == 300
    assert [fitting.fits_at_once(n) for n in (0, 10, 100, 10_000)] == [16, 16, 5, 2] and fitting.fits_at_once(10_000, 1) == 1


def test_the_booster_of_a_saved_pipeline_is_read_alone(spark, yearly, tmp_path, monkeypatch):
    data, encoder, windows = yearly
    whole, loads = saved.load_model, []
    monkeypatch.setattr(saved.PipelineModel, "load", lambda path: loads.append(path))
    models, scored = Tr.tune_windows(data, encoder, windows[:1], TRIALS[:1], str(tmp_path), folds=2)
    monkeypatch.undo()
    assert not loads and scored.count() > 0
    pipeline, booster = whole(models[0].path), saved.load_last_stage(spark, models[0].path)
    assert booster.uid == pipeline.stages[-1].uid and len(pipeline.stages) > 9
    predicted = [m.transform(data).select("match_id", "prediction") for m in (booster, pipeline.stages[-1])]
    assert predicted[0].exceptAll(predicted[1]).isEmpty()
