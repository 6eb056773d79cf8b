import subprocess
import sys
from datetime import date

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from gtdlens import schemas
from gtdlens.checks import queries as Q
from gtdlens.operators import modeling as Mo
from gtdlens.operators import splits
from gtdlens.operators import tuning
from gtdlens.operators.neighbours import nearest_points, split_cells
from gtdlens.operators.resample import balanced
from gtdlens.plans import extracts as X
from gtdlens.plans import training as Tr
from gtdlens.session import write_once
from gtdlens.sources import models
from gtdlens.sources import sample_views as V
from gtdlens.streaming.uploads import score_uploads

QUICK = {"n_estimators": 8, "max_depth": 3, "learning_rate": 0.3}


@pytest.fixture(scope="module")
def rows(spark):
    return X.regressor_extract(
        V.tournaments(spark, "/root/testdata/sf0.01"), Q.FIRST_DAY, Q.LAST_DAY, classes=Q.ALL_CLASSES
    ).persist()


@pytest.fixture(scope="module")
def prepared(rows):
    return Tr.prepared_regressor_data(rows, 2)


def test_no_outcome_is_a_feature(prepared):
    _, _, names = prepared
    assert not set(schemas.REGRESSOR_OUTCOMES) & set(names)
    assert "start_hour_local_23" in names and "gtd" in names
    assert not set(schemas.REGRESSOR_OUTCOMES) & set(schemas.REGRESSOR_NUMBERS)


def test_fit_is_repeatable_and_beats_the_median(rows, prepared):
    data, _, names = prepared
    parts = Mo.training_parts(data, 2)
    first, _ = Mo.out_of_fold(data, lambda t: Mo.fit_regressor(t, QUICK), parts)
    second, _ = Mo.out_of_fold(data, lambda t: Mo.fit_regressor(t, QUICK), parts)
    assert first.exceptAll(second).isEmpty()
    assert first.count() == data.count() == first.select("match_id").distinct().count()
    error = first.agg(F.avg("absolute_difference")).first()[0]
    actual = np.array([r[0] for r in first.select("actual").collect()])
    assert error < np.abs(actual - np.median(actual)).mean()
    importances = Mo.feature_importances(data, Mo.fit_regressor(data, QUICK), names)
    assert importances.agg(F.sum("value")).first()[0] == pytest.approx(1.0)
    # The sample amounts grow with the buy-in.
    assert importances.orderBy(F.desc("value")).first()["feature"] in (
        "mtt_customer_buy_in", "buyin_gtd_rate", "mtt_customer_rebuy", "mtt_customer_addon",
    )


def test_saved_model_scores_the_same(spark, rows, prepared, tmp_path):
    data, encoder, _ = prepared
    model = Mo.joined_pipeline(encoder, Mo.fit_regressor(data, QUICK))
    path = models.save_model(model, str(tmp_path / "model"))
    before, after = Tr.score(rows, model), Tr.score(rows, path)
    assert before.exceptAll(after).isEmpty()
    assert set(after.columns) == {*rows.columns, "prediction", "result_pred", "has_overlay_pred"}
    assert models.cached_model(path) is models.cached_model(path)
    fewer = Mo.joined_pipeline(encoder, Mo.fit_regressor(data, QUICK | {"n_estimators": 2}))
    models.save_model(fewer, path)
    assert models.cached_model(path).stages[-1].getNumTrees == 2
    models.save_model(model, path)
    # A batch with an unseen category, a lacking column and no labels still gets scores.
    odd = rows.withColumn("ko_type", F.lit("Satellite")).drop("same_hour_game", "collected")
    assert Tr.score(odd, path).where("prediction is null").isEmpty()
    assert "same_hour_game" not in Tr.score(odd, path).columns


def test_uploads_are_scored(spark, rows, prepared, tmp_path):
    data, encoder, _ = prepared
    model = Mo.joined_pipeline(encoder, Mo.fit_regressor(data, QUICK))
    folders = [str(tmp_path / n) for n in ("in", "out", "progress")]
    rows.write.option("header", True).csv(folders[0])
    for _ in range(2):  # the second run finds nothing new
        score_uploads(spark, model, rows.schema, *folders).awaitTermination()
    found = spark.read.option("header", True).csv(folders[1])
    assert found.count() == rows.count() and "has_overlay_pred" in found.columns


def test_uploads_are_taken_by_their_header(spark, rows, prepared, tmp_path):
    """Files in other column orders, one without a column: the same scores as in one batch."""
    data, encoder, _ = prepared
    model = Mo.joined_pipeline(encoder, Mo.fit_regressor(data, QUICK))
    folders = [str(tmp_path / n) for n in ("in", "out", "progress")]
    even, odd = rows.where("match_id % 2 = 0"), rows.where("match_id % 2 = 1")
    even.select(*reversed(rows.columns)).coalesce(1).write.option("header", True).csv(folders[0])
    odd.drop("earlybird").coalesce(1).write.mode("append").option("header", True).csv(folders[0])
    score_uploads(spark, model, rows.schema, *folders).awaitTermination()
    found = spark.read.option("header", True).csv(folders[1])
    expected = Tr.score(even, model).select("match_id", "prediction").unionByName(
        Tr.score(odd.drop("earlybird"), model).select("match_id", "prediction")
    )
    got = found.selectExpr("cast(match_id as long) as match_id", "cast(prediction as double) as prediction")
    assert got.exceptAll(expected).isEmpty() and expected.exceptAll(got).isEmpty()


def test_uploads_of_one_header_are_one_scan(spark, rows, prepared, tmp_path):
    from gtdlens.streaming.uploads import scored_file, scored_files

    data, encoder, _ = prepared
    model = Mo.joined_pipeline(encoder, Mo.fit_regressor(data, {"n_estimators": 1, "max_depth": 2}))
    paths = []
    for i in range(10):
        part = rows.where(F.col("match_id") % 10 == i).coalesce(1)
        part = part.drop("earlybird") if i % 3 == 0 else part
        part.write.option("header", True).csv(str(tmp_path / str(i)))
        paths += sorted(str(p) for p in (tmp_path / str(i)).glob("*.csv"))
    found = scored_files(spark, model, rows.schema, paths)
    assert found._jdf.queryExecution().executedPlan().toString().count("FileScan") == 2
    alone = [scored_file(spark, model, rows.schema, p) for p in paths]
    expected = alone[0]
    for part in alone[1:]:
        expected = expected.unionByName(part)
    assert found.count() == rows.count() and found.exceptAll(expected).isEmpty()


def test_over_sampling_does_not_depend_on_the_layout(spark):
    """Points on a grid have many equal distances; the same rows come out for any number of partitions."""
    from pyspark.ml.functions import array_to_vector, vector_to_array

    from gtdlens.operators.resample import balanced

    grid = [(i, [float(i % 5), float(i % 7), float(i % 3)], float(i % 6 == 0)) for i in range(600)]
    df = spark.createDataFrame(grid, "id long, x array<double>, label double")
    df = df.select("id", array_to_vector("x").alias("features"), "label")
    results = []
    for partitions in (3, 7, 40):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        made = balanced(df.repartition(partitions), ["id"]).where("synthetic")
        results.append(sorted(map(str, made.select(vector_to_array("features")).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert results[0] == results[1] == results[2] and len(results[0]) == 400


def test_folds_over_windows_are_the_windows(spark, tmp_path):
    extract = X.regressor_extract(
        V.yearly_tournaments(spark, "/root/testdata/sf0.001"), None, None, classes=Q.ALL_CLASSES
    )
    data, _, _ = Tr.prepared_regressor_data(extract, 2, by_day=True)
    windows = splits.rolling_windows(date(1998, 1, 1), date(1999, 1, 1), 33, 6, 6)
    scored, _ = Mo.out_of_window(data, lambda t: Mo.fit_regressor(t, {"n_estimators": 2, "max_depth": 2}), windows)
    assert scored.where("fold <> window_id").isEmpty()
    per_window = scored.groupBy("window_id").agg(F.avg("absolute_difference").alias("e"))
    expected = per_window.agg(F.avg("e")).first()[0]
    assert abs(tuning.mean_fold_mae(scored) - expected) < 1e-9


def test_search_and_refit(spark, prepared):
    data, _, _ = prepared
    table = tuning.trial_table(spark, 2, Q.QUICK_SPACE)
    trials = Tr.trial_rows(table)
    tuned = Tr.tune(data, trials, 2)
    assert tuned.best.score == min(o.score for o in tuned.outcomes)
    assert tuned.best.score == tuning.pooled_median_error(tuned.out_of_fold)
    last = Tr.tune(data, trials[:1], 2, objective=tuning.mean_fold_mse, refit="last_fold")
    parts = Mo.training_parts(data, 2)
    expected, model = Mo.out_of_fold(data, lambda t: Mo.fit_regressor(t, trials[0]), parts)
    trees = [m.toDebugString.split("\n", 1)[1] for m in (last.model, model)]
    assert trees[0] == trees[1]
    assert tuning.mean_fold_mae(expected) > 0
    with pytest.raises(ValueError, match="refit"):
        Tr.tune(data, trials, 2, refit="none")


def test_trial_draws(spark):
    table = tuning.trial_table(spark, 300)
    assert table.exceptAll(tuning.trial_table(spark, 300)).isEmpty()
    pdf = table.toPandas()
    for name, kind in tuning.LARGE_SPACE.items():
        assert pdf[name].between(kind.low, kind.high).all()
    assert set(pdf["min_child_weight"]) == set(range(1, 11))
    assert pdf["reg_alpha"].median() < 0.1 < 1 < pdf["reg_alpha"].max()
    assert list(tuning.trial_table(spark, 2, tuning.SMALL_SPACE).columns) == ["trial_id", *tuning.SMALL_SPACE]


def test_parameters_are_mapped():
    chosen = Mo.spark_parameters(
        {"trial_id": 3, "n_estimators": 9, "max_depth": 4, "colsample_bytree": 1.0, "gamma": 0.5, "reg_alpha": 1.0}
    )
    assert chosen == {"maxIter": 9, "maxDepth": 4, "featureSubsetStrategy": "1.000000", "minInfoGain": 0.5}


def test_window_models_are_saved(spark, tmp_path):
    tournaments = V.yearly_tournaments(spark, "/root/testdata/sf0.001")
    extract = X.regressor_extract(tournaments, date(1995, 1, 1), date(2001, 12, 31), classes=Q.ALL_CLASSES)
    data, encoder, _ = Tr.prepared_regressor_data(extract, 2, by_day=True)
    windows = splits.rolling_windows(date(1990, 1, 1), date(1990, 2, 1)) + splits.rolling_windows(
        date(1999, 1, 31), date(1999, 2, 5)
    )
    trials = [{"trial_id": 0, "n_estimators": 2, "max_depth": 2}]
    fitted, scored = Tr.tune_windows(data, encoder, windows, trials, str(tmp_path), folds=2)
    # The first window lies before all rows: it has no model, but is not lost.
    assert [f.path for f in fitted] == [None, f"{tmp_path}/period=1998-02-28_to_1999-02-27"]
    assert fitted[0].train_rows == 0 < fitted[1].train_rows
    days = scored.agg(F.min("start_date_local"), F.max("start_date_local")).first()
    assert date(1999, 1, 31) <= days[0] and days[1] <= date(1999, 2, 27)
    assert Tr.score(extract, fitted[1].path).count() == extract.count()
    with pytest.raises(ValueError, match="no window"):
        Mo.out_of_window(data, lambda t: Mo.fit_regressor(t, QUICK), windows[:1])


@pytest.fixture(scope="module")
def classified(spark):
    return Tr.prepared_classifier_data(Q.classifier_extract(spark, "/root/testdata/sf0.01"), 3)


def test_classifier_labels(spark, classified):
    data, encoder, names = classified
    assert {r["label"] for r in data.select("label").distinct().collect()} == {0.0, 1.0}
    assert names[:4] == list(schemas.CLASSIFIER_NUMBERS) and "period_dawn" in names
    assert not set(schemas.CLASSIFIER_UNUSED) & set(names)
    model = Mo.joined_pipeline(encoder, Mo.fit_classifier(data, {"n_estimators": 2, "max_depth": 2}))
    rows = Q.classifier_extract(spark, "/root/testdata/sf0.01")
    texts = {r[0] for r in Tr.classify(rows, model).select("outcome_text").distinct().collect()}
    assert texts <= {"PREVISÃO DE LUCRO", "PREVISÃO DE PREJUIZO"}
    form = {
        "buyin_price": 5.5, "rebuy_price": 0.0, "gtd_match": 153.0, "day_of_week": "friday",
        "match_type_detail_name": "MTT-PLO5", "class_match": "Micro", "period": "morning",
    }
    typed = spark.createDataFrame([form])  # without an add-on price
    assert Tr.classify(typed, model).first()["outcome_text"] in texts
    with pytest.raises(Exception, match="Unseen label: noon"):
        Tr.classify(rows.withColumn("period", F.lit("noon")), model).select("prediction").collect()


def test_resampling_leaves_the_test_fold_alone(classified):
    data, _, _ = classified
    seen = []

    def resample(train):
        seen.append(balanced(train, ["id_match"]))
        return seen[-1]

    trials = [{"trial_id": i, "n_estimators": 1 + i, "max_depth": 2} for i in range(2)]
    tuned = Tr.tune(
        data, trials, 2, fit=Mo.fit_classifier, objective=tuning.mean_fold_f1, largest=True,
        refit="last_fold", resample=resample,
    )
    # Two folds, resampled once for both trials.
    assert len(seen) == 2
    assert tuned.best.score == max(o.score for o in tuned.outcomes)
    assert tuned.out_of_fold.count() == data.where("fold < 2").count()
    for i, train in enumerate(seen):
        counts = {r["label"]: r["count"] for r in train.groupBy("label").count().collect()}
        assert counts[0.0] == counts[1.0]
        originals = train.where("not synthetic").select(F.col("features").cast("string"), "label")
        given = data.where(F.col("fold") != i).select(F.col("features").cast("string"), "label")
        assert originals.count() == given.count() and originals.exceptAll(given).isEmpty()


def points_table(spark, x):
    rows = [(i, [float(v) for v in p], 1) for i, p in enumerate(x)]
    return write_once(spark.createDataFrame(rows, "point_id bigint, x array<double>, copies bigint"), "test")


def brute_force(x, k):
    gaps = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    np.fill_diagonal(gaps, np.inf)
    order = np.lexsort((np.broadcast_to(np.arange(len(x)), gaps.shape), gaps), axis=1)[:, :k]
    return {i: list(row) for i, row in enumerate(order)}


@pytest.mark.parametrize("kind", ["spread", "clustered", "grid", "line"])
def test_neighbours_are_exact(spark, kind, monkeypatch):
    from gtdlens.operators import neighbours as N

    monkeypatch.setattr(N, "BLOCK_POINTS", 40)  # several blocks per cell
    random = np.random.default_rng(3)
    x = {
        "spread": random.normal(size=(400, 5)),
        "clustered": np.concatenate([random.normal(size=(300, 3)) * 0.01, random.normal(size=(100, 3)) * 10]),
        "grid": np.array([(i % 20, i // 20) for i in range(400)], dtype=float),
        "line": np.array([(2.0**-i, 0, 0) for i in range(200)]),
    }[kind]
    points = points_table(spark, x)
    found = nearest_points(points, points, 5, cell_points=50)
    got = {r["point_id"]: [n["point_id"] for n in r["near"]] for r in found.collect()}
    assert got == brute_force(x, 5)


def test_block_distances_are_those_of_every_pair(monkeypatch):
    """Far from zero, with ties, repeated ids, missing and enormous numbers; several parts and runs a block."""
    from gtdlens.operators import neighbours as N

    monkeypatch.setattr(N, "RUN", 8)
    random = np.random.default_rng(11)
    x = random.normal(size=(500, 6))
    odd = x.copy()
    odd[3], odd[7, 0], odd[9], odd[11] = np.nan, np.inf, 1e200, 1e154
    ids = random.permutation(500) // 2
    for points in (x, np.round(x), 1e7 + x * 1e-3, odd):
        with np.errstate(all="ignore"):
            gaps = np.sqrt(((points[:60, None] - points[None]) ** 2).sum(axis=2))
        gaps[~np.isfinite(gaps) | (ids[:60, None] == ids[None])] = np.inf
        order = np.lexsort((np.broadcast_to(np.arange(500), gaps.shape), np.broadcast_to(ids, gaps.shape), gaps), axis=1)[:, :5]
        found, at = N.nearest_in_block(points[:60], ids[:60], points, ids, 5)
        want = np.take_along_axis(gaps, order, axis=1)
        assert (np.where(np.isfinite(found), found, np.inf) == want).all()
        assert (at == order)[np.isfinite(want)].all()


def test_block_measures_few_pairs_exactly(monkeypatch):
    from gtdlens.operators import neighbours as N

    marked = []
    measured = N._nearest_of
    monkeypatch.setattr(N, "_nearest_of", lambda q, p, near, *out: (marked.append(near.sum()), measured(q, p, near, *out)))
    x, ids = np.random.default_rng(2).normal(size=(3_000, 64)), np.arange(3_000)
    N.nearest_in_block(x[:1_000], ids[:1_000], x, ids, 5)
    assert 5_000 <= sum(marked) < 0.01 * 1_000 * 3_000


def test_cells_cover_every_point():
    random = np.random.default_rng(1)
    x = random.normal(size=(1000, 4))
    cells = split_cells(x[:200], 16)
    counts = np.bincount(cells.of(x), minlength=16)
    assert len(counts) == 16 and counts.min() > 0
    assert set(split_cells(np.ones((10, 2)), 4).of(x[:, :2])) == {0}


def test_balanced_rows_lie_between_neighbours(spark):
    random = np.random.default_rng(5)
    few = np.concatenate([random.normal(size=(30, 3)), np.zeros((12, 3)), np.ones((3, 3))])
    many = random.normal(size=(160, 3)) + 5
    table = [(i, [float(v) for v in p], float(label)) for i, (p, label) in enumerate(
        [(p, 1) for p in few] + [(p, 0) for p in many]
    )]
    df = spark.createDataFrame(table, "id int, x array<double>, label double").select(
        "id", array_to_vector("x").alias("features"), "label"
    )
    result = balanced(df, ["id"]).select("label", "synthetic", vector_to_array("features").alias("x"))
    rows = result.collect()
    assert sum(r["label"] == 1 for r in rows) == sum(r["label"] == 0 for r in rows) == 160
    made = [np.array(r["x"]) for r in rows if r["synthetic"]]
    assert len(made) == 115 and all(r["label"] == 1 for r in rows if r["synthetic"])
    near = brute_force(few, 5)
    segments = [(few[i], few[j]) for i, js in near.items() for j in js]
    for p in made:
        assert any(
            abs(np.linalg.norm(p - a) + np.linalg.norm(p - b) - np.linalg.norm(a - b)) < 1e-9
            for a, b in segments
        )
    again = balanced(df.repartition(3), ["id"]).select("synthetic", vector_to_array("features").alias("x"))
    assert again.exceptAll(result.select("synthetic", "x")).isEmpty()
    # Twelve equal rows have only each other as nearest neighbours.
    assert sum(not p.any() for p in made) >= 2 * 12


def test_balanced_needs_two_classes(spark):
    df = spark.createDataFrame([(i, 1.0) for i in range(9)], "id int, label double").select(
        "id", array_to_vector(F.array(F.col("id").cast("double"))).alias("features"), "label"
    )
    with pytest.raises(ValueError, match="two classes"):
        balanced(df, ["id"])
    with pytest.raises(ValueError, match="3 minority rows"):
        balanced(df.withColumn("label", (F.col("id") < 3).cast("double")), ["id"])
    even = df.where("id < 8").withColumn("label", (F.col("id") % 2).cast("double"))
    assert balanced(even, ["id"]).where("synthetic").isEmpty()


def test_tasks_carry_their_code(tmp_path):
    from pyspark import cloudpickle

    from gtdlens.operators import neighbours as N

    cells = N.split_cells(np.array([[0.0], [1.0], [2.0], [3.0]]), 2)
    (tmp_path / "task").write_bytes(cloudpickle.dumps((cells, N.nearest_in_block)))
    # Another process, started where the package cannot be imported.
    code = (
        "import pickle, numpy as np; cells, near = pickle.load(open('task', 'rb')); "
        "x = np.array([[0.0], [3.0]]); ids = np.arange(2); "
        "print(cells.of(x).tolist(), near(x, ids, x, ids, 1)[1].tolist())"
    )
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True)
    assert done.stdout.split("\n")[0] == "[0, 1] [[1], [0]]", done.stderr
