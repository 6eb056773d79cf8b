"""Fits inside one task grow the trees that Spark's regressor grows, and a search of small windows takes few jobs."""

from datetime import date

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from gtdlens.checks import queries as Q
from gtdlens.operators import modeling as Mo
from gtdlens.operators import small_fits as S
from gtdlens.operators import splits
from gtdlens.plans import extracts as X
from gtdlens.plans import training as Tr
from gtdlens.sources import sample_views as V
from gtdlens.sources.models import JoinedSaver, load_model, save_model

DRAWN = {"trial_id": 0, "n_estimators": 3, "max_depth": 3, "learning_rate": 0.4, "subsample": 0.7, "colsample_bytree": 0.5}


@pytest.fixture(scope="module")
def yearly(spark):
    tournaments = V.yearly_tournaments(spark, "/root/testdata/sf0.001")
    extract = X.regressor_extract(tournaments, date(1995, 1, 1), date(2001, 12, 31), classes=Q.ALL_CLASSES)
    data, encoder, _ = Tr.prepared_regressor_data(extract, 3, by_day=True)
    return data, encoder, splits.rolling_windows(date(1999, 1, 31), date(1999, 4, 5))


def features(spark, n):
    """Numbers of few and of many values, one that is always zero, and two flags that are marked as such."""
    r = F.col("id")
    numbers = {
        "few": r % 7 - 2.0,
        "many": F.sin(r * 1.7) * 100,
        "mostly_zero": F.when(r % 11 == 0, F.sqrt(r * 1.0)).otherwise(0.0),
        "zero": F.lit(0.0),
    }
    flags = {"odd": (r * 31 % 13 < 5).cast("double"), "even": (r * 31 % 13 >= 5).cast("double")}
    label = F.round(F.col("few") * F.col("many") + 40 * F.col("odd") * F.cos(r * 0.3) + r % 29, 2).alias("label")
    rows = spark.range(n, numPartitions=1).select("id", *[c.alias(name) for name, c in (numbers | flags).items()]).select("*", label)
    marked = {name: {"ml_attr": {"type": "binary", "name": name}} for name in flags}
    for name, metadata in marked.items():
        rows = rows.withMetadata(name, metadata)
    return VectorAssembler(inputCols=[*numbers, *flags], outputCol="features").transform(rows).select("id", "features", "label")


def arrays(df):
    table = df.select(vector_to_array("features").alias("x"), "label").toArrow()
    x = table.column("x").combine_chunks().flatten().to_numpy().reshape(table.num_rows, -1)
    return np.ascontiguousarray(x.T), table.column("label").to_numpy()


@pytest.mark.parametrize(
    "n, trial",
    [
        (40, DRAWN),
        (3_000, DRAWN),
        (3_000, {"n_estimators": 2, "max_depth": 6, "learning_rate": 0.1}),
        (3_000, DRAWN | {"gamma": 30.0, "min_child_weight": 40, "max_bins": 6, "max_depth": 5}),
        (3_000, {"n_estimators": 2, "max_depth": 0}),
        (14_000, DRAWN | {"max_depth": 5}),
        (30_000, DRAWN),
    ],
)
def test_the_trees_are_those_of_spark(spark, n, trial):
    df = features(spark, n)
    flags = S.flags_of(df.schema["features"])
    assert flags == [4, 5]
    x, label = arrays(df)
    booster = S.SmallBooster(x, label, Mo.spark_parameters(trial), 42, flags)
    model = Mo.fit_regressor(df, trial)
    theirs = np.array([r[0] for r in model.transform(df).select("prediction").collect()])
    shorter = np.array([r[0] for r in Mo.first_rounds(model, 1).transform(df).select("prediction").collect()])
    mine, first = booster.predict(x, [None, 1])
    assert np.abs(mine - theirs).max() < 1e-9 and np.abs(first - shorter).max() < 1e-9
    assert len(np.unique(mine)) > 1 or trial["max_depth"] == 0


def test_generators(spark):
    generator = spark._jvm.org.apache.spark.util.random.XORShiftRandom
    for seed in (42, -7):
        there = generator(seed)
        assert [there.nextDouble() for _ in range(1_100)] == S.uniforms(seed, 1_100).tolist()
    assert sorted(S.drawn_features(9, 9, 5)) == list(range(9)) and len(set(S.drawn_features(90, 20, 5))) == 20


def test_unusable_rows_are_refused(spark):
    x, label = arrays(features(spark, 50))
    x[4, 3] = 0.5
    with pytest.raises(ValueError, match="flag"):
        S.SmallBooster(x, label, {}, 42, [4, 5])
    df = features(spark, 50).withColumns({"fold": F.col("id").cast("int") % 2, "label": F.when(F.col("id") != 3, F.col("label"))})
    with pytest.raises(Exception, match="a row has no label"):
        S.out_of_fold_in_one_task(df, {}, 42, {"p": None}).collect()


def jobs(spark, group, work):
    spark.sparkContext.setJobGroup(group, group)
    try:
        return work(), len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_a_search_of_small_windows_takes_few_jobs(spark, yearly, tmp_path, monkeypatch):
    """One task makes all fits of a trial in a window; the scores and the models are those of Spark's own fits."""
    data, encoder, windows = yearly
    trials = [DRAWN, DRAWN | {"trial_id": 1, "learning_rate": 0.1}, DRAWN | {"trial_id": 2, "n_estimators": 1}]

    def searched(name, **pool):
        return Tr.tune_windows(data, encoder, windows, trials, str(tmp_path / name), folds=3, **pool)

    (models, scored), few = jobs(spark, "few", lambda: searched("few"))
    monkeypatch.setattr(Mo, "CELLS_PER_TASK", 0)
    (alone, again), many = jobs(spark, "many", lambda: searched("many", parallelism=1))
    # Three windows of two groups of trials and three folds: 18 fits of the search, and three last ones.
    assert few < 110 < many
    assert [m.best for m in models] == [m.best for m in alone] and len({m.best.score for m in models}) == 3
    columns = ["window_id", "match_id", "actual", "prediction"]
    assert scored.select(columns).exceptAll(again.select(columns)).isEmpty() and scored.count() == again.count() > 0
    kept = [spark.read.json(str(tmp_path / name / "ledger")).where("fold is not null") for name in ("few", "many")]
    scores = [{(r.entry, r.trial_id, r.fold): r.score for r in table.collect()} for table in kept]
    assert scores[0] == pytest.approx(scores[1], rel=1e-12) and len(scores[0]) == 27


def test_large_windows_read_the_folds_they_come_with(spark, yearly, tmp_path, monkeypatch):
    """A table that has the search's folds already is not written again, unless a window is fitted in one partition."""
    data, encoder, windows = yearly
    plain, written = Tr.write_once, []

    def kept(df, name, *rest):
        written.append(name)
        return plain(df, name, *rest)

    monkeypatch.setattr(Tr, "write_once", kept)
    counts = []
    for most, folds in ((Mo.ROWS_PER_TASK, 3), (0, 3), (0, 2)):
        monkeypatch.setattr(Mo, "ROWS_PER_TASK", most)
        models, scored = Tr.tune_windows(data, encoder, windows[:1], [DRAWN], str(tmp_path / f"{most}-{folds}"), folds=folds)
        counts.append((written.count("windows"), models[0].train_rows, scored.count()))
        written.clear()
    assert [n for n, *_ in counts] == [1, 0, 1] and len({tuple(rest) for _, *rest in counts}) == 1
    other = data.withColumn("fold", F.col("fold") + 0)
    assert splits.has_hashed_folds(data, ["match_id"], 3) and not splits.has_hashed_folds(other, ["match_id"], 3)
    assert not splits.has_hashed_folds(data, ["match_id"], 3, seed=1) and not splits.has_hashed_folds(data.drop("fold"), ["match_id"], 3)


def test_a_joined_pipeline_is_what_saving_all_stages_gives(spark, yearly, tmp_path):
    data, encoder, _ = yearly
    model = Mo.fit_regressor(data, {"n_estimators": 2, "max_depth": 2})
    whole = load_model(save_model(Mo.joined_pipeline(encoder, model), str(tmp_path / "whole")))
    saver = JoinedSaver(spark, encoder, str(tmp_path / "encoder"))
    for _ in range(2):  # the second takes the place of the first
        joined = load_model(saver.save(model, str(tmp_path / "joined")))
        assert [s.uid for s in joined.stages] == [s.uid for s in whole.stages]
    rows = X.regressor_extract(V.yearly_tournaments(spark, "/root/testdata/sf0.001"), None, None, classes=Q.ALL_CLASSES)
    found = [Tr.score(rows, m).select("match_id", "prediction") for m in (joined, whole)]
    assert found[0].exceptAll(found[1]).isEmpty() and found[0].count() > 100
