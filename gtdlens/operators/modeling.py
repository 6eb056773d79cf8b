"""Boosted-tree models on Spark ML: fitting, folds, importances."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable, Mapping, Sequence
from functools import partial
from itertools import accumulate

from pyspark import SparkContext
from pyspark.ml import Model, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.regression import GBTRegressor
from pyspark.ml.wrapper import JavaWrapper
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField

from gtdlens.operators import encoding as E
from gtdlens.operators.fitting import PARALLEL_FITS, fits_at_once, kept_by_partition
from gtdlens.operators.metrics import with_errors
from gtdlens.operators.small_fits import flags_of, out_of_fold_in_one_task
from gtdlens.session import new_path

Fit = Callable[[DataFrame], Model]

# Rows up to which a fit is one task.
ROWS_PER_TASK = 200_000
# Numbers that a task holds at once to fit by itself: 50 MB, and a few times as much while it fits.
CELLS_PER_TASK = 6_250_000
# Rows of a file of a table that is laid out by day. A task reads about twenty files at most, however large the table, and
# the files of a window lie in many tasks.
ROWS_PER_FILE = 25_000
WEIGHT = "weight"

# Search parameter -> Spark ML parameter. ``colsample_bytree`` becomes a
# share of features per node; ``reg_alpha`` and ``reg_lambda`` have no counterpart and
# stay in the trial table unused.
PARAMETERS = {
    "n_estimators": "maxIter",
    "max_depth": "maxDepth",
    "learning_rate": "stepSize",
    "subsample": "subsamplingRate",
    "colsample_bytree": "featureSubsetStrategy",
    "gamma": "minInfoGain",
    "min_child_weight": "minInstancesPerNode",
    "max_bins": "maxBins",
}


def spark_parameters(trial: Mapping[str, object]) -> dict[str, object]:
    chosen: dict[str, object] = {}
    for name, target in PARAMETERS.items():
        if trial.get(name) is None:
            continue
        # The strategy is a text; "1.0" means all features where "1" would mean one.
        value = trial[name]
        chosen[target] = f"{float(value):.6f}" if target == "featureSubsetStrategy" else value
    return chosen


def fit_regressor(
    train: DataFrame, parameters: Mapping[str, object], label: str = "label", seed: int = 42
) -> Model:
    return regressor(parameters, label, seed, WEIGHT in train.columns).fit(train)


def regressor(
    parameters: Mapping[str, object], label: str = "label", seed: int = 42, weighted: bool = False
) -> GBTRegressor:
    booster = GBTRegressor(featuresCol="features", labelCol=label, seed=seed)
    if weighted:
        booster.setWeightCol(WEIGHT)
    return booster.setParams(**spark_parameters(parameters))


def fit_classifier(
    train: DataFrame, parameters: Mapping[str, object], label: str = "label", seed: int = 42
) -> Model:
    booster = GBTClassifier(featuresCol="features", labelCol=label, seed=seed)
    return booster.setParams(**spark_parameters(parameters)).fit(train)


def first_rounds(model: Model, rounds: int) -> Model:
    """The booster as it was after its first rounds: what a fit of that many rounds with the same seed gives."""
    shorter = _shortened(model._java_obj, rounds)
    return model if shorter is model._java_obj else type(model)(shorter)


def _shortened(booster, rounds: int):
    if rounds >= booster.getNumTrees():
        return booster
    jvm = SparkContext._active_spark_context._jvm
    trees, weights = booster.trees(), booster.treeWeights()
    shorter = JavaWrapper._new_java_obj(
        booster.getClass().getName(),
        booster.uid(),
        JavaWrapper._new_java_array(trees[:rounds], jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel),
        JavaWrapper._new_java_array(weights[:rounds], jvm.double),
    )
    booster.copyValues(shorter, booster.extractParamMap())
    return shorter


class SearchBooster:
    """A regressor for the many short fits of a search: each fit predicts other rows at several numbers of rounds.

    The fitted model stays in the JVM. Its Python mirror asks for every tree when it is made, which takes longer than
    a small fit and holds up all other fits meanwhile. With ``in_one_task`` the same table is both, in one partition and with
    all folds: one task predicts each row's label by a fit on the rows of all other folds, with the same trees.
    """

    def __init__(
        self,
        parameters: Mapping[str, object],
        stages: Mapping[str, int | None],
        weighted: bool = False,
        in_one_task: bool = False,
    ):
        """stages: prediction column -> number of rounds, None for all."""
        self.estimator, self.stages = regressor(parameters, weighted=weighted), dict(stages)
        self.parameters, self.in_one_task = spark_parameters(parameters), in_one_task
        self.estimator._transfer_params_to_java()

    def predicted(self, train: DataFrame, rows: DataFrame) -> DataFrame:
        if self.in_one_task:
            return out_of_fold_in_one_task(rows, self.parameters, self.estimator.getSeed(), self.stages)
        model, frame = self.estimator._java_obj.fit(train._jdf), rows._jdf
        for column, rounds in self.stages.items():
            stage = model if rounds is None else _shortened(model, rounds)
            frame = stage.setPredictionCol(column).transform(frame)
        return DataFrame(frame, rows.sparkSession)


def split_label(
    rows: DataFrame, label: str, outcomes: Sequence[str], keys: Sequence[str] = ()
) -> DataFrame:
    """Feature columns and the label: every outcome column is taken out of the features."""
    drop = [c for c in outcomes if c in rows.columns and c not in keys]
    return rows.withColumn("label", F.col(label).cast("double")).drop(*drop, label)


def binary_labels(rows: DataFrame, label: str) -> DataFrame:
    """Rows a classifier can learn from: the label is 0 or 1, not an amount or missing."""
    return rows.where(F.col(label).isin(0.0, 1.0))


def encoded(
    rows: DataFrame,
    categories: Sequence[str],
    numbers: Sequence[str],
    label: str,
    keep: Sequence[str] = (),
    strict: bool = False,
    vocabulary: E.Vocabulary | None = None,
) -> tuple[DataFrame, PipelineModel, list[str]]:
    """Rows as (kept columns, features, label), with the fitted encoder and feature names.

    The encoder is fitted on these rows unless a vocabulary is given.
    """
    vocabulary = vocabulary or E.fit_vocabulary(rows, categories)
    encoder, names = E.fit_feature_pipeline(rows, vocabulary, numbers, strict)
    data = encoder.transform(rows).select(
        *keep, "features", F.col(label).cast("double").alias("label")
    )
    return data, encoder, names


def joined_pipeline(encoder: PipelineModel, model: Model) -> PipelineModel:
    """Encoder and booster as one artefact, so scoring needs a single folder."""
    return PipelineModel([*encoder.stages, model])


def training_parts(
    data: DataFrame,
    folds: int,
    resample: Callable[[DataFrame], DataFrame] | None = None,
    fold: str = "fold",
) -> dict[int, DataFrame]:
    """The rows outside each fold; ``resample`` changes these and never the fold itself."""
    parts = {i: data.where(F.col(fold) != i) for i in range(folds)}
    return parts if resample is None else {i: resample(part) for i, part in parts.items()}


def fitting_rows(train: DataFrame, rows: int) -> DataFrame:
    """A small table in one partition: its fit is a row of jobs, and each is over sooner in one task.

    A larger one stays as its files are: joined partitions hold as many rows of a window as happen to meet in them.
    """
    return train.coalesce(1) if rows <= ROWS_PER_TASK else train


def fits_in_one_task(features: StructField, rows: int, width: int) -> bool:
    """Whether a task can hold all rows of a window at once, and knows all kinds of their features."""
    return rows <= ROWS_PER_TASK and rows * width <= CELLS_PER_TASK and flags_of(features) is not None


def takes_weights(trial: Mapping[str, object]) -> bool:
    """Whether a fit on weighted rows is the fit on all rows: it draws no rows and counts none."""
    return all(trial.get(name) in (None, 1) for name in ("subsample", "min_child_weight"))


def equal_rows_as_one(data: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows with the same features as one row with their mean label and their number as its weight.

    Squared-error trees see sums of weights and labels only, so they are the same. A missing label stays missing.
    """
    label = F.when(F.count("label") == F.count("*"), F.avg("label"))
    return data.groupBy(*by, "features").agg(label.alias("label"), F.count("*").cast("double").alias(WEIGHT))


def _kept(df: DataFrame) -> DataFrame:
    dropped = [c for c in ("features", "rawPrediction", "probability") if c in df.columns]
    return with_errors(df.drop(*dropped).withColumnRenamed("label", "actual"))


def out_of_fold(
    data: DataFrame,
    fit: Fit,
    parts: Mapping[int, DataFrame],
    fold: str = "fold",
    parallelism: int = PARALLEL_FITS,
) -> tuple[DataFrame, Model]:
    """Predict each fold with a model fitted on its training part.

    Returns all predictions with their errors, as a written table, and the last fold's
    model. The folds share a pool; each writes its predictions to a partition of its own.
    """
    models: dict[int, Model] = {}

    def predicted(i: int) -> DataFrame:
        models[i] = fit(parts[i])
        return _kept(models[i].transform(data.where(F.col(fold) == i))).drop(fold)

    at_once = fits_at_once(data.count(), parallelism)
    return _pooled(data, {i: partial(predicted, i) for i in parts}, fold, at_once), models[max(parts)]


def out_of_window(
    data: DataFrame,
    fit: Fit,
    windows: Sequence,
    day: str = "start_date_local",
    parallelism: int = PARALLEL_FITS,
) -> tuple[DataFrame, Model]:
    """Predict each validation interval with a model fitted on the days before it.

    A window without training or validation rows gives no predictions. The windows share a pool; each writes its
    predictions to a partition of its own, so that reading them is one scan however many windows there are.
    """
    sizes = window_sizes(data, windows, day)
    usable = [k for k in range(len(windows)) if all(sizes[k])]
    if not usable:
        raise ValueError("no window has both training and validation rows")
    models: dict[int, Model] = {}

    def predicted(k: int) -> DataFrame:
        w = windows[k]
        train = data.where(F.col(day).between(F.lit(w.train_start), F.lit(w.train_end)))
        valid = data.where(F.col(day).between(F.lit(w.valid_start), F.lit(w.valid_end)))
        models[k] = fit(fitting_rows(train, sizes[k][0]))
        # Fold metrics over windows are per window, whatever folds the table had.
        here = F.lit(w.window_id)
        return _kept(models[k].transform(valid).withColumn("window_id", here).withColumn("fold", here))

    at_once = fits_at_once(max(sizes[k][0] for k in usable), parallelism)
    pooled = _pooled(data, {k: partial(predicted, k) for k in usable}, "unit", at_once)
    return pooled.drop("unit"), models[usable[-1]]


def _pooled(
    data: DataFrame, predictions: Mapping[int, Callable[[], DataFrame]], column: str, parallelism: int
) -> DataFrame:
    spark = data.sparkSession
    return kept_by_partition(spark, new_path(spark, f"by_{column}"), column, predictions, parallelism)


def window_sizes(
    data: DataFrame, windows: Sequence, day: str = "start_date_local"
) -> list[tuple[int, int]]:
    """Training and validation rows of each window, from one count of all days."""
    # A row a day.
    return _sizes([tuple(r) for r in data.where(F.col(day).isNotNull()).groupBy(day).count().collect()], windows)


def window_fold_sizes(
    data: DataFrame, windows: Sequence, folds: int, day: str = "start_date_local"
) -> tuple[list[int], list[list[int]]]:
    """Training rows of each window, and those of each fold in it, from one count of all days and folds."""
    # A row a day and fold.
    counted = data.where(F.col(day).isNotNull()).groupBy(day, "fold").count().collect()
    inside = [[n for n, _ in _sizes([(d, n) for d, f, n in counted if f == i], windows)] for i in range(folds)]
    return [n for n, _ in _sizes([(d, n) for d, _, n in counted], windows)], inside


def _sizes(counted: Sequence[tuple], windows: Sequence) -> list[tuple[int, int]]:
    per_day = sorted(counted, key=lambda r: r[0])
    days = [d for d, _ in per_day]
    upto = [0, *accumulate(n for _, n in per_day)]

    def between(first, last) -> int:
        return upto[max(bisect_right(days, last), bisect_left(days, first))] - upto[bisect_left(days, first)]

    return [(between(w.train_start, w.train_end), between(w.valid_start, w.valid_end)) for w in windows]


def feature_importances(data: DataFrame, model: Model, names: Sequence[str]) -> DataFrame:
    """One row per feature with its share of the total importance."""
    values = model.featureImportances.toArray()
    rows = [(name, float(value)) for name, value in zip(names, values, strict=True)]
    return data.sparkSession.createDataFrame(rows, "feature string, value double")
