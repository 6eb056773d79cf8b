"""Training plans: cross-validated search, refit, per-window models, batch scoring."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from datetime import timedelta
from functools import partial
from hashlib import sha256
from statistics import fmean

from pyspark.ml import Model, PipelineModel
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from gtdlens import schemas
from gtdlens.functions import columns as C
from gtdlens.operators import encoding as E
from gtdlens.operators import modeling as Mo
from gtdlens.operators import splits
from gtdlens.operators import tuning
from gtdlens.operators.fitting import PARALLEL_FITS, Ledger, fits_at_once, kept_by_partition, run_pool
from gtdlens.operators.metrics import mean_absolute_error, with_errors
from gtdlens.plans.reports import with_outcome
from gtdlens.session import new_path, write_once
from gtdlens.sources.models import JoinedSaver, load_last_stage, load_model, period_path


@dataclass
class Tuned:
    best: tuning.Outcome
    outcomes: list[tuning.Outcome]
    model: Model
    out_of_fold: DataFrame


def trial_rows(trials: DataFrame) -> list[dict[str, object]]:
    return [row.asDict() for row in trials.orderBy("trial_id").collect()]


def tune(
    data: DataFrame,
    trials: Sequence[Mapping[str, object]],
    folds: int = 0,
    windows: Sequence[splits.CalendarWindow] = (),
    fit: Callable[[DataFrame, Mapping[str, object]], Model] = Mo.fit_regressor,
    objective: Callable[[DataFrame], float | None] = tuning.pooled_median_error,
    largest: bool = False,
    refit: str = "all",
    resample: Callable[[DataFrame], DataFrame] | None = None,
    parallelism: int = PARALLEL_FITS,
) -> Tuned:
    """Search over the trials by cross-validation: over ``windows`` of days where given,
    else over the ``fold`` column of the table.

    ``refit="all"`` fits the best parameters on every row; ``refit="last_fold"`` keeps the
    model of the last fold. All fits share one pool. Trials that differ in their number of rounds only are one
    fit a fold, scored at each number. Predictions are written as they come, so the objective and later reports read them.
    """
    if refit not in ("all", "last_fold"):
        raise ValueError(f"unknown refit: {refit}")
    spark = data.sparkSession
    groups = tuning.staged_groups(trials)
    if windows:
        parts, rows = _window_parts(data, windows)
    else:
        # All trials share the training parts, so each fold is resampled once.
        training = Mo.training_parts(data, folds, resample)
        parts = {i: (train, data.where(F.col("fold") == i)) for i, train in training.items()}
        rows = data.count()
    models: dict[tuple[int, int], Model] = {}

    def predicted(g: int, i: int) -> DataFrame:
        train, held_out = parts[i]
        models[g, i] = fit(train, groups[g][-1])
        return with_errors(_staged(models[g, i], groups[g], held_out))

    units = [(g, i) for g in range(len(groups)) for i in parts]
    work = {u: partial(predicted, *unit) for u, unit in enumerate(units)}
    at_once = fits_at_once(rows, parallelism)
    pooled = kept_by_partition(spark, new_path(spark, "search"), "unit", work, at_once).drop("unit")

    scores = _scores(pooled, trials, objective, parallelism)

    def outcome(g: int, trial: Mapping[str, object]) -> tuning.Outcome:
        scored = pooled.where(F.col("trial_id") == trial["trial_id"]).drop("trial_id")
        kept = None
        if refit == "last_fold":
            kept = _at_rounds(models[g, max(parts)], trial, groups[g])
        return tuning.Outcome(dict(trial), scores.get(trial["trial_id"]), scored, kept)

    outcomes = [outcome(g, trial) for g, group in enumerate(groups) for trial in group]
    outcomes.sort(key=lambda o: o.trial["trial_id"])
    best = tuning.best_of(outcomes, largest)
    model = best.model
    if model is None:
        model = fit(data if resample is None else resample(data), best.trial)
    return Tuned(best, outcomes, model, best.scored)


def _scores(
    pooled: DataFrame, trials: Sequence[Mapping[str, object]], objective: Callable[[DataFrame], float | None], parallelism: int
) -> dict[int, float | None]:
    """Score of each trial: in passes that all trials share, or one by one for an objective of the caller's own."""
    together = tuning.TOGETHER.get(objective)
    if together is not None:
        # One row a trial.
        return {row["trial_id"]: row["score"] for row in together(pooled, ["trial_id"]).collect()}

    def score(trial: Mapping[str, object]) -> tuple[int, float | None]:
        return trial["trial_id"], objective(pooled.where(F.col("trial_id") == trial["trial_id"]).drop("trial_id"))

    return dict(run_pool(pooled.sparkSession, [partial(score, t) for t in trials], parallelism=parallelism))


def _window_parts(
    data: DataFrame, windows: Sequence[splits.CalendarWindow]
) -> tuple[dict[int, tuple[DataFrame, DataFrame]], int]:
    """Training and validation rows of each window that has both, and the most training rows; a validation row's fold is its window."""
    sizes, parts = Mo.window_sizes(data, windows), {}
    for k, w in enumerate(windows):
        if all(sizes[k]):
            here = F.lit(w.window_id)
            held_out = _valid(data, w).withColumn("window_id", here).withColumn("fold", here)
            parts[k] = (Mo.fitting_rows(_train(data, w), sizes[k][0]), held_out)
    if not parts:
        raise ValueError("no window has both training and validation rows")
    return parts, max(sizes[k][0] for k in parts)


def _train(data: DataFrame, w: splits.CalendarWindow) -> DataFrame:
    return data.where(F.col("start_date_local").between(F.lit(w.train_start), F.lit(w.train_end)))


def _valid(data: DataFrame, w: splits.CalendarWindow) -> DataFrame:
    return data.where(F.col("start_date_local").between(F.lit(w.valid_start), F.lit(w.valid_end)))


def _at_rounds(model: Model, trial: Mapping[str, object], group: Sequence[Mapping[str, object]]) -> Model:
    """The model of one trial of a group out of the group's longest fit."""
    return model if len(group) == 1 else Mo.first_rounds(model, int(trial["n_estimators"]))


def _predictions(model: Model, group: Sequence[Mapping[str, object]], rows: DataFrame) -> tuple[DataFrame, dict[int, str]]:
    """The rows with one prediction column a trial."""
    columns = {}
    for trial in group:
        one = _at_rounds(model, trial, group).copy()
        columns[trial["trial_id"]] = f"prediction_{trial['trial_id']}"
        one.setPredictionCol(columns[trial["trial_id"]])
        for other in ("rawPredictionCol", "probabilityCol"):
            if one.hasParam(other):
                one.set(one.getParam(other), "")
        rows = one.transform(rows)
    return rows, columns


def _staged(model: Model, group: Sequence[Mapping[str, object]], rows: DataFrame) -> DataFrame:
    """Each row once a trial of the group: trial_id, actual, prediction."""
    predicted, columns = _predictions(model, group, rows)
    each = F.explode(
        F.array(*[F.struct(F.lit(t).cast("long").alias("trial_id"), F.col(c).alias("prediction")) for t, c in columns.items()])
    )
    kept = [c for c in rows.columns if c not in ("features", "label")]
    long = predicted.select(*kept, F.col("label").alias("actual"), each.alias("__one"))
    return long.select(*kept, "actual", "__one.trial_id", "__one.prediction")


def prepared_regressor_data(
    rows: DataFrame, folds: int, seed: int = 42, strict: bool = False, by_day: bool = False
) -> tuple[DataFrame, PipelineModel, list[str]]:
    """Encode once, assign folds, and write the result: every fit then reads that table.

    With ``by_day`` the table is laid out by date, so each rolling window reads only the
    row groups of its own days. The id is part of the range, which splits a hot date.
    """
    numbers = [c for c in schemas.REGRESSOR_NUMBERS if c in rows.columns]
    data, encoder, names = Mo.encoded(
        rows,
        schemas.REGRESSOR_CATEGORIES,
        numbers,
        schemas.REGRESSOR_LABEL,
        keep=schemas.REGRESSOR_KEYS,
        strict=strict,
    )
    with_folds = splits.hashed_folds(data, ["match_id"], folds, seed)
    if by_day:
        with_folds = with_folds.repartitionByRange(
            "start_date_local", "match_id"
        ).sortWithinPartitions("start_date_local")
    return write_once(with_folds, "features", Mo.ROWS_PER_FILE if by_day else 0), encoder, names


def prepared_classifier_data(
    rows: DataFrame, folds: int
) -> tuple[DataFrame, PipelineModel, list[str]]:
    """As above for the classifier: rows labelled 0 or 1, in runs of the id order.

    The encoder knows the categories of all rows, also of those without a usable label.
    """
    usable = Mo.binary_labels(rows, schemas.CLASSIFIER_LABEL)
    data, encoder, names = Mo.encoded(
        usable,
        schemas.CLASSIFIER_CATEGORIES,
        schemas.CLASSIFIER_NUMBERS,
        schemas.CLASSIFIER_LABEL,
        keep=["id_match"],
        strict=True,
        vocabulary=E.fit_vocabulary(rows, schemas.CLASSIFIER_CATEGORIES),
    )
    # The ranked rows are already a written table.
    return splits.contiguous_folds(data, ["id_match"], folds), encoder, names


class _Stretches:
    """The training rows of all windows, with equal ones of a stretch of days as one weighted row.

    The days are cut wherever a window begins or ends, so each window is a run of whole stretches. The table lies in their
    order and a window reads the row groups of its own.
    """

    def __init__(self, data: DataFrame, windows: Sequence[splits.CalendarWindow], day: str = "start_date_local"):
        self.edges = sorted({e for w in windows for e in (w.train_start, w.train_end + timedelta(days=1))})
        # A row a day that a window may have.
        days = [self.edges[0] + timedelta(days=i) for i in range((self.edges[-1] - self.edges[0]).days)]
        numbered = [(d, bisect_right(self.edges, d)) for d in days]
        calendar = F.broadcast(data.sparkSession.createDataFrame(numbered, "__day date, stretch int"))
        inside = data.join(calendar, F.col(day) == F.col("__day"))
        rows = Mo.equal_rows_as_one(inside, ["stretch", "fold"])
        placed = rows.repartitionByRange("stretch", "fold", "label").sortWithinPartitions("stretch")
        self.rows = write_once(placed, "stretches", Mo.ROWS_PER_FILE)
        # A row a stretch.
        self.sizes = dict(self.rows.groupBy("stretch").count().collect())

    def of(self, w: splits.CalendarWindow) -> tuple[DataFrame, int]:
        """The rows of a window's training days and their number."""
        first, end = bisect_right(self.edges, w.train_start), bisect_right(self.edges, w.train_end)
        return self.rows.where(F.col("stretch").between(first, end)), sum(self.sizes.get(s, 0) for s in range(first, end + 1))


def _with_folds(
    data: DataFrame, windows: Sequence[splits.CalendarWindow], folds: int, seed: int
) -> tuple[DataFrame, list[int], list[list[int]]]:
    """The rows with the folds of a search, as a written table, and the sizes of the windows and of their folds.

    Every fit reads the folds several times, so they are written. Large tables that come with these folds are read as they are;
    in a window that is fitted in one partition the draws follow the order of the files, so small ones are always laid out here.
    """
    if splits.has_hashed_folds(data, ["match_id"], folds, seed):
        sizes, inside = Mo.window_fold_sizes(data, windows, folds)
        if min((n for n in sizes if n), default=0) > Mo.ROWS_PER_TASK:
            return data, sizes, inside
    data = write_once(splits.hashed_folds(data.drop("fold"), ["match_id"], folds, seed), "windows", Mo.ROWS_PER_FILE)
    return data, *Mo.window_fold_sizes(data, windows, folds)


@dataclass
class WindowModel:
    """A window's model; without training rows it has none."""

    window: splits.CalendarWindow
    train_rows: int
    path: str | None = None
    best: tuning.Outcome | None = None


def tune_windows(
    data: DataFrame,
    encoder: PipelineModel,
    windows: Sequence[splits.CalendarWindow],
    trials: Sequence[Mapping[str, object]],
    root: str,
    folds: int = 5,
    seed: int = 42,
    parallelism: int = PARALLEL_FITS,
) -> tuple[list[WindowModel], DataFrame]:
    """Tune, refit and save one model per window, and score its validation interval.

    The search minimises the mean of the fold errors. Every window is returned with its
    number of training rows; one without any has no model. The validation interval is
    scored with the model as it was saved.

    The fits of all windows, trials and folds share one pool; a window's model is fitted once its last score is there.
    A score goes to the ledger ``root/ledger`` as its fit ends, predictions to a partition of ``root/scored``,
    so a later call on the same folder does what is missing only.
    """
    spark = data.sparkSession
    groups = tuning.staged_groups(trials)
    data, sizes, inside = _with_folds(data, windows, folds, seed)
    stretches = _Stretches(data, windows) if any(map(Mo.takes_weights, trials)) else None
    described = repr((list(windows), sorted(repr(sorted(t.items())) for t in trials), folds, seed))
    ledger = Ledger(spark, f"{root}/ledger", sha256(described.encode()).hexdigest())
    # The fits of each window's search; a fold without rows inside or outside it has none.
    units = [
        {f"score-{k}-{g}-{i}": (g, i) for g in range(len(groups)) for i in range(folds) if 0 < inside[i][k] < sizes[k]}
        for k in range(len(windows))
    ]

    columns = [{f"prediction_{t['trial_id']}": t for t in group} for group in groups]
    width = len(data.select("features").first()["features"]) if any(sizes) else 0

    def in_one_task(k: int, g: int) -> bool:
        """Whether a task makes all fits of a group in a window; equal rows as one are few enough for Spark's own fits."""
        small = Mo.fits_in_one_task(data.schema["features"], sizes[k], width)
        return small and not Mo.takes_weights(groups[g][-1])

    boosters = {
        (g, together): Mo.SearchBooster(
            group[-1], {c: t.get("n_estimators") for c, t in columns[g].items()}, Mo.takes_weights(group[-1]), together
        )
        for g, group in enumerate(groups)
        for together in (False, True)
    }
    errors = [[mean_absolute_error("label", c).alias(c) for c in named] for named in columns]

    def training(k: int, trial: Mapping[str, object], without: int | None = None) -> DataFrame:
        """The window's rows to fit on, equal ones as one where the trial allows it."""
        if Mo.takes_weights(trial):
            rows, n = stretches.of(windows[k])
        else:
            rows, n = _train(data, windows[k]), sizes[k]
        return Mo.fitting_rows(rows if without is None else rows.where(F.col("fold") != without), n)

    def kept(k: int, entry: str, found: Row) -> None:
        g, i = units[k][entry]
        rows = [{"trial_id": t["trial_id"], "fold": i, "score": found[c]} for c, t in columns[g].items()]
        ledger.add(entry, [{"window_id": windows[k].window_id} | row for row in rows])

    def scored(k: int, entry: str) -> tuple[int, list[str]]:
        if entry not in ledger.entries:
            g, i = units[k][entry]
            held_out = Mo.fitting_rows(_train(data, windows[k]).where(F.col("fold") == i), inside[i][k])
            kept(k, entry, boosters[g, False].predicted(training(k, groups[g][-1], i), held_out).agg(*errors[g]).first())
        return k, [entry]

    def scored_together(k: int, g: int) -> tuple[int, list[str]]:
        entries = {i: entry for entry, (h, i) in units[k].items() if h == g}
        if any(entry not in ledger.entries for entry in entries.values()):
            rows = training(k, groups[g][-1])
            # A row a fold.
            for found in boosters[g, True].predicted(rows, rows).groupBy("fold").agg(*errors[g]).collect():
                kept(k, entries[found["fold"]], found)
        return k, list(entries.values())

    def chosen(k: int) -> tuning.Outcome:
        found: dict[int, list[float]] = {}
        for entry in units[k]:
            for row in ledger.entries[entry]:
                found.setdefault(row["trial_id"], []).append(row["score"])
        mean = {t: fmean(errors) for t, errors in found.items()}
        outcomes = [tuning.Outcome(dict(t), mean.get(t["trial_id"])) for t in trials]
        # A window whose rows all lie in one fold cannot be searched.
        return tuning.best_of(outcomes) if found else outcomes[0]

    def fitted(k: int) -> None:
        w, entry = windows[k], f"model-{k}"
        if entry in ledger.entries:
            return
        best = chosen(k)
        path = period_path(root, w.label)
        model = Mo.fit_regressor(training(k, best.trial), best.trial)
        saver.save(model, path)
        predictions = load_last_stage(spark, path).transform(_valid(data, w)).select(
            F.lit(w.window_id).alias("window_id"),
            F.lit(w.label).alias("period"),
            "match_id",
            "start_date_local",
            F.col("label").alias("actual"),
            "prediction",
        )
        with_errors(predictions).write.mode("overwrite").parquet(f"{root}/scored/unit={k}")
        row = {"window_id": w.window_id, "trial_id": best.trial["trial_id"], "score": best.score}
        ledger.add(entry, [row | {"train_rows": sizes[k], "path": path}])

    usable = [k for k in range(len(windows)) if sizes[k]]
    if not usable:
        raise ValueError("no window has training rows")
    left = [set(entries) for entries in units]
    saver = JoinedSaver(spark, encoder, f"{root}/encoder")

    def next_tasks(result: tuple[int, list[str]] | None) -> list[Callable[[], object]]:
        if result is None:
            return []
        k, entries = result
        left[k].difference_update(entries)
        return [] if left[k] else [partial(fitted, k)]

    first: list[Callable[[], object]] = []
    for k in usable:
        together = sorted({g for g, _ in units[k].values() if in_one_task(k, g)})
        first += [partial(scored_together, k, g) for g in together]
        first += [partial(scored, k, entry) for entry, (g, _) in units[k].items() if g not in together]
    first += [partial(fitted, k) for k in usable if not units[k]]
    run_pool(spark, first, next_tasks, fits_at_once(max(sizes), parallelism))
    models = [
        WindowModel(w, sizes[k], period_path(root, w.label), chosen(k)) if sizes[k] else WindowModel(w, 0)
        for k, w in enumerate(windows)
    ]
    folder = f"{root}/scored"
    pooled = spark.read.option("basePath", folder).parquet(*[f"{folder}/unit={k}" for k in usable])
    return models, pooled.drop("unit")


def score(rows: DataFrame, model: PipelineModel | str) -> DataFrame:
    """Rows with prediction, predicted result and predicted overlay.

    Categories the model never saw count as none, and the feature vector always follows
    the model's own vocabulary, whatever columns or values the batch has.
    """
    fitted = load_model(model) if isinstance(model, str) else model
    return with_outcome(_predicted(rows, fitted))


def classify(rows: DataFrame, model: PipelineModel | str) -> DataFrame:
    """Rows with the predicted class and the text shown for it.

    The classifier's encoder is strict: a category it never saw is an error.
    """
    fitted = load_model(model) if isinstance(model, str) else model
    return _predicted(rows, fitted).withColumn("outcome_text", C.class_text("prediction"))


def _predicted(rows: DataFrame, model: PipelineModel) -> DataFrame:
    ready, absent = E.padded(rows, model)
    predicted = model.transform(ready)
    return predicted.drop(*absent, "features", "rawPrediction", "probability")

