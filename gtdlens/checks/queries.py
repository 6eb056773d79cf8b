"""The registered queries: each takes (session, table folder) and reads its whole tables."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gtdlens import schemas
from gtdlens.functions import columns as C
from gtdlens.operators import encoding as E
from gtdlens.operators import metrics as M
from gtdlens.operators import modeling as Mo
from gtdlens.operators import slots as S
from gtdlens.operators import splits
from gtdlens.operators import tuning
from gtdlens.operators.neighbours import nearest_points
from gtdlens.operators.resample import balanced
from gtdlens.plans import extracts as X
from gtdlens.plans import lookups as L
from gtdlens.plans import reports as R
from gtdlens.plans import scenario as Sc
from gtdlens.plans import training as Tr
from gtdlens.session import new_path
from gtdlens.sources import sample_views as V
from gtdlens.sources import tables
from gtdlens.sources.models import save_model

FIRST_DAY, LAST_DAY = date(2023, 1, 1), date(2024, 12, 31)
ALL_CLASSES = ("Micro", "Low", "Medium", "High")
SCENARIO = L.Scenario("MTT-PLO5", "Low", "friday", "morning", 5.5, 0.0, 5.5, 153.0)
RANGES = L.Ranges((1, 25), (0, 15), (1, 25), (1, 200))
ROLLING_START = date(1996, 1, 30)
# A small budget: the searches below fit many models.
QUICK = {"n_estimators": 5, "max_depth": 3, "learning_rate": 0.3}
QUICK_SPACE = {
    "n_estimators": tuning.Whole(2, 4),
    "max_depth": tuning.Whole(2, 3),
    "learning_rate": tuning.Real(0.1, 0.5),
    "subsample": tuning.Real(0.5, 1.0),
    "colsample_bytree": tuning.Real(0.5, 1.0),
}
FOLDS, WINDOW_FOLDS = 10, 5
STAGES = 5


def _rounded(df: DataFrame, places: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in columns})


def _scored(spark: SparkSession, d: str) -> DataFrame:
    return R.with_outcome(V.predicted(V.tournaments(spark, d)))


def _extract(spark: SparkSession, d: str) -> DataFrame:
    return X.regressor_extract(V.tournaments(spark, d), FIRST_DAY, LAST_DAY)


# --- extracts and lookups


def regressor_extract(spark, d):
    return _extract(spark, d)


def regressor_extract_selfjoin(spark, d):
    return X.regressor_extract(V.tournaments(spark, d), FIRST_DAY, LAST_DAY, by_join=True)


def regressor_extract_sql(spark, d):
    return X.regressor_extract_sql(V.tournaments(spark, d), FIRST_DAY, LAST_DAY)


def hour_slot_counts(spark, d):
    rows = S.selected(V.tournaments(spark, d), X.HOLDEM, X.SMALL_CLASSES)
    return S.hour_slot_counts(rows)


def hour_band_counts(spark, d):
    return S.hour_band_counts(hour_slot_counts(spark, d))


def classifier_extract(spark, d):
    return X.classifier_extract(V.products(spark, d), V.prices(spark, d))


def exact_matches(spark, d):
    return L.exact_matches(V.products(spark, d), V.prices(spark, d), SCENARIO)


def similar_matches(spark, d):
    return L.similar_matches(V.products(spark, d), V.prices(spark, d), SCENARIO, RANGES)


def constrained_extract_a(spark, d):
    return X.constrained_extract(
        V.tournaments(spark, d),
        classes=X.SMALL_CLASSES,
        gtd_range=(30, 58000),
        ratio_range=(33, 7833),
        last_day=date(2024, 10, 19),
        positive_buy_in=False,
        stored_norms=True,
        with_level=True,
    )


def constrained_extract_b(spark, d):
    return X.constrained_extract(V.tournaments(spark, d))


def constrained_extract_c(spark, d):
    return X.constrained_extract(
        V.tournaments(spark, d), gtd_range=(30, 58000), ratio_range=(33, 1593), with_level=True
    )


def csv_round_trip(spark, d):
    kept = ["match_id", "start_date_local", "ko_type", "gtd", "collected", "prediction"]
    scored = _scored(spark, d).select(*kept, "result_pred", "has_overlay_pred")
    path = new_path(spark, "csv")
    tables.write_csv(scored, path)
    return tables.read_csv(spark, path, scored.schema)


# --- features


def _slot_lookup(spark, d):
    return S.hour_slot_lookup(hour_slot_counts(spark, d))


def scenario_features(spark, d):
    return Sc.scenario_features(V.scenarios(spark, d), _slot_lookup(spark, d))


def onehot_vocabulary(spark, d):
    rows = V.tournaments(spark, d)
    return E.vocabulary_table(spark, E.fit_vocabulary(rows, schemas.REGRESSOR_CATEGORIES))


def _category_rows(spark, d):
    return _extract(spark, d).select("match_id", *schemas.REGRESSOR_CATEGORIES, "gtd")


def onehot_strict(spark, d):
    rows = _category_rows(spark, d)
    return E.onehot(rows, E.fit_vocabulary(rows, schemas.REGRESSOR_CATEGORIES), strict=True)


PARTIAL_VOCABULARY = {"ko_type": ["KO", "Regular"], "estrutura_blinds": ["Hyper", "Turbo - no ante"]}


def onehot_lenient(spark, d):
    return E.onehot(_category_rows(spark, d), PARTIAL_VOCABULARY)


ALIGNED = ["match_id", "ko_type_Regular", "ko_type_Satellite", "ko_type_KO", "gtd"]


def aligned_features(spark, d):
    return E.align(onehot_lenient(spark, d), ALIGNED)


def feature_label_split(spark, d):
    return Mo.split_label(
        _extract(spark, d), schemas.REGRESSOR_LABEL, schemas.REGRESSOR_OUTCOMES
    ).drop("start_date_local")


# --- splits


def kfold_contiguous(spark, d):
    return splits.contiguous_folds(V.tournaments(spark, d).select("match_id", "collected"), ["match_id"])


def kfold_shuffled(spark, d):
    rows = V.tournaments(spark, d).select("match_id", "collected")
    return splits.shuffled_folds(rows, ["match_id"], k=7)


def kfold_hashed(spark, d):
    return splits.hashed_folds(V.tournaments(spark, d).select("match_id", "collected"), ["match_id"])


def _last_day(rows: DataFrame) -> date:
    return rows.agg(F.max("start_date_local")).first()[0]


def _monthly(rows: DataFrame) -> list[splits.CalendarWindow]:
    return splits.rolling_windows(ROLLING_START, _last_day(rows) + timedelta(days=1))


def rolling_schedule(spark, d):
    rows = V.yearly_tournaments(spark, d)
    windows = _monthly(rows)
    per_day = rows.groupBy("start_date_local").agg(F.count("*").alias("n"))
    role = F.col("role")
    sizes = (
        splits.assign_windows(per_day, windows)
        .groupBy("window_id")
        .agg(
            F.coalesce(F.sum(F.when(role == "train", F.col("n"))), F.lit(0)).alias("train_rows"),
            F.coalesce(F.sum(F.when(role == "valid", F.col("n"))), F.lit(0)).alias("valid_rows"),
        )
    )
    return (
        splits.schedule_table(spark, windows)
        .join(sizes, "window_id", "left")
        .fillna(0, ["train_rows", "valid_rows"])
    )


def rolling_assignment(spark, d):
    rows = V.yearly_tournaments(spark, d).select("match_id", "start_date_local")
    return splits.assign_windows(rows, _monthly(rows))


# --- reports on a given prediction


def score_flags(spark, d):
    scored = R.with_row_errors(_scored(spark, d))
    kept = ["match_id", "gtd", "mtt_result", "prediction", "result_pred", "has_overlay_pred"]
    text = C.class_text(F.when(F.col("has_overlay_pred"), 0).otherwise(1)).alias("outcome_text")
    rounded = [F.round(c, 6).alias(c) for c in ("abs_error_collected", "abs_error_result")]
    return _rounded(scored.select(*kept, *rounded, text), 6, "result_pred")


def kept_tournaments(spark, d):
    return R.kept(_scored(spark, d)).select("match_id", "mtt_result")


def caught_overlays(spark, d):
    return R.caught_overlays(_scored(spark, d)).select("match_id", "mtt_result")


def daily_result_gap(spark, d):
    gap = R.daily_result_gap(_scored(spark, d))
    return _rounded(gap, 2, "actual_result", "predicted_result", "dif")


def daily_result_gap_total(spark, d):
    return _rounded(R.result_gap_total(_scored(spark, d)), 2, "dif_total")


def daily_profit_breakdown(spark, d):
    days = R.daily_profit_breakdown(_scored(spark, d))
    return _rounded(days, 2, *[c for c in days.columns if c != R.DAY])


def confusion_matrix(spark, d):
    return R.overlay_confusion(_scored(spark, d))


def classification_report(spark, d):
    report = M.classification_report(_scored(spark, d), "has_overlay", "has_overlay_pred")
    return _rounded(report, 6, "precision", "recall", "f1")


def label_report(spark, d):
    report = M.classification_report(V.table(spark, d, "labels"), "quality", "toxic")
    return _rounded(report, 6, "precision", "recall", "f1")


ERRORS = (
    "absolute_difference", "squared_difference", "error_percentage", "absolute_error_percentage",
)


def error_table(spark, d):
    errors = M.with_errors(_scored(spark, d), "collected", "prediction")
    return _rounded(errors.select("match_id", "collected", "prediction", *ERRORS), 6, *ERRORS)


def error_summary(spark, d):
    summary = R.error_summary(_scored(spark, d))
    return _rounded(summary, 6, *[c for c in summary.columns if c != "series"])


def value_boxplot(spark, d):
    box = M.box_statistics(V.table(spark, d, "events"), {"value": F.col("value")})
    return _rounded(box, 6, *[c for c in box.columns if c != "series"])


def normalised_error(spark, d):
    errors = R.normalised_errors(_scored(spark, d))
    kept = ["match_id", "absolute_error_percentage", "normalised_error"]
    return _rounded(errors.select(*kept), 6, *kept[1:])


def normalised_error_summary(spark, d):
    summary = R.normalised_error_summary(R.normalised_errors(_scored(spark, d)))
    return _rounded(summary, 6, *summary.columns)


def _fold_rows(spark, d):
    return splits.hashed_folds(_scored(spark, d), ["match_id"])


def _fold_metrics(rows: DataFrame) -> DataFrame:
    return M.fold_scores(
        rows,
        "fold",
        mae=M.mean_absolute_error("collected", "prediction"),
        mse=M.mean_squared_error("collected", "prediction"),
        f1=M.class_f1("has_overlay", "has_overlay_pred"),
    )


def fold_metrics(spark, d):
    return _rounded(_fold_metrics(_fold_rows(spark, d)), 6, "mae", "mse", "f1")


def cv_objectives(spark, d):
    rows = _fold_rows(spark, d)
    means = M.mean_of_folds(_fold_metrics(rows), "mae", "mse", "f1")
    pooled = rows.agg(M.r_squared("collected", "prediction").alias("r2")).scalar()
    median = M.median_absolute_error(rows, "collected", "prediction")
    joined = means.withColumn("pooled_r2", pooled).withColumn("pooled_median_ae", F.lit(median))
    return _rounded(joined, 6, *joined.columns)


def chart_long(spark, d):
    return R.chart_rows(
        V.predicted(V.tournaments(spark, d)), ["match_id"], ["collected", "prediction"]
    )


def importance_ranked(spark, d):
    """Share of rows per category value as the importance table, through its CSV form."""
    rows = V.tournaments(spark, d)
    columns = ("ko_type", "class_match", "estrutura_blinds")
    names = F.array(*[F.concat_ws("_", F.lit(c), F.col(c)) for c in columns])
    shares = (
        rows.select(F.explode(names).alias("feature"))
        .groupBy("feature")
        .agg((F.count("*") / rows.agg(F.count("*")).scalar()).alias("value"))
    )
    path = new_path(spark, "importances")
    tables.write_csv(shares, path)
    return R.importances_from_csv(spark, path)


def best_trial(spark, d):
    trials = (
        V.predicted(V.tournaments(spark, d))
        .groupBy(F.col("start_hour_local").alias("trial_id"))
        .agg(F.round(F.avg(C.absolute_error("collected", "prediction")), 6).alias("score"))
    )
    return R.best_trial(trials, "score")


# --- resampling and models


def _embedded(spark, d):
    return V.table(spark, d, "embeddings").select(
        "vec_id",
        array_to_vector(F.col("embedding").cast("array<double>")).alias("features"),
        F.when(F.col("label") == 0, 1.0).otherwise(0.0).alias("label"),
    )


def smote_balance(spark, d):
    rows = balanced(_embedded(spark, d), ["vec_id"])
    return rows.select("label", "synthetic", vector_to_array("features").alias("x"))


def smote_class_counts(spark, d):
    return balanced(_embedded(spark, d), ["vec_id"]).groupBy("label", "synthetic").agg(
        F.count("*").alias("rows")
    )


def _regressor_data(spark, d, folds=FOLDS):
    rows = X.regressor_extract(V.tournaments(spark, d), FIRST_DAY, LAST_DAY, classes=ALL_CLASSES)
    return rows, *Tr.prepared_regressor_data(rows, folds)


def gbt_regressor_scores(spark, d):
    """Fit, save, load, then score the extract as a batch."""
    rows, data, encoder, _ = _regressor_data(spark, d)
    model = Mo.joined_pipeline(encoder, Mo.fit_regressor(data, QUICK))
    scored = Tr.score(rows, save_model(model, new_path(spark, "regressor")))
    kept = ["match_id", "gtd", "mtt_result", "has_overlay", "prediction", "result_pred"]
    return scored.select(*kept, "has_overlay_pred")


def scenario_scores(spark, d):
    """What a fitted model says about planned tournaments."""
    _, data, encoder, _ = _regressor_data(spark, d)
    model = Mo.joined_pipeline(encoder, Mo.fit_regressor(data, QUICK))
    rows = Sc.scenario_rows(V.scenarios(spark, d), _slot_lookup(spark, d))
    kept = ["scenario_id", "gtd", "prediction", "result_pred", "has_overlay_pred"]
    return Tr.score(rows, model).select(*kept)


def gbt_classifier_scores(spark, d):
    rows = classifier_extract(spark, d)
    data, encoder, _ = Tr.prepared_classifier_data(rows, FOLDS)
    model = Mo.joined_pipeline(encoder, Mo.fit_classifier(balanced(data, ["id_match"]), QUICK))
    classified = Tr.classify(rows, model)
    return classified.select("id_match", "overlay_match_bi", "prediction", "outcome_text")


def feature_importance(spark, d):
    _, data, _, names = _regressor_data(spark, d)
    importances = Mo.feature_importances(data, Mo.fit_regressor(data, QUICK), names)
    return R.ranked_importances(importances)


def _out_of_fold(spark, d, folds):
    _, data, _, _ = _regressor_data(spark, d, folds)
    parts = Mo.training_parts(data, folds)
    return Mo.out_of_fold(data, lambda train: Mo.fit_regressor(train, QUICK), parts)[0]


def cv_oof(spark, d):
    return _out_of_fold(spark, d, FOLDS)


def _resampled(train):
    return balanced(train, ["id_match"])


def classifier_cv_f1(spark, d):
    """Folds in id order; the minority is over-sampled in the training part only."""
    data, _, _ = Tr.prepared_classifier_data(classifier_extract(spark, d), FOLDS)
    parts = Mo.training_parts(data, FOLDS, _resampled)
    scored, _ = Mo.out_of_fold(data, lambda train: Mo.fit_classifier(train, QUICK), parts)
    return M.fold_scores(scored, "fold", f1=M.class_f1("actual", "prediction"))


def classifier_search(spark, d):
    """The search with the mean F1 over the folds as its objective, resampled as above."""
    data, _, _ = Tr.prepared_classifier_data(classifier_extract(spark, d), FOLDS)
    tuned = Tr.tune(
        data,
        Tr.trial_rows(tuning.trial_table(spark, 3, QUICK_SPACE)),
        FOLDS,
        fit=Mo.fit_classifier,
        objective=tuning.mean_fold_f1,
        largest=True,
        resample=_resampled,
    )
    return tuning.outcome_table(spark, tuned.outcomes, QUICK_SPACE)


def tune_and_refit(spark, d):
    _, data, _, _ = _regressor_data(spark, d)
    trials = Tr.trial_rows(tuning.trial_table(spark, 3, QUICK_SPACE))
    tuned = Tr.tune(data, trials, folds=FOLDS)
    return tuning.outcome_table(spark, tuned.outcomes, QUICK_SPACE)


def _yearly_data(spark, d):
    rows = V.yearly_tournaments(spark, d)
    days = rows.agg(F.min("start_date_local"), F.max("start_date_local")).first()
    extract = X.regressor_extract(rows, days[0], days[1], classes=ALL_CLASSES)
    data, encoder, _ = Tr.prepared_regressor_data(extract, WINDOW_FOLDS, by_day=True)
    return data, encoder, days


def _monthly_data(spark, d):
    """11 months of training, 1 of validation, step 1, up to the last day."""
    data, encoder, (first, last) = _yearly_data(spark, d)
    return data, encoder, splits.rolling_windows(splits.add_months(first, 11), last + timedelta(days=1))


def _long_data(spark, d):
    """The four long windows that the SQL of the `_rows` queries has."""
    data, encoder, (first, last) = _yearly_data(spark, d)
    windows = splits.rolling_windows(
        splits.add_months(first, 33), last, train_months=33, valid_months=12, step_months=12
    )
    return data, encoder, windows


def _temporal_cv(data, windows):
    return Mo.out_of_window(data, lambda train: Mo.fit_regressor(train, QUICK), windows)[0]


def _window_tuning(spark, data, encoder, windows):
    trials = Tr.trial_rows(tuning.trial_table(spark, 2, QUICK_SPACE))
    root = new_path(spark, "windows")
    return Tr.tune_windows(data, encoder, windows, trials, root, folds=WINDOW_FOLDS)[1]


def temporal_cv(spark, d):
    data, _, windows = _monthly_data(spark, d)
    return _temporal_cv(data, windows)


def temporal_search(spark, d):
    """The search with the pooled error over the windows as its objective."""
    data, _, windows = _monthly_data(spark, d)
    trials = Tr.trial_rows(tuning.trial_table(spark, 2, QUICK_SPACE))
    tuned = Tr.tune(data, trials, windows=windows)
    return tuning.outcome_table(spark, tuned.outcomes, QUICK_SPACE)


def window_tuning(spark, d):
    return _window_tuning(spark, *_monthly_data(spark, d))


# --- what must hold of the model queries whatever the trees are


def nearest_neighbours(spark, d):
    """The five nearest other vectors of every vector, as the over-sampling finds them."""
    points = V.table(spark, d, "embeddings").select(
        F.col("vec_id").alias("point_id"),
        F.col("embedding").cast("array<double>").alias("x"),
        F.lit(1).cast("bigint").alias("copies"),
    )
    near = nearest_points(points, points, 5)
    return near.select("point_id", F.posexplode("near").alias("place", "n")).select(
        F.col("point_id").alias("vec_id"),
        "place",
        F.col("n.point_id").alias("neighbour"),
        F.round("n.distance", 6).alias("distance"),
    )


def score_consistency(spark, d):
    """Derived columns follow from the prediction, and a reloaded model predicts the same."""
    rows, data, encoder, _ = _regressor_data(spark, d)
    model = Mo.joined_pipeline(encoder, Mo.fit_regressor(data, QUICK))
    path = save_model(model, new_path(spark, "regressor"))
    again = Tr.score(Tr.score(rows, model).withColumnRenamed("prediction", "first"), path)
    return again.select(
        "match_id",
        "gtd",
        "collected",
        (F.col("prediction") == F.col("first")).alias("same_after_reload"),
        (F.col("result_pred") == F.col("prediction") - F.col("gtd")).alias("result_follows"),
        (F.col("has_overlay_pred") == (F.col("result_pred") < 0)).alias("flag_follows"),
    )


def classifier_consistency(spark, d):
    classified = gbt_classifier_scores(spark, d)
    text = F.when(F.col("prediction") == 1, C.PROFIT_TEXT).otherwise(C.LOSS_TEXT)
    return classified.select(
        "id_match",
        "overlay_match_bi",
        F.col("prediction").isin(0.0, 1.0).alias("is_class"),
        (F.col("outcome_text") == text).alias("text_follows"),
    )


def importance_features(spark, d):
    """The feature names, and that their importances sum to one."""
    _, data, _, names = _regressor_data(spark, d)
    found = Mo.feature_importances(data, Mo.fit_regressor(data, QUICK), names)
    total = found.agg(F.round(F.sum("value"), 6)).scalar()
    return found.select("feature", total.alias("total"))


def cv_oof_rows(spark, d):
    """Every row is predicted once, in its own fold, with its own actual value; three folds, as the SQL has."""
    return _out_of_fold(spark, d, 3).select("match_id", "fold", "actual")


def cv_oof_ten_rows(spark, d):
    """The same of `cv_oof` and its ten folds."""
    return cv_oof(spark, d).select("match_id", "fold", "actual")


def temporal_cv_rows(spark, d):
    """The validated rows of the long windows, as the SQL has them."""
    data, _, windows = _long_data(spark, d)
    return _temporal_cv(data, windows).select("window_id", "match_id", "start_date_local", "actual")


def temporal_cv_monthly_rows(spark, d):
    """The same of `temporal_cv` and its monthly windows."""
    return temporal_cv(spark, d).select("window_id", "match_id", "start_date_local", "actual")


def window_tuning_rows(spark, d):
    """The scored rows of the long windows, as the SQL has them."""
    scored = _window_tuning(spark, *_long_data(spark, d))
    return scored.select("window_id", "period", "match_id", "actual")


def search_trials(spark, d):
    """The drawn parameters of a search, each with a score."""
    outcomes = tune_and_refit(spark, d)
    drawn = [F.round(name, 6).alias(name) for name in QUICK_SPACE]
    return outcomes.select("trial_id", *drawn, (F.col("score") >= 0).alias("is_scored"))


def staged_search(spark, d):
    """40 trials over ten folds: eight draws of the other parameters, each fitted once a fold for five numbers of rounds."""
    _, data, _, _ = _regressor_data(spark, d)
    trials = Tr.trial_rows(tuning.trial_table(spark, tuning.TRIALS, QUICK_SPACE, stages=STAGES))
    outcomes = tuning.outcome_table(spark, Tr.tune(data, trials, folds=FOLDS).outcomes, QUICK_SPACE)
    drawn = [F.round(name, 6).alias(name) for name in QUICK_SPACE]
    return outcomes.select("trial_id", *drawn, (F.col("score") >= 0).alias("is_scored"))


def large_space_draws(spark, d):
    """A draw of the larger space, log-uniform penalties included, for every customer."""
    ids = V.table(spark, d, "customer").select(F.col("c_custkey").alias("trial_id"))
    drawn = tuning.with_draws(ids, tuning.LARGE_SPACE)
    return drawn.select("trial_id", *[F.round(F.col(name).cast("double"), 6).alias(name) for name in tuning.LARGE_SPACE])


REGISTERED = (
    regressor_extract,
    regressor_extract_selfjoin,
    regressor_extract_sql,
    hour_slot_counts,
    hour_band_counts,
    classifier_extract,
    exact_matches,
    similar_matches,
    constrained_extract_a,
    constrained_extract_b,
    constrained_extract_c,
    csv_round_trip,
    scenario_features,
    onehot_vocabulary,
    onehot_strict,
    onehot_lenient,
    aligned_features,
    feature_label_split,
    kfold_contiguous,
    kfold_shuffled,
    kfold_hashed,
    rolling_schedule,
    rolling_assignment,
    score_flags,
    kept_tournaments,
    caught_overlays,
    daily_result_gap,
    daily_result_gap_total,
    daily_profit_breakdown,
    confusion_matrix,
    classification_report,
    label_report,
    error_table,
    error_summary,
    value_boxplot,
    normalised_error,
    normalised_error_summary,
    fold_metrics,
    cv_objectives,
    chart_long,
    importance_ranked,
    best_trial,
    smote_balance,
    smote_class_counts,
    gbt_regressor_scores,
    scenario_scores,
    gbt_classifier_scores,
    feature_importance,
    cv_oof,
    classifier_cv_f1,
    classifier_search,
    tune_and_refit,
    temporal_cv,
    temporal_search,
    window_tuning,
    nearest_neighbours,
    score_consistency,
    classifier_consistency,
    importance_features,
    cv_oof_rows,
    cv_oof_ten_rows,
    temporal_cv_rows,
    temporal_cv_monthly_rows,
    window_tuning_rows,
    search_trials,
    staged_search,
    large_space_draws,
)
