"""Registered queries that check values where the larger model queries can only be checked for their shape.

A booster of one round and depth 1 over 0/1 flags is a plain aggregate: the flag that leaves the least variance, and the
two means. So a SQL text can repeat its training, and with it out-of-fold rows, searches, saved models and windows.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gtdlens import schemas
from gtdlens.checks.queries import RANGES, SCENARIO
from gtdlens.functions import columns as C
from gtdlens.operators import encoding as E
from gtdlens.operators import metrics as M
from gtdlens.operators import modeling as Mo
from gtdlens.operators import splits
from gtdlens.operators import tuning
from gtdlens.operators.group_quantiles import grouped_quantiles
from gtdlens.plans import extracts as X
from gtdlens.plans import lookups as L
from gtdlens.plans import reports as R
from gtdlens.plans import scenario as Sc
from gtdlens.plans import training as Tr
from gtdlens.session import new_path, write_once
from gtdlens.sources import sample_views as V
from gtdlens.sources import tables
from gtdlens.sources.models import cached_model, save_model
from gtdlens.streaming.uploads import scored_file

STUMP = {"trial_id": 0, "n_estimators": 1, "max_depth": 1}
ALL_CLASSES = ("Micro", "Low", "Medium", "High")


# --- extracts over odd hours and partial periods


def _odd_hours(spark, d) -> DataFrame:
    """Tournaments with some hours outside the day and some missing."""
    hour = (
        F.when(F.col("match_id") % 97 == 0, -1)
        .when(F.col("match_id") % 89 == 0, 24)
        .when(F.col("match_id") % 83 == 0, F.lit(None))
        .otherwise(F.col("start_hour_local"))
    )
    return V.tournaments(spark, d).withColumn("start_hour_local", hour.cast("int"))


def odd_hours_short_period(spark, d):
    return X.regressor_extract(_odd_hours(spark, d), date(2024, 1, 5), date(2024, 1, 20))


def odd_hours_long_period(spark, d):
    return X.regressor_extract_sql(_odd_hours(spark, d), date(1800, 1, 1), date(2300, 1, 1))


def odd_hours_open_period(spark, d):
    return X.regressor_extract(_odd_hours(spark, d), None, None)


def daily_gap_missing_days(spark, d):
    """Rows without a day belong to no day."""
    day = F.when(F.col("match_id") % 50 != 0, F.col(R.DAY))
    scored = R.with_outcome(V.predicted(V.tournaments(spark, d))).withColumn(R.DAY, day)
    gap = R.daily_result_gap(scored)
    return gap.select(R.DAY, *[F.round(c, 2).alias(c) for c in gap.columns if c != R.DAY])


# --- many scenarios at once


def _scenarios(spark, d) -> DataFrame:
    """One typed scenario per customer: every class, weekday and period occurs."""
    key = F.col("c_custkey")
    days = "sunday", "monday", "tuesday", "wednesday", "thursday", "friday", "saturday"
    return V.table(spark, d, "customer").select(
        key.alias("scenario_id"),
        F.when(key % 3 == 0, "MTT-PLO5").otherwise("MTT").alias("match_type_detail_name"),
        V.pick(key % 4, *ALL_CLASSES).alias("class_match"),
        V.pick(F.floor(key / 4) % 7, *days).alias("day_of_week"),
        V.pick(F.floor(key / 28) % 4, "dawn", "morning", "afternoon", "evening").alias("period"),
        V.pick(key % 3, *map(str, (5.5, 11.0, 22.0))).cast("double").alias("buyin_price"),
        F.when(key % 2 == 0, 0.0).otherwise(11.0).alias("rebuy_price"),
        V.pick(key % 3, *map(str, (5.5, 11.0, 22.0))).cast("double").alias("addon_price"),
        ((key % 10) * 25.5).cast("double").alias("gtd_match"),
    )


def batch_exact_matches(spark, d):
    found = L.batch_matches(V.products(spark, d), V.prices(spark, d), _scenarios(spark, d))
    return found.select("scenario_id", "id_match", "buyin_price", "rebuy_price", "gtd_match", "day_of_week", "period")


def batch_similar_matches(spark, d):
    typed = _scenarios(spark, d)
    ranges = {f"{c}_min": F.col(c) - 6.0 for c in ("buyin_price", "rebuy_price", "addon_price")}
    ranges |= {f"{c}_max": F.col(c) + 6.0 for c in ("buyin_price", "rebuy_price", "addon_price")}
    ranges |= {"gtd_match_min": F.col("gtd_match") - 26.0, "gtd_match_max": F.col("gtd_match") + 26.0}
    found = L.batch_matches(V.products(spark, d), V.prices(spark, d), typed.withColumns(ranges), similar=True)
    return found.select("scenario_id", "id_match", "buyin_price", "rebuy_price", "gtd_match", "day_of_week", "period")


# --- lookups from the stored table


def _stored_lookup(spark, d) -> DataFrame:
    """Loaded up to a day, then refreshed by the last of these days again and all after it."""
    products, prices, path = V.products(spark, d), V.prices(spark, d), new_path(spark, "lookup")
    day = F.col("date_start_time_match_utc_local").cast("date")
    first, last = products.agg(F.min(day), F.max(day)).first()
    middle = first + (last - first) / 2
    L.store_lookup(products.where(day <= F.lit(middle)), prices, path)
    L.store_lookup(products.where(day >= F.lit(middle)), prices, path)
    return L.open_lookup(spark, path)


def stored_exact_matches(spark, d):
    return L.stored_exact_matches(_stored_lookup(spark, d), SCENARIO)


def stored_similar_matches(spark, d):
    return L.stored_similar_matches(_stored_lookup(spark, d), SCENARIO, RANGES)


def stored_lookup_empty(spark, d):
    """Whether each customer's scenario has any similar tournament: the form says so when the answer is empty."""
    asked = _scenarios(spark, d)
    found = batch_similar_matches(spark, d).select("scenario_id").distinct().withColumn("found", F.lit(True))
    return asked.join(found, "scenario_id", "left").select("scenario_id", F.col("found").isNull().alias("is_empty"))


# --- dictionaries that stay tables


def dictionary_flags(spark, d):
    """One-hot indices over the categories and a column with as many values as rows, in a dictionary of the earlier half."""
    rows = V.yearly_tournaments(spark, d).withColumn("series", F.concat(F.lit("serie "), "match_id"))
    columns = ["ko_type", "start_hour_local", "series"]
    first, last = rows.agg(F.min("start_date_local"), F.max("start_date_local")).first()
    known = rows.where(F.col("start_date_local") <= F.lit(first + (last - first) / 2))
    encoded = E.encode_by_dictionary(rows, E.fit_dictionary(known, columns), columns)
    return encoded.select("match_id", F.concat_ws(",", F.transform("flags", lambda i: i.cast("string"))).alias("flags"))


# --- many groups at once


def class_error_quantiles(spark, d):
    """Quartiles of the absolute error of every class and fold, searched by rank beyond 100 values."""
    scored = splits.hashed_folds(V.predicted(V.tournaments(spark, d)), ["match_id"])
    gap = F.abs(F.col("collected") - F.col("prediction") * 1.5)
    found = grouped_quantiles(scored, ["class_match", "fold"], gap, [0.25, 0.5, 0.75], gather_limit=100)
    named = [F.round(F.col("quantiles")[i], 6).alias(n) for i, n in enumerate(("q1", "median", "q3"))]
    return found.select("class_match", "fold", *named)


# --- boosters of one split


def _off_halves():
    """A mean over 32 rows may lie on half of the sixth place, where the order of its sum decides; the SQL adds the same."""
    return F.round(F.col("prediction") + 1e-8, 6).alias("prediction")


def _flag_data(rows: DataFrame, folds: int, by_day: bool = False):
    """Only the category flags as features, with hashed folds, written once."""
    data, encoder, names = Mo.encoded(
        rows, schemas.REGRESSOR_CATEGORIES, [], schemas.REGRESSOR_LABEL, keep=schemas.REGRESSOR_KEYS
    )
    return write_once(splits.hashed_folds(data, ["match_id"], folds), "flags"), encoder, names


def _month(spark, d) -> DataFrame:
    return X.regressor_extract(V.tournaments(spark, d), None, None, classes=ALL_CLASSES)


def stump_scores(spark, d):
    """Fit, save, and score the extract with the model read back."""
    rows = _month(spark, d)
    data, encoder, _ = _flag_data(rows, 3)
    path = new_path(spark, "stump")
    save_model(Mo.joined_pipeline(encoder, Mo.fit_regressor(data, STUMP)), path)
    scored = Tr.score(rows, path)
    rounded = [F.round(c, 6).alias(c) for c in ("prediction", "result_pred")]
    return scored.select("match_id", *rounded, "has_overlay_pred")


def stump_importances(spark, d):
    data, _, names = _flag_data(_month(spark, d), 3)
    return Mo.feature_importances(data, Mo.fit_regressor(data, STUMP), names)


def stump_out_of_fold(spark, d):
    data, _, _ = _flag_data(_month(spark, d), 5)
    scored, _ = Mo.out_of_fold(data, lambda train: Mo.fit_regressor(train, STUMP), Mo.training_parts(data, 5))
    return scored.select("match_id", "fold", "actual", F.round("prediction", 6).alias("prediction"))


def stump_search(spark, d):
    """The pooled median error of the search, and its model refitted on all rows."""
    data, _, _ = _flag_data(_month(spark, d), 5)
    tuned = Tr.tune(data, [STUMP], folds=5)
    refitted = tuned.model.transform(data).select(
        "match_id", F.round("prediction", 6).alias("prediction"), F.lit(round(tuned.best.score, 6)).alias("score")
    )
    return refitted


def stump_classes(spark, d):
    """The classifier on labels 0 and 1, for every row of the extract."""
    rows = X.classifier_extract(V.products(spark, d), V.prices(spark, d))
    usable = Mo.binary_labels(rows, schemas.CLASSIFIER_LABEL)
    vocabulary = E.fit_vocabulary(rows, schemas.CLASSIFIER_CATEGORIES)
    data, encoder, _ = Mo.encoded(
        usable, schemas.CLASSIFIER_CATEGORIES, [], schemas.CLASSIFIER_LABEL, ["id_match"], True, vocabulary
    )
    data = write_once(data, "flags")
    model = Mo.joined_pipeline(encoder, Mo.fit_classifier(data, STUMP))
    return Tr.classify(rows, model).select("id_match", "buyin_price", "rebuy_price", "prediction", "outcome_text")


def _class_folds(spark, d, folds=5):
    """Category flags of the rows labelled 0 or 1, in hashed folds."""
    rows = X.classifier_extract(V.products(spark, d), V.prices(spark, d))
    usable = Mo.binary_labels(rows, schemas.CLASSIFIER_LABEL)
    vocabulary = E.fit_vocabulary(rows, schemas.CLASSIFIER_CATEGORIES)
    kept = ["id_match", "buyin_price", "rebuy_price"]
    data, _, names = Mo.encoded(usable, schemas.CLASSIFIER_CATEGORIES, [], schemas.CLASSIFIER_LABEL, kept, True, vocabulary)
    return write_once(splits.hashed_folds(data, ["id_match"], folds), "flags"), names


def _class_predictions(data, folds=5):
    return Mo.out_of_fold(data, lambda train: Mo.fit_classifier(train, STUMP), Mo.training_parts(data, folds))


def stump_class_folds(spark, d):
    scored, _ = _class_predictions(_class_folds(spark, d)[0])
    return scored.select("id_match", "buyin_price", "rebuy_price", "fold", "actual", "prediction")


def stump_class_report(spark, d):
    """The report over all folds' predictions together."""
    scored, _ = _class_predictions(_class_folds(spark, d)[0])
    report = M.classification_report(scored, "actual", "prediction")
    return report.select("label", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support")


def stump_class_importances(spark, d):
    """Importances of the last fold's classifier."""
    data, names = _class_folds(spark, d)
    return R.ranked_importances(Mo.feature_importances(data, _class_predictions(data)[1], names))


def stump_class_search(spark, d):
    """The search of the classifier by the mean F1 over the folds."""
    data, _ = _class_folds(spark, d)
    trials = [STUMP, {**STUMP, "trial_id": 1, "learning_rate": 0.5}]
    tuned = Tr.tune(data, trials, 5, fit=Mo.fit_classifier, objective=tuning.mean_fold_f1, largest=True)
    return data.sparkSession.createDataFrame(
        [(o.trial["trial_id"], round(o.score, 6), o is tuned.best) for o in tuned.outcomes],
        "trial_id long, score double, best boolean",
    )


def typed_scores(spark, d):
    """Planned tournaments as typed into the form, scored by a saved model that the session keeps."""
    data, encoder, _ = _flag_data(_month(spark, d), 3)
    path = save_model(Mo.joined_pipeline(encoder, Mo.fit_regressor(data, STUMP)), new_path(spark, "stump"))
    scored = Tr.score(Sc.scenario_rows(V.scenarios(spark, d)), cached_model(path))
    rounded = [F.round(c, 6).alias(c) for c in ("prediction", "result_pred")]
    return scored.select("scenario_id", "gtd", *rounded, "has_overlay_pred")


def _monthly_windows(spark, d):
    rows = V.yearly_tournaments(spark, d)
    days = rows.agg(F.min("start_date_local"), F.max("start_date_local")).first()
    extract = X.regressor_extract(rows, days[0], days[1], classes=ALL_CLASSES)
    data, encoder, _ = _flag_data(extract, 5)
    return data, encoder, splits.rolling_windows(splits.add_months(days[0], 11), days[1] + timedelta(days=1))


def stump_monthly_windows(spark, d):
    """11 months of training, 1 of validation, step 1, over the whole table."""
    data, _, windows = _monthly_windows(spark, d)
    scored, _ = Mo.out_of_window(data, lambda train: Mo.fit_regressor(train, STUMP), windows)
    return scored.select("window_id", "fold", "match_id", "actual", _off_halves())


def _window_models(spark, data, encoder, windows, folds):
    _, scored = Tr.tune_windows(data, encoder, windows, [STUMP], new_path(spark, "windows"), folds=folds)
    return scored.select("window_id", "period", "match_id", "actual", _off_halves())


def stump_window_models(spark, d):
    """A tuned, saved and reloaded model for every monthly window, two folds each."""
    return _window_models(spark, *_monthly_windows(spark, d), folds=2)


def stump_all_window_models(spark, d):
    """The same with five folds; one trial wins whatever its folds."""
    return _window_models(spark, *_monthly_windows(spark, d), folds=5)


def csv_scored(spark, d):
    """An uploaded file in another column order and without one column, scored, written and read back."""
    rows = _month(spark, d)
    data, encoder, _ = _flag_data(rows, 3)
    model = Mo.joined_pipeline(encoder, Mo.fit_regressor(data, STUMP))
    given, back = new_path(spark, "upload"), new_path(spark, "scored")
    tables.write_csv(rows.select(*[c for c in reversed(rows.columns) if c != "earlybird"]), given)
    scored = scored_file(spark, model, rows.schema, given)
    tables.write_csv(scored.select(sorted(scored.columns)), back)
    read = tables.read_csv(spark, back, scored.schema)
    rounded = [F.round(c, 6).alias(c) for c in ("prediction", "result_pred")]
    return read.select("match_id", "start_date_local", "ko_type", "gtd", "collected", "earlybird", *rounded, "has_overlay_pred")


def days_from_text(spark, d):
    """Dates typed as text, with some that are none."""
    typed = F.when(F.col("o_orderkey") % 40 == 0, F.lit("soon")).otherwise(F.col("o_orderdate").cast("date").cast("string"))
    return V.table(spark, d, "orders").select("o_orderkey", C.day_from_text(typed).alias("day"))


REGISTERED = (
    stored_exact_matches,
    stored_similar_matches,
    stored_lookup_empty,
    dictionary_flags,
    class_error_quantiles,
    stump_class_folds,
    stump_class_report,
    stump_class_importances,
    stump_class_search,
    typed_scores,
    odd_hours_short_period,
    odd_hours_long_period,
    odd_hours_open_period,
    daily_gap_missing_days,
    batch_exact_matches,
    batch_similar_matches,
    stump_scores,
    stump_importances,
    stump_out_of_fold,
    stump_search,
    stump_classes,
    stump_monthly_windows,
    stump_window_models,
    stump_all_window_models,
    csv_scored,
    days_from_text,
)
