"""Evaluation reports over scored tournaments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gtdlens.functions import columns as C
from gtdlens.operators import metrics as M
from gtdlens.operators.quantiles import quantiles_of
from gtdlens.schemas import IMPORTANCES
from gtdlens.session import write_once
from gtdlens.sources.tables import read_csv

DAY = "start_date_local"


def with_outcome(scored: DataFrame, prediction: str = "prediction") -> DataFrame:
    """Add the predicted result and whether it falls short of the guarantee."""
    return scored.withColumn("result_pred", C.predicted_result(prediction)).withColumn(
        "has_overlay_pred", C.predicted_overlay("result_pred")
    )


def with_row_errors(scored: DataFrame, prediction: str = "prediction") -> DataFrame:
    return scored.withColumns(
        {
            "abs_error_collected": C.absolute_error("collected", prediction),
            "abs_error_result": C.absolute_error("mtt_result", "result_pred"),
        }
    )


def kept(scored: DataFrame) -> DataFrame:
    """Tournaments one would still run: no overlay predicted."""
    return scored.where(~F.col("has_overlay_pred"))


def caught_overlays(scored: DataFrame) -> DataFrame:
    """Tournaments with an overlay that was also predicted."""
    return scored.where(F.col("has_overlay") & F.col("has_overlay_pred"))


def daily_result_gap(scored: DataFrame) -> DataFrame:
    """Result per day of running everything and of running only the kept tournaments.

    Both sums come from one aggregate: a conditional sum is NULL on a day without a
    kept tournament, just as a left join to a second aggregate would leave it. The
    difference is then NULL too. Rows without a day belong to none.
    """
    keep = ~F.col("has_overlay_pred")
    kept_rows = F.count(F.when(keep, 1))
    kept_sum = F.sum(F.when(keep, F.coalesce("mtt_result", F.lit(0.0))))
    return (
        scored.where(F.col(DAY).isNotNull())
        .groupBy(DAY)
        .agg(
            F.coalesce(F.sum("mtt_result"), F.lit(0.0)).alias("actual_result"),
            F.when(kept_rows > 0, kept_sum).alias("predicted_result"),
        )
        .withColumn("dif", F.col("actual_result") - F.col("predicted_result"))
    )


def result_gap_total(scored: DataFrame) -> DataFrame:
    """Grand total of the daily differences; days without one are skipped."""
    return daily_result_gap(scored).agg(F.coalesce(F.sum("dif"), F.lit(0.0)).alias("dif_total"))


def daily_profit_breakdown(scored: DataFrame) -> DataFrame:
    """Overlay and profit per day, actual and as the prediction would have caught it."""
    overlay, flagged = F.col("has_overlay"), F.col("has_overlay_pred")

    def total(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col("mtt_result"))), F.lit(0.0))

    kept_rows = F.count(F.when(~flagged, 1))
    return (
        scored.where(F.col(DAY).isNotNull())
        .groupBy(DAY)
        .agg(
            total(overlay).alias("total_overlay_actual"),
            total(overlay & flagged).alias("total_overlay_pred"),
            total(~overlay).alias("profit_actual"),
            total(~overlay & ~flagged).alias("profit_pred"),
            F.when(kept_rows > 0, total(~flagged)).alias("profit_dif_total"),
        )
        .withColumn("dif_overlay", F.col("total_overlay_actual") - F.col("total_overlay_pred"))
        .withColumn("dif_profit", F.col("profit_actual") - F.col("profit_pred"))
    )


def overlay_confusion(scored: DataFrame) -> DataFrame:
    return M.confusion_matrix(scored, "has_overlay", "has_overlay_pred")


def error_summary(scored: DataFrame, prediction: str = "prediction") -> DataFrame:
    """Mean, median and box plot of the absolute error on the amount and on the result.

    The two errors are written once: the searches for medians pass over them several times,
    and scored rows would be predicted again on each pass.
    """
    errors = {
        "collected": C.absolute_error("collected", prediction),
        "mtt_result": C.absolute_error("mtt_result", "result_pred"),
    }
    written = write_once(scored.select(*[e.alias(name) for name, e in errors.items()]), "errors")
    return M.box_statistics(written, {name: F.col(name) for name in errors})


def chart_rows(
    df: DataFrame, ids: Sequence[str], values: Sequence[str], series: str = "series"
) -> DataFrame:
    """Long form for charts: one row per (row, series)."""
    return df.unpivot(list(ids), list(values), series, "value")


def normalised_errors(
    df: DataFrame, actual: str = "collected", prediction: str = "prediction"
) -> DataFrame:
    """Error table with the absolute error percentage also scaled to 0..100."""
    return M.min_max_scaled(
        M.with_errors(df, actual, prediction),
        "absolute_error_percentage",
        "normalised_error",
    )


def normalised_error_summary(errors: DataFrame) -> DataFrame:
    """Mean and median of the scaled error and of the plain absolute error."""
    series = ("absolute_difference", "normalised_error")
    errors = write_once(errors.select(*series), "errors")
    means = errors.agg(*[F.avg(c).alias(c) for c in series]).first()
    medians = quantiles_of(errors, {c: c for c in series}, [0.5])
    row = tuple(v for c in series for v in (means[c], medians[c][0]))
    names = "mean_abs_error", "median_abs_error", "mean_normalised_error", "median_normalised_error"
    schema = ", ".join(f"{n} double" for n in names)
    return errors.sparkSession.createDataFrame([row], schema)


def ranked_importances(importances: DataFrame) -> DataFrame:
    """Importance table under its display names, largest first."""
    named = importances.toDF("Feature Importance", "Value")
    return named.orderBy(F.desc("Value"), "Feature Importance")


def importances_from_csv(spark, path: str) -> DataFrame:
    # The table's header is that of an unnamed series: an empty name and a number.
    return ranked_importances(read_csv(spark, path, IMPORTANCES, by_position=True))


def best_trial(trials: DataFrame, score: str, trial_id: str = "trial_id", largest: bool = False) -> DataFrame:
    """The trial with the best score; the earliest of equals. A missing score never wins."""
    key = F.desc(score) if largest else F.asc(score)
    return trials.where(F.col(score).isNotNull()).orderBy(key, trial_id).limit(1)
