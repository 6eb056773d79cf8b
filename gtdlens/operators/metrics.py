"""Error tables, class counts and fold scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gtdlens.functions.columns import absolute_error
from gtdlens.operators.group_quantiles import grouped_quantiles
from gtdlens.operators.quantiles import exact_quantiles, quantiles_of


def with_errors(df: DataFrame, actual: str = "actual", predicted: str = "prediction") -> DataFrame:
    """Four error columns; the percentages are NULL where the actual value is zero."""
    difference = F.col(actual) - F.col(predicted)
    percentage = F.try_divide(difference, F.col(actual)) * 100
    return df.withColumns(
        {
            "absolute_difference": F.abs(difference),
            "squared_difference": difference * difference,
            "error_percentage": percentage,
            "absolute_error_percentage": F.abs(percentage),
        }
    )


def as_label(column: str) -> Column:
    """Boolean, integer and fractional labels on one scale."""
    return F.col(column).cast("double")


def _pair_counts(df: DataFrame, actual: str, predicted: str, labels: Sequence[int]) -> DataFrame:
    """Rows per (actual, predicted), with NULL for a prediction outside the labels.

    One hash update per input row, and a handful of rows after the map-side combine.
    """
    a, p = as_label(actual), as_label(predicted)
    known = df.where(a.isin(list(labels)) & p.isNotNull())
    chosen = F.when(p.isin(list(labels)), p)
    return known.groupBy(a.alias("a"), chosen.alias("p")).agg(F.count("*").alias("n"))


def _total(condition: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0))


def confusion_matrix(
    df: DataFrame, actual: str, predicted: str, labels: Sequence[int] = (0, 1)
) -> DataFrame:
    """Rows per (actual, predicted) pair of the given labels; other labels are ignored.

    One aggregate row holds all cells, so a pair that never occurs still gets its zero.
    """
    a, p = F.col("a"), F.col("p")
    cells = [(x, y) for x in labels for y in labels]
    counted = _pair_counts(df, actual, predicted, labels).agg(
        *[_total((a == x) & (p == y)).alias(f"c{i}") for i, (x, y) in enumerate(cells)]
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(x).alias("actual"), F.lit(y).alias("predicted"), F.col(f"c{i}").alias("rows")
            )
            for i, (x, y) in enumerate(cells)
        ]
    )
    return counted.select(F.inline(rows))


def _ratio_or_zero(top: Column, bottom: Column) -> Column:
    return F.when(bottom > 0, top / bottom).otherwise(0.0)


def classification_report(
    df: DataFrame, actual: str, predicted: str, labels: Sequence[int] = (0, 1)
) -> DataFrame:
    """Precision, recall, F1 and support per class, accuracy, macro and weighted averages.

    All counts come from one aggregate. The accuracy row has its value under ``f1``.
    """
    a, p = F.col("a"), F.col("p")
    sums = [_total(a == p).alias("right")]
    for i, label in enumerate(labels):
        sums += [
            _total((a == label) & (p == label)).alias(f"hit{i}"),
            _total(a == label).alias(f"support{i}"),
            _total(p == label).alias(f"chosen{i}"),
        ]
    counted = _pair_counts(df, actual, predicted, labels).agg(*sums)
    n = len(labels)
    support = [F.col(f"support{i}") for i in range(n)]
    total = sum(support[1:], support[0])
    precision = [_ratio_or_zero(F.col(f"hit{i}"), F.col(f"chosen{i}")) for i in range(n)]
    recall = [_ratio_or_zero(F.col(f"hit{i}"), support[i]) for i in range(n)]
    f1 = [_ratio_or_zero(2 * F.col(f"hit{i}"), support[i] + F.col(f"chosen{i}")) for i in range(n)]

    def macro(scores: list[Column]) -> Column:
        return sum(scores[1:], scores[0]) / n

    def weighted(scores: list[Column]) -> Column:
        products = [s * w for s, w in zip(scores, support)]
        return _ratio_or_zero(sum(products[1:], products[0]), total)

    def line(name: str, *values: Column) -> Column:
        names = ("precision", "recall", "f1", "support")
        return F.struct(F.lit(name).alias("label"), *[v.alias(c) for v, c in zip(values, names)])

    nothing = F.lit(None).cast("double")
    lines = [
        line(str(label), precision[i], recall[i], f1[i], support[i]) for i, label in enumerate(labels)
    ]
    lines += [
        line("accuracy", nothing, nothing, _ratio_or_zero(F.col("right"), total), total),
        line("macro avg", macro(precision), macro(recall), macro(f1), total),
        line("weighted avg", weighted(precision), weighted(recall), weighted(f1), total),
    ]
    return counted.select(F.inline(F.array(*lines)))


def r_squared(actual: str, predicted: str) -> Column:
    """Aggregate expression: 1 - residual / total sum of squares, over the rows with both values."""
    p = F.when(F.col(actual).isNotNull(), F.col(predicted))
    a = F.when(F.col(predicted).isNotNull(), F.col(actual))
    residual = F.sum((a - p) * (a - p))
    spread = F.var_pop(a) * F.count(a)
    return F.when(spread > 0, 1 - residual / spread)


def mean_absolute_error(actual: str, predicted: str) -> Column:
    return F.avg(absolute_error(actual, predicted))


def mean_squared_error(actual: str, predicted: str) -> Column:
    difference = F.col(actual) - F.col(predicted)
    return F.avg(difference * difference)


def class_f1(actual: str, predicted: str, label: int = 0) -> Column:
    """Aggregate expression: F1 of one class (by default the loss class), 0 where undefined."""
    a, p = as_label(actual) == label, as_label(predicted) == label
    either = F.count(F.when(a, 1)) + F.count(F.when(p, 1))
    return _ratio_or_zero(2 * F.count(F.when(a & p, 1)), either)


def fold_scores(df: DataFrame, fold: str, **scores: Column) -> DataFrame:
    """The given aggregate expressions per fold, in one pass."""
    return df.groupBy(fold).agg(*[score.alias(name) for name, score in scores.items()])


def mean_of_folds(scores: DataFrame, *names: str) -> DataFrame:
    """Each fold counts once, whatever its size."""
    return scores.agg(*[F.avg(n).alias(f"mean_{n}") for n in names])


def min_max_scaled(df: DataFrame, column: str, output: str, top: float = 100.0) -> DataFrame:
    """Scale a column to 0..top over the whole table; NULL where all values are equal.

    The two bounds are one scalar subquery, so the rows stay where they are.
    """
    bounds = df.agg(F.struct(F.min(column).alias("low"), F.max(column).alias("high")).alias("b"))
    bound = bounds.scalar()
    low, high = bound["low"], bound["high"]
    return df.withColumn(output, top * F.try_divide(F.col(column) - low, high - low))


BOX = T.StructType(
    [
        T.StructField("series", T.StringType()),
        T.StructField("mean", T.DoubleType()),
        T.StructField("median", T.DoubleType()),
        T.StructField("q1", T.DoubleType()),
        T.StructField("q3", T.DoubleType()),
        T.StructField("whisker_low", T.DoubleType()),
        T.StructField("whisker_high", T.DoubleType()),
    ]
)


def box_statistics(df: DataFrame, series: dict[str, Column]) -> DataFrame:
    """Mean, quartiles and whiskers of each series, one row per series, in shared scans.

    A whisker ends at the outermost value within 1.5 box heights of the box, or at the
    box itself where there is none.
    """
    quartiles = quantiles_of(df, series, [0.25, 0.5, 0.75])
    filled = {name: q for name, q in quartiles.items() if q[1] is not None}
    ends = []
    for name, (q1, _, q3) in filled.items():
        value, reach = series[name], 1.5 * (q3 - q1)
        ends += [
            F.avg(value).alias(f"{name}_mean"),
            F.min(F.when(value >= q1 - reach, value)).alias(f"{name}_low"),
            F.max(F.when(value <= q3 + reach, value)).alias(f"{name}_high"),
        ]
    found = df.agg(*ends).first() if ends else {}
    rows = []
    for name in series:
        if name not in filled:
            rows.append((name, None, None, None, None, None, None))
            continue
        q1, median, q3 = filled[name]
        low, high = min(found[f"{name}_low"], q1), max(found[f"{name}_high"], q3)
        rows.append((name, found[f"{name}_mean"], median, q1, q3, low, high))
    return df.sparkSession.createDataFrame(rows, BOX)


def median_absolute_error(df: DataFrame, actual: str, predicted: str) -> float | None:
    return exact_quantiles(df, absolute_error(actual, predicted), [0.5])[0]


def median_absolute_errors(df: DataFrame, keys: Sequence[str], actual: str, predicted: str) -> DataFrame:
    """The median absolute error of every group, as ``score``, in passes that all groups share."""
    found = grouped_quantiles(df, keys, absolute_error(actual, predicted), [0.5])
    return found.select(*keys, F.element_at("quantiles", 1).alias("score"))
