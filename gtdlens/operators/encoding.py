"""One-hot encoding against a fitted or a closed vocabulary."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import accumulate

from pyspark.ml import PipelineModel
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StringIndexerModel, VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gtdlens.operators.ranking import global_rank
from gtdlens.session import write_once

Vocabulary = Mapping[str, Sequence[str]]

# A missing value is a category of its own, under this text.
MISSING = "None"
# Values of all columns that become a feature of their own each; beyond it the dictionary stays a table.
MOST_VALUES = 100_000


def feature_name(column: str, value: str) -> str:
    return f"{column}_{value}"


def category_text(column: str) -> Column:
    return F.coalesce(F.col(f"`{column}`").cast("string"), F.lit(MISSING))


def fit_vocabulary(df: DataFrame, columns: Sequence[str], most: int = MOST_VALUES) -> dict[str, list[str]]:
    """Sorted distinct values per column. Numbers sort as numbers, a missing value last.

    One scan for all columns: the (column, value) pairs are combined map-side, so only
    distinct pairs are shuffled. What comes to the driver is one text per feature of the
    model, which holds them anyway. More than ``most`` are refused: such columns are encoded by a
    table, see :func:`fit_dictionary`.
    """
    pairs = F.array(
        *[F.struct(F.lit(c).alias("column"), category_text(c).alias("value")) for c in columns]
    )
    fitted: dict[str, list[str]] = {c: [] for c in columns}
    found = df.select(F.inline(pairs)).distinct().limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"more than {most} categories in {', '.join(columns)}: use fit_dictionary")
    for column, value in found:
        fitted[column].append(value)
    for column, found in fitted.items():
        is_number = isinstance(df.schema[column].dataType, T.NumericType)
        found.sort(key=lambda v: (v == MISSING, float(v) if is_number and v != MISSING else v))
    return fitted


def vocabulary_table(spark: SparkSession, vocabulary: Vocabulary) -> DataFrame:
    """The vocabulary as rows, with the position and feature name of each value."""
    rows = [
        (c, v, i, feature_name(c, v)) for c, values in vocabulary.items() for i, v in enumerate(values)
    ]
    schema = "column string, value string, position int, feature_name string"
    return spark.createDataFrame(rows, schema)


def feature_names(vocabulary: Vocabulary) -> list[str]:
    return [feature_name(c, v) for c, values in vocabulary.items() for v in values]


def _known(df: DataFrame, column: str, values: Sequence[str]) -> Column:
    text = category_text(column)
    refusal = F.concat(F.lit(f"unseen value in {column}: "), text)
    return F.when(text.isin(list(values)), F.col(column)).otherwise(F.raise_error(refusal))


def onehot(df: DataFrame, vocabulary: Vocabulary, strict: bool = False) -> DataFrame:
    """Replace each category column by one 0/1 column per vocabulary value.

    ``strict`` refuses a value outside the vocabulary; otherwise it gets all zeros.
    """
    if strict:
        df = df.withColumns({c: _known(df, c, values) for c, values in vocabulary.items()})
    flags = [
        F.when(F.col(c).isNull() if v == MISSING else F.col(c) == F.lit(v).cast(df.schema[c].dataType), 1.0)
        .otherwise(0.0)
        .alias(feature_name(c, v))
        for c, values in vocabulary.items()
        for v in values
    ]
    kept = [F.col(f"`{c}`") for c in df.columns if c not in vocabulary]
    return df.select(*kept, *flags)


def align(df: DataFrame, expected: Sequence[str], fill: float = 0.0) -> DataFrame:
    """Exactly the expected columns in their order: absent ones filled, others dropped.

    Only absent columns are filled; a NULL cell stays NULL.
    """
    have = set(df.columns)
    return df.select(
        [F.col(f"`{c}`") if c in have else F.lit(fill).alias(c) for c in expected]
    )


def hour_flags(hour: Column | str, prefix: str = "start_hour_local") -> list[Column]:
    """24 flags; a fractional hour counts as its whole hour, one outside the day as none."""
    whole = F.floor(F.col(hour) if isinstance(hour, str) else hour)
    return [
        F.coalesce(whole == h, F.lit(False)).alias(feature_name(prefix, str(h))) for h in range(24)
    ]


def value_flags(column: str, values: Sequence[str]) -> list[Column]:
    return [
        F.coalesce(F.col(column) == v, F.lit(False)).alias(feature_name(column, v)) for v in values
    ]


def feature_pipeline(
    vocabulary: Vocabulary,
    numbers: Sequence[str],
    strict: bool = False,
    missing: float = -1.0,
    output: str = "features",
) -> tuple[list, list[str]]:
    """Spark ML stages from raw columns to one sparse vector, and the feature names.

    The order is the numbers, then the flags of each category. An unseen category gives
    no flag, or an error when ``strict``. A missing number becomes ``missing``, which
    lies outside the domain of every number feature, so a tree can split it off.
    """
    columns = list(vocabulary)
    number_columns = [f"{c}__number" for c in numbers]
    text_columns = [f"{c}__text" for c in columns]
    index_columns = [f"{c}__index" for c in columns]
    flag_columns = [f"{c}__flags" for c in columns]
    selected = [
        f"coalesce(cast({c} as double), {float(missing)}D) as {a}"
        for c, a in zip(numbers, number_columns)
    ] + [f"coalesce(cast({c} as string), '{MISSING}') as {a}" for c, a in zip(columns, text_columns)]
    prepare = SQLTransformer(statement=f"select *, {', '.join(selected)} from __THIS__")
    # One indexer per column: the many-column constructor pads lists of unequal length.
    index = [
        StringIndexerModel.from_labels(
            list(vocabulary[c]), text, indexed, handleInvalid="error" if strict else "keep"
        )
        for c, text, indexed in zip(columns, text_columns, index_columns)
    ]
    # With "keep" the last index stands for unseen values; dropping it leaves all zeros.
    encode = OneHotEncoder(inputCols=index_columns, outputCols=flag_columns, dropLast=not strict)
    assemble = VectorAssembler(inputCols=number_columns + flag_columns, outputCol=output)
    helpers = number_columns + text_columns + index_columns + flag_columns
    tidy = SQLTransformer(
        statement=f"select * except ({', '.join(helpers)}) from __THIS__"
    )
    names = list(numbers) + feature_names(vocabulary)
    return [prepare, *index, encode, assemble, tidy], names


def fit_feature_pipeline(
    df: DataFrame,
    vocabulary: Vocabulary,
    numbers: Sequence[str],
    strict: bool = False,
    missing: float = -1.0,
) -> tuple[PipelineModel, list[str]]:
    """Fitting needs no pass over the data: the sizes come with the vocabulary."""
    stages, names = feature_pipeline(vocabulary, numbers, strict, missing)
    prepare, *index, encode, assemble, tidy = stages
    indexed = PipelineModel([prepare, *index]).transform(df.limit(0))
    return PipelineModel([prepare, *index, encode.fit(indexed), assemble, tidy]), names


def pipeline_inputs(model: PipelineModel) -> tuple[list[str], dict[str, list[str]]]:
    """The number columns and the vocabulary a fitted pipeline expects, in feature order."""
    numbers: list[str] = []
    vocabulary: dict[str, list[str]] = {}
    for stage in model.stages:
        if isinstance(stage, StringIndexerModel):
            vocabulary[stage.getInputCol().removesuffix("__text")] = list(stage.labels)
        elif isinstance(stage, VectorAssembler):
            numbers = [
                c.removesuffix("__number") for c in stage.getInputCols() if c.endswith("__number")
            ]
    return numbers, vocabulary


def padded(df: DataFrame, model: PipelineModel) -> tuple[DataFrame, list[str]]:
    """Add the columns a fitted pipeline needs and the batch lacks; return their names too.

    An absent number becomes 0 and an absent category matches no value. Cells that are
    there but NULL are left alone.
    """
    numbers, vocabulary = pipeline_inputs(model)
    have = {c.lower() for c in df.columns}
    absent = {c: F.lit(0.0) for c in numbers if c.lower() not in have}
    absent |= {c: F.lit(None).cast("string") for c in vocabulary if c.lower() not in have}
    return (df.withColumns(absent) if absent else df), list(absent)


# --- dictionaries too long for one column a value


DICTIONARY = ("column", "value", "position", "feature_name")


def fit_dictionary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The vocabulary as a written table, in the order of :func:`fit_vocabulary`: column, value, position, feature_name.

    Values are numbered by a parallel range sort, so a column may have as many as it has rows. Only
    the number of values of each column comes to the driver.
    """
    names = list(columns)
    texts = [
        F.struct(F.lit(i).alias("place"), category_text(c).alias("value"), _sorted_by(df, c).alias("number"))
        for i, c in enumerate(names)
    ]
    values = df.select(F.inline(F.array(*texts))).distinct()
    order = ["place", F.col("value") == MISSING, F.col("number").asc_nulls_last(), "value"]
    ranked, _ = global_rank(values, order, "__rank")
    ranked = write_once(ranked, "dictionary")
    # One row a column.
    first = {r["place"]: r["first"] for r in ranked.groupBy("place").agg(F.min("__rank").alias("first")).collect()}
    starts = F.create_map(*[F.lit(x) for i in range(len(names)) for x in (i, first.get(i, 0))])
    column = F.element_at(F.array(*[F.lit(c) for c in names]), F.col("place") + 1)
    return ranked.select(
        column.alias("column"),
        "value",
        (F.col("__rank") - F.element_at(starts, F.col("place"))).alias("position"),
        F.concat(column, F.lit("_"), "value").alias("feature_name"),
    )


def _sorted_by(df: DataFrame, column: str) -> Column:
    """Numbers sort as numbers, texts as texts."""
    is_number = isinstance(df.schema[column].dataType, T.NumericType)
    return F.col(f"`{column}`").cast("double") if is_number else F.lit(None).cast("double")


def dictionary_sizes(dictionary: DataFrame, columns: Sequence[str]) -> list[int]:
    """The number of values of each column."""
    counted = dict(dictionary.groupBy("column").count().collect())
    return [counted.get(c, 0) for c in columns]


def encode_by_dictionary(
    df: DataFrame, dictionary: DataFrame, columns: Sequence[str], strict: bool = False, output: str = "flags"
) -> DataFrame:
    """Replace the category columns by the indices of their flags in the one-hot vector, ascending.

    The vector has the flags of each column in turn, so an index is the value's position behind all values of the columns
    before. A value meets its position in a join by hash: a short dictionary is
    broadcast by its size, a long one is shuffled, where a hot value can be split. An unseen value has no flag, or
    an error when ``strict``.
    """
    offsets = [0, *accumulate(dictionary_sizes(dictionary, columns))]
    kept = [F.col(f"`{c}`") for c in df.columns if c not in columns]
    found = []
    for i, c in enumerate(columns):
        named = dictionary.where(F.col("column") == c).select(
            F.col("value").alias(f"__value{i}"), (F.col("position") + offsets[i]).alias(f"__index{i}")
        )
        df = df.join(named, category_text(c) == F.col(f"__value{i}"), "left").drop(f"__value{i}")
        index = F.col(f"__index{i}")
        if strict:
            refusal = F.raise_error(F.concat(F.lit(f"unseen value in {c}: "), category_text(c)))
            index = F.coalesce(index, refusal.cast("long"))
        found.append(index)
    return df.select(*kept, F.array_compact(F.array(*found)).alias(output))
