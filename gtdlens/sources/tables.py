"""Readers and writers: Parquet tables, CSV files, SQL texts and user-typed rows."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Parquet table; with a schema, its columns are checked and put in that order."""
    df = spark.read.parquet(path)
    return df if schema is None else conform(df, schema)


def conform(df: DataFrame, schema: T.StructType, pad: bool = False) -> DataFrame:
    """Select the columns of a schema by name (any case) and cast them to its types.

    With ``pad`` an absent column becomes NULL; otherwise it is an error.
    """
    have = {name.lower() for name in df.columns}
    missing = [f.name for f in schema if f.name.lower() not in have]
    if missing and not pad:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df.select(
        [
            (F.lit(None) if f.name in missing else df[f.name]).cast(f.dataType).alias(f.name)
            for f in schema
        ]
    )


def read_csv(
    spark: SparkSession,
    path: str | list[str],
    schema: T.StructType,
    pad: bool = False,
    by_position: bool = False,
) -> DataFrame:
    """CSV with a header line, its columns taken by name and cast to the schema's types.

    Only the header line is read to learn the names. Files of one folder, or of a list, must share it, and
    a value that does not fit its type is an error. ``by_position`` is for files whose
    header does not name the columns.
    """
    texts = spark.read.option("header", True).csv(path).schema
    if by_position:
        rows = spark.read.option("header", True).option("mode", "FAILFAST").schema(texts).csv(path)
        return conform(rows.toDF(*schema.names), schema)
    rows = (
        spark.read.option("header", True)
        .option("enforceSchema", False)
        .option("mode", "FAILFAST")
        .schema(texts)
        .csv(path)
    )
    return conform(rows, schema, pad)


def header_columns(spark: SparkSession, path: str) -> list[str]:
    return spark.read.option("header", True).csv(path).columns


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """CSV part files with a header line and no row number."""
    df.write.mode(mode).option("header", True).option("emptyValue", '""').csv(path)


def run_sql(
    spark: SparkSession,
    text: str,
    args: Mapping[str, object] | None = None,
    **tables: DataFrame,
) -> DataFrame:
    """Run a SQL text. Values go in as ``:name`` markers and tables as ``{name}``."""
    return spark.sql(text, args=dict(args or {}), **tables)


def run_sql_file(
    spark: SparkSession,
    path: str | Path,
    args: Mapping[str, object] | None = None,
    **tables: DataFrame,
) -> DataFrame:
    return run_sql(spark, Path(path).read_text(encoding="utf-8"), args, **tables)


def typed_rows(
    spark: SparkSession, rows: Iterable[Mapping[str, object]], schema: T.StructType
) -> DataFrame:
    """Rows typed by a user (one form, or a few) as a table of the given schema."""
    return spark.createDataFrame([tuple(r.get(f.name) for f in schema) for r in rows], schema)
