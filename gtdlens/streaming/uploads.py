"""Scoring of uploaded CSV files as they arrive.

Scoring keeps no state, so each uploaded file goes through the batch plan as it is.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import partial, reduce

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from gtdlens.operators.fitting import run_pool
from gtdlens.plans.training import score
from gtdlens.sources.models import load_model
from gtdlens.sources.tables import header_columns, read_csv, write_csv

FILES_PER_BATCH = 100


def score_uploads(
    spark: SparkSession,
    model: PipelineModel | str,
    schema: T.StructType,
    uploads: str,
    results: str,
    checkpoint: str,
) -> StreamingQuery:
    """Score every CSV file put into ``uploads`` once, and write CSV to ``results``.

    The stream carries file names only, so that each file's columns can be taken by its own
    header; a column of the schema that a file lacks is padded as in batch scoring. A batch
    writes its own folder, so a repeated one replaces it.
    """
    fitted = load_model(model) if isinstance(model, str) else model
    files = (
        spark.readStream.format("binaryFile")
        .schema("path string, modificationTime timestamp, length long, content binary")
        .option("pathGlobFilter", "*.csv")
        .option("maxFilesPerTrigger", FILES_PER_BATCH)
        .load(uploads)
        .select("path")
    )

    def write(batch: DataFrame, number: int) -> None:
        paths = sorted(row["path"] for row in batch.collect())
        if paths:
            write_csv(scored_files(spark, fitted, schema, paths), f"{results}/batch={number}", "overwrite")

    return (
        files.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def scored_file(spark: SparkSession, model: PipelineModel | str, schema: T.StructType, path: str) -> DataFrame:
    """One CSV file, scored. Columns the file lacks are left to the scoring, then NULL."""
    return scored_files(spark, model, schema, [path])


def scored_files(
    spark: SparkSession, model: PipelineModel | str, schema: T.StructType, paths: Sequence[str]
) -> DataFrame:
    """CSV files, scored in one scan for all files of the same header, in whatever number they come."""
    fitted = load_model(model) if isinstance(model, str) else model

    def header(path: str) -> tuple[str, tuple[str, ...]]:
        return path, tuple(header_columns(spark, path))

    headers = dict(run_pool(spark, [partial(header, path) for path in paths]))
    groups: dict[tuple[str, ...], list[str]] = {}
    for path in paths:
        groups.setdefault(headers[path], []).append(path)
    return reduce(DataFrame.unionByName, [_scored(spark, fitted, schema, *group) for group in groups.items()])


def _scored(
    spark: SparkSession, model: PipelineModel, schema: T.StructType, header: tuple[str, ...], paths: list[str]
) -> DataFrame:
    have = {name.lower() for name in header}
    there = T.StructType([f for f in schema if f.name.lower() in have])
    scored = score(read_csv(spark, paths, there), model)
    absent = {f.name: F.lit(None).cast(f.dataType) for f in schema if f.name.lower() not in have}
    return scored.withColumns(absent) if absent else scored
