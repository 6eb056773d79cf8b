"""What the corpus operators share: reading, narrowing and passing Arrow batches through a function."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def narrowed(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Only the id (long) and the text, so that no other column can clash with an operator's own."""
    return df.select(
        F.col(f"`{id_column}`").cast("long").alias("doc_id"), F.col(f"`{text_column}`").cast("string").alias("text")
    )


_carried: set[str] = set()


def carry_code(spark: SparkSession) -> None:
    """Send this package's code to the executors once per application, so they need not have it installed.

    Workers import it like any module and so keep what they have compiled between tasks.
    """
    context, package = spark.sparkContext, Path(__file__).resolve().parent.parent
    if context.applicationId in _carried or not package.is_dir():
        return
    archive = Path(tempfile.mkdtemp(prefix="code-")) / f"{package.name}-code.zip"
    with zipfile.ZipFile(archive, "w") as file:
        for path in sorted(package.rglob("*.py")):
            file.write(path, path.relative_to(package.parent))
    context.addPyFile(str(archive))
    _carried.add(context.applicationId)


def per_batch(df: DataFrame, function: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Run a function from one Arrow batch to some Arrow batches in the tasks that hold the rows: no shuffle."""

    carry_code(df.sparkSession)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield from function(batch)

    return df.mapInArrow(run, schema)
