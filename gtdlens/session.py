"""Session defaults and the shared folder for written intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Folders made for each application, to be freed by it alone.
_made: dict[str, list[str]] = {}

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def local_session(cores: int | str = 8, **extra: str) -> SparkSession:
    """Session for tests and the bench. A cluster job brings its own session."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("gtdlens")
    settings = {
        **DEFAULTS,
        "spark.driver.memory": "16g",
        "spark.sql.shuffle.partitions": "8",
        "spark.ui.showConsoleProgress": "false",
        **extra,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, named by the cluster in ``spark.checkpoint.dir``."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    made = tempfile.mkdtemp(prefix="gtdlens-")
    spark.sparkContext.setCheckpointDir(made)
    return made


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder; ``release_written`` deletes what is put there."""
    path = f"{shared_folder(spark)}/gtdlens/{name}-{uuid.uuid4().hex}"
    _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def write_once(df: DataFrame, name: str, rows_per_file: int = 0) -> DataFrame:
    """Write a table to the shared folder and read it back.

    Cuts the lineage, fixes row-order dependent values, and survives lost executors. ``rows_per_file`` bounds the rows
    of a file where given.
    """
    path = new_path(df.sparkSession, name)
    df.write.option("maxRecordsPerFile", rows_per_file).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release_written(spark: SparkSession) -> None:
    """Delete what this session has put under ``new_path``, once no result needs it."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    configuration = spark.sparkContext._jsc.hadoopConfiguration()
    for made in _made.pop(spark.sparkContext.applicationId, []):
        path = hadoop.Path(made)
        path.getFileSystem(configuration).delete(path, True)
