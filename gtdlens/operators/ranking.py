"""Global row positions without a single-task sort."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gtdlens.session import write_once

# monotonically_increasing_id() holds the partition above these bits, the row below.
ROW_BITS = 33


def global_rank(
    df: DataFrame, order: Sequence[Column | str], name: str = "row_rank"
) -> tuple[DataFrame, int]:
    """Add the 0-based position of each row in the given order; also return the row count.

    The rows are range-partitioned and sorted in parallel, numbered within their
    partition, and written once, so a rerun task cannot renumber them. Only one count
    per partition comes to the driver. Ties are broken by a hash of the whole row and
    then by scan position, so rows sharing one key, or plain copies, still spread over
    many partitions.
    """
    spark = df.sparkSession
    keys = [F.col(o) if isinstance(o, str) else o for o in order]
    tie = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    ordered = (
        df.select("*", tie.alias("__tie"), F.monotonically_increasing_id().alias("__scan"))
        .orderBy(*keys, "__tie", "__scan")
        .drop("__tie", "__scan")
        .withColumn("__place", F.monotonically_increasing_id())
    )
    stored = write_once(ordered, "ranked")
    part = F.shiftright("__place", ROW_BITS).alias("__part")
    sizes = stored.groupBy(part).count().collect()
    offsets, total = [], 0
    for row in sorted(sizes, key=lambda r: r["__part"]):
        offsets.append((row["__part"], total))
        total += row["count"]
    schema = T.StructType(
        [T.StructField("__part", T.LongType()), T.StructField("__offset", T.LongType())]
    )
    # One row per partition of the sort.
    starts = F.broadcast(spark.createDataFrame(offsets, schema))
    within = F.col("__place").bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    ranked = (
        stored.withColumn("__part", part)
        .join(starts, "__part")
        .withColumn(name, F.col("__offset") + within)
        .drop("__part", "__offset", "__place")
    )
    return ranked, total
