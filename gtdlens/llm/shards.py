"""Shards of near equal bytes by K-d tree partitioning.

Each row is a point of metadata (its size, the checksum of its text). A node is split along its widest dimension, relative to the
whole table's range, at the weighted median: the bytes on either side are in the ratio of the leaves they become. That
goes on until every leaf holds the target bytes. Rows with the same value are told apart by checksum, then id, so equal texts
stay together unless a median falls between them, and a group of copies that holds a third of all bytes is still
split evenly.

The medians are exact and distributed: each pass sums bytes in a few hundred bins per node and narrows down the bin that
holds the median, so the driver sees bins and never rows. The passes read a narrow table written once.

Defined results: a null text has no bytes and size 1; a null id sorts before all ids; repeated rows always share
a shard and get slots of their own; an empty table gives no rows; a shard may stay empty if rows are few.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gtdlens.llm.common import narrowed
from gtdlens.operators.ranking import global_rank
from gtdlens.session import write_once

BINS = 1024
FEW_ROWS = 2_000  # candidates for a median that are fetched at once; more are narrowed down
LAW = "bytes"


def points(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Narrow rows: id, bytes plus one, unsigned checksum of the text."""
    raw = F.coalesce(F.encode(F.col("text"), "UTF-8"), F.lit("").cast("binary"))
    return narrowed(df, id_column, text_column).select(
        "doc_id",
        (F.octet_length(raw) + 1).cast("long").alias("size"),
        F.crc32(raw).cast("long").alias("text_crc32"),
    )


def kd_shards(
    rows: DataFrame,
    shards: int | None = None,
    target_bytes: int | None = None,
    dimensions: Sequence[str] = ("size", "text_crc32"),
    bins: int = BINS,
) -> DataFrame:
    """Add `shard` to rows of `points`; give the number of shards or the bytes a leaf may hold.

    What comes to the driver, and is broadcast, is one row per node and `bins` sums per node that is being split.
    """
    spark = rows.sparkSession
    stored = write_once(rows, "points")
    names = [*dimensions, *[k for k in ("text_crc32", "doc_id") if k not in dimensions]]
    orders = [[d, *[c for c in names if c != d]] for d in dimensions]
    placed = stored.withColumn("node", F.lit(0))
    whole = _ranges(placed, dimensions).collect()
    if not whole:
        return stored.withColumn("shard", F.lit(0))
    if shards is None:
        shards = max(1, -(-whole[0]["bytes"] // target_bytes))
    widths = [max(1, whole[0][f"high_{d}"] - whole[0][f"low_{d}"]) for d in dimensions]
    leaves = {0: shards}  # of each node, which is named by the first of its leaves
    while any(n > 1 for n in leaves.values()):
        nodes = {}
        for r in _ranges(placed, dimensions).collect():
            if leaves[r["node"]] > 1:
                spread = [(r[f"high_{d}"] - r[f"low_{d}"]) / w for d, w in zip(dimensions, widths)]
                widest = spread.index(max(spread))
                low, high = r[f"low_{dimensions[widest]}"], r[f"high_{dimensions[widest]}"]
                nodes[r["node"]] = _Node(widest, leaves[r["node"]], r["bytes"], r["rows"], low, high)
        keyed = placed.withColumn("__all", F.array(*[_key(order) for order in orders]))
        _find_medians(spark, keyed, dict(nodes), len(names), bins)
        splits = [(k, n.order, n.median, k + n.leaves // 2) for k, n in nodes.items()]
        for k, n in list(leaves.items()):
            if n > 1:
                leaves[k], leaves[k + n // 2] = n // 2, n - n // 2
        table = spark.createDataFrame(splits, "node int, __order int, __median array<bigint>, __right int")
        # One row per node.
        placed = (
            keyed.join(F.broadcast(table), "node", "left")
            .withColumn("__beyond", F.get(F.col("__all"), F.col("__order")) > F.col("__median"))
            .withColumn("node", F.when(F.col("__beyond"), F.col("__right")).otherwise(F.col("node")))
            .select(*stored.columns, "node")
        )
    return placed.withColumnRenamed("node", "shard")


@dataclass
class _Node:
    """A node to split: which key order, its leaves, its bytes, and the median key found so far."""

    order: int
    leaves: int
    bytes: int
    rows: int  # that may hold the median
    low: int
    high: int
    before: int = 0  # bytes known to lie below the median
    median: list[int] = field(default_factory=list)

    def reached(self, more: int) -> bool:
        """Whether the left-hand leaves' share of the bytes is reached with these more."""
        return (self.before + more) * self.leaves >= self.bytes * (self.leaves // 2)

    def narrow(self, sums: dict[int, tuple[int, int]], width: int) -> None:
        """Go on in the bin that holds the median."""
        for b in sorted(sums):
            if self.reached(sums[b][0]):
                break
            self.before += sums[b][0]
        self.rows = sums[b][1]
        self.low, self.high = self.low + b * width, min(self.high, self.low + (b + 1) * width - 1)

    def settle(self, keys: list[tuple[list[int], int]]) -> None:
        """Take the median from the few keys left."""
        for self.median, size in keys:
            if self.reached(size):
                break
            self.before += size


def _key(order: Sequence[str]) -> Column:
    return F.array(*[F.coalesce(F.col(c).cast("long"), F.lit(-(1 << 63)).cast("long")) for c in order])


def _ranges(placed: DataFrame, dimensions: Sequence[str]) -> DataFrame:
    return placed.groupBy("node").agg(
        F.sum("size").alias("bytes"),
        F.count("*").alias("rows"),
        *[F.min(d).alias(f"low_{d}") for d in dimensions],
        *[F.max(d).alias(f"high_{d}") for d in dimensions],
    )


def _find_medians(spark: SparkSession, keyed: DataFrame, nodes: dict[int, _Node], depth: int, bins: int) -> None:
    """Find each node's median key: narrow histograms of bytes, one component after the other, until few rows are left."""
    schema = "node int, __order int, __fixed array<bigint>, __low decimal(20,0), __high decimal(20,0), __width decimal(20,0)"
    key = F.get(F.col("__all"), F.col("__order"))

    def matching(live: dict[int, _Node], at: int, inside: bool = True) -> DataFrame:
        """The rows of these nodes that share the components found so far and lie in the range of the next."""
        rows = [(k, n.order, n.median, Decimal(n.low), Decimal(n.high), Decimal(_width(n, bins))) for k, n in live.items()]
        table = spark.createDataFrame(rows, schema)  # one row per node
        found = (
            keyed.join(F.broadcast(table), "node")
            .where(F.slice(key, 1, at) == F.col("__fixed"))
            .withColumn("__value", key[at])
        )
        return found.where(F.col("__value").between(F.col("__low"), F.col("__high"))) if inside else found

    for at in range(depth):
        if at and nodes:
            ranges = matching(nodes, at, inside=False).groupBy("node")
            for r in ranges.agg(F.min("__value").alias("low"), F.max("__value").alias("high")).collect():
                nodes[r["node"]].low, nodes[r["node"]].high = r["low"], r["high"]
        while live := {k: n for k, n in nodes.items() if n.low < n.high and n.rows > FEW_ROWS}:
            offset = F.col("__value").cast("decimal(20,0)") - F.col("__low")
            bin_of = F.floor(offset / F.col("__width")).cast("long").alias("bin")
            sums = matching(live, at).groupBy("node", bin_of).agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
            by_node: dict[int, dict[int, tuple[int, int]]] = {k: {} for k in live}
            for r in sums.collect():
                by_node[r["node"]][r["bin"]] = r["bytes"], r["rows"]
            for k, n in live.items():
                n.narrow(by_node[k], _width(n, bins))
        if few := {k: n for k, n in nodes.items() if n.rows <= FEW_ROWS}:
            left = matching(few, at).groupBy("node", key.alias("key")).agg(F.sum("size").alias("bytes"))
            by_key: dict[int, list] = {k: [] for k in few}
            for r in left.collect():
                by_key[r["node"]].append((list(r["key"]), r["bytes"]))
            for k, n in few.items():
                n.settle(sorted(by_key[k]))
            nodes = {k: n for k, n in nodes.items() if k not in few}
        for n in nodes.values():
            n.median.append(n.low)
        if not nodes:
            return


def _width(node: _Node, bins: int) -> int:
    return -(-(node.high - node.low + 1) // bins)


def sharded(
    df: DataFrame,
    shards: int | None = 8,
    target_bytes: int | None = None,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """One row per document: its size, checksum, shard, and gapless place in the shard by id."""
    placed = kd_shards(points(df, id_column, text_column), shards, target_bytes)
    ranked, _ = global_rank(placed, ["shard", "doc_id", "text_crc32"], "place")
    counts = sorted(placed.groupBy("shard").count().collect(), key=lambda r: r["shard"])  # one row per shard
    firsts = [(r["shard"], sum(c["count"] for c in counts[:i])) for i, r in enumerate(counts)]
    starts = F.broadcast(df.sparkSession.createDataFrame(firsts, "shard int, first long"))
    return ranked.join(starts, "shard").select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit(LAW).alias("law"),
        "shard",
        (F.col("place") - F.col("first")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
