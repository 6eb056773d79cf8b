"""Merkle manifest of a table: a digest of every row, a root for each group, one root over the groups, and proofs.

`H` is the lowercase hex SHA-256 of its inputs one after the other, digests as hex text. A leaf is H of the row's fields, each
`-` where null, else the UTF-8 byte count, `:` and the value. Leaves of a group stand in the order of the id (ties by the leaf
itself). While a group has several nodes, every `fanout` consecutive ones become their H; the last run may be shorter, down
to one node. What remains is the group's subroot, and the subroots, in bytewise order of the group (null first), give
the root by the same rule.

Upwards, every level joins its nodes with themselves by equality on computed sibling indices: index XOR 1 for binary runs, the
other slots of the run otherwise. The row in slot zero then emits the parent, so a level is a join of evenly spread
integers whatever the groups' sizes are, and all groups rise together. Every level is written to the shared folder
with its siblings, 1 / fanout of the level below. Downwards, a node's proof is its own siblings before its parent's proof,
again one equality join a level. All digests are made by built-in functions; the driver sees the largest group's size, the
number of rows in each sorted partition and the root.

Defined results: a null in any field is `-`; a null id sorts first; a null group is a group of its own; equal rows are leaves
of their own, and as their digests are equal their order does not matter; a lone leaf is its group's subroot and a lone
subroot the root, with the empty proof where there is no sibling; an empty table has no rows (and no root). Other columns of
the table are not read.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gtdlens.operators.ranking import global_rank
from gtdlens.session import write_once

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
TAMPER_EVERY = 7
PATH = "array<struct<slot: int, siblings: array<string>>>"


def digest_of(*parts: Column) -> Column:
    """H of texts and arrays of texts; a null is left out."""
    return F.sha2(F.concat_ws("", *parts).cast("binary"), 256)


def encoded(value: Column) -> Column:
    """A field as the digest sees it."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(fields: Sequence[Column]) -> Column:
    return digest_of(*[encoded(f) for f in fields])


@dataclass
class Tree:
    """Levels from the leaves up, each (grp, idx, n, digest, slot, siblings, ...), and the last digest of each group."""

    levels: list[DataFrame]
    tops: DataFrame
    fanout: int


def _with_siblings(nodes: DataFrame, fanout: int) -> DataFrame:
    """The digests of the other nodes of each node's run, left to right, found by equality on their computed indices."""
    idx = F.col("idx")
    slot = (idx % fanout).cast("int")
    found = nodes.withColumn("slot", slot)
    for offset in range(1, fanout):
        sibling = F.col("idx").bitwiseXOR(F.lit(1)) if fanout == 2 else idx - slot + (slot + offset) % fanout
        other = nodes.select(F.col("grp").alias("__grp"), F.col("idx").alias("__idx"), F.col("digest").alias(f"__{offset}"))
        found = found.withColumn("__sibling", sibling)
        found = found.join(other, (F.col("grp") == F.col("__grp")) & (F.col("__sibling") == F.col("__idx")), "left")
        found = found.drop("__grp", "__idx", "__sibling")
    # The node in slot s finds that of slot t at offset (t - s) modulo the fanout.
    by_offset = F.array(F.lit(None).cast("string"), *[F.col(f"__{o}") for o in range(1, fanout)])
    in_order = F.array(*[F.get(by_offset, (F.lit(t + fanout) - F.col("slot")) % fanout) for t in range(fanout)])
    return found.withColumn("siblings", F.array_compact(in_order)).drop(*[f"__{o}" for o in range(1, fanout)])


def grown(leaves: DataFrame, fanout: int = 2) -> Tree:
    """All levels over leaves (grp, idx, n, digest, ...): n nodes in the group, idx from 0 without gaps."""
    if fanout < 2:
        raise ValueError("a run has two nodes at least")
    most = leaves.agg(F.max("n")).first()[0] or 1
    levels, nodes = [], leaves
    while True:
        if most > 1:
            level = _with_siblings(nodes, fanout)
        else:
            level = nodes.withColumn("slot", F.lit(0)).withColumn("siblings", F.array().cast("array<string>"))
        levels.append(write_once(level, f"merkle-{len(levels)}"))
        if most <= 1:
            break
        parents = levels[-1].where("n > 1 and slot = 0")
        nodes = parents.select(
            "grp",
            F.floor(F.col("idx") / fanout).alias("idx"),
            F.ceil(F.col("n") / fanout).alias("n"),
            digest_of(F.col("digest"), F.col("siblings")).alias("digest"),
        )
        most = -(-most // fanout)
    # A group's last node stands in the one level where it is alone.
    tops = levels[0].where("n = 1").select("grp", "digest")
    for level in levels[1:]:
        tops = tops.unionByName(level.where("n = 1").select("grp", "digest"))
    return Tree(levels, write_once(tops, "merkle-tops"), fanout)


def proofs(tree: Tree, top_paths: DataFrame) -> DataFrame:
    """The leaves with `path`: slot and siblings of each level from the leaf up, followed by the path of the group's top.

    top_paths: (grp, path) of the groups' last nodes.
    """
    path = None
    for number, level in reversed(list(enumerate(tree.levels))):
        alone = level.where("n = 1").join(top_paths, "grp")
        if path is not None:
            parents = path.select("grp", F.col("idx").alias("__idx"), F.col("path").alias("__path"))
            own = F.array(F.struct("slot", "siblings")).cast(PATH)
            nodes = level.where("n > 1").withColumn("__parent", F.floor(F.col("idx") / tree.fanout))
            joined = nodes.join(parents.withColumnRenamed("grp", "__grp"), F.expr("grp = __grp and __parent = __idx"))
            below = joined.withColumn("path", F.concat(own, "__path")).drop("__grp", "__idx", "__parent", "__path")
            alone = below.unionByName(alone)
        if number == 0:
            return alone
        path = write_once(alone.select("grp", "idx", "path"), f"merkle-path-{number}")
    raise ValueError("a tree has one level at least")


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its proof give."""

    def up(below: Column, step: Column) -> Column:
        left = F.slice(step["siblings"], 1, step["slot"])
        right = F.slice(step["siblings"], step["slot"] + 1, F.size(step["siblings"]) + 1)
        return digest_of(left, below, right)

    return F.aggregate(path, leaf, up)


def proof_digest(path: Column) -> Column:
    return digest_of(F.flatten(F.transform(path, lambda step: step["siblings"])))


@dataclass
class Manifest:
    """rows: the leaves with grp, idx, subroot, root and path; groups: (grp, group, n, subroot)."""

    rows: DataFrame
    groups: DataFrame
    root: str | None


def manifest(leaves: DataFrame, fanout: int = 2) -> Manifest:
    """The tree over rows (group, id, digest, ...). Other columns are carried to the result."""
    placed, _ = global_rank(leaves, ["group", "id", "digest"], "place")
    # One row a group; its size on disk decides how it meets the rows, so many small groups and a huge one are both fine.
    counted = placed.groupBy("group").agg(F.count("*").alias("n"), F.min("place").alias("first"))
    groups, count = global_rank(counted, ["group"], "grp")
    groups = write_once(groups, "merkle-groups")
    known = groups.withColumnRenamed("group", "__group")
    numbered = placed.join(known, placed["group"].eqNullSafe(known["__group"])).drop("__group")
    numbered = numbered.withColumn("idx", F.col("place") - F.col("first")).drop("place", "first")
    tree = grown(numbered, fanout)

    subroots = tree.tops.withColumnRenamed("grp", "idx").withColumn("grp", F.lit(0).cast("long"))
    above = grown(subroots.withColumn("n", F.lit(count).cast("long")), fanout)
    last = above.tops.first()
    root = last["digest"] if last else None
    empty = F.array().cast(PATH)
    over = proofs(above, above.tops.select("grp", empty.alias("path")))
    tops = write_once(over.select(F.col("idx").alias("grp"), "path", F.col("digest").alias("subroot")), "merkle-subroots")
    rows = proofs(tree, tops.select("grp", "path"))
    rows = rows.join(tops.select("grp", "subroot"), "grp").withColumn("root", F.lit(root).cast("string"))
    described = groups.join(tops.select("grp", "subroot"), "grp").select("grp", "group", "n", "subroot")
    return Manifest(rows, described, root)


def merkle_digest(
    df: DataFrame,
    id_column: str = "doc_id",
    group_column: str = "lang",
    fields: Sequence[str] = FIELDS,
    tampered_field: str = "n_chars",
    fanout: int = 2,
    every: int = TAMPER_EVERY,
) -> DataFrame:
    """One row per row of the table: leaf, subroot, root, digest of the proof, and whether the row as it is now verifies.

    As it is now: where `every` divides the checksum of the id, one has been added to the tampered field, so the
    root folded from that row's leaf and the proof is another.
    """
    key = F.col(f"`{id_column}`")
    given = [F.col(f"`{f}`") for f in fields]
    hit = F.coalesce(F.crc32(key.cast("string").cast("binary")) % every == 0, F.lit(False))
    changed = [c + F.when(hit, 1).otherwise(0) if f == tampered_field else c for f, c in zip(fields, given)]
    leaves = df.select(
        F.col(f"`{group_column}`").cast("string").alias("group"),
        key.cast("long").alias("id"),
        leaf_of(given).alias("digest"),
        F.when(hit, leaf_of(changed)).alias("tampered"),
    )
    # Written before the sort, which reads its input twice: the texts are hashed once.
    rows = manifest(write_once(leaves, "merkle-leaves"), fanout).rows
    seen = rows.withColumn("folded_root", folded(F.coalesce("tampered", "digest"), F.col("path")))
    return seen.select(
        F.col("id").alias("doc_id"),
        F.col("digest").alias("leaf"),
        "subroot",
        "root",
        proof_digest(F.col("path")).alias("proof_sha256"),
        "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
        F.col("idx").alias("position"),
        F.size("path").alias("proof_levels"),
    )
