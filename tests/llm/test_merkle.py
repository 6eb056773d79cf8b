"""Merkle manifest against a plain tree of lists, for binary and wider runs, and its defined results."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from gtdlens.llm import merkle
from gtdlens.llm.queries import op12_merkle_manifest

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, idx int, grp string, path string, n double"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def levels(nodes, fanout):
    made = [nodes]
    while len(made[-1]) > 1:
        made.append([H(*made[-1][i : i + fanout]) for i in range(0, len(made[-1]), fanout)])
    return made


def steps(made, i, fanout):
    """(digests before, digests after) on each level."""
    out = []
    for level in made[:-1]:
        low = i - i % fanout
        out.append((level[low:i], level[i + 1 : low + fanout]))
        i //= fanout
    return out


def plain(rows, fanout=2):
    """Sorted (doc_id, leaf, subroot, root, proof digest, folded root, verified)."""
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in order:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[g] = levels([leaf(r) for r in groups[g]], fanout)
    over = levels([trees[g][-1][0] for g in order], fanout)
    out = []
    for k, g in enumerate(order):
        for i, r in enumerate(groups[g]):
            path = steps(trees[g], i, fanout) + steps(over, k, fanout)
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            now = leaf((r[0], r[1], r[2], r[3] + 1 if hit and r[3] is not None else r[3], r[4]))
            for before, after in path:
                now = H(*before, now, *after)
            proof = H(*[d for before, after in path for d in before + after])
            out.append((r[0], leaf(r), trees[g][-1][0], over[-1][0], proof, now, now == over[-1][0]))
    return sorted(out, key=str)


def hard_rows():
    rows = [(i, "s", "xyz"[i % 3] if i % 7 else None, i % 4 or None, f"text {i}") for i in range(60)]
    rows += [(100 + i, None, "hot", 5, "same") for i in range(41)] + [(7, "s", "hot", 1, "a")] * 5
    rows += [(None, "s", "x", 3, "no id"), (None, None, None, None, None), (500, "é", "ä", 9, "日本 - 3:x"), (501, "", "", 0, "")]
    return rows + [(900, "s", "long", 40_000, "wort " * 8_000), (901, "s", "xx", 2, "-"), (902, "s", "Z", 2, "1:-")]


def framed(spark, rows):
    return spark.createDataFrame([(*r, 1, "g", "p", 0.5) for r in rows], SCHEMA).repartition(4)


def found(df):
    kept = "doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"
    return sorted(map(tuple, df.select(*kept).collect()), key=str)


@pytest.mark.parametrize("fanout", [2, 3, 5])
def test_equals_plain_tree(spark, fanout):
    rows = hard_rows()
    assert found(merkle.merkle_digest(framed(spark, rows), fanout=fanout)) == plain(rows, fanout)


@pytest.mark.parametrize("n", [1, 2, 3, 8])
def test_few_rows(spark, n):
    rows = [(i, "s", "en", 1, "t") for i in range(n)]
    assert found(merkle.merkle_digest(framed(spark, rows))) == plain(rows)


def test_a_lone_row_has_the_empty_proof(spark):
    row = merkle.merkle_digest(framed(spark, [(1, "s", None, 1, "t")])).first()
    assert row.leaf == row.subroot == row.root == row.folded_root and row.proof_sha256 == H()


def test_every_row_a_group(spark):
    rows = [(i, "s", f"group {i}", 1, "t") for i in range(9)]
    assert found(merkle.merkle_digest(framed(spark, rows))) == plain(rows)


def test_empty_table(spark):
    assert merkle.merkle_digest(framed(spark, [])).count() == 0


def test_changes_are_located(spark):
    """A changed text, a lost row and a null taken for an empty text each change the root."""
    rows = [(i, "s", "en", 3, f"t{i}") for i in range(6)]
    root = merkle.merkle_digest(framed(spark, rows)).first().root
    for other in (rows[:-1], [*rows[:-1], (5, "s", "en", 3, "T5")], [*rows[:-1], (5, "s", "en", 3, None)]):
        assert merkle.merkle_digest(framed(spark, other)).first().root != root


def test_runs_need_two_nodes(spark):
    with pytest.raises(ValueError, match="two nodes"):
        merkle.merkle_digest(framed(spark, [(1, "s", "en", 1, "t")]), fanout=1)


def test_untampered_rows_verify(spark, small):
    rows = op12_merkle_manifest(spark, small)
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    assert rows.where(F.col("verified") == hit).count() == 0
