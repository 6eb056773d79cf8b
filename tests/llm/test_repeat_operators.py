"""Operators that compare documents: substring, line and near dedup, and connected components."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gtdlens.llm import components, lines, near_dups, quality, substrings, text_arrays
from tests.llm import brute
from tests.llm.conftest import known


def random_docs(seed, n=60):
    """Documents put together from few shared passages, so that paths branch and cross everywhere."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(12)]
    passages = [[rng.choice(vocabulary) for _ in range(rng.randint(5, 45))] for _ in range(8)]
    docs = []
    for i in range(n):
        w = []
        for _ in range(rng.randint(0, 5)):
            p = rng.choice(passages)
            a, b = sorted(rng.choices(range(len(p) + 1), k=2))
            w += p[a:b] if rng.random() < 0.5 else p
        docs.append((rng.randint(0, 10**6) * 100 + i, " ".join(w)))
    return docs


# --- substring dedup


def check_substrings(df, rows, window=20):
    expected = brute.substring_dedup(known(rows), window)
    found = substrings.dedup_digest(df, window=window, seed_words=max(1, window // 2)).collect()
    assert sorted(str(r.doc_id) for r in found) == sorted(str(i) for i, _ in rows)
    for r in found:
        if r.doc_id is not None:
            n, removed, kept = expected[r.doc_id]
            assert (r.n_words, r.n_removed, r.kept_sha256) == (n, removed, brute.digest(kept)), r.doc_id


@pytest.mark.parametrize("window", [4, 20])
@pytest.mark.parametrize("seed", [1, 2])
def test_substrings_of_crossing_passages(spark, seed, window):
    rows = random_docs(seed)
    check_substrings(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), rows, window)


def test_substrings_of_hard_rows(hard_df, hard_rows):
    check_substrings(hard_df, hard_rows)


def test_rows_without_id_are_kept_whole(hard_df, hard_rows):
    found = [r for r in substrings.dedup_digest(hard_df).collect() if r.doc_id is None]
    texts = [t for i, t in hard_rows if i is None]
    assert sorted(r.kept_sha256 for r in found) == sorted(brute.digest(brute.words(t)) for t in texts)


def test_substrings_of_small_documents(spark, small, small_docs):
    check_substrings(spark.read.parquet(f"{small}/documents.parquet"), small_docs)


def test_a_phrase_in_different_surroundings(spark):
    """A third of all documents share 12 words, some of them longer passages around these; no shuffle gathers the phrase."""
    rng = random.Random(7)
    phrase = [f"p{i}" for i in range(12)]
    around = [f"q{i}" for i in range(6)]
    rows = []
    for i in range(600):
        own = [f"{i}_{j}" for j in range(rng.randint(3, 30))]
        at = rng.randrange(len(own))
        middle = around + phrase + around if i % 12 == 0 else phrase
        rows.append((i, " ".join(own[:at] + middle + own[at:] if i % 3 == 0 else own)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    check_substrings(df, rows)
    plan = substrings.repeated_spans(df, 20, 8)._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition" in plan
    for line in plan.splitlines():
        if line.lstrip(" +-:").startswith("Window"):
            assert "[seed#" not in line or "path#" in line.rsplit("[seed#", 1)[1]


def test_substrings_do_not_depend_on_the_layout(spark, small):
    df = spark.read.parquet(f"{small}/documents.parquet")
    one = substrings.dedup_digest(df.repartition(1)).orderBy("doc_id").collect()
    assert substrings.dedup_digest(df.repartition(23)).orderBy("doc_id").collect() == one


def test_without_repeats_keeps_columns(hard_df, hard_rows):
    cleaned = substrings.without_repeats(hard_df)
    assert cleaned.schema == hard_df.schema
    expected = brute.substring_dedup(known(hard_rows))
    text = dict(known(hard_rows))
    for r in cleaned.where("doc_id is not null").collect():
        n, removed, kept = expected[r.doc_id]
        assert r.text == (" ".join(kept) if removed else text[r.doc_id])


# --- near dedup


def check_components(df, rows, size=4):
    expected = brute.components(known(rows), size)
    found = near_dups.near_duplicates(df, shingle=size).collect()
    assert sorted(str(r.doc_id) for r in found) == sorted(str(i) for i, _ in rows)
    for r in found:
        if r.doc_id is None:
            assert (r.component_id, r.kept) == (None, True)
        else:
            n, component = expected[r.doc_id]
            assert (r.n_shingles, r.component_id, r.kept) == (n, component, r.doc_id == component), r.doc_id


def near_copies(seed, n, words=60):
    """Copies of copies, so that groups hold together by chains of links."""
    rng = random.Random(seed)
    docs = [[f"t{rng.randint(0, 5000)}" for _ in range(words)]]
    for _ in range(n - 1):
        copy = list(rng.choice(docs[-20:]))
        for _ in range(rng.randint(0, 2)):
            copy[rng.randrange(len(copy))] = f"t{rng.randint(0, 5000)}"
        docs.append(copy)
    ids = rng.sample(range(10_000), n)
    return [(i, " ".join(d)) for i, d in zip(ids, docs)]


@pytest.mark.parametrize("seed", [1, 2])
def test_chains_of_near_copies(spark, seed):
    rows = near_copies(seed, 150) + [(i + 20_000, t) for i, t in near_copies(seed + 10, 40, 12)]
    check_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), rows)


def test_large_buckets_meet_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_dups, "LARGE_BUCKET", 3)
    monkeypatch.setattr(near_dups, "BLOCK_CLASSES", 7)
    rows = near_copies(5, 160)
    check_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), rows)


def test_near_dups_of_hard_rows(hard_df, hard_rows):
    check_components(hard_df, hard_rows)


def test_near_dups_of_small_documents(spark, small, small_docs):
    check_components(spark.read.parquet(f"{small}/documents.parquet"), small_docs)


def test_estimate_is_corrected_for_chance(spark):
    """Over many pairs the estimated similarity is the true one."""
    rng = random.Random(8)
    rows, truth = [], []
    for k in range(60):
        a = [f"u{rng.randint(0, 10**6)}" for _ in range(300)]
        b = a[: rng.randint(30, 300)] + [f"u{rng.randint(0, 10**6)}" for _ in range(60)]
        rows += [(2 * k, " ".join(a)), (2 * k + 1, " ".join(b))]
        x, y = brute.shingles(rows[-2][1], 4), brute.shingles(rows[-1][1], 4)
        truth.append(len(x & y) / len(x | y))
    made = near_dups.signatures(spark.createDataFrame(rows, "doc_id long, text string"), 4)
    pairs = made.alias("a").join(made.alias("b"), F.expr("a.doc_id + 1 = b.doc_id and a.doc_id % 2 = 0"))
    pairs = pairs.select("a.doc_id", F.col("a.sketch").alias("one"), F.col("b.sketch").alias("other"))
    found = pairs.select("doc_id", near_dups.estimated_similarity("one", "other").alias("e")).orderBy("doc_id").collect()
    errors = np.array([r.e for r in found]) - truth
    assert abs(errors.mean()) < 0.02 and np.abs(errors).max() < near_dups.MARGIN


def test_components_of_paths_and_stars(spark):
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(0, 60)] + [(1000, i) for i in range(1001, 1100)] + [(7, 7), (2000, 1999)]
    rng.shuffle(links)
    found = dict(
        (r.node, r.component)
        for r in components.connected_components(spark.createDataFrame(links, "a long, b long")).collect()
    )
    assert found == {i: 0 for i in range(61)} | {i: 1000 for i in range(1000, 1100)} | {1999: 1999, 2000: 1999}


# --- line dedup


def check_lines(df, rows):
    expected = brute.line_dedup(known(rows), lines.WINDOW, lines.DIVISOR, lines.PRIME)
    found = lines.without_repeated_chunks(df).collect()
    assert sorted(str(r.doc_id) for r in found) == sorted(str(i) for i, _ in rows)
    text = dict(known(rows))
    for r in found:
        if r.doc_id is not None:
            removed, left = expected.get(r.doc_id, (0, None))
            assert (r.removed_lines, r.text) == (removed, left if removed else text[r.doc_id]), r.doc_id
    return sum(r.removed_lines for r in found)


def line_docs(seed):
    rng = random.Random(seed)
    pool = [f"line {rng.randint(0, 10**6)}" for _ in range(80)] + ["", " "]
    blocks = [rng.choices(pool, k=rng.randint(3, 14)) for _ in range(12)]
    docs = []
    for i in range(80):
        body = []
        for _ in range(rng.randint(1, 5)):
            body += rng.choice(blocks) if rng.random() < 0.6 else rng.choices(pool, k=rng.randint(1, 6))
        docs.append((rng.randint(0, 10**6) * 100 + i, "\n".join(body)))
    return docs


@pytest.mark.parametrize("seed", [1, 2])
def test_lines_of_moved_blocks(spark, seed):
    rows = line_docs(seed)
    assert check_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), rows) > 100


def test_lines_of_hard_rows(hard_df, hard_rows):
    assert check_lines(hard_df, hard_rows) > 0
    cleaned = lines.without_repeated_chunks(hard_df)
    assert set(cleaned.columns) == {*hard_df.columns, "removed_lines", "removed_chunks"}


def test_lines_of_small_documents(spark, small, small_docs):
    check_lines(spark.read.parquet(f"{small}/documents.parquet"), small_docs)


def test_line_digest(spark):
    rows = line_docs(3)
    digests = {r.doc_id: r for r in lines.line_digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    expected = brute.line_dedup(rows, lines.WINDOW, lines.DIVISOR, lines.PRIME)
    for i, text in rows:
        removed, left = expected[i]
        assert digests[i].n_lines == text.count("\n") + 1
        assert digests[i].n_removed_lines == removed
        assert digests[i].kept_sha256 == brute.hashlib.sha256(left.encode()).hexdigest()


def test_boundaries_resist_shifts(spark):
    rng = random.Random(4)
    block = [f"row {rng.randint(0, 10**9)}" for _ in range(40)]
    texts = [(1, "\n".join(block)), (2, "\n".join(["new first line", *block])), (3, "\n".join(block[5:]))]
    found = {r.doc_id: r.removed_lines for r in lines.without_repeated_chunks(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert found[1] == 0 and found[2] > 25 and found[3] > 20


@pytest.mark.parametrize("operator", [substrings.dedup_digest, near_dups.near_duplicates, lines.line_digest, lines.without_repeated_chunks, substrings.without_repeats])
def test_empty_table(empty_df, operator):
    assert operator(empty_df).collect() == []


def test_line_dedup_runs_no_python(spark, small):
    plan = lines.line_digest(spark.read.parquet(f"{small}/documents.parquet"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# --- what the operators of a pipeline leave in a worker


def test_operators_in_one_worker_keep_small_arrays(spark, monkeypatch):
    """The tables that stay in a worker, and the arrays of a slice, are small; verdicts and signatures do not depend on it."""
    monkeypatch.setattr(text_arrays, "_grown", {})
    rng = random.Random(5)
    texts = [" ".join(f"w{rng.randint(0, 5000)}" for _ in range(400)) for _ in range(800)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], ["doc_id", "text"])
    seen = {}

    def kept(df, function, schema):
        seen[schema] = list(function(batch))
        return df

    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    for module in (quality, near_dups, substrings):
        monkeypatch.setattr(module, "per_batch", kept)
    quality.keep_good(df)
    near_dups.signatures(df, 5)
    substrings.path_records(df, 20, 10)
    assert batch.nbytes > 1_500_000 and len(seen) == 3
    assert text_arrays._grown and max(len(power) for power, _ in text_arrays._grown.values()) <= 500_001
    rows, _ = near_dups.shingle_sets(batch.column("text"), 5)
    found = pa.Table.from_batches(next(v for k, v in seen.items() if "buckets" in k))
    assert found.column("n").to_pylist() == np.bincount(rows, minlength=len(texts)).tolist()
