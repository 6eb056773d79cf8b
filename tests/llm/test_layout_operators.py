"""Operators that lay the corpus out: packing, sharding, neighbours, and the whole pipeline."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from gtdlens.llm import neighbours, packing, quality, shards
from tests.llm import brute
from tests.llm.conftest import known, table

# --- packing


def test_boundaries_have_the_least_padding():
    rng = random.Random(1)
    for _ in range(60):
        histogram = {rng.randint(0, 40): rng.randint(1, 9) for _ in range(rng.randint(1, 11))}
        buckets = rng.randint(1, 5)
        bounds = packing.best_boundaries(histogram, buckets)
        assert bounds == sorted(set(bounds)) and len(bounds) <= buckets and bounds[-1] == max(histogram)
        cost = sum(c * (min(b for b in bounds if b >= s) - s) for s, c in histogram.items())
        assert cost == brute.least_padding(histogram, buckets)


def check_packing(df, rows, **settings):
    result = packing.packed(df, **settings).collect()
    bounds = sorted({(r.bucket, r.bucket_tokens) for r in result})
    max_tokens = settings.get("max_tokens", packing.MAX_TOKENS)
    lengths = Counter(min(max_tokens, n - at) for _, t in rows for n in [len(brute.words(t))] for at in range(0, max(n, 1), max_tokens))
    chosen = packing.best_boundaries(dict(lengths), settings.get("buckets", packing.BUCKETS))
    assert bounds == list(enumerate(chosen))
    expected = brute.packed(rows, chosen, max_tokens, settings.get("batch_tokens", packing.BATCH_TOKENS))
    found = {(r.doc_id, r.piece): (r.first_word, r.n_tokens, r.bucket, r.bucket_tokens, r.batch, r.slot) for r in result}
    assert len(result) == len(expected) and found == expected


def test_packing_of_small_documents(spark, small, small_docs):
    df = spark.read.parquet(f"{small}/documents.parquet")
    check_packing(df, small_docs)
    check_packing(df, small_docs, max_tokens=100, buckets=4, batch_tokens=700)


def test_packing_of_hard_rows(hard_df, hard_rows):
    result = packing.packed(hard_df).collect()
    words = sorted((str(i), len(brute.words(t))) for i, t in hard_rows)
    per_row = Counter()
    for r in result:
        per_row[str(r.doc_id)] += r.n_tokens
        assert 0 <= r.n_tokens <= r.bucket_tokens
    totals = Counter()
    for i, n in words:
        totals[i] += n
    assert per_row == totals
    slots = Counter((r.bucket, r.batch) for r in result)
    for r in result:
        assert r.slot < slots[r.bucket, r.batch] <= max(1, packing.BATCH_TOKENS // max(1, r.bucket_tokens))


# --- sharding


def kd_brute(rows, n_shards):
    """(size, crc, id) -> shard, by sorting each node along its widest dimension."""
    points = [(len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), -(1 << 63) if i is None else i) for i, t in rows]
    width = [max(1, max(p[d] for p in points) - min(p[d] for p in points)) for d in (0, 1)]

    def split(part, leaves, first):
        if leaves == 1 or not part:
            return {p: first for p in part}
        spread = [(max(p[d] for p in part) - min(p[d] for p in part)) / width[d] for d in (0, 1)]
        d = spread.index(max(spread))
        key = lambda p: (p[d], p[1 - d], p[2])
        total, before, left = sum(p[0] for p in part), 0, set()
        for value, size in sorted(Counter({key(p): sum(q[0] for q in part if q == p) for p in set(part)}).items()):
            left.add(value)
            before += size
            if before * leaves >= total * (leaves // 2):
                break
        low = [p for p in part if key(p) in left]
        high = [p for p in part if key(p) not in left]
        return split(low, leaves // 2, first) | split(high, leaves - leaves // 2, first + leaves // 2)

    return points, split(points, n_shards, 0)


def check_shards(df, rows, n_shards=8):
    result = shards.sharded(df, shards=n_shards).collect()
    points, expected = kd_brute(rows, n_shards)
    found = sorted((r.size, r.text_crc32, -(1 << 63) if r.doc_id is None else r.doc_id, r.shard) for r in result)
    assert found == sorted((*p, expected[p]) for p in points)
    for shard in range(n_shards):
        slots = sorted(r.slot for r in result if r.shard == shard)
        assert slots == list(range(len(slots)))
    assert {(r.law, r.grown_shard) for r in result} == {("bytes", None)}
    return Counter({s: sum(r.size for r in result if r.shard == s) for s in range(n_shards)})


@pytest.mark.parametrize("few", [1, 2_000])
def test_shards_of_small_documents(spark, small, small_docs, monkeypatch, few):
    monkeypatch.setattr(shards, "FEW_ROWS", few)
    sizes = check_shards(spark.read.parquet(f"{small}/documents.parquet"), small_docs)
    largest = max(len((t or "").encode()) + 1 for _, t in small_docs)
    assert max(sizes.values()) - min(sizes.values()) <= 3 * largest


def test_shards_of_hard_rows(hard_df, hard_rows):
    check_shards(hard_df, hard_rows)
    check_shards(hard_df, hard_rows, 5)


def test_copies_that_hold_most_bytes_are_split(spark):
    rows = [(i, "the same text " * 20) for i in range(300)] + [(1000 + i, f"other {i}") for i in range(50)]
    sizes = check_shards(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), rows)
    assert max(sizes.values()) - min(sizes.values()) <= 600


def test_shards_by_target_bytes(spark, small):
    df = spark.read.parquet(f"{small}/documents.parquet")
    rows = shards.points(df)
    total = rows.agg({"size": "sum"}).first()[0]
    placed = shards.kd_shards(rows, target_bytes=total // 5).groupBy("shard").agg({"size": "sum"}).collect()
    assert len(placed) == 6


# --- neighbours


def exact(vectors, every, k):
    """query -> ids of the nearest, for {id: vector}."""
    result = {}
    for q in vectors:
        if q % every == 0:
            scores = sorted((-float(np.dot(vectors[q], v)), i) for i, v in vectors.items() if i != q)
            result[q] = [i for _, i in scores[:k]]
    return result


def recall(found, expected):
    got = {}
    for r in found:
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    for q, ids in expected.items():
        assert sorted(x for x, _ in got.get(q, [])) == list(range(1, len(ids) + 1)), q
    return np.mean([len({i for _, i in got[q]} & set(ids)) / len(ids) for q, ids in expected.items() if ids])


def test_recall_on_embeddings(spark, small):
    for folder in (small, "/root/testdata/sf0.01"):
        df = spark.read.parquet(f"{folder}/embeddings.parquet")
        vectors = {r.vec_id: np.array(r.embedding, float) for r in df.collect()}
        found = neighbours.nearest(df).collect()
        assert recall(found, exact(vectors, 20, 20)) >= 0.9
        for r in found:
            assert abs(r.score - float(np.dot(vectors[r.query_id], vectors[r.vec_id]))) < 1e-12
        by_rank = sorted((r.query_id, r.rank, -r.score, r.vec_id) for r in found)
        assert by_rank == sorted(by_rank, key=lambda x: (x[0], x[2], x[3]))


def test_copies_ties_and_unusable_vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=6) * rng.integers(1, 9)], 1) for i in range(1, 90)]
    rows += [(200 + i, rows[0][1], 2) for i in range(60)]  # more copies than are asked for
    rows += [(0, rows[0][1], 2), (0, rows[0][1], 2), (None, rows[3][1], 3), (300, None, 3), (301, [0.0] * 6, 3)]
    rows += [(302, [1.0, None, 1.0, 1.0, 1.0, 1.0], 3), (303, [float("nan")] * 6, 3), (304, [float("inf")] * 6, 3), (305, [1.0], 3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, point int").repartition(3)
    usable = {i: np.array(v) for i, v, k in rows if i is not None and k < 3}
    found = neighbours.nearest(df).collect()
    expected = exact(usable, 20, 20)
    assert recall(found, expected) >= 0.9
    zero = [r.vec_id for r in sorted(found, key=lambda r: r.rank) if r.query_id == 0]
    assert zero == expected[0]


def test_few_candidates_come_back_whole(spark):
    rng = np.random.default_rng(6)
    rows = [(i * 10, [float(x) for x in rng.normal(size=40)]) for i in range(9)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    # So narrow that no bucket holds a second point: the exact way has to answer.
    found = neighbours.nearest(df, index=neighbours.Index(width=0.001, probes=1)).collect()
    assert recall(found, exact({i: np.array(v) for i, v in rows}, 20, 20)) == 1.0


def test_hot_buckets_are_cut_into_blocks(spark):
    rng = np.random.default_rng(9)
    center = rng.normal(size=16)
    rows = [(i, [float(x) for x in center + 0.05 * rng.normal(size=16)]) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    index = neighbours.Index(cell_rows=16, block_queries=5)
    assert recall(neighbours.nearest(df, index=index).collect(), exact({i: np.array(v) for i, v in rows}, 20, 20)) >= 0.9


def test_probes_come_in_the_order_of_their_cost():
    index = neighbours.Index(tables=1, projections=3, width=1.0, probes=27)
    places = np.array([[[0.1, 0.5, 0.8]]])
    cells = index.probe_cells(places)[0, 0]

    def cost(cell):
        return sum({0: 0, -1: f, 1: 1 - f}[int(c)] ** 2 for c, f in zip(cell, places[0, 0]))

    costs = [cost(c) for c in cells]
    assert cells[0].tolist() == [0, 0, 0] and costs == sorted(costs) and len({tuple(c) for c in cells}) == 27


@pytest.mark.parametrize("operator", [packing.packed, shards.sharded])
def test_empty_documents(empty_df, operator):
    assert operator(empty_df).collect() == []


def test_empty_embeddings(spark):
    assert neighbours.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


# --- pipeline


def pipeline_brute(docs):
    docs = [(i, t) for i, t in docs if brute.quality(t, quality.Rules())["kept"]]
    cleaned = brute.bounded_line_dedup(docs)
    docs = [(i, cleaned[i][1]) for i, _ in docs]
    groups = brute.components(docs, 5)
    docs = [(i, t) for i, t in docs if groups[i][1] == i]
    short = brute.substring_dedup(docs)
    docs = [(i, " ".join(short[i][2]) if short[i][1] else t) for i, t in docs]
    lengths = Counter(min(packing.MAX_TOKENS, n - at) for _, t in docs for n in [len(brute.words(t))] for at in range(0, max(n, 1), packing.MAX_TOKENS))
    bounds = packing.best_boundaries(dict(lengths), packing.BUCKETS)
    return brute.packed(docs, bounds, packing.MAX_TOKENS, packing.BATCH_TOKENS)


def test_pipeline_equals_brute_force(spark, small, small_docs):
    found = corpus_pipeline.run(spark, small).collect()
    expected = pipeline_brute(small_docs)
    assert len(found) == len(expected)
    assert {(r.doc_id, r.piece): (r.first_word, r.n_tokens, r.bucket, r.bucket_tokens, r.batch, r.slot) for r in found} == expected


def test_stages_keep_the_columns(spark, hard_df, small):
    docs = hard_df.withColumnRenamed("path", "n_chars")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        result = stage(spark, docs, small)
        assert result.columns == docs.columns, name
        assert result.count() <= docs.count()
    assert corpus_pipeline.STAGES[-1][1](spark, docs, small).count() >= docs.count()


def test_stages_take_an_empty_table(spark, empty_df, small):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty_df, small).count() == 0, name
