"""Chains over whole texts: cuts change nothing, plain forward-backward agrees, and few bytes of new words do no harm."""

import numpy as np
import pyarrow as pa
import pytest

from gtdlens.llm import language as L
from gtdlens.llm.text_arrays import Words


def some_model(run_words, labels=3, seed=2):
    rng = np.random.default_rng(seed)
    model = L.Model(list("abc")[:labels], L.Settings(run_words=run_words, feature_bits=10))
    model.weights = rng.normal(size=model.weights.shape).astype(np.float32) * 2
    model.change = rng.normal(size=model.change.shape)
    return model


def texts():
    rng = np.random.default_rng(8)
    sizes = [1, 2, 5, 6, 7, 11, 12, 13, 64, 65, 129, 700, 0, 30]
    return [" ".join(f"w{rng.integers(40)}" for _ in range(n)) for n in sizes]


def plain_chances(scores, change):
    """Forward and backward messages of one chain by logarithms."""
    n, labels = scores.shape
    forward, backward = np.zeros((n, labels)), np.zeros((n, labels))
    forward[0] = scores[0]
    for t in range(1, n):
        forward[t] = scores[t] + np.logaddexp.reduce(forward[t - 1][:, None] + change, axis=0)
    for t in range(n - 1, 0, -1):
        backward[t - 1] = np.logaddexp.reduce(change + (scores[t] + backward[t])[None, :], axis=1)
    chance = np.exp(forward + backward - np.logaddexp.reduce(forward + backward, axis=1, keepdims=True))
    return chance


@pytest.mark.parametrize("run_words", [1, 2, 6, 64, 1_000])
def test_any_cut_gives_the_whole_texts_chances(run_words):
    model = some_model(run_words)
    words = Words(pa.array(texts(), pa.large_string()))
    labeller = L.Labeller(model)
    found = labeller.chances(words)
    scores = labeller.word_scores(words).astype(float)
    for row, n in enumerate(words.counts):
        if n:
            part = slice(words.first[row], words.first[row] + n)
            assert found[part] == pytest.approx(plain_chances(scores[part], model.change), abs=1e-9)


def test_a_word_is_judged_alike_wherever_a_chunk_ends():
    """After certain words of a language an unknown word leans to it, as 64th word and as 65th."""
    model = some_model(64, labels=2)
    model.change = np.array([[3.0, -3.0], [-3.0, 3.0]])
    labeller = L.Labeller(model)
    labeller.word_scores = lambda words: np.array([[8.0, 0.0] if words.data[a] == 107 else [0.0, 0.0] for a in words.start])
    for n in (10, 63, 64, 65, 128):
        chance = labeller.chances(Words(pa.array(["known " * n + "other"], pa.large_string())))
        assert chance[-1, 0] > 0.99


NEW = ["", "a", "ab", "a b", "é", "abc", "a b c", "ab c", "abcd", "a b c d", "日", "abcde", "ab cde", "日a b"]


@pytest.mark.parametrize("new", NEW)
def test_few_new_bytes_cold_and_warm(new):
    model = some_model(64)
    warm, cold = L.Labeller(model), L.Labeller(model)
    warm.documents(pa.array(["hello world"]))
    assert [len(x) for x in warm.documents(pa.array(["hello " + new]))] == [1] * 4
    one, two = cold.documents(pa.array([new])), warm.documents(pa.array([new]))
    assert one[0] == two[0] and one[1] == pytest.approx(two[1])


def test_few_bytes_through_spark(spark):
    rows = [(i, t, "xy"[i % 2]) for i, t in enumerate(["hello world", "of", "hello ab", "hello a b", "hello é", *NEW])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    try:
        found = L.identify(docs, L.Settings(runs=50, epochs=1)).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(r.doc_id for r in found) == list(range(len(rows)))


def test_labels_and_sample_are_bounded(spark):
    rows = [(i, "some text here", f"label {i % 30}") for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    with pytest.raises(ValueError, match="more than 20 languages"):
        L.fitted(docs, L.Settings(most_languages=20))
    assert len(L.fitted(docs, L.Settings(most_rows=60, runs=20, epochs=1)).languages) == 30
