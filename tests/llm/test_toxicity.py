"""Toxicity: slopes against differences, scores against plain code, held-out labels, sentences found, defined results."""

import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from gtdlens.llm import toxicity as X
from gtdlens.llm.queries import op11_toxicity
from tests.llm.conftest import known, table

BAD = ["wretch", "vermin", "grublo", "grublan"]


def prose(rng, n):
    return [rng.choice(["lo", "mi", "ta", "re"]) + rng.choice(["ban", "cor", "dul", "fen"]) + rng.choice("aeiou") for _ in range(n)]


def texts(n=900, seed=4):
    """(doc_id, text, toxic, the toxic sentence or None): one sentence in a toxic text has one bad word or two."""
    rng, rows = random.Random(seed), []
    for i in range(n):
        sentences = [prose(rng, rng.randint(3, 14)) for _ in range(rng.randint(1, 12))]
        toxic = i % 3 == 0
        place = rng.randrange(len(sentences)) if toxic else None
        if toxic:
            for _ in range(rng.randint(1, 2)):
                sentences[place].insert(rng.randrange(len(sentences[place])), rng.choice(BAD))
        rows.append((i, " ".join(" ".join(s).capitalize() + "." for s in sentences), int(toxic), place))
    return rows


@pytest.fixture(scope="module")
def fitted_on_all(spark):
    rows = texts()
    docs = spark.createDataFrame([(i, t) for i, t, _, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y, _ in rows], "doc_id long, toxic int")
    return rows, docs, labels, X.fitted(docs, labels)


def test_held_out_texts_and_their_sentences(fitted_on_all):
    rows, docs, labels, model = fitted_on_all
    found = {r.doc_id: r for r in X.scored(docs, model).collect()}
    sentences = {}
    for r in X.offending_sentences(docs, model).collect():
        sentences.setdefault(r.doc_id, []).append(r)
    unseen = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert len(unseen) > 150
    right = [found[i].predicted == y for i, _, y, _ in unseen]
    assert np.mean(right) > 0.98
    located = [(found[i].worst_sentence, found[i].n_offending) == (place, 1) for i, _, y, place in unseen if y]
    assert np.mean(located) > 0.97
    for i, text, _, _ in rows:
        assert found[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
        for s in sentences.get(i, []):
            assert text[s.first_char :].startswith(s.sentence_text) and s.score >= X.THRESHOLD
        assert found[i].n_offending == len(sentences.get(i, []))


def plain_score(text, model, settings):
    """1 - prod(1 - chance) over the instances, word by word."""
    from gtdlens.llm.text_arrays import range_hashes

    def weight(word):
        raw = np.frombuffer(word, np.uint8)
        pieces = [(0, len(raw), 3)] + [(0, n, 20 + n) for n in X.PREFIXES if n <= len(raw)]
        ids = [int(range_hashes(raw, np.array([a]), np.array([b]), seed)[0]) % 2**settings.feature_bits for a, b, seed in pieces]
        return sum(float(model.weights[i]) for i in ids)

    instances, current = [], []
    for m in re.finditer(r"[^\x20\x09-\x0D]+", text or ""):
        word = m.group()
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in word).encode()
        a, b = 0, len(low)
        while b > a + 1 and X.MARKS[low[b - 1]]:
            b -= 1
        while b > a + 1 and X.MARKS[low[a]]:
            a += 1
        current.append(low[a:b])
        core = word[:-1] if len(word) > 1 and word[-1] in "\"')]}" else word
        behind = re.match(r"[\x20\x09-\x0D]*", text[m.end() :]).group()
        over = core[-1] in ".!?" or word[-1] in "。！？" or "\n" in behind
        if over or len(current) == settings.instance_words:
            instances.append(current)
            current = []
    if current:
        instances.append(current)
    z = [model.bias + sum(weight(w) for w in i) for i in instances]
    return 1 - math.prod(1 - 1 / (1 + math.exp(-v)) for v in z)


def test_scores_equal_plain_code(spark, hard_df, hard_rows, fitted_on_all):
    model = fitted_on_all[3]
    extra = ['He said "wretch." Then left', "(vermin!) ok?\nno", "日本。grublox！ x", " ".join(["a"] * 31 + ["wretch", "b"]) * 3]
    rows = known(hard_rows) + [(9_000 + k, t) for k, t in enumerate(extra)]
    found = {}
    for r in X.scored(spark.createDataFrame(rows, "doc_id long, text string"), model).collect():
        found.setdefault(r.doc_id, []).append(r)
    for i, text in rows:
        want = plain_score(text, model, model.settings)
        assert all(r.score == pytest.approx(want, abs=1e-9) for r in found[i]), text
        assert all(r.predicted == (r.score >= 0.3) for r in found[i])
        assert all((r.worst_sentence is None) == (r.n_sentences == 0) for r in found[i])
    assert sorted(i for i in found for _ in found[i]) == sorted(i for i, _ in rows)


def test_slopes_are_those_of_the_loss():
    settings, rows = X.Settings(least_texts=1), texts(40)
    labels = np.array([r[2] for r in rows])
    sample = X._Sample([r[1] for r in rows], settings)
    used, slot = np.unique(sample.feature, return_inverse=True)
    fit = X._Fit(sample, sample.owner, slot, labels, np.full(len(rows), 1 / len(rows)), len(used))
    fit.weights = np.random.default_rng(1).normal(size=len(used)) * 0.3
    fit.bias = -2.0

    def loss():
        of_form = np.bincount(fit.owner, fit.weights[fit.slot], fit.n_forms)
        z = fit.bias + np.bincount(fit.instance, of_form[fit.form], len(fit.row))
        hazard = np.bincount(fit.row, np.logaddexp(0, z), len(labels))
        return (fit.shares * np.where(labels == 1, -np.log(-np.expm1(-hazard)), hazard)).sum()

    slope, slope_bias = fit.slopes()
    for k in range(0, len(used), max(1, len(used) // 25)):
        fit.weights[k] += 1e-5
        high = loss()
        fit.weights[k] -= 2e-5
        low = loss()
        fit.weights[k] += 1e-5
        assert (high - low) / 2e-5 == pytest.approx(slope[k], abs=1e-6)
    fit.bias += 1e-5
    high = loss()
    fit.bias -= 2e-5
    assert (high - loss()) / 2e-5 == pytest.approx(slope_bias, abs=1e-6)


def test_sample_counts_do_not_depend_on_slices(monkeypatch):
    given = [r[1] for r in texts(60)]
    whole = X._Sample(given, X.Settings())
    monkeypatch.setattr(X, "slices", lambda batch: (batch.slice(i, 7) for i in range(0, batch.num_rows, 7)))
    cut = X._Sample(given, X.Settings())
    assert (whole.texts_with == cut.texts_with).all() and (whole.form == cut.form).all()
    assert (whole.instance == cut.instance).all() and (whole.row == cut.row).all()
    words = {w.lower().strip(".") for w in given[0].split()}
    bags = X.Bags(pa.array(given[:1], pa.large_string()), X.Settings())
    assert len(bags.features(18)[0]) == len(words)


def test_query(spark, small):
    found = op11_toxicity(spark, small)
    assert found.columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    rows = found.collect()
    assert sorted(r.doc_id for r in rows) == sorted(i for i, _ in table(small))
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)


LABELS = "doc_id long, toxic int, score double, text string, id int, label string"


def labelled(spark, rows):
    return spark.createDataFrame([(i, y, 0.5, "t", 1, "l") for i, y in rows], LABELS)


def test_one_label_no_label_and_odd_labels(spark, hard_df, empty_df):
    some = [(3, 1), (3, 0), (13, 1), (23, None), (33, 7), (None, 1), (99_999, 0)]
    only_ones = X.toxicity(hard_df, labelled(spark, [(i, y) for i, y in some if y != 0])).collect()
    assert {(r.score, r.predicted) for r in only_ones if r.n_sentences} == {(1.0, 1)}
    assert {(r.score, r.predicted, r.n_offending) for r in only_ones if not r.n_sentences} == {(0.0, 0, 0)}
    none = X.toxicity(hard_df, labelled(spark, [])).collect()
    assert {(r.score, r.predicted) for r in none} == {(0.0, 0)} and len(none) == hard_df.count()
    mixed = X.toxicity(hard_df, labelled(spark, some + [(43, 0), (63, 0), (73, 0)])).collect()
    assert len(mixed) == hard_df.count()
    assert X.toxicity(empty_df, labelled(spark, some)).count() == 0


def test_repeated_ids_teach_once_and_held_out_labels_nothing(spark):
    rows = texts(60)
    docs = spark.createDataFrame([(i, t) for i, t, _, _ in rows] * 2 + [(1, "zzz other")], "doc_id long, text string")
    taught = [(i, y) for i, _, y, _ in rows]
    first = X.fitted(docs, labelled(spark, taught + taught))
    # What the held-out rows' labels say makes no difference.
    turned = [(i, 1 - y if zlib.crc32(str(i).encode()) % 4 == 2 else y) for i, y in taught]
    second = X.fitted(docs, labelled(spark, turned))
    assert first.bias == second.bias and (first.weights == second.weights).all()
