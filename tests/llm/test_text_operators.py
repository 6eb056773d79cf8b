"""Operators that judge each text on its own: quality, token counts, pieces, language."""

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
import tokenizers

from gtdlens.llm import language, piece_model, quality, token_counts
from tests.llm import brute

BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def by_text(found, rows):
    """Result rows paired with the input's texts; ids repeat only with equal texts."""
    text = dict(rows)
    assert sorted(str(r.doc_id) for r in found) == sorted(str(i) for i, _ in rows)
    return [(text[r.doc_id], r) for r in found if r.doc_id is not None]


def test_quality_equals_brute_force(hard_df, hard_rows):
    rules = quality.Rules()
    for text, row in by_text(quality.quality(hard_df).collect(), hard_rows):
        for name, value in brute.quality(text, rules).items():
            assert getattr(row, name) == value, (name, text and text[:50])


def test_quality_of_small_documents(spark, small, small_docs):
    found = quality.quality(spark.read.parquet(f"{small}/documents.parquet")).collect()
    for text, row in by_text(found, small_docs):
        for name, value in brute.quality(text, quality.Rules()).items():
            assert getattr(row, name) == value, (name, row.doc_id)


def test_bands_reject_noise_and_repeats_and_keep_prose(spark):
    rng = np.random.default_rng(1)
    noise = " ".join("".join(chr(c) for c in rng.integers(0x21, 0x17F, 12)) for _ in range(300))
    prose = " ".join("".join(rng.choice(list("etaoinshr"), 5)) for _ in range(900))
    half = prose[:5_000] + " " + " ".join("abcdefgh"[i % 7 :] for i in range(4_000))
    df = spark.createDataFrame([(1, noise), (2, prose), (3, half)], "doc_id long, text string")
    kept = {r.doc_id: (r.kept, r.n_bad_chunks) for r in quality.quality(df).collect()}
    assert not kept[1][0] and kept[2] == (True, 0) and kept[3][1] > 0 and not kept[3][0]


def test_keep_good_keeps_columns(hard_df):
    kept = quality.keep_good(hard_df)
    assert kept.schema == hard_df.schema
    assert kept.count() == quality.quality(hard_df).where("kept").count()


@pytest.mark.parametrize("operator", ["quality", "tokens", "pieces", "language"])
def test_empty_table(empty_df, operator):
    result = {
        "quality": lambda: quality.quality(empty_df),
        "tokens": lambda: token_counts.token_counts(empty_df, BPE),
        "pieces": lambda: piece_model.encode_texts(empty_df, PIECES),
        "language": lambda: language.identify(empty_df),
    }[operator]()
    assert result.collect() == []


def test_token_counts_equal_the_library(spark, small, small_docs, hard_df, hard_rows):
    library = tokenizers.Tokenizer.from_file(BPE)
    for df, rows in ((hard_df, hard_rows), (spark.read.parquet(f"{small}/documents.parquet"), small_docs)):
        for text, row in by_text(token_counts.token_counts(df, BPE).collect(), rows):
            n = len(library.encode(text or "", add_special_tokens=False).ids)
            assert (row.n_tokens, row.n_bytes, row.over_limit) == (n, len((text or "").encode()), n > 1024)


def test_splitter_equals_the_pattern():
    import regex

    compiled = token_counts.Splitter()
    rng = np.random.default_rng(5)
    letters = list("'''strevldmx  \n\t1²é日!-_ ")
    for _ in range(3_000):
        text = "".join(rng.choice(letters, rng.integers(0, 200)))
        kinds = np.concatenate([compiled.kinds[[ord(c) for c in text]], [token_counts.END]]) if text else np.array([], np.uint8)
        starts = np.flatnonzero(compiled.starts(kinds)).tolist()
        assert starts == [m.start() for m in regex.finditer(public_tokenizers.PATTERN, text)], text


def test_pieces_equal_the_library_and_decode(spark, small, small_docs, hard_df, hard_rows):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for df, rows in ((hard_df, hard_rows), (spark.read.parquet(f"{small}/documents.parquet"), small_docs)):
        encoded = piece_model.encode_texts(df, PIECES)
        for text, row in by_text(encoded.collect(), rows):
            ids = library.encode(text or "")
            assert list(row.pieces) == ids and row.n_pieces == len(ids) and row.decoded == library.decode(ids)
        again = {r.doc_id: r.text for r in piece_model.decode_pieces(encoded, PIECES).collect()}
        assert again == {r.doc_id: r.decoded for r in encoded.collect()}


def test_round_trip_of_plain_texts(spark, small):
    df = spark.read.parquet(f"{small}/documents.parquet")
    encoded = piece_model.encode_texts(df, PIECES).join(df, "doc_id")
    assert encoded.where("text not like '%▁%' and decoded <> text").count() == 0


def test_suffix_array_ranges():
    rng = np.random.default_rng(2)
    codes = rng.integers(97, 100, 500).astype(np.uint32)
    index = piece_model.SuffixArray(codes, 4)
    patterns = [rng.integers(97, 101, n) for n in rng.integers(1, 5, 60)]
    padded = np.full((60, 4), -1, np.int64)
    for i, p in enumerate(patterns):
        padded[i, : len(p)] = p
    low, high = index.ranges(padded, np.array([len(p) for p in patterns]))
    text = bytes(codes.astype(np.uint8)).decode()
    for p, a, b in zip(patterns, low, high):
        wanted = "".join(map(chr, p))
        assert sorted(index.order[a:b]) == [i for i in range(500) if text.startswith(wanted, i)]


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(4)
    scores, change = rng.normal(size=(1, 4, 3)), rng.normal(size=(3, 3))
    chance, pairs = language.forward_backward(scores, np.ones((1, 4), bool), change)
    weight, marginal, joint = 0.0, np.zeros((4, 3)), np.zeros((3, 3))
    for labels in np.ndindex(3, 3, 3, 3):
        value = np.exp(sum(scores[0, t, k] for t, k in enumerate(labels)) + sum(change[a, b] for a, b in zip(labels, labels[1:])))
        weight += value
        for t, k in enumerate(labels):
            marginal[t, k] += value
        for a, b in zip(labels, labels[1:]):
            joint[a, b] += value
    assert np.allclose(chance[0], marginal / weight) and np.allclose(pairs, joint / weight)


def test_language_held_out_accuracy(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    settings = language.Settings(rows_per_language=150, runs=1_500, epochs=4)
    found = language.identify(df, settings).join(df, "doc_id").toPandas()
    assert len(found) == 1000
    expected = [zlib.crc32(str(i).encode()) % 4 == 2 for i in found.doc_id]
    assert found.held_out.tolist() == expected
    assert found.score.between(0, 1).all()
    held = found[found.held_out]
    assert (held.lang_pred == held.lang).mean() > 0.96


def test_code_switched_words(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.fitted(df, language.Settings(rows_per_language=150, runs=1_500, epochs=4))
    texts = {lang: df.where(f"lang = '{lang}' and n_chars > 900").first().text[:900] for lang in ("en", "de")}
    words = language.Words(pa.array([texts["en"] + " " + texts["de"]]))
    labels = language.Labeller(model).chances(words).argmax(1)
    n = len(brute.words(texts["en"]))
    right = (labels[:n] == model.languages.index("en")).mean(), (labels[n:] == model.languages.index("de")).mean()
    assert min(right) > 0.9


def test_language_of_hard_rows(hard_df, hard_rows):
    found = language.identify(hard_df, language.Settings(runs=50, epochs=1)).collect()
    assert len(found) == len(hard_rows)
    for text, row in by_text(found, hard_rows):
        if not any(c.isalpha() for c in text or ""):
            assert (row.lang_pred, row.score) == ("und", 0.0)
        else:
            assert row.lang_pred in ("x", "y") and 0 <= row.score <= 1


def test_language_without_labels(hard_df):
    from pyspark.sql import functions as F

    found = language.identify(hard_df.withColumn("lang", F.lit(None).cast("string")))
    assert {(r.lang_pred, r.score) for r in found.collect()} == {("und", 0.0)}


def test_tasks_need_no_installed_package(tmp_path, small):
    """A driver that knows the package only by its own path, started from another folder."""
    import os
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent.parent
    code = f"""
import sys; sys.path.insert(0, {str(root)!r})
import __spark_entry__ as entry
from gtdlens.session import local_session
spark = local_session(2)
for name in ("op7_quality_rules", "op10_token_counts"):
    print(name, entry.queries()[name](spark, {small!r}).count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True)
    assert "op7_quality_rules 200" in done.stdout and "op10_token_counts 200" in done.stdout, done.stderr[-500:]
