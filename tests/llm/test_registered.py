"""The registered corpus queries: those with SQL equal it, the others give one row or more per document."""

import pytest

import __spark_entry__ as entry
from gtdlens.llm import queries
from tests.compare import compare, oracle_connection

SQL = queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, small, name):
    assert compare(spark, oracle_connection(small), small, name) == ""


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(SQL)))
def test_columns(spark, small, name):
    expected = {
        "op2_multiprobe_neighbours": ["query_id", "rank", "vec_id", "score"],
        "op3_sentencepiece": ["doc_id", "n_pieces", "pieces", "decoded"],
        "op4_line_dedup": ["doc_id", "n_lines", "n_removed_lines", "n_removed_chunks", "kept_sha256"],
        "op5_language_id": ["doc_id", "held_out", "lang_pred", "score"],
        "op7_quality_rules": [
            "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        ],
        "op8_length_packing": ["doc_id", "piece", "first_word", "n_tokens", "bucket", "bucket_tokens", "batch", "slot"],
        "op9_kd_sharding": ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"],
        "op10_token_counts": ["doc_id", "n_bytes", "n_tokens", "over_limit"],
        "op11_toxicity": ["doc_id", "held_out", "score", "predicted"],
        "op13_embedding_whitening": ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
    }[name]
    # The plan alone: the operators' own tests check the rows.
    assert entry.queries()[name](spark, small).columns[: len(expected)] == expected


def test_every_operator_and_the_pipeline_are_registered():
    names = list(entry.queries())
    assert [sum(n.startswith(f"op{i}_") for n in names) for i in range(1, 14)] == [1] * 13
    assert "pipeline" in names
