"""Encoding by a dictionary that is a table gives what the listed vocabulary gives, for columns of any length."""

import pytest
from pyspark.errors import PySparkException
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from gtdlens.operators import encoding as E


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(
        [(1, 10, "b", 1.5), (2, 2, "a", None), (3, 1, None, 2.0), (4, 10, "None", 0.0), (5, None, "ä b", None)],
        "id int, hour int, `ki.nd` string, amount double",
    )


COLUMNS = ["hour", "ki.nd"]


def test_same_positions_as_the_vocabulary(spark, rows):
    listed = E.vocabulary_table(spark, E.fit_vocabulary(rows.withColumnRenamed("ki.nd", "kind"), ["hour", "kind"]))
    table = E.fit_dictionary(rows.withColumnRenamed("ki.nd", "kind"), ["hour", "kind"])
    assert tuple(table.columns) == E.DICTIONARY == tuple(listed.columns)
    plain = sorted(map(tuple, listed.collect()))
    assert sorted(map(tuple, table.collect())) == plain and len(plain) == 8


def test_same_flags_as_the_vectors(rows):
    named = rows.withColumnRenamed("ki.nd", "kind")
    model, names = E.fit_feature_pipeline(named, E.fit_vocabulary(named, ["hour", "kind"]), [])
    vectors = model.transform(named).select("id", vector_to_array("features").alias("v")).collect()
    encoded = E.encode_by_dictionary(named, E.fit_dictionary(named, ["hour", "kind"]), ["hour", "kind"], strict=True)
    assert encoded.columns == ["id", "amount", "flags"]
    found = {r["id"]: r["flags"] for r in encoded.collect()}
    assert found == {r["id"]: [i for i, x in enumerate(r["v"]) if x] for r in vectors}
    assert len(names) == 8


def test_unseen_values(spark, rows):
    table = E.fit_dictionary(rows.where("id < 3"), COLUMNS)
    found = {r["id"]: r["flags"] for r in E.encode_by_dictionary(rows, table, COLUMNS).collect()}
    # hour: 2, 10; kind: a, b.
    assert found == {1: [1, 3], 2: [0, 2], 3: [], 4: [1], 5: []}
    with pytest.raises(PySparkException, match="unseen value in hour: (1|None)"):
        E.encode_by_dictionary(rows, table, COLUMNS, strict=True).collect()
    empty = E.fit_dictionary(rows.limit(0), COLUMNS)
    assert empty.count() == 0
    assert {tuple(r["flags"]) for r in E.encode_by_dictionary(rows, empty, COLUMNS).collect()} == {()}


def test_a_million_values_and_no_list_of_them(spark):
    df = spark.range(1_000_000).select("id", F.format_string("player %07d", "id").alias("player"), (F.col("id") % 3).alias("k"))
    with pytest.raises(ValueError, match="more than 100000 categories"):
        E.fit_vocabulary(df, ["player", "k"])
    table = E.fit_dictionary(df, ["player", "k"])
    encoded = E.encode_by_dictionary(df, table, ["player", "k"], strict=True)
    plan = encoded._jdf.queryExecution().optimizedPlan().toString()
    assert "player 0000" not in plan and len(plan) < 20_000
    wrong = encoded.where(
        (F.col("flags")[0] != F.col("id")) | (F.col("flags")[1] != 1_000_000 + F.col("id") % 3) | (F.size("flags") != 2)
    )
    assert wrong.isEmpty() and encoded.count() == 1_000_000
