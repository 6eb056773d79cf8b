import pytest
from pyspark.errors import PySparkException
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from gtdlens.operators import encoding as E


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(
        [(1, 10, "b", 1.5), (2, 2, "a", None), (3, 1, None, 2.0), (4, 10, "a", 0.0)],
        "id int, hour int, kind string, amount double",
    )


def test_vocabulary_order(spark, rows):
    vocabulary = E.fit_vocabulary(rows, ["hour", "kind"])
    # A missing value is a category of its own and sorts last.
    assert vocabulary == {"hour": ["1", "2", "10"], "kind": ["a", "b", "None"]}
    table = E.vocabulary_table(spark, vocabulary).collect()
    names = [r["feature_name"] for r in table]
    assert names == ["hour_1", "hour_2", "hour_10", "kind_a", "kind_b", "kind_None"]


def test_vocabulary_takes_every_value_and_the_missing_one(spark):
    assert len(E.fit_vocabulary(spark.range(12_000), ["id"])["id"]) == 12_000
    df = spark.createDataFrame([(2,), (None,), (10,)], "n int")
    vocabulary = E.fit_vocabulary(df, ["n"])
    assert vocabulary == {"n": ["2", "10", "None"]}
    flags = E.onehot(df, vocabulary, strict=True).collect()
    assert sorted(tuple(r) for r in flags) == [(0.0, 0.0, 1.0), (0.0, 1.0, 0.0), (1.0, 0.0, 0.0)]


def test_lenient_zeros_and_strict_error(rows):
    vocabulary = {"hour": ["1", "10"], "kind": ["a"]}
    found = E.onehot(rows, vocabulary).orderBy("id").collect()
    assert [tuple(r) for r in found] == [
        (1, 1.5, 0.0, 1.0, 0.0), (2, None, 0.0, 0.0, 1.0), (3, 2.0, 1.0, 0.0, 0.0), (4, 0.0, 0.0, 1.0, 1.0),
    ]
    with pytest.raises(PySparkException, match="unseen value in hour: 2"):
        E.onehot(rows, {"hour": ["1", "10"]}, strict=True).collect()
    full = {"hour": ["1", "2", "10"]}
    assert E.onehot(rows, full, strict=True).exceptAll(E.onehot(rows, full)).isEmpty()


def test_align_pads_absent_columns_only(rows):
    found = E.align(rows, ["amount", "kind_x", "id"]).orderBy("id")
    assert found.columns == ["amount", "kind_x", "id"]
    assert [tuple(r) for r in found.collect()][:2] == [(1.5, 0.0, 1), (None, 0.0, 2)]


def vectors(model, rows):
    return [r["v"] for r in model.transform(rows).orderBy("id").select(vector_to_array("features").alias("v")).collect()]


def test_pipeline_vectors(spark, rows):
    vocabulary = {"hour": ["1", "10"], "kind": ["a", "b"]}
    model, names = E.fit_feature_pipeline(rows, vocabulary, ["amount"])
    assert names == ["amount", "hour_1", "hour_10", "kind_a", "kind_b"]
    assert vectors(model, rows) == [
        [1.5, 0, 1, 0, 1], [-1.0, 0, 0, 1, 0], [2.0, 1, 0, 0, 0], [0.0, 0, 1, 1, 0],
    ]
    assert E.pipeline_inputs(model) == (["amount"], vocabulary)


def test_pipeline_same_as_columns(rows):
    vocabulary = E.fit_vocabulary(rows, ["hour", "kind"])
    model, names = E.fit_feature_pipeline(rows, vocabulary, [])
    flags = E.align(E.onehot(rows, vocabulary).orderBy("id"), names).collect()
    assert vectors(model, rows) == [list(r) for r in flags]


def test_strict_pipeline(spark, rows):
    model, _ = E.fit_feature_pipeline(rows, {"hour": ["1", "2", "10"]}, [], strict=True)
    assert vectors(model, rows) == [[0, 0, 1], [0, 1, 0], [1, 0, 0], [0, 0, 1]]
    with pytest.raises(Exception, match="Unseen label: 5"):
        vectors(model, rows.withColumn("hour", F.lit(5)))


def test_absent_columns_are_padded(spark, rows):
    model, _ = E.fit_feature_pipeline(rows, {"hour": ["1", "2"], "kind": ["a", "b"]}, ["amount"])
    ready, absent = E.padded(rows.select("id", "hour"), model)
    assert sorted(absent) == ["amount", "kind"]
    assert vectors(model, ready)[1] == [0.0, 0, 1, 0, 0]


@pytest.mark.parametrize("hour, expected", [(0.0, 0), (23.99, 23), (5.5, 5), (24.0, None), (-0.5, None), (None, None)])
def test_hour_flags(spark, hour, expected):
    row = spark.createDataFrame([(hour,)], "hour double").select(*E.hour_flags("hour")).first()
    assert [i for i, flag in enumerate(row) if flag] == ([] if expected is None else [expected])
