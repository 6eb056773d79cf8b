import random

import duckdb
import pytest

from tests.conftest import SMALL

SCHEMA = "doc_id long, text string, lang string, seed string, path int, n double, spans string, component string, __text int"


def table(folder, sql="select doc_id, text from documents"):
    con = duckdb.connect()
    for name in ("documents", "embeddings"):
        con.execute(f"create view {name} as select * from read_parquet('{folder}/{name}.parquet')")
    return con.execute(sql).fetchall()


@pytest.fixture(scope="session")
def small_docs():
    return table(SMALL)


def hard_texts():
    """Texts with ties, repeats, blanks, odd characters and great length."""
    rng = random.Random(3)
    vocabulary = ["alpha", "béta", "Gamma", "delta!", "日本", "x", "it's", "12", "#", "é"]

    def prose(n):
        return " ".join(rng.choice(vocabulary) + str(rng.randint(0, 300)) for _ in range(n))

    base, passage = prose(120), prose(40)
    block = "\n".join(prose(9) for _ in range(12))
    long = prose(9_000)
    near = base.split(" ")
    near[50] = "changed"
    return [
        base, base, base.upper(), " ".join(near), "", " \t\n ", "a", "one two three", "one two three", "a " * 400,
        prose(30) + " " + passage + " " + prose(25), prose(10) + "\n" + passage + "\x0b" + prose(5), passage, passage,
        block, prose(8) + "\n" + block + "\n" + prose(7), block + "\n\n\n", "\n" * 50, long, long, prose(20) + " " + long,
        "z" * 20_000, "<|endoftext|> it's ▁ 're <s>\x00", "12345 67890", "Der Hund und die Katze <|endoftext|>",
    ]


@pytest.fixture(scope="session")
def hard_rows():
    """(doc_id, text): the hard texts, one row twice, a null text, a null id with a text of others."""
    rows = [(10 * i + 3, t) for i, t in enumerate(hard_texts())]
    return [*rows, rows[0], rows[10], (-7, None), (4_000, None), (None, rows[0][1]), (None, None)]


@pytest.fixture(scope="session")
def hard_df(spark, hard_rows):
    """The hard rows with null labels and columns named like the operators' own."""
    rows = [(i, t, None if k % 5 == 0 else "xy"[k % 2], "s", k, None, None, "c", 1) for k, (i, t) in enumerate(hard_rows)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty_df(spark):
    return spark.createDataFrame([], SCHEMA)


def known(rows):
    """The rows with an id."""
    return [(i, t) for i, t in rows if i is not None]
