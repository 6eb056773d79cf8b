"""Compare every registered query with its oracle SQL: ``python tests/compare.py [sf] [name ...]``."""

import math
import sys
import time
from datetime import date, datetime
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import __spark_entry__ as entry

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def oracle_connection(sf_dir):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from read_parquet('{sf_dir}/{name}.parquet')")
    return con


def cell(value):
    if value is None:
        return "~"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    if isinstance(value, (datetime, date)):
        return value.isoformat()
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


def compare(spark, con, sf_dir, name):
    """Empty when equal, else a short description of the first differences."""
    df = entry.queries()[name](spark, sf_dir)
    ours = rows_of(df.columns, df.collect())
    result = con.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in result.description]
    theirs = rows_of(columns, result.fetchall())
    if sorted(columns) != sorted(df.columns):
        return f"columns differ: {sorted(set(columns) ^ set(df.columns))}"
    if len(ours) != len(theirs):
        return f"{len(ours)} rows against {len(theirs)}"
    wrong = [(a, b) for a, b in zip(ours, theirs) if a != b]
    return f"{len(wrong)} of {len(ours)} rows differ, first {wrong[0]}" if wrong else ""


if __name__ == "__main__":
    from gtdlens.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    spark, folder = local_session(8), f"/root/testdata/sf{sf}"
    con = oracle_connection(folder)
    for name in sys.argv[2:] or entry.queries():
        started = time.time()
        if name in entry.oracle_sql():
            outcome = compare(spark, con, folder, name) or "same"
        else:
            outcome = f"{len(entry.queries()[name](spark, folder).collect())} rows, no oracle"
        print(f"{name}: {outcome} ({time.time() - started:.1f} s)", flush=True)
