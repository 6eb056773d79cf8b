"""Line dedup with chunks of two or three lines, against a plain version and against all repeated multi-line runs."""

from gtdlens.llm import lines
from tests.llm.brute import bounded_chunks, bounded_line_dedup, not_blank
from tests.llm.conftest import known, table
from tests.llm.test_repeat_operators import line_docs


def in_repeated_runs(docs):
    """Lines in a run of two or more that occurred before."""
    first, total = {}, 0
    for i, text in sorted(docs):
        every, covered = text.split("\n"), set()
        at = not_blank(every)
        for a, b in zip(at, at[1:]):
            if first.setdefault((every[a], every[b]), (i, a)) != (i, a):
                covered.update((a, b))
        total += len(covered)
    return total


def check(df, rows):
    found, expected, text = lines.without_repeated_chunks(df, bounded=True).collect(), bounded_line_dedup(known(rows)), dict(known(rows))
    assert sorted(str(r.doc_id) for r in found) == sorted(str(i) for i, _ in rows)
    for r in found:
        if r.doc_id is not None:
            removed, left = expected.get(r.doc_id, (0, None))
            assert (r.removed_lines, r.text) == (removed, left if removed else text[r.doc_id]), r.doc_id
    return sum(r.removed_lines for r in found)


def test_chunks_can_all_take_part():
    for _, text in line_docs(5):
        sizes = [len(not_blank(c)) for c in bounded_chunks(text)]
        assert "\n".join("\n".join(c) for c in bounded_chunks(text)) == text
        assert max(sizes) <= 3 and (min(sizes) >= 2 or len(sizes) == 1)


def test_bounded_equals_brute_force(spark, hard_df, hard_rows):
    rows = line_docs(1)
    check(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), rows)
    check(hard_df, hard_rows)


def test_run_of_equal_lines(spark):
    rows = [(1, "\n".join(["one and the same"] * 101)), (2, "a\nb\nc"), (3, "a\nb\nc"), (4, "a\nb\nc\n\n")]
    found = {r.doc_id: r.removed_lines for r in lines.without_repeated_chunks(spark.createDataFrame(rows, "doc_id long, text string"), bounded=True).collect()}
    assert found == {1: 96, 2: 0, 3: 3, 4: 0}


def test_share_of_repeated_runs(spark):
    folder = "/root/testdata/sf0.01"
    rows = [(i, t) for i, t in table(folder) if t is not None]
    removed = check(spark.read.parquet(f"{folder}/documents.parquet").where("text is not null"), rows)
    assert removed > 0.8 * in_repeated_runs(rows)


def test_bounded_runs_no_python(spark, small):
    df = spark.read.parquet(f"{small}/documents.parquet")
    plan = lines.line_digest(df, bounded=True)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
