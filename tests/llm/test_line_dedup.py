import duckdb
import pytest

from chronolode.llm import line_dedup as op

SF = "/root/testdata/sf0.01"
LONG = "x" * 44


def run(spark, rows, schema="doc_id long, text string"):
    return {r.doc_id: r for r in op.line_dedup(spark.createDataFrame(rows, schema)).collect()}


def test_equals_sql(spark):
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = sorted(c.sql(op.OP1_SQL).fetchall())
    got = op.op1_line_dedup(spark, SF).select("doc_id", "n_lines", "n_dropped", "kept_sha256")
    assert sorted(map(tuple, got.collect())) == want and any(r[2] for r in want)


def test_main_path_is_native(spark):
    plan = op.op1_line_dedup(spark, SF)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_lines_are_sorted_and_streamed(spark):
    """The sort by document and position is in the plan that runs, on range partitions, with nothing exchanged for the runs."""
    rows = spark.createDataFrame([(d, 1, p, bytes([k])) for d in range(5000, 0, -7) for p in (3, 1) for k in range(3)], "did long, row_hash long, pos int, key binary")
    firsts = op.first_occurrences(rows)
    plan = firsts._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "rangepartitioning" in plan and plan.count("Sort [") == 1 and "did#" in plan.split("Sort [")[1].split("]")[0] and "pos#" in plan.split("Sort [")[1].split("]")[0]
    got = sorted(map(tuple, firsts.collect()))
    want = []
    for k in range(3):
        for span in (0, 1):
            ids = [d for d in range(5000, 0, -7) if d >> op.SPAN_BITS == span]
            want += [(bytes([k]), span, d, 2 * i + 1) for i, d in enumerate(ids)]
    assert got == sorted((bytearray(k), *r) for k, *r in want)


def test_lines_are_cut_once(spark):
    df = spark.createDataFrame([(i, LONG) for i in range(5)], "doc_id long, text string")
    hashes = op.line_hashes(df)
    assert "Generate" not in op.keep_bitmaps(df)._jdf.queryExecution().toString() and hashes.count() == 5


def test_spans_of_a_hot_line(spark, monkeypatch):
    monkeypatch.setattr(op, "SPAN_BITS", 2)
    got = run(spark, [(i, f"{LONG}\nown {i}\n{LONG}") for i in range(-40, 60)])
    assert [d for d, r in got.items() if not r._n_dropped] == [59] and {r._n_dropped for d, r in got.items() if d != 59} == {2}


def test_keeper_and_case(spark):
    rows = [(i, f"  {LONG}É\t\nshort\n{LONG.upper()}É") for i in range(5)] + [(9, f"{LONG}é"), (8, None), (7, "")]
    got = run(spark, rows)
    assert [got[i]._n_dropped for i in range(5)] == [2, 2, 2, 2, 0] and got[0].text == "short" and got[4].text == rows[4][1]
    assert (got[9]._n_dropped, got[9].text) == (0, f"{LONG}é") and got[8].text is None and (got[7].text, got[7]._n_lines) == ("", 1)


@pytest.mark.parametrize("n, dropped", [(4, 0), (5, 1)])
def test_counts_documents_not_lines(spark, n, dropped):
    rows = [(i, "\n".join([LONG] * 3)) for i in range(n)]
    assert run(spark, rows)[0]._n_dropped == 3 * dropped


def test_kelvin_sign_is_no_k(spark):
    got = run(spark, [(i, "Kk" + LONG) for i in range(4)] + [(i, "kK" + LONG) for i in range(4, 8)])
    assert all(r._n_dropped == 0 for r in got.values())


def test_nulls_repeats_and_clashing_columns(spark):
    schema = "doc_id long, text string, keep string, did long, _n_lines string, row string"
    rows = [(None, LONG, "a", 1, "b", "c"), (None, LONG, "a", 1, "b", "c")] + [(i, LONG, "a", 1, "b", "c") for i in (1, 1, 2, 3, 4)]
    df = op.line_dedup(spark.createDataFrame(rows, schema))
    assert df.columns == ["doc_id", "text", "keep", "did", "row", "_n_lines", "_n_dropped"]
    got = [(r.doc_id, r._n_dropped, r.text, r.keep) for r in df.collect()]
    assert sorted(got, key=str) == sorted([(None, 1, "", "a")] * 2 + [(1, 1, "", "a")] * 2 + [(2, 1, "", "a"), (3, 1, "", "a"), (4, 0, LONG, "a")], key=str)


def test_long_text_and_bitmap(spark):
    shared = [f"{k:04d}" + LONG for k in range(200)]
    rows = [(i, "\n".join(x for k, s in enumerate(shared) for x in (s, f"own {i} {k}"))) for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in op.line_dedup(df).collect()}
    assert got[0].text == "\n".join(f"own 0 {k}" for k in range(200)) and got[4].text == rows[4][1]
    bitmap = op.keep_bitmaps(df).where("did = 0").first()
    assert bitmap.n_dropped == 200 and [w.word for w in bitmap.keep] == list(range(7)) and bin(bitmap.keep[0].bits & (2**64 - 1)).count("1") == 32


def test_empty_table(spark):
    assert run(spark, []) == {}
