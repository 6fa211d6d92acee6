import duckdb

from seamline.llm import fixity as X

SF = "/root/testdata/sf0.001"
KIND = "page_id long, url string, html string, side int, node string"


def audit(spark, a, b):
    df = lambda rows: spark.createDataFrame([(*r, 1, "x") for r in rows], KIND)
    return sorted((r.place, r.kind, r.n_left, r.n_right) for r in X.audit(df(a), df(b), "page_id", ["url", "html"]).collect())


def test_faults_are_found_at_their_places(spark):
    rows = [(i, f"u{i % 3}", f"text {i}") for i in range(300)] + [(7, "u", "again"), (None, "n", None)]
    assert audit(spark, rows, rows[::-1]) == []
    other = [r for r in rows if r[0] != 40] + [(999, "u", "new"), (8, "u2", "text 8")]
    other = [(r[0], r[1], r[2] + "!") if r[0] == 100 else r for r in other]
    assert audit(spark, rows, other) == [(8, "count", 1, 2), (40, "missing", 1, 0), (100, "changed", 1, 1), (999, "extra", 0, 1)]


def test_null_empty_and_shifted_texts_differ(spark):
    rows = [(1, "ab", "c"), (2, None, ""), (None, "a", "b")]
    assert audit(spark, rows, [(1, "a", "bc"), (2, "", None), (None, "a", None)]) == [(-1, "changed", 1, 1), (1, "changed", 1, 1), (2, "changed", 1, 1)]


def test_empty_tables(spark):
    assert audit(spark, [], []) == [] and audit(spark, [(0, "a", "b")], []) == [(0, "missing", 1, 0)]


def test_query_against_sql(spark):
    got = sorted((r.page_id, r.kind, r.n_left, r.n_right) for r in X.op2_warc_fixity(spark, SF).collect())
    want = duckdb.sql(X.SQL.replace("from pages", f"from '{SF}/pages.parquet'")).fetchall()
    assert got == sorted(want) and got
