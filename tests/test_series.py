import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from seamline.functions import arrays as A
from seamline.operators import series as S


def made(spark, values, f, out, **more):
    df = spark.createDataFrame([(1, i, float(v) if v is not None else None) for i, v in enumerate(values)], "k int, i int, v double")
    return [r[out] for r in f(df, **more).orderBy("i").collect()]


@pytest.mark.parametrize("f, values, want, more", [
    (S.rolling_mean, [1, 2, 3, 4, 5], [2, 2, 3, 4, 4], {"width": 3}),
    (S.rolling_median, [5, 1, 4, 2, 3], [4, 4, 2, 3, 3], {"width": 3}),
    (S.derivative, [0, 2, 6, 12], [1, 1.5, 2.5, 3], {"step": 2}),
    (S.derivative, [1, 4], [3, 3], {"step": 1}),
    (S.derivative, [1], [None], {"step": 1}),
    (S.rolling_mean, [1, 2], [None, None], {"width": 3}),
])
def test_ordered(spark, f, values, want, more):
    out = {S.rolling_mean: "rolling_mean", S.rolling_median: "rolling_median", S.derivative: "derivative"}[f]
    assert made(spark, values, lambda df, **m: f(df, ["k"], ["i"], "v", **m), out, **more) == want


def test_scales(spark):
    assert made(spark, [1, 2, 3], lambda df: S.zscore(df, ["k"], "v"), "zscore") == pytest.approx([-math.sqrt(1.5), 0, math.sqrt(1.5)])
    assert made(spark, [1, 2, 3, 4], lambda df: S.robust(df, ["k"], "v"), "robust") == pytest.approx([-1, -1 / 3, 1 / 3, 1])
    assert made(spark, [2, 4, 6], lambda df: S.minmax(df, ["k"], "v"), "minmax") == [0, 0.5, 1]
    for f, code in ((S.zscore, "zero_std"), (S.robust, "zero_iqr"), (S.minmax, "zero_range")):
        assert made(spark, [5, 5, 5], lambda df, f=f: f(df, ["k"], "v"), "error") == [code] * 3


def test_gap_fill_ends_and_few_values(spark):
    fill = lambda df: S.gap_fill(df, ["k"], ["i"], "v")
    assert made(spark, [None, 1, None, 3, None], fill, "filled") == [1, 1, 2, 3, 3]
    assert made(spark, [None, 1, None], fill, "filled") == [None, 1, None]


def test_empty_tables(spark):
    df = spark.createDataFrame([], "k int, i int, v double, l string")
    for f in (S.rolling_mean(df, ["k"], ["i"], "v", 3), S.robust(df, ["k"], "v"), S.gap_fill(df, ["k"], ["i"], "v"), S.run_lengths(df, ["k"], ["i"], "l", "i"), S.histogram(df, ["k"], "v", 4)):
        assert f.collect() == []


@settings(max_examples=15, deadline=None)
@given(st.lists(st.sampled_from("abc"), min_size=1, max_size=12))
def test_runs_rebuild_the_series(labels):
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(labels)], "k int, i int, l string")
    runs = S.run_lengths(df, ["k"], ["i"], "l", "i").orderBy("run").collect()
    assert [r.l for r in runs for _ in range(r.rows)] == labels
    assert all(a.l != b.l and a.bottom == b.top for a, b in zip(runs, runs[1:]))


def test_ties_go_to_the_first_seen(spark):
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate("abba")], "k int, i int, l string")
    assert [r.s for r in S.smooth_labels(df, ["k"], ["i"], "l", 3, out="s").orderBy("i").collect()] == ["a", "b", "b", "b"]


def test_array_functions(spark):
    df = spark.createDataFrame([([1.0, 3.0, 2.0, 5.0, 4.0],), ([],), (None,), ([2.0, 2.0],)], "a array<double>")
    a = F.col("a")
    rows = df.select(A.mean(a).alias("m"), A.resample(a, 3).alias("r"), A.count_peaks(a).alias("p"), A.ranks(a).alias("k"), A.skewness(a).alias("s")).collect()
    assert (rows[0].m, rows[0].r, rows[0].p, rows[0].k) == (3.0, [1.0, 2.0, 4.0], 2, [1.0, 3.0, 2.0, 5.0, 4.0])
    assert rows[1].m is None and rows[1].r is None and rows[2].m is None and rows[3].s is None and rows[3].k == [1.5, 1.5]
