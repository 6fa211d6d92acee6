"""Medians of similarities against all pairs."""

import numpy as np
import pytest

from seamline.operators import similarity as C


@pytest.mark.parametrize("size", [5, 1000])
def test_medians_by_all_pairs(spark, monkeypatch, size):
    # blocks of five on either side, zeros, constants, nulls, another length and equal traces
    monkeypatch.setattr(C, "SOME", size)
    monkeypatch.setattr(C, "MANY", size)
    x = np.random.default_rng(4).normal(size=(41, 6)).round(2)
    x[7], x[8], x[9] = 0, 3, x[10]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(60, None), (61, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (80, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, a array<double>").repartition(3)
    got = {r.id: (r.cosine, r.pearson) for r in C.median_similarities(df.filter("vec_id % 2 = 0 or vec_id = 7"), df, "vec_id", "a").collect()}
    assert set(got) == {*range(0, 41, 2), 7, 60, 80}

    def middle(m, i):
        with np.errstate(invalid="ignore"):
            s = np.array([m[i] @ v / (np.linalg.norm(m[i]) * np.linalg.norm(v)) for k, v in enumerate(m) if k != i])
        return float(np.median(s[~np.isnan(s)])) if (~np.isnan(s)).any() else None

    for i, pair in got.items():
        want = (middle(x, i), middle(x - x.mean(axis=1)[:, None], i)) if i < 41 else (None, None)
        assert all(a is b or abs(a - b) < 1e-9 for a, b in zip(pair, want)), i
