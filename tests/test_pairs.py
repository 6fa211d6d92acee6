"""Pairs found inside tasks against all pairs."""

import math
import random

import pyarrow as pa
import pytest

from seamline.operators import grids as G
from seamline.operators import pairs as N


@pytest.fixture(scope="module")
def crowd():
    """Points over cells of both signs, and 60 of them in one small square."""
    r = random.Random(11)
    return [(i, r.uniform(-9, 9), r.uniform(-9, 9), r.random()) for i in range(150)] + [(1000 + i, 1 + r.random() / 9, 1 + r.random() / 9, r.random()) for i in range(60)]


@pytest.mark.parametrize("chunk", [7, 2000])
def test_all_pairs_once(spark, crowd, monkeypatch, chunk):
    monkeypatch.setattr(N, "CHUNK", chunk)

    def ids(t, blocks):
        for i, j, d, square in blocks:
            i, j, d = i[square <= 1], j[square <= 1], d[square <= 1]
            yield pa.RecordBatch.from_arrays([t["id"].take(pa.array(i)).combine_chunks(), t["id"].take(pa.array(j)).combine_chunks(), pa.array(d)], ["a", "b", "d"])

    df = spark.createDataFrame(crowd, "id long, x double, y double, v double").repartition(5)
    got = sorted((min(r.a, r.b), max(r.a, r.b), round(r.d, 9)) for r in N.near_in_tasks(df, 2.5, ids, "a long, b long, d double").collect())
    want = sorted((p[0], q[0], round(math.dist(p[1:3], q[1:3]), 9)) for p in crowd for q in crowd if p[0] < q[0] and math.dist(p[1:3], q[1:3]) <= 2.5)
    assert got == want
    units = N._units(df, 2.5, "id", "x", "y").filter("_own").groupBy("_ux", "_uy", "_u").count().collect()
    assert max(r["count"] for r in units) < 5 * chunk


def test_semivariances_of_crowded_points(spark, crowd, monkeypatch):
    monkeypatch.setattr(N, "CHUNK", 7)
    df = spark.createDataFrame(crowd + [(5000, None, 1.0, 1.0), (5001, 1.0, float("nan"), 1.0)], "id long, x double, y double, value double").repartition(5)
    got = {r.lag: (r.pairs, round(r.distance, 9), round(r.semivariance, 9)) for r in G.semivariances(df, 3.0, 4).collect()}
    bins = {}
    for k, p in enumerate(crowd):
        for q in crowd[:k]:
            if (d := math.dist(p[1:3], q[1:3])) <= 3:
                bins.setdefault(min(int(d / 0.75), 3), []).append((d, (p[3] - q[3]) ** 2))
    assert got == {k: (len(b), round(sum(d for d, _ in b) / len(b), 9), round(sum(g for _, g in b) / len(b) / 2, 9)) for k, b in bins.items()}
