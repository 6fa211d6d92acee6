"""Dimensions of sets whose dimension is known."""

import random

import pytest

from seamline.operators.dimensions import counting_dimensions

SIZES = [2.0**k for k in range(-6, -1)]


def test_known_sets(spark):
    r = random.Random(2)
    rows = [("line", k / 8192, 0.25 + k / 16384) for k in range(8192)]
    rows += [("plane", i / 128, j / 128) for i in range(128) for j in range(128)]
    rows += [("place", 0.3, 0.3)] * 50 + [(None, 0.5, 0.5), ("line", None, 1.0), ("line", float("inf"), 1.0)]
    # the middle third of each third left out, again and again
    rows += [("dust", sum(r.choice((0, 2)) / 3**k for k in range(1, 18)), 0.0) for _ in range(9000)]
    df = spark.createDataFrame(rows, "kind string, x double, y double")
    got = {x.kind: x for x in counting_dimensions(df, ["kind"], ["x", "y"], SIZES).collect()}
    for kind, want in (("line", 1.0), ("plane", 2.0), ("place", 0.0), (None, 0.0)):
        for name in ("counting", "information", "correlation"):
            assert abs(got[kind][name] - want) < 0.08, (kind, name)
    assert got["line"].n == 8192
    dust = counting_dimensions(df.filter("kind = 'dust'"), ["kind"], ["x"], [3.0**-k for k in range(1, 7)]).first()
    assert all(abs(dust[c] - 0.6309) < 0.02 for c in ("counting", "information", "correlation"))
    assert counting_dimensions(df, ["kind"], ["x"], [0.5]).filter("counting is not null").count() == 0
    assert counting_dimensions(df.limit(0), ["kind"], ["x"], SIZES).count() == 0
    with pytest.raises(ValueError):
        counting_dimensions(df, ["kind"], ["x"], [0.0])
