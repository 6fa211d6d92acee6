import pytest

from seamline.operators import formula as X

ROWS = [(1, 1.0, 2.0), (1, 2.0, 2.0), (1, 3.0, 2.0)]


def run(spark, expression, rows=ROWS, **more):
    df = spark.createDataFrame(rows, "w int, GR double, RHOB double")
    return [(r.value, r.error) for r in X.evaluate(df, expression, ["w"], **more).orderBy("GR").collect()]


def test_names_in_order():
    assert X.names("2.5 * sqrt(abs(depth - velocity)) / zscore(depth) + minmax(porosity * velocity)") == ["depth", "velocity", "porosity"]


@pytest.mark.parametrize("bad", ["GR ** 2", "GR.x", "GR > 1", "pow(GR, 2)", "log(GR, 2)", "log(x=GR)", "True", "import os", "", "__import__('os')", "[GR]"])
def test_what_is_not_allowed(bad):
    with pytest.raises(X.FormulaError):
        X.names(bad)


def test_values_and_scales(spark):
    assert [v for v, _ in run(spark, "-(GR + RHOB) / 2")] == [-1.5, -2.0, -2.5]
    assert [v for v, _ in run(spark, "zscore(GR)")] == pytest.approx([-(1.5**0.5), 0, 1.5**0.5])
    assert [v for v, _ in run(spark, "minmax(GR) + norm(GR * 1)")] == pytest.approx([-(1.5**0.5), 0.5, 1 + 1.5**0.5])


def test_bad_points_block_all(spark):
    assert run(spark, "log(GR - 1)") == [(None, X.DOMAIN)] * 3
    assert run(spark, "1 / (GR - 2)") == [(None, X.DOMAIN)] * 3
    assert run(spark, "norm(RHOB)") == [(None, "zero_std")] * 3
    assert run(spark, "GR + 1", [(1, 1.0, 1.0), (1, float("nan"), 1.0), (2, 5.0, 1.0)])[1:][0] == (6.0, None)


def test_scale_of_a_bare_name_uses_the_whole_series(spark):
    from pyspark.sql import functions as F

    inside = F.col("GR") >= 2
    assert [v for v, _ in run(spark, "zscore(GR)", inside=inside)] == pytest.approx([0, 1.5**0.5])
    assert [v for v, _ in run(spark, "zscore(GR * 1)", inside=inside)] == pytest.approx([-1, 1])


def test_coverage(spark):
    df = spark.createDataFrame(ROWS, "w int, GR double, RHOB double")
    got = {r.formula: (r.status, r.points) for r in X.coverage(df, {"a": "GR", "b": "log(-GR)"}, ["w"]).collect()}
    assert got == {"a": ("ok", 3), "b": (X.DOMAIN, 0)}
