"""Filters, grids and kriging against plain loops."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from seamline.operators import grids as G
from seamline.operators import spatial as P
from seamline.sources import jdbc

TRACES = "profile string, place long, a array<double>, filtered string"


def plain_windows(block, rows, columns):
    padded = np.pad(block, ((rows // 2,) * 2, (columns // 2,) * 2))
    return np.lib.stride_tricks.sliding_window_view(padded, (rows, columns)).reshape(*block.shape, -1)


@pytest.fixture(scope="module")
def profile(spark):
    values = np.random.default_rng(4).normal(size=(13, 9)).round(3)
    rows = [("p", i, v.tolist(), None) for i, v in enumerate(values)] + [("q", 5, [1.0, None, 3.0], None), ("q", 9, None, None), ("r", 1, [], None), (None, 2, [4.0], None)]
    return values, spark.createDataFrame(rows, TRACES).drop("filtered")


def of(df, profile):
    return [r.filtered for r in df.filter(F.col("profile").eqNullSafe(F.lit(profile))).orderBy("place").collect()]


@pytest.mark.parametrize("rows, columns", [(3, 5), (5, 1), (1, 3), (19, 3)])
def test_medians(spark, profile, rows, columns):
    values, df = profile
    got = G.median_2d(df, ["profile"], "place", "a", rows, columns, block=4)
    assert np.allclose(of(got, "p"), np.median(plain_windows(values, rows, columns), axis=-1))
    assert of(got, "r") == [None] and of(got, "q")[1] is None and got.count() == 17
    assert G.median_2d(df.limit(0), ["profile"], "place", "a", 3, 3).count() == 0
    with pytest.raises(ValueError):
        G.median_2d(df, ["profile"], "place", "a", 2, 3)


def test_three_medians(spark, profile):
    values, df = profile
    for size in ((3, 1), (3, 3), (1, 3)):
        values = np.median(plain_windows(values, *size), axis=-1)
    assert np.allclose(of(G.median_cross(df, ["profile"], "place", "a", 3), "p"), values)


def test_wiener(spark, profile):
    values, df = profile
    w = plain_windows(values, 3, 5)
    mean, var = w.mean(axis=-1), w.var(axis=-1)
    noise = var.mean()
    got = G.wiener_2d(df, ["profile"], "place", "a", 3, 5, block=4)
    assert np.allclose(of(got, "p"), np.where(var < noise, mean, mean + (1 - noise / var) * (values - mean)))
    assert got.count() == 17 and of(got, "r") == [None] and len(of(got, None)[0]) == 1


def test_smoothed_grid(spark):
    r = np.random.default_rng(8)
    grid = r.integers(0, 3, (7, 5)).astype(float)
    grid[2, 2] = np.nan
    df = spark.createDataFrame([(i, j, None if np.isnan(v) else int(v)) for (i, j), v in np.ndenumerate(grid)], "gx long, gy long, label long")
    for _ in range(3):
        e, new = np.pad(grid, 1, mode="edge"), grid.copy()
        for i, j in np.ndindex(grid.shape):
            cross = [e[i + 1, j + 1], e[i, j + 1], e[i + 2, j + 1], e[i + 1, j], e[i + 1, j + 2]]
            if not np.isnan(grid[i, j]):
                new[i, j] = max((0, 1, 2), key=lambda c: (cross.count(c), -c))
        grid = new
    got = {(c.gx, c.gy): c.label for c in G.smooth_grid(df, "high").collect()}
    assert got == {k: None if np.isnan(v) else int(v) for k, v in np.ndenumerate(grid)}
    assert G.smooth_grid(df, "off").count() == 35 and G.smooth_grid(df.limit(0)).count() == 0


def test_kriging(spark):
    r = np.random.default_rng(2)
    known = [(i, *map(float, r.random(2) * 10), float(r.normal())) for i in range(30)]
    s = spark.createDataFrame(known, "sid long, sx double, sy double, sv double")
    targets = [(0, known[3][1], known[3][2]), *((i, *map(float, r.random(2) * 10)) for i in range(1, 9))]
    t = spark.createDataFrame(targets, "id long, x double, y double")
    near = P.nearest(t, s, 6, 3.0, "id", "sid").join(s, "sid")
    got = {x.id: x for x in G.kriged(near, "id", "sv", 2.0, 7.0, model="exponential").collect()}
    assert abs(got[0].value - known[3][3]) < 1e-8 and got[0].variance < 1e-8
    for i, x, y in targets:
        own = sorted(known, key=lambda k: np.hypot(k[1] - x, k[2] - y))[:6]
        gamma = lambda a, b, c, d: 2 * (1 - np.exp(-3 * np.hypot(a - c, b - d) / 7))
        m = np.array([[*(gamma(a[1], a[2], b[1], b[2]) for b in own), 1] for a in own] + [[1] * 6 + [0]])
        right = np.array([*(gamma(a[1], a[2], x, y) for a in own), 1])
        weight = np.linalg.solve(m, right)
        assert abs(got[i].value - weight[:6] @ [k[3] for k in own]) < 1e-8 and abs(got[i].variance - weight @ right) < 1e-8
    flat = {x.id: x for x in G.kriged(near, "id", "sv", 0.0, 1.0).collect()}
    assert len(flat) == 9 and all(x.variance is None and x.value is not None for x in flat.values())


@pytest.mark.parametrize("model", ["spherical", "exponential", "gaussian"])
def test_fitted_variogram(spark, model):
    h = np.linspace(0.5, 10, 12)
    bins = spark.createDataFrame([(i, float(x), float(g), 5) for i, (x, g) in enumerate(zip(h, 3 * G._shape(model, h, 6.0)))], "lag long, distance double, semivariance double, pairs long")
    sill, reach = G.fitted_variogram(bins, model)
    assert abs(sill - 3) < 0.02 and abs(reach - 6) < 0.05
    assert G.fitted_variogram(bins.limit(0)) == (0.0, 1.0)


def test_database(spark, tmp_path):
    spark._jvm.java.lang.System.setProperty("derby.stream.error.file", str(tmp_path / "derby.log"))
    url, options = "jdbc:derby:memory:grids;create=true", {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    rows = spark.createDataFrame([(i, float(i) / 2, f"n{i}" if i % 5 else None) for i in range(100)], "id long, v double, name string")
    jdbc.write_table(rows, url, "curves", "overwrite", **options)
    jdbc.write_table(rows.withColumn("id", F.col("id") + 100), url, "curves", **options)
    back = jdbc.read_table(spark, url, "curves", "id", 4, **options)
    assert back.rdd.getNumPartitions() == 4
    assert sorted(map(tuple, back.filter("id < 100").collect()), key=lambda r: r[0]) == sorted(map(tuple, rows.collect()), key=lambda r: r[0])
    assert back.count() == 200 and jdbc.read_table(spark, url, "curves", **options).agg(F.max("v")).first()[0] == 49.5
    jdbc.write_table(rows.limit(0), url, "curves", "overwrite", **options)
    assert jdbc.read_table(spark, url, "curves", "id", **options).count() == 0


def test_kriging_query_with_many_sites(spark, tmp_path, monkeypatch):
    # 5,000 sites: within the first radius of 60 lie 56 of them, far more than the eight that are asked for
    from pyspark.sql import Window as W

    from seamline.plans import common, grids

    spark.range(5000).selectExpr("id as s_suppkey", "double(id * 31 % 997) as s_acctbal").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.range(40).selectExpr("id * 13 as c_custkey", "'c' as c_name", "1.0d as c_acctbal", "'k' as c_mktsegment").write.parquet(f"{tmp_path}/customer.parquet")
    radii, within = [], P.within
    monkeypatch.setattr(P, "within", lambda a, b, radius, *more: radii.append(radius) or within(a, b, radius, *more))
    got = {r.id: (r.value, r.variance, r.neighbours) for r in grids.kriging(spark, str(tmp_path)).collect()}
    assert radii[0] < 60
    s = common.sites(spark, str(tmp_path))
    a, b = s, s.select(*(F.col(c).alias(f"o{c}") for c in s.columns))
    d = F.sqrt((F.col("sx") - F.col("osx")) ** 2 + (F.col("sy") - F.col("osy")) ** 2)
    lag = F.least(F.floor(d / 30), F.lit(9)).cast("long").alias("lag")
    bins = a.crossJoin(b).filter((F.col("sid") < F.col("osid")) & (d <= 300)).groupBy(lag).agg(F.avg(d).alias("distance"), (F.avg((F.col("sv") - F.col("osv")) ** 2) / 2).alias("semivariance"), F.count("*").alias("pairs"))
    far = F.sqrt((F.col("x") - F.col("sx")) ** 2 + (F.col("y") - F.col("sy")) ** 2)
    near = common.points(spark, str(tmp_path)).select("id", "x", "y").crossJoin(s).withColumn("distance", far).withColumn("r", F.row_number().over(W.partitionBy("id").orderBy("distance", "sid"))).filter("r <= 8")
    want = {r.id: r for r in G.kriged(near, "id", "sv", *G.fitted_variogram(bins)).collect()}
    assert len(got) == 40 and all(abs(v[0] - want[i].value) < 0.01 and abs(v[1] - want[i].variance) < 0.1 + 1e-6 * want[i].variance and v[2] == 8 for i, v in got.items())
