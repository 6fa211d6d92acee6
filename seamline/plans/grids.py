"""Queries of filters over profiles, labelled grids, variograms and kriging."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import grids as G
from ..operators import spatial as P
from .common import POINTS, SAMPLES, points, rounded, sites, traces


def _profiles(spark, sf_dir):
    return traces(spark, sf_dir).withColumns({"profile": F.col("vec_id") % 3, "place": F.floor(F.col("vec_id") / 3)})


def _samples(df):
    return df.select("vec_id", F.posexplode("filtered").alias("i", "x")).select("vec_id", F.col("i").cast("long").alias("i"), rounded("x").alias("x"))


def profile_median(spark, sf_dir):
    return _samples(G.median_2d(_profiles(spark, sf_dir), ["profile"], "place", "a", 3, 5, block=64))


def profile_wiener(spark, sf_dir):
    return _samples(G.wiener_2d(_profiles(spark, sf_dir), ["profile"], "place", "a", 3, 5, block=64))


def _cells(spark, sf_dir):
    """A full grid of 21 by 21 cells with the number of points modulo 4, where there are points."""
    p = points(spark, sf_dir)
    filled = p.groupBy(F.floor(F.col("x") / 50).alias("gx"), F.floor(F.col("y") / 50).alias("gy")).agg((F.count("*") % 4).alias("label"))
    whole = spark.range(21).select(F.col("id").alias("gx"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(20).cast("long"))).alias("gy"))
    return whole.join(filled, ["gx", "gy"], "left")


def grid_smoothing(spark, sf_dir):
    return G.smooth_grid(_cells(spark, sf_dir), "medium")


def variogram(spark, sf_dir):
    found = G.semivariances(points(spark, sf_dir).withColumnRenamed("v", "value"), 50.0, 10)
    return found.select("lag", rounded("distance").alias("distance"), rounded("semivariance", 3).alias("semivariance"), "pairs")


def kriging(spark, sf_dir):
    """Sites' values at all points, by their eight nearest sites."""
    s = sites(spark, sf_dir)
    sill, reach = G.fitted_variogram(G.semivariances(s, 300.0, 10, "sid", "sx", "sy", "sv"))
    near = P.nearest(points(spark, sf_dir), s, 8, 60.0, "id", "sid").join(s, "sid")
    return G.kriged(near, "id", "sv", sill, reach).select("id", rounded("value", 3).alias("value"), rounded("variance", 1).alias("variance"), "neighbours")


_W = f"""with {SAMPLES}, r as (select *, vec_id % 3 as profile, vec_id // 3 as place from p), m as (select vec_id, profile, place, x, i, o.di, o.dp from r, (select d1.d as dp, d2.d as di from (select unnest(range(-1, 2)) as d) d1, (select unnest(range(-2, 3)) as d) d2) o),
w as (select m.vec_id, m.profile, m.i, m.x, coalesce(q.x, 0) as z from m left join r q on q.profile = m.profile and q.place = m.place + m.dp and q.i = m.i + m.di)"""


def _pass(name: str, last: str) -> str:
    return f"""{name} as (select e.gx, e.gy, case when e.label is not null then b.label end as label from {last} e left join (select gx, gy, label from (select greatest(0, least(20, c.gx + o.i)) as gx, greatest(0, least(20, c.gy + o.j)) as gy, label, count(*) as n
        from {last} c, (values (0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)) o(i, j) where label is not null group by 1, 2, 3) qualify row_number() over (partition by gx, gy order by n desc, label) = 1) b using (gx, gy))"""


QUERIES = {
    "profile_median": (profile_median, f"{_W} select vec_id, i, round(median(z), 6) as x from w group by 1, 2"),
    "profile_wiener": (profile_wiener, f"""{_W}, l as (select vec_id, profile, i, any_value(x) as x, avg(z) as m, avg(z * z) - avg(z) * avg(z) as v from w group by 1, 2, 3), n as (select *, avg(v) over (partition by profile) as noise from l)
        select vec_id, i, round(m + case when v < noise then 0 else (1 - noise / v) * (x - m) end, 6) as x from n"""),
    "grid_smoothing": (grid_smoothing, f"""with {POINTS}, f as (select cast(floor(x / 50) as bigint) as gx, cast(floor(y / 50) as bigint) as gy, count(*) % 4 as label from pt group by 1, 2), g as (select a.d as gx, b.d as gy from (select unnest(range(21)) as d) a, (select unnest(range(21)) as d) b),
        c0 as (select g.gx, g.gy, label from g left join f using (gx, gy)), {_pass("c1", "c0")}, {_pass("c2", "c1")} select gx, gy, label from c2"""),
    "space_variogram": (variogram, f"""with {POINTS}, q as (select sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2)) as d, a.v - b.v as g from pt a join pt b on a.id < b.id and abs(a.x - b.x) <= 50 and abs(a.y - b.y) <= 50)
        select least(floor(d / 5.0), 9)::bigint as lag, round(avg(d), 6) as distance, round(avg(g * g) / 2, 3) as semivariance, count(*) as pairs from q where d <= 50 group by 1"""),
    "space_kriging": (kriging, None),
}
