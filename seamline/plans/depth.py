"""Depth, temperature and component queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import depth as D
from .common import SERIES, rounded, series, table


def interval_velocity(spark, sf_dir):
    p = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.sum("l_quantity").alias("q"))
    p = p.select("l_orderkey", "l_linenumber", (F.col("l_linenumber") * 10 + F.col("q") / 10).alias("depth"), (F.col("l_linenumber") * 40).alias("sample"))
    return D.interval_velocity(p, ["l_orderkey"], "l_linenumber", "depth", "sample").select("l_orderkey", "l_linenumber", rounded("velocity").alias("velocity"))


def between_picks(spark, sf_dir):
    s = series(spark, sf_dir)
    picks = s.filter("i % 9 = 4").select("user_id", "i", F.when(F.col("event_id") % 5 == 0, 0.0).otherwise(F.col("v")).alias("v"))
    return D.between_picks(picks, s.select("user_id", "i"), ["user_id"], "i", "v").select("user_id", "i", rounded("filled").alias("filled"))


def depth_of_time(spark, sf_dir):
    layers = F.array(*(F.struct(F.lit(a).alias("top"), F.lit(b).alias("bottom"), F.lit(v).alias("velocity")) for a, b, v in ((0.0, 20.0, 1.5), (20.0, 35.0, 2.0), (35.0, 60.0, 0.5))))
    return table(spark, sf_dir, "part").select("p_partkey", rounded(D.to_depth(F.col("p_size") * 1.5, layers)).alias("depth"))


def rank_correlation(spark, sf_dir):
    s = series(spark, sf_dir).select("user_id", "i", F.round("v", 0).alias("v"))
    first = s.agg(F.min("user_id")).first()[0]
    return D.rank_correlation(s, "user_id", "i", "v", first).select("user_id", rounded("spearman").alias("spearman"), "depths")


def unit_rows(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", F.col("l_quantity").alias("a"), F.col("l_tax").alias("b"))
    return D.unit_rows(rows, ["a", "b"]).select("l_orderkey", "l_linenumber", "l_suppkey", rounded("a").alias("a"), rounded("b").alias("b"))


def power_transform(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_acctbal") / 1000).alias("x"))
    return rows.select("c_custkey", *(rounded(D.yeo_johnson(F.col("x"), lam)).alias(f"p{i}") for i, lam in enumerate((0.0, 0.5, 2.0))))


QUERIES = {
    "depth_interval_velocity": (interval_velocity, """with p as (select l_orderkey, l_linenumber, l_linenumber * 10 + sum(l_quantity) / 10 as d, l_linenumber * 40 as s from lineitem group by 1, 2)
        select l_orderkey, l_linenumber, round((d - coalesce(lag(d) over k, 0)) * 100 / ((s - coalesce(lag(s) over k, 0)) * 8.0::double), 6) as velocity from p window k as (partition by l_orderkey order by l_linenumber)"""),
    "depth_between_picks": (between_picks, f"""with {SERIES}, k as (select user_id, i, case when event_id % 5 = 0 then 0 else v end as r from s where i % 9 = 4), f as (select user_id, arg_min(r, i) as f from k where r <> 0 group by 1), q as (select user_id, i, case when r = 0 then f else r end as v from k left join f using (user_id)),
        b as (select s.user_id, s.i, max(q.i) filter (where q.i <= s.i and q.v is not null) as a, min(q.i) filter (where q.i >= s.i and q.v is not null) as b from s left join q using (user_id) group by 1, 2)
        select b.user_id, b.i, round(case when b.a is null then w.v when b.b is null or b.a = b.b then u.v else u.v + (w.v - u.v) * (b.i - b.a) / (b.b - b.a) end, 6) as filled from b left join q u on u.user_id = b.user_id and u.i = b.a left join q w on w.user_id = b.user_id and w.i = b.b"""),
    "depth_of_time": (depth_of_time, """with t as (select p_partkey, p_size * 1.5::double as t from part) select p_partkey, round(greatest(0, least(t, 20)) * 1.5 + greatest(0, least(t, 35) - 20) * 2 + greatest(0, least(t, 60) - 35) * 0.5 + greatest(0, t - 60) * 0.5, 6) as depth from t"""),
    "temperature_rank_correlation": (rank_correlation, f"""with {SERIES}, r as (select user_id, i, round(v, 0) as v from s), m as (select i, v as m from r where user_id = (select min(user_id) from r)), b as (select * from r join m using (i)),
        k as (select user_id, rank() over (partition by user_id order by v) + (count(*) over (partition by user_id, v) - 1) / 2.0::double as a, rank() over (partition by user_id order by m) + (count(*) over (partition by user_id, m) - 1) / 2.0::double as c from b) select user_id, round(corr(a, c), 6) as spearman, count(*) as depths from k group by 1"""),
    "components_unit_rows": (unit_rows, "select l_orderkey, l_linenumber, l_suppkey, round(l_quantity / (abs(l_quantity) + abs(l_tax)), 6) as a, round(l_tax / (abs(l_quantity) + abs(l_tax)), 6) as b from lineitem"),
    "components_power_transform": (power_transform, """with x as (select c_custkey, c_acctbal / 1000 as x from customer) select c_custkey, round(case when x >= 0 then ln(1 + x) else -(power(1 - x, 2) - 1) / 2 end, 6) as p0, round(case when x >= 0 then (sqrt(x + 1) - 1) / 0.5 else -(power(1 - x, 1.5) - 1) / 1.5 end, 6) as p1, round(case when x >= 0 then (power(x + 1, 2) - 1) / 2 else -ln(1 - x) end, 6) as p2 from x"""),
}
