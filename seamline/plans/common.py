"""Stand-in relations that several queries share, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(c: Column | str, digits: int = 6) -> Column:
    return F.round(c, digits)


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as one series for each user: user_id, i (from 0), n, v, event_type, event_id."""
    from ..operators.series import numbered

    events = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", F.col("value").alias("v"))
    return numbered(events, ["user_id"], ["ts", "event_id"])


SERIES = """s as (select user_id, event_id, event_type, ts, value as v, row_number() over (partition by user_id order by ts, event_id) - 1 as i, count(*) over (partition by user_id) as n from events)"""


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as traces of doubles: vec_id, label, a."""
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("a"))


#: The same, a row for each sample: vec_id, label, i (from 0), x.
SAMPLES = """t as (select vec_id, label, cast(embedding as double[]) as a from embeddings), p as (select vec_id, label, unnest(range(0, len(a))) as i, unnest(a) as x, len(a) as n from t)"""


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as points: id, name, x, y, v, kind."""
    c = table(spark, sf_dir, "customer")
    return c.select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), (F.pmod(F.col("c_custkey") * 7919, F.lit(10007)) / 10.0).alias("x"),
        (F.pmod(F.col("c_custkey") * 104729, F.lit(10009)) / 10.0).alias("y"), F.col("c_acctbal").alias("v"), F.col("c_mktsegment").alias("kind"),
    )


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as points: sid, sx, sy, sv."""
    s = table(spark, sf_dir, "supplier")
    return s.select(
        F.col("s_suppkey").alias("sid"), (F.pmod(F.col("s_suppkey") * 6151, F.lit(10007)) / 10.0).alias("sx"),
        (F.pmod(F.col("s_suppkey") * 3571, F.lit(10009)) / 10.0).alias("sy"), F.col("s_acctbal").alias("sv"),
    )


POINTS = """pt as (select c_custkey as id, c_name as name, (c_custkey * 7919 % 10007) / 10.0::double as x, (c_custkey * 104729 % 10009) / 10.0::double as y, c_acctbal as v, c_mktsegment as kind from customer),
st as (select s_suppkey as sid, (s_suppkey * 6151 % 10007) / 10.0::double as sx, (s_suppkey * 3571 % 10009) / 10.0::double as sy, s_acctbal as sv from supplier)"""


#: The Ratcliff-Obershelp ratio s of the texts a and b of each row k of a relation p, as o (after ``with recursive``).
SIMILAR = """q as (select k, i, j from p, unnest(range(length(a))) as t(i), unnest(range(length(b))) as u(j) where a[i + 1] = b[j + 1]),
g as (select *, i - row_number() over (partition by k, i - j order by i) as g from q),
r as (select k, i, j, max(i) over (partition by k, i - j, g) - i + 1 as r from g),
v as (select k, 0 as al, length(a) as ah, 0 as bl, length(b) as bh, 0 as size from p
  union all select k, unnest([al, i + n]), unnest([i, ah]), unnest([bl, j + n]), unnest([j, bh]), unnest([n, 0]) from (
    select k, al, ah, bl, bh, best // 1000000 as n, 999 - best // 1000 % 1000 as i, 999 - best % 1000 as j from (
      select v.k, al, ah, bl, bh, max(least(r, ah - i, bh - j) * 1000000 + (999 - i) * 1000 + 999 - j) as best from v join r on r.k = v.k and i >= al and i < ah and j >= bl and j < bh group by all))),
o as (select k, case when any_value(a) = '' or any_value(b) = '' then 0.0::double else 2.0::double * sum(size) / any_value(length(a) + length(b)) end as s from v join p using (k) group by 1)"""
