"""Relational, text and coordinate queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import relational as R
from .common import SIMILAR, rounded, table


def _names(spark, sf_dir):
    """Part brands as raw curve names with noise in case and blanks."""
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", F.concat(F.when(F.col("p_partkey") % 2 == 0, " "). otherwise(""), F.when(F.col("p_partkey") % 3 == 0, F.upper("p_brand")).otherwise(F.col("p_brand"))).alias("raw"), "p_type", "p_size")


def _aliases(spark, sf_dir):
    """Every brand that doesn't end in 3, under the canonical name of its last digit."""
    b = table(spark, sf_dir, "part").select("p_brand").distinct().filter("not p_brand like '%3'")
    return b.select(F.lower("p_brand").alias("alias"), F.concat(F.lit("c"), F.right("p_brand", F.lit(1))).alias("canonical"))


_N = """n as (select p_partkey, case when p_partkey % 2 = 0 then ' ' else '' end || case when p_partkey % 3 = 0 then upper(p_brand) else p_brand end as raw, p_type, p_size from part),
al as (select distinct lower(p_brand) as alias, 'c' || right(p_brand, 1) as canonical from part where not p_brand like '%3')"""


def resolve(spark, sf_dir):
    return R.resolve(_names(spark, sf_dir), _aliases(spark, sf_dir), "raw").select("p_partkey", "canonical")


def unassigned(spark, sf_dir):
    return R.unassigned(_names(spark, sf_dir), _aliases(spark, sf_dir), "raw")


def coverage(spark, sf_dir):
    return R.coverage(_names(spark, sf_dir).filter("p_size < 20"), _aliases(spark, sf_dir), "raw")


def frequencies(spark, sf_dir):
    return R.frequencies(_names(spark, sf_dir), "raw")


def _hashed(df):
    return df.withColumn("h", X.place_hash(F.col("c_acctbal"), F.col("c_custkey") * 1.5))


def sync_missing(spark, sf_dir):
    c = _hashed(table(spark, sf_dir, "customer"))
    return R.missing(c, c.filter("c_custkey % 3 = 0"), "h").select("c_custkey", "h")


def sync_children(spark, sf_dir):
    c = _hashed(table(spark, sf_dir, "customer")).select(F.col("c_custkey").alias("id"), "h")
    target = c.filter("id % 2 = 0").select((F.col("id") + 1_000_000).alias("id"), "h")
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), "o_orderkey", "o_totalprice")
    there = o.filter("o_orderkey % 5 = 0").select((F.col("id") + 1_000_000).alias("id"), "o_orderkey")
    return R.missing_children(c, o, target, there, "id", "h", ["o_orderkey"])


def eav_pivot(spark, sf_dir):
    long = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"), F.col("l_discount").alias("discount"))
    long = long.unpivot(["l_orderkey", "l_linenumber"], ["quantity", "price", "discount"], "name", "value").filter("not (name = 'discount' and value > 0.05)")
    return R.pivot(long, ["l_orderkey", "l_linenumber"], "name", "value", ["quantity", "price", "discount"])


def eav_titles(spark, sf_dir):
    return R.titles(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderstatus", "o_orderkey", ["F", "O", "P"])


def latest(spark, sf_dir):
    return R.latest(table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_totalprice"), ["o_custkey"], "o_orderdate", "o_orderkey").select("o_custkey", "o_orderkey", rounded("o_totalprice", 2).alias("o_totalprice"))


def first_copies(spark, sf_dir):
    return R.first_copies(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"), ["lang"], "text", "doc_id").select("doc_id", "lang")


def upsert(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    new = c.filter("c_custkey % 10 = 0").select(F.when(F.col("c_custkey") % 20 == 0, F.col("c_custkey")).otherwise(F.col("c_custkey") + 10_000_000).alias("c_custkey"), (F.col("c_acctbal") + 1).alias("c_acctbal"))
    return R.upsert(c, new, ["c_custkey"]).select("c_custkey", rounded("c_acctbal", 2).alias("c_acctbal"))


def stratified(spark, sf_dir):
    return R.stratified(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", "c_custkey", 25)


def diverse(spark, sf_dir):
    return R.diverse(table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_retailprice"), "p_brand", [F.desc("p_retailprice"), F.col("p_partkey")], 40)


def partition_mark(spark, sf_dir):
    c = table(spark, sf_dir, "customer").withColumn("label", F.col("c_custkey") % 4)
    return R.partition_mark(c, ["c_nationkey"], "label", "c_custkey")


def parts_of_total(spark, sf_dir):
    return R.parts_of_total(table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_returnflag")


def side_by_side(spark, sf_dir):
    p = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_tax").alias("raw"), F.when(F.col("l_suppkey") % 4 == 0, F.col("l_discount")).alias("fixed"))
    return R.side_by_side(p, ["l_orderkey"], "l_linenumber", "raw", "fixed", [1, 2, 3])


def intervals_of_names(spark, sf_dir):
    """Least and greatest place of each series, the other way round where reversed, of series with two kinds of event."""
    e = table(spark, sf_dir, "events")
    g = e.groupBy("user_id").agg(F.min("event_id").alias("a"), F.max("event_id").alias("b"), F.count_distinct("event_type").alias("k"), F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("kinds"))
    return g.filter("k >= 2").select("user_id", F.least("a", "b").alias("top"), F.greatest("a", "b").alias("bottom"), "kinds")


def years(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").alias("year")).agg(F.count("*").alias("n")).orderBy(F.desc("year"))


def text_numbers(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit(" "), F.translate(F.format_string("%.2f", F.bround("o_totalprice", 2)), ".", ","), F.when(F.col("o_orderkey") % 5 == 0, " m").otherwise("")).alias("raw"))
    return o.select("o_orderkey", rounded(X.parse_number(F.col("raw")), 2).alias("number"), X.digits_text(F.concat(F.lit("-a"), F.col("raw"), F.lit(" .. "))).alias("digits"))


def text_words(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", X.words(F.concat_ws("-", "p_name", "p_type", F.lit("area Ёл")), X.AREA_WORDS).alias("words"))


def text_keys(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return c.select("c_custkey", F.array_join(X.natural_key(F.concat(F.lit("P"), F.col("c_custkey").cast("string"), F.lit("x7"))), "|").alias("natural"), X.place_hash(F.col("c_acctbal"), F.col("c_nationkey") + 0.5).alias("hash"), X.plural(F.col("c_custkey"), "one", "few", "many").alias("plural"))


def text_ranges(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    spec = F.when(F.col("n_nationkey") % 5 == 4, "1-x").otherwise(F.concat(F.col("n_nationkey").cast("string"), F.lit("-"), (F.col("n_nationkey") + 3).cast("string"), F.lit(",7, 600")))
    return n.select("n_nationkey", F.array_join(X.ranges(spec).cast("array<string>"), ",").alias("places"))


def text_similarity(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", rounded(X.similarity(F.lower("p_name"), F.lower("p_type"))).alias("similarity"))


def _geo(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return c.select("c_custkey", (50 + F.col("c_custkey") % 100 / 10.0).alias("lat"), (45 + F.col("c_custkey") % 163 / 10.0).alias("lon"))


def zones(spark, sf_dir):
    g = _geo(spark, sf_dir)
    return g.select("c_custkey", X.zone_of_longitude(F.col("lon")).alias("zone"), X.zone_of_easting(F.col("lon") * 200_000).alias("easting_zone"))


def datum(spark, sf_dir):
    """Datum shift and projection, in whole centimetres."""
    g = _geo(spark, sf_dir)
    lat, lon = X.datum_42(F.col("lat"), F.col("lon"))
    g = g.select("c_custkey", lat.alias("b"), lon.alias("l"))
    x, y = X.gauss_kruger(F.col("b"), F.col("l"), X.zone_of_longitude(F.col("l")))
    return g.select("c_custkey", rounded("b", 7).alias("lat"), rounded("l", 7).alias("lon"), rounded(x, 2).alias("easting"), rounded(y, 2).alias("northing"))


def _datum_sql() -> str:
    from ..functions.text import A_42, A_WGS, F_42, F_WGS, SCALE, SHIFT, TURN
    import math

    e1, e2 = 2 * F_42 - F_42**2, 2 * F_WGS - F_WGS**2
    a, e, da, de = (A_42 + A_WGS) / 2, (e1 + e2) / 2, A_WGS - A_42, e2 - e1
    (dx, dy, dz), (wx, wy, wz) = SHIFT, [math.radians(t / 3600) for t in TURN]
    d = lambda v: f"{v!r}::double"
    return f"""with g as (select c_custkey, 50 + (c_custkey % 100) / 10.0::double as lat, 45 + (c_custkey % 163) / 10.0::double as lon from customer),
    r as (select *, radians(lat) as b, radians(lon) as k from g), q as (select *, sin(b) as s, cos(b) as c, 1 - {d(e)} * sin(b) * sin(b) as w from r),
    m as (select *, {d(a * (1 - e))} / power(w, 1.5) as m, {d(a)} / sqrt(w) as n from q),
    h as (select c_custkey, lat - degrees((n / {d(a)} * {d(e)} * s * c * {d(da)} + (n * n / {d(a * a)} + 1) * n * s * c * {d(de)} / 2 - ({d(dx)} * cos(k) + {d(dy)} * sin(k)) * s + {d(dz)} * c) / m
      + ({d(wy)} * cos(k) - {d(wx)} * sin(k)) * (1 + {d(e)} * cos(2 * b)) - {d(SCALE * e)} * s * c) as b,
      lon - degrees((-{d(dx)} * sin(k) + {d(dy)} * cos(k)) / (n * c) + tan(b) * {d(1 - e)} * ({d(wx)} * cos(k) + {d(wy)} * sin(k)) - {d(wz)}) as l from m),
    z as (select *, least(60, greatest(1, floor(l / 6) + 1)) as z, radians(b) as f from h),
    p as (select *, radians(l - (z * 6 - 3)) as dl, sin(f) as s, cos(f) as c, power(tan(f), 2) as t, {d(e1 / (1 - e1))} * power(cos(f), 2) as eta, {d(A_42)} / sqrt(1 - {d(e1)} * power(sin(f), 2)) as n from z),
    u as (select *, power(dl * c, 2) as l2, {d(A_42)} * ({d(1 - e1 / 4 - 3 * e1**2 / 64 - 5 * e1**3 / 256)} * f - {d(3 * e1 / 8 + 3 * e1**2 / 32 + 45 * e1**3 / 1024)} * sin(2 * f) + {d(15 * e1**2 / 256 + 45 * e1**3 / 1024)} * sin(4 * f) - {d(35 * e1**3 / 3072)} * sin(6 * f)) as arc from p)
    select c_custkey, round(b, 7) as lat, round(l, 7) as lon, round(z * 1000000 + 500000 + n * dl * c * (1 + l2 / 6 * (1 - t + eta) + l2 * l2 / 120 * (5 - 18 * t + t * t + 14 * eta - 58 * t * eta)), 2) as easting,
    round(arc + n * tan(f) * l2 / 2 * (1 + l2 / 12 * (5 - t + 9 * eta + 4 * eta * eta) + l2 * l2 / 360 * (61 - 58 * t + t * t)), 2) as northing from u"""


_H = "md5(cast(round_even(c_acctbal, 0) as bigint) || ':' || cast(round_even(c_custkey * 1.5::double, 0) as bigint)) as h"

QUERIES = {
    "names_resolve": (resolve, f"with {_N} select p_partkey, canonical from n left join al on lower(trim(raw)) = alias"),
    "names_unassigned": (unassigned, f"with {_N} select lower(trim(raw)) as name, count(*) as uses from n where lower(trim(raw)) not in (select alias from al) group by 1"),
    "names_coverage": (coverage, f"""with {_N}, u as (select distinct lower(trim(raw)) as name from n where p_size < 20)
        select canonical, count(*) as aliases, count(name) as covered, round(100.0::double * count(name) / (select count(*) from u), 2) as coverage from al left join u on alias = name group by 1"""),
    "names_frequencies": (frequencies, f"with {_N} select lower(trim(raw)) as key, min(raw) as name, count(*) as uses from n group by 1"),
    "sync_missing": (sync_missing, f"with c as (select c_custkey, {_H} from customer) select c_custkey, h from c where h not in (select h from c where c_custkey % 3 = 0)"),
    "sync_children": (sync_children, f"""with c as (select c_custkey as id, {_H} from customer), t as (select id + 1000000 as id, h from c where id % 2 = 0)
        select t.id, o_orderkey, o_totalprice from c join t using (h) join orders on o_custkey = c.id where not (o_orderkey % 5 = 0 and t.id = o_custkey + 1000000)"""),
    "eav_pivot": (eav_pivot, "select l_orderkey, l_linenumber, min(l_quantity) as quantity, min(l_extendedprice) as price, min(case when l_discount <= 0.05 then l_discount end) as discount from lineitem group by 1, 2"),
    "eav_titles": (eav_titles, """select o_custkey, nullif(array_to_string(list_sort(list(cast(o_orderkey as varchar)) filter (where o_orderstatus = 'F')), '; '), '') as F, nullif(array_to_string(list_sort(list(cast(o_orderkey as varchar)) filter (where o_orderstatus = 'O')), '; '), '') as O,
        nullif(array_to_string(list_sort(list(cast(o_orderkey as varchar)) filter (where o_orderstatus = 'P')), '; '), '') as P from orders group by 1"""),
    "latest_by_key": (latest, "select o_custkey, o_orderkey, round(o_totalprice, 2) as o_totalprice from orders qualify row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) = 1"),
    "first_copies": (first_copies, "select min(doc_id) as doc_id, lang from documents group by lang, text"),
    "upsert": (upsert, """with n as (select case when c_custkey % 20 = 0 then c_custkey else c_custkey + 10000000 end as c_custkey, c_acctbal + 1 as c_acctbal from customer where c_custkey % 10 = 0)
        select c_custkey, round(c_acctbal, 2) as c_acctbal from n union all select c_custkey, round(c_acctbal, 2) from customer where c_custkey not in (select c_custkey from n)"""),
    "stratified_sample": (stratified, "select c_custkey, c_mktsegment from customer qualify row_number() over (partition by c_mktsegment order by md5(c_custkey || '42'), c_custkey) <= 25"),
    "diverse_top": (diverse, """with r as (select p_partkey, p_brand, p_retailprice, row_number() over (partition by p_brand order by p_retailprice desc, p_partkey) as k from part)
        select p_partkey, p_brand, p_retailprice from r order by least(k, 2), p_retailprice desc, p_partkey limit 40"""),
    "partition_mark": (partition_mark, """with g as (select c_nationkey, c_custkey % 4 as label, string_agg(c_custkey, ',' order by c_custkey) as g, min(c_custkey) as f from customer group by 1, 2)
        select c_nationkey, substr(sha1(string_agg(g, '|' order by f)), 1, 12) as mark from g group by 1"""),
    "parts_of_total": (parts_of_total, "select l_suppkey, l_returnflag, count(*) as n, round(100.0::double * count(*) / sum(count(*)) over (partition by l_suppkey), 4) as share from lineitem group by 1, 2"),
    "side_by_side": (side_by_side, """with p as (select l_orderkey, l_linenumber as m, coalesce(case when l_suppkey % 4 = 0 then l_discount end, l_tax) as v from lineitem),
        w as (select l_orderkey, min(v) filter (where m = 1) as m_1, min(v) filter (where m = 2) as m_2, min(v) filter (where m = 3) as m_3 from p group by 1) select * from w where m_1 is not null and m_2 is not null and m_3 is not null"""),
    "series_intervals": (intervals_of_names, "select user_id, min(event_id) as top, max(event_id) as bottom, array_to_string(list_sort(list(distinct event_type)), ',') as kinds from events group by 1 having count(distinct event_type) >= 2"),
    "years": (years, "select cast(year(o_orderdate) as int) as year, count(*) as n from orders group by 1"),
    "text_numbers": (text_numbers, """with r as (select o_orderkey, ' ' || replace(printf('%.2f', round_even(o_totalprice, 2)), '.', ',') || case when o_orderkey % 5 = 0 then ' m' else '' end as raw from orders)
        select o_orderkey, case when o_orderkey % 5 <> 0 then round(cast(replace(trim(raw), ',', '.') as double), 2) end as number, '-' || replace(regexp_replace(raw, '[^0-9,]', '', 'g'), ',', '.') || '.' as digits from r"""),
    "text_words": (text_words, """select p_partkey, array_to_string(list_filter(regexp_extract_all(replace(lower(p_name || '-' || p_type || '-area Ёл'), 'ё', 'е'), '[a-z0-9а-я]+'), lambda w: w not in ('пл', 'площадь', 'area')), ' ') as words from part"""),
    "text_keys": (text_keys, """select c_custkey, 'p|' || lpad(cast(c_custkey as varchar), 20, '0') || '|x|' || lpad('7', 20, '0') as natural, md5(cast(round_even(c_acctbal, 0) as bigint) || ':' || cast(round_even(c_nationkey + 0.5::double, 0) as bigint)) as hash,
        case when c_custkey % 100 between 11 and 19 then 'many' when c_custkey % 10 = 1 then 'one' when c_custkey % 10 between 2 and 4 then 'few' else 'many' end as plural from customer"""),
    "text_ranges": (text_ranges, """select n_nationkey, case when n_nationkey % 5 <> 4 then array_to_string(list_sort(list_distinct(list_append(list_filter(range(n_nationkey, n_nationkey + 4), lambda x: x >= 1), 7))), ',') end as places from nation"""),
    "text_similarity": (text_similarity, f"with recursive p as (select p_partkey as k, lower(p_name) as a, lower(p_type) as b from part), {SIMILAR} select k as p_partkey, round(s, 6) as similarity from o"),
    "geo_zones": (zones, """with g as (select c_custkey, 45 + (c_custkey % 163) / 10.0::double as lon from customer)
        select c_custkey, cast(least(60, greatest(1, floor(lon / 6) + 1)) as int) as zone, cast(case when floor(lon * 200000 / 1000000) between 1 and 60 then floor(lon * 200000 / 1000000) end as int) as easting_zone from g"""),
    "geo_projection": (datum, _datum_sql()),
}
