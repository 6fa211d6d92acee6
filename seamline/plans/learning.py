"""Formula and feature-table queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import formula
from ..operators import learning as L
from ..operators import spatial as P
from .common import SAMPLES, rounded, table

FEATURES = ["quantity", "price", "discount", "tax"]


def items(spark, sf_dir):
    """Line items as rows of features with a class and a group."""
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    return l.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"), F.col("l_discount").alias("discount"),
        F.col("l_tax").alias("tax"), F.col("l_returnflag").alias("kind"), (F.col("l_returnflag") == "R").cast("int").alias("mark"), F.col("l_suppkey").alias("grp"),
    )


_I = "l as (select l_orderkey * 10 + l_linenumber as id, l_quantity as quantity, l_extendedprice as price, l_discount as discount, l_tax as tax, l_returnflag as kind, cast(l_returnflag = 'R' as int) as mark, l_suppkey as grp from lineitem)"


def formula_values(spark, sf_dir):
    o = items(spark, sf_dir)
    out = formula.evaluate(o, "log(price) + sqrt(quantity) - abs(tax) + norm(discount) * 2", ["grp"])
    return out.select("id", "grp", "price", "tax", rounded("value", 5).alias("value"), "error")


def formula_errors(spark, sf_dir):
    o = items(spark, sf_dir)
    return formula.coverage(o, {"log_discount": "log(discount)", "ratio": "price / (quantity - 1)", "robust": "robust(price - tax)", "scaled": "minmax(quantity) + zscore(price * 1.5)", "flat": "norm(tax - tax)"}, ["grp"])


def finite_report(spark, sf_dir):
    e = items(spark, sf_dir).select(*FEATURES).withColumn("price", F.when(F.col("price") < 1000, float("nan")).otherwise(F.col("price"))).withColumn("tax", F.when(F.col("tax") == 0, float("inf")).otherwise(F.col("tax")))
    return L.finite_report(e, FEATURES)


def impute_median(spark, sf_dir):
    e = items(spark, sf_dir).withColumn("price", F.when(F.col("price") < 2000, float("nan")).otherwise(F.col("price")))
    return L.impute_median(e, ["price", "tax"]).groupBy("grp").agg(rounded(F.sum("price"), 4).alias("price"), rounded(F.sum("tax"), 4).alias("tax"))


def moments(spark, sf_dir):
    return L.moments(items(spark, sf_dir), FEATURES).select("feature", *(F.round(c, 4).alias(c) for c in ("mean",)), rounded(F.col("var_pop") / F.col("var_samp"), 9).alias("ratio"), F.round(F.log10("var_samp"), 6).alias("log_var"))


def correlations(spark, sf_dir):
    return L.correlations(items(spark, sf_dir), FEATURES).select("a", "b", rounded("r", 7).alias("r"))


def kept_features(spark, sf_dir):
    rows = items(spark, sf_dir).withColumns({"price2": F.col("price") * 2 + F.col("tax"), "flat": F.lit(1.0)})
    kept = L.uncorrelated(rows, ["quantity", "price", "flat", "price2", "discount"], most=0.95)
    return spark.createDataFrame([(f, i) for i, f in enumerate(kept)], "feature string, place long")


def standard(spark, sf_dir):
    return _scaled(spark, sf_dir, "standard")


def robust(spark, sf_dir):
    return _scaled(spark, sf_dir, "robust")


def _scaled(spark, sf_dir, mode):
    return L.scaled(items(spark, sf_dir), FEATURES, mode).select("id", "grp", *(rounded(c).alias(c) for c in FEATURES))


def row_norm(spark, sf_dir):
    return L.scaled(items(spark, sf_dir), FEATURES, "l2_norm").select("id", "grp", *(rounded(c).alias(c) for c in FEATURES))


def anova(spark, sf_dir):
    return L.anova(items(spark, sf_dir), FEATURES, "kind").select("feature", rounded("f", 5).alias("f"))


def components(spark, sf_dir):
    """Shares of variance of the principal components of scaled features; tests check them against NumPy."""
    _, shares = L.components(L.scaled(items(spark, sf_dir).select("id", *FEATURES), FEATURES, "standard"), FEATURES, 3)
    return spark.createDataFrame([(i, round(s, 6)) for i, s in enumerate(shares)], "component long, share double")


def separation(spark, sf_dir):
    rows = items(spark, sf_dir).withColumn("label", F.floor(F.col("quantity") / 17).cast("long"))
    return L.separation(rows, ["quantity", "discount", "tax"], "label").select("clusters", rounded("calinski_harabasz", 3).alias("calinski_harabasz"), rounded("davies_bouldin", 6).alias("davies_bouldin"))


def silhouette(spark, sf_dir):
    t = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("a"))
    size = t.agg(F.count("*").alias("n"), F.count_distinct("label").alias("k")).first()
    sample = t.orderBy(F.md5(F.concat(F.col("vec_id").cast("string"), F.lit("42")))).limit(L.sample_size(size.n, size.k))
    return L.silhouette(t, "a", "label", "vec_id", sample).select("vec_id", rounded("s").alias("s"))


def candidate_scores(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") / 50.0).alias("s"), (F.col("p_retailprice") / 500.0).alias("d"), (F.col("p_partkey") * 1.0).alias("c"), (F.col("p_partkey") % 97 / 96.0).alias("noise"), (F.col("p_partkey") % 25).alias("k"))
    return p.select("p_partkey", rounded(L.candidate_score(F.col("s"), F.col("d"), F.col("c"), F.col("noise"), F.col("k"))).alias("score"))


def cluster_profile(spark, sf_dir):
    return L.cluster_profile(items(spark, sf_dir), ["quantity", "discount"], "kind").select("kind", "feature", "n", *(rounded(c, 5).alias(c) for c in ("mean", "median", "std", "p10", "p90", "standing")))


def outlier_factor(spark, sf_dir):
    from .common import sites

    s = sites(spark, sf_dir)
    near = P.nearest(s.selectExpr("sid as id", "sx as x", "sy as y"), s, 6, 60.0, "id", "sid").filter("id <> sid")
    return L.outlier_factor(near, "id", "sid", "distance", 5).select("id", rounded("lof", 5).alias("lof"))


def group_split(spark, sf_dir):
    return L.group_split(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), "o_custkey", "o_orderstatus", 0.2).select("o_orderkey", "part")


def group_folds(spark, sf_dir):
    return L.group_folds(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), "o_custkey", "o_orderstatus", 5).select("o_orderkey", "fold")


def roc(spark, sf_dir):
    rows = items(spark, sf_dir).withColumn("score", F.round(F.col("discount") + F.col("quantity") / 100, 2))
    return L.roc(rows, "score", "mark").select("threshold", rounded("tpr").alias("tpr"), rounded("fpr").alias("fpr"))


def best_threshold(spark, sf_dir):
    rows = items(spark, sf_dir).withColumn("score", F.round(F.col("discount") + F.col("quantity") / 100, 2))
    return L.best_threshold(rows, "score", "mark").select("threshold", rounded("tpr").alias("tpr"), rounded("fpr").alias("fpr"))


def confidence(spark, sf_dir):
    return L.confidence(items(spark, sf_dir), ["grp"], "discount").select("grp", *(rounded(c).alias(c) for c in ("mean", "low", "high")))


def productivity(spark, sf_dir):
    return L.productivity(items(spark, sf_dir), ["quantity", "price", "discount"]).select("id", "grp", "price", rounded("index").alias("index"))


_AVG = ", ".join(f"avg({c}) as m_{c}, stddev_pop({c}) as s_{c}, quantile_cont({c}, 0.25) as a_{c}, quantile_cont({c}, 0.5) as q_{c}, quantile_cont({c}, 0.75) as b_{c}" for c in FEATURES)

QUERIES = {
    "formula_values": (formula_values, f"with {_I}, g as (select grp, avg(discount) as m, stddev_pop(discount) as d from l group by 1) select id, grp, price, tax, round(ln(price) + sqrt(quantity) - abs(tax) + (discount - m) / d * 2, 5) as value, cast(null as varchar) as error from l join g using (grp)"),
    "formula_errors": (formula_errors, f"""with {_I}, g as (select grp, count(*) as n, bool_or(discount <= 0) as a, bool_or(quantity = 1) as b, quantile_cont(price - tax, 0.75) = quantile_cont(price - tax, 0.25) as c from l group by 1)
        select grp, case when a then 'invalid_math_domain' else 'ok' end as status, case when a then 0 else n end as points, 'log_discount' as formula from g union all select grp, case when b then 'invalid_math_domain' else 'ok' end, case when b then 0 else n end, 'ratio' from g
        union all select grp, case when c then 'zero_iqr' else 'ok' end, case when c then 0 else n end, 'robust' from g union all select grp, 'ok', n, 'scaled' from g union all select grp, 'zero_std', 0, 'flat' from g"""),
    "table_finite_report": (finite_report, f"""with {_I} select count(*) as rows, 4::bigint as columns, count(*) filter (where price < 1000) as nan, count(*) filter (where tax = 0) as inf, count(*) filter (where price < 1000 or tax = 0) as bad_rows,
        count(*) - count(distinct (quantity, case when price < 1000 then -1 else price end, discount, tax)) as repeated from l"""),
    "table_impute_median": (impute_median, f"with {_I}, m as (select quantile_cont(price, 0.5) as p from l where price >= 2000) select grp, round(sum(case when price < 2000 then p else price end), 4) as price, round(sum(tax), 4) as tax from l, m group by 1"),
    "table_moments": (moments, f"with {_I}, u as (unpivot (select quantity, price, discount, tax from l) on quantity, price, discount, tax into name feature value x) select feature, round(avg(x), 4) as mean, round(var_pop(x) / var_samp(x), 9) as ratio, round(log10(var_samp(x)), 6) as log_var from u group by 1"),
    "table_correlations": (correlations, f"with {_I} " + " union all ".join(f"select '{a}' as a, '{b}' as b, round(corr({a}, {b}), 7) as r from l" for i, a in enumerate(FEATURES) for b in FEATURES[i + 1 :])),
    "table_kept_features": (kept_features, f"""with {_I}, r as (select abs(corr(quantity, price)) as qp, abs(corr(price, price * 2 + tax)) as pp, abs(corr(quantity, price * 2 + tax)) as q2 from l)
        select feature, row_number() over (order by o) - 1 as place from (select 'quantity' as feature, 1 as o union all select 'price', 2 from r where qp <= 0.95 union all select 'price2', 3 from r where q2 <= 0.95 and not (qp <= 0.95 and pp > 0.95) union all select 'discount', 4)"""),
    "table_standard": (standard, f"with {_I}, g as (select {_AVG} from l) select id, grp, {', '.join(f'round(({c} - m_{c}) / s_{c}, 6) as {c}' for c in FEATURES)} from l, g"),
    "table_robust": (robust, f"with {_I}, g as (select {_AVG} from l) select id, grp, {', '.join(f'round(({c} - q_{c}) / (b_{c} - a_{c}), 6) as {c}' for c in FEATURES)} from l, g"),
    "table_row_norm": (row_norm, f"with {_I} select id, grp, {', '.join(f'round({c} / sqrt(quantity * quantity + price * price + discount * discount + tax * tax), 6) as {c}' for c in FEATURES)} from l"),
    "table_anova": (anova, f"with {_I}, u as (unpivot (select kind, quantity, price, discount, tax from l) on quantity, price, discount, tax into name feature value x), t as (select feature, avg(x) as m, count(*) as n from u group by 1), g as (select feature, kind, avg(x) as gm, count(*) as gn, var_pop(x) as gv from u group by 1, 2) select feature, round((sum(gn * power(gm - m, 2)) / (count(*) - 1)) / (sum(gn * gv) / (any_value(n) - count(*))), 5) as f from g join t using (feature) group by 1"),
    "table_components": (components, None),
    "cluster_separation": (separation, f"""with {_I}, r as (select quantity as x, discount as y, tax as z, floor(quantity / 17) as k from l), c as (select k, count(*) as n, avg(x) as cx, avg(y) as cy, avg(z) as cz from r group by 1),
        d as (select r.k, sqrt(power(x - cx, 2) + power(y - cy, 2) + power(z - cz, 2)) as d from r join c using (k)), s as (select k, avg(d) as s, sum(d * d) as w from d group by 1), t as (select avg(x) as gx, avg(y) as gy, avg(z) as gz from r),
        p as (select a.k, max((sa.s + sb.s) / sqrt(power(a.cx - b.cx, 2) + power(a.cy - b.cy, 2) + power(a.cz - b.cz, 2))) as r from c a join c b on a.k <> b.k join s sa on sa.k = a.k join s sb on sb.k = b.k group by 1)
        select count(*) as clusters, round((sum(n * (power(cx - gx, 2) + power(cy - gy, 2) + power(cz - gz, 2))) / (count(*) - 1)) / (sum(w) / (sum(n) - count(*))), 3) as calinski_harabasz, round((select avg(r) from p), 6) as davies_bouldin from c join s using (k), t"""),
    "cluster_silhouette": (silhouette, f"""with {SAMPLES}, q as (select vec_id, label, a from t qualify row_number() over (order by md5(vec_id || '42')) <= (select least(5000, greatest(400, floor(24 * sqrt(count(*)) * count(distinct label)))) from t)), d as (select u.vec_id, u.label as la, w.label as lb, avg(list_distance(u.a, w.a)) as d from q u join q w on u.vec_id <> w.vec_id group by 1, 2, 3),
        m as (select vec_id, max(d) filter (where la = lb) as x, min(d) filter (where la <> lb) as y from d group by 1) select vec_id, round(case when x is null then 0 else (y - x) / greatest(x, y) end, 6) as s from m"""),
    "candidate_scores": (candidate_scores, """select p_partkey, round(greatest(0, 0.4 * greatest(0, least(1, (p_size / 50.0::double + 1) / 2)) + 0.3 * greatest(0, least(1, 1 / (1 + p_retailprice / 500.0::double))) + 0.3 * greatest(0, least(1, p_partkey * 1.0::double / (p_partkey * 1.0::double + 1000)))
        - case when p_partkey % 97 / 96.0::double > 0.3 then least(0.2, (p_partkey % 97 / 96.0::double - 0.3) * 0.4) else 0 end - case when p_partkey % 25 < 2 then 0.3 when p_partkey % 25 = 2 then 0.05 when p_partkey % 25 > 12 then least(0.2, (p_partkey % 25 - 12) * 0.02) else 0 end), 6) as score from part"""),
    "cluster_profile": (cluster_profile, f"""with {_I}, u as (unpivot (select kind, quantity, discount from l) on quantity, discount into name feature value x), g as (select feature, avg(x) as gm, stddev_pop(x) as gs from u group by 1)
        select kind, feature, count(*) as n, round(avg(x), 5) as mean, round(quantile_cont(x, 0.5), 5) as median, round(stddev_pop(x), 5) as std, round(quantile_cont(x, 0.1), 5) as p10, round(quantile_cont(x, 0.9), 5) as p90, round((avg(x) - any_value(gm)) / any_value(gs), 5) as standing from u join g using (feature) group by 1, 2"""),
    "outlier_factor": (outlier_factor, """with s as (select s_suppkey as id, (s_suppkey * 6151 % 10007) / 10.0::double as x, (s_suppkey * 3571 % 10009) / 10.0::double as y from supplier), n as (select a.id, b.id as o, sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2)) as d from s a join s b on a.id <> b.id qualify row_number() over (partition by a.id order by sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2)), b.id) <= 5),
        k as (select id, max(d) as kd from n group by 1), r as (select n.id, 1 / (avg(greatest(kd, d)) + 1e-10) as lrd from n join k on k.id = n.o group by 1) select n.id, round(avg(b.lrd) / any_value(a.lrd), 5) as lof from n join r b on b.id = n.o join r a on a.id = n.id group by 1"""),
    "group_split": (group_split, """with g as (select o_custkey, max(o_orderstatus) as l from orders group by 1), r as (select o_custkey, row_number() over (partition by l order by md5(o_custkey || '42'), o_custkey) as r, count(*) over (partition by l) as n from g)
        select o_orderkey, case when r <= ceil(n * 0.2::double) then 'test' else 'train' end as part from orders join r using (o_custkey)"""),
    "group_folds": (group_folds, """with g as (select o_custkey, max(o_orderstatus) as l from orders group by 1), r as (select o_custkey, row_number() over (partition by l order by md5(o_custkey || '42'), o_custkey) - 1 as r from g) select o_orderkey, r % 5 as fold from orders join r using (o_custkey)"""),
    "roc_curve": (roc, f"""with {_I}, c as (select round(discount + quantity / 100, 2) as threshold, sum(mark) as p, sum(1 - mark) as n from l group by 1) select threshold, round(sum(p) over k / (select sum(p) from c)::double, 6) as tpr, round(sum(n) over k / (select sum(n) from c)::double, 6) as fpr from c window k as (order by threshold desc rows unbounded preceding)"""),
    "roc_threshold": (best_threshold, f"""with {_I}, c as (select round(discount + quantity / 100, 2) as threshold, sum(mark) as p, sum(1 - mark) as n from l group by 1), r as (select threshold, sum(p) over k / (select sum(p) from c)::double as tpr, sum(n) over k / (select sum(n) from c)::double as fpr from c window k as (order by threshold desc rows unbounded preceding))
        select threshold, round(tpr, 6) as tpr, round(fpr, 6) as fpr from r order by round(tpr - fpr, 9) desc, threshold desc limit 1"""),
    "confidence_band": (confidence, f"with {_I} select grp, round(avg(discount), 6) as mean, round(greatest(0, avg(discount) - 1.959963984540054 * stddev_samp(discount)), 6) as low, round(greatest(0, avg(discount) + 1.959963984540054 * stddev_samp(discount)), 6) as high from l group by 1"),
    "productivity_index": (productivity, f"with {_I}, g as (select min(quantity) as a, max(quantity) as b, min(price) as c, max(price) as d, min(discount) as e, max(discount) as f from l) select id, grp, price, round((quantity - a) / (b - a) * (price - c) / (d - c) * (discount - e) / (f - e), 6) as index from l, g"),
}
