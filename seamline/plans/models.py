"""Queries of clustering, training and prediction.

What is learned here has one right result that SQL can state: groups that lie
apart, classes that one feature tells, a value that is a sum of features.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..checkpoints import shared_folder
from ..operators import ensembles as E
from ..operators import fronts as R
from ..operators import learning as L
from ..operators import models as M
from ..operators import selection as S
from ..operators import tuning as T
from .common import rounded
from .learning import _I, items

_APART = "case kind when 'A' then 0 when 'N' then 1000 else 3000 end"


def _apart(spark, sf_dir):
    return items(spark, sf_dir).withColumns({"x": F.expr(f"quantity + {_APART}"), "y": F.expr(f"100 * discount - {_APART}")})


def _clustered(method):
    def run(spark, sf_dir):
        return M.cluster(_apart(spark, sf_dir), ["x", "y"], method, 3, starts=3).select("id", "label")

    return run


def cluster_report(spark, sf_dir):
    rows = items(spark, sf_dir).withColumn("label", F.when(F.col("quantity") > 45, -1).otherwise(F.floor(F.col("quantity") / 10)).cast("long"))
    return M.cluster_report(rows, ["quantity", "discount"]).select("clusters", "noise_points", rounded("noise_share").alias("noise_share"), rounded("inertia", 3).alias("inertia"))


def out_of_fold(spark, sf_dir):
    rows = items(spark, sf_dir).withColumns({"step": F.floor(F.col("quantity") / 5) + F.when(F.col("kind") == "R", 100).otherwise(0), "fold": F.pmod("grp", F.lit(3))})
    return M.out_of_fold(rows, ["step", "tax"], "mark", "fold", "tree").select("id", "fold", "predicted")


def regression(spark, sf_dir):
    rows = items(spark, sf_dir).withColumn("value", 3 * F.col("quantity") + 20 * F.col("discount") - 10 * F.col("tax") + 1)
    model = M.train(L.group_split(rows, "grp", "mark", 0.3).filter("part = 'train'"), ["quantity", "discount", "tax"], "value", "linear", "value")
    return M.predict(model, rows).select("id", rounded("predicted", 4).alias("predicted"))


def importances(spark, sf_dir):
    """Shares of the features in a linear model; a test checks their order and sum."""
    rows = items(spark, sf_dir).withColumn("value", 3 * F.col("quantity") + 20 * F.col("discount") - 10 * F.col("tax"))
    found = M.importances(M.train(rows, ["quantity", "discount", "tax"], "value", "linear", "value"))
    return spark.createDataFrame([(c, round(s, 6)) for c, s in found], "feature string, share double")


def feature_search(spark, sf_dir):
    """The value is a sum of three features, so these are found, and fit it wholly."""
    rows = items(spark, sf_dir).withColumns({"value": 3 * F.col("quantity") + 200 * F.col("discount") - 100 * F.col("tax"), "fold": F.pmod("grp", F.lit(3))})
    found = S.search_features(rows, ["price", "quantity", "discount", "tax"], "value", "fold", 3, "backward")
    return spark.createDataFrame([(c, round(r, 6)) for c, r in found], "feature string, r2 double")


def feature_fronts(spark, sf_dir):
    """Masks of two features that tell returned items best for their number of features."""
    found = R.feature_fronts(items(spark, sf_dir).withColumn("big", (F.col("price") > 30_000).cast("int")), ["quantity", "discount"], "big", generations=3)
    return spark.createDataFrame([(",".join(s), round(d, 6)) for s, d in found], "features string, distance double")


def shadow_features(spark, sf_dir):
    """The price of an item follows from its quantity, in part, and not from the others."""
    rows = items(spark, sf_dir).withColumn("big", (F.col("price") > 30_000).cast("int"))
    found = R.shadow_test(rows, ["quantity", "discount", "tax"], "big", "id", rounds=9, trees=10, depth=4)
    return spark.createDataFrame(found, "feature string, verdict string, hits long, rounds long")


def tuning_run(spark, sf_dir):
    space = [{"method": "kmeans", "clusters": k, "scaler": "standard", "projection": None} for k in (2, 3, 4)]
    told = T.tune(items(spark, sf_dir), ["quantity", "price", "discount"], "id", space, f"{shared_folder(spark)}/tuning-{uuid.uuid4().hex}", keep=1, patience=3)
    return told.select("stage", "place", "candidate", rounded("score").alias("score"), rounded("smallest").alias("smallest"), "error")


def isolation(spark, sf_dir):
    rows = items(spark, sf_dir)
    found = S.isolation_scores(rows, rows, ["quantity", "price", "discount", "tax"], "id")
    return found.select("id", rounded("anomaly").alias("anomaly"), rounded("inlier").alias("inlier"))


def stacking(spark, sf_dir):
    rows = items(spark, sf_dir).withColumns({"step": F.floor(F.col("quantity") / 5) + F.when(F.col("kind") == "R", 100).otherwise(0), "fold": F.pmod("grp", F.lit(3))})
    return E.stacked_out_of_fold(rows, ["step", "tax"], "mark", "fold", ["tree", "bayes"]).select("id", "fold", "predicted")


def voting(spark, sf_dir):
    """Three stand-ins for learners' shares of whether an item was returned."""
    second = {"a": F.col("quantity") / 50, "b": F.col("discount") * 10, "c": F.when(F.col("kind") != "A", F.col("tax") * 12.5)}
    rows = items(spark, sf_dir).withColumns({c: F.when(p.isNotNull(), F.array(1 - p, p)) for c, p in second.items()})
    soft = E.vote(rows, list(second), ["kept", "returned"]).withColumnsRenamed({"share": "soft", "predicted": "by_mean"})
    return E.vote(soft, list(second), ["kept", "returned"], hard=True).select("id", rounded("soft").alias("soft"), rounded("share").alias("hard"), F.col("predicted").alias("by_votes"))


def share_calibration(spark, sf_dir):
    rows = items(spark, sf_dir).withColumn("p", F.array(1 - F.col("quantity") / 50, F.col("quantity") / 50))
    fitted = E.calibration(rows.withColumn("mark", (F.col("price") > 40_000).cast("int")), "p", "mark", ["0", "1"])
    return E.calibrated(fitted, rows, "p").select("id", rounded(F.col("calibrated")[1]).alias("share"))


_PREDICTED = "case when quantity > 40 then 'N' when quantity > 20 then 'R' else kind end"


def classification_report(spark, sf_dir):
    rows = items(spark, sf_dir).withColumn("predicted", F.expr(_PREDICTED))
    return M.classification_report(rows, "kind", "predicted").select("label", "support", *(rounded(c).alias(c) for c in ("precision", "recall", "f1")))


def regression_report(spark, sf_dir):
    rows = items(spark, sf_dir).withColumn("guess", F.col("quantity") * 1500)
    return M.regression_report(rows, "price", "guess").select("n", rounded("mae", 3).alias("mae"), rounded("rmse", 3).alias("rmse"), rounded("r2").alias("r2"))


_LABELS = f"with {_I}, c as (select kind, row_number() over (order by count(*) desc, avg(quantity + {_APART})) - 1 as label from l group by 1) select id, label from l join c using (kind)"

QUERIES = {
    "cluster_kmeans": (_clustered("kmeans"), _LABELS),
    "cluster_bisecting": (_clustered("bisecting"), _LABELS),
    "cluster_mixture": (_clustered("mixture"), None),
    "cluster_report": (cluster_report, f"""with {_I}, r as (select quantity, discount, case when quantity > 45 then -1 else floor(quantity / 10) end as label from l), g as (select label, count(*) as n, var_pop(quantity) * count(*) + var_pop(discount) * count(*) as w from r group by 1)
        select count(*) filter (where label <> -1) as clusters, cast(sum(n) filter (where label = -1) as bigint) as noise_points, round(sum(n) filter (where label = -1) / sum(n)::double, 6) as noise_share, round(sum(w) filter (where label <> -1), 3) as inertia from g"""),
    "model_out_of_fold": (out_of_fold, f"with {_I} select id, grp % 3 as fold, cast(mark as varchar) as predicted from l"),
    "model_stacking": (stacking, f"with {_I} select id, grp % 3 as fold, cast(mark as varchar) as predicted from l"),
    "model_voting": (voting, f"""with {_I}, s as (select id, [quantity / 50, discount * 10, case when kind <> 'A' then tax * 12.5::double end] as s from l), p as (select id, list_filter(s, lambda x: x is not null) as p from s),
        v as (select id, list_sum(p) / len(p) as y, list_sum(list_transform(p, lambda x: 1 - x)) / len(p) as n, len(list_filter(p, lambda x: x > 1 - x)) / len(p)::double as h from p)
        select id, round(greatest(y, n), 6) as soft, round(greatest(h, 1 - h), 6) as hard, case when h > 1 - h then 'returned' else 'kept' end as by_votes from v"""),
    "share_calibration": (share_calibration, f"""with {_I}, g as (select quantity as x, count(*) as n, count(*) filter (where price > 40000) as y from l group by 1), c as (select x, n, y, sum(n) over (order by x) as cn, sum(y) over (order by x) as cy from g),
        m as (select a.x as lo, b.x as hi, (b.cy - a.cy + a.y) / (b.cn - a.cn + a.n)::double as mean from c a join c b on a.x <= b.x), f as (select g.x, lo, min(mean) as least from g join m on lo <= g.x and hi >= g.x group by 1, 2), i as (select x, max(least) as share from f group by 1)
        select id, round(share, 6) as share from l join i on x = quantity"""),
    "model_regression": (regression, f"with {_I} select id, round(3 * quantity + 20 * discount - 10 * tax + 1, 4) as predicted from l"),
    "model_importances": (importances, None),
    "feature_search": (feature_search, "select unnest(['quantity', 'discount', 'tax']) as feature, 1.0::double as r2"),
    "feature_fronts": (feature_fronts, f"""with {_I}, b as (select *, price > 30000 as big from l), m as (select (avg(quantity) filter (where big) - avg(quantity) filter (where not big)) / stddev_pop(quantity) as q, (avg(discount) filter (where big) - avg(discount) filter (where not big)) / stddev_pop(discount) as d from b)
        select case when abs(q) >= abs(d) then 'quantity' else 'discount' end as features, round(greatest(abs(q), abs(d)), 6) as distance from m union all select 'quantity,discount', round(sqrt(q * q + d * d), 6) from m"""),
    "shadow_features": (shadow_features, None),
    "tuning_run": (tuning_run, None),
    "isolation_scores": (isolation, None),
    "classification_report": (classification_report, f"""with {_I}, p as (select kind, {_PREDICTED} as predicted from l), s as (select kind as label, count(*) as support, count(*) filter (where predicted = kind) as hits from p group by 1), g as (select predicted as label, count(*) as got from p group by 1)
        select label, support, round(hits / got::double, 6) as precision, round(hits / support::double, 6) as recall, round(2 * hits / (support + got)::double, 6) as f1 from s join g using (label)"""),
    "regression_report": (regression_report, f"with {_I} select count(*) as n, round(avg(abs(price - quantity * 1500)), 3) as mae, round(sqrt(avg(power(price - quantity * 1500, 2))), 3) as rmse, round(1 - avg(power(price - quantity * 1500, 2)) / var_pop(price), 6) as r2 from l"),
}
