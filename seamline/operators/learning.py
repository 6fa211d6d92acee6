"""Cleaning, scaling, evaluation, selection and splitting of feature tables."""

from __future__ import annotations

import math

from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..checkpoints import checkpointed


def _bad(c: str) -> Column:
    return F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf"))


def finite_report(df: DataFrame, features: list[str]) -> DataFrame:
    """Rows, columns, NaN or null, infinite, rows with either, repeated rows: one pass and one distinct."""
    nan, inf = sum((F.when(F.col(c).isNull() | F.isnan(c), 1).otherwise(0) for c in features), F.lit(0)), sum((F.when(F.abs(c) == float("inf"), 1).otherwise(0) for c in features), F.lit(0))
    marked = df.select(nan.alias("nan"), inf.alias("inf"), F.xxhash64(*features).alias("h"))
    return marked.agg(
        F.count("*").alias("rows"), F.lit(len(features)).cast("long").alias("columns"), F.sum("nan").cast("long").alias("nan"), F.sum("inf").cast("long").alias("inf"),
        F.count_if(F.col("nan") + F.col("inf") > 0).alias("bad_rows"), (F.count("*") - F.count_distinct("h")).alias("repeated"),
    )


def impute_median(df: DataFrame, features: list[str]) -> DataFrame:
    """What isn't finite takes the exact median of its column."""
    median = exact_quantiles(df, features, [0.5])
    return df.select(*(c for c in df.columns if c not in features), *(F.when(_bad(c), F.lit(median[c][0])).otherwise(F.col(c)).alias(c) for c in features))


def moments(df: DataFrame, features: list[str]) -> DataFrame:
    """Mean, population and sample variance of each feature, in long form."""
    stats = df.agg(*(f(c).alias(f"{n}_{c}") for c in features for n, f in (("mean", F.avg), ("pop", F.var_pop), ("samp", F.var_samp))))
    rows = F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(f"mean_{c}").alias("mean"), F.col(f"pop_{c}").alias("var_pop"), F.col(f"samp_{c}").alias("var_samp")) for c in features)))
    return stats.select(rows.alias("r")).select("r.*")


def correlations(df: DataFrame, features: list[str]) -> DataFrame:
    """Pearson correlation of each pair (a before b), all in one aggregation."""
    pairs = [(a, b) for i, a in enumerate(features) for b in features[i + 1 :]]
    wide = df.agg(*(F.corr(a, b).alias(f"c{k}") for k, (a, b) in enumerate(pairs)))
    return wide.select(F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{k}").alias("r")) for k, (a, b) in enumerate(pairs)))).alias("r")).select("r.*")


def uncorrelated(df: DataFrame, features: list[str], most: float = 0.98, least_variance: float = 1e-6) -> list[str]:
    """Features in order, without nearly constant ones and those correlated with one kept before. Only the matrix of features is collected."""
    var = {r.feature: r.var_pop or 0.0 for r in moments(df, features).collect()}
    left = [f for f in features if var[f] > least_variance]
    r = {(x.a, x.b): x.r for x in correlations(df, left).collect()} if len(left) > 1 else {}
    kept: list[str] = []
    for f in left:
        if all(abs(r.get((k, f)) or 0.0) <= most for k in kept):
            kept.append(f)
    return kept


def scaled(df: DataFrame, features: list[str], mode: str) -> DataFrame:
    """none, standard (population), robust (median and interpolated quartiles), l2_norm or row_center; constant columns are only centred."""
    if mode in ("l2_norm", "row_center"):
        norm = F.sqrt(sum((F.col(c) * F.col(c) for c in features), F.lit(0.0)))
        mean = sum((F.col(c) for c in features), F.lit(0.0)) / len(features)
        return df.withColumns({c: F.coalesce(F.try_divide(F.col(c), norm), F.lit(0.0)) if mode == "l2_norm" else F.col(c) - mean for c in features})
    if mode == "none":
        return df
    if mode == "standard":
        stats = df.agg(*(F.avg(c).alias(f"_c_{c}") for c in features), *(F.stddev_pop(c).alias(f"_s_{c}") for c in features))
    else:
        q = exact_quantiles(df, features, [0.25, 0.5, 0.75])
        width = {c: (q[c][2] or 0.0) - (q[c][0] or 0.0) for c in features}
        return df.withColumns({c: (F.col(c) - F.lit(q[c][1])) / F.lit(width[c] if width[c] > 0 else 1.0) for c in features})
    out = {c: (F.col(c) - F.col(f"_c_{c}")) / F.when(F.col(f"_s_{c}") > 0, F.col(f"_s_{c}")).otherwise(1.0) for c in features}
    return df.join(F.broadcast(stats)).withColumns(out).select(*df.columns)


def anova(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """F of a one-way analysis of variance of each feature over the labels, from group sums."""
    groups = df.groupBy(label).agg(F.count("*").alias("n"), *(F.avg(c).alias(f"m_{c}") for c in features), *(F.var_pop(c).alias(f"v_{c}") for c in features))
    total = groups.agg(F.sum("n").alias("all_n"), F.count("*").alias("k"), *((F.sum(F.col("n") * F.col(f"m_{c}")) / F.sum("n")).alias(f"g_{c}") for c in features))
    both = groups.join(F.broadcast(total))
    sums = both.agg(F.max("all_n").alias("all_n"), F.max("k").alias("k"), *(F.sum(F.col("n") * F.pow(F.col(f"m_{c}") - F.col(f"g_{c}"), F.lit(2))).alias(f"b_{c}") for c in features), *(F.sum(F.col("n") * F.col(f"v_{c}")).alias(f"w_{c}") for c in features))
    f = lambda c: (F.col(f"b_{c}") / (F.col("k") - 1)) / F.nullif(F.col(f"w_{c}") / (F.col("all_n") - F.col("k")), F.lit(0.0))
    return sums.select(F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), f(c).alias("f")) for c in features))).alias("r")).select("r.*")


def components(df: DataFrame, features: list[str], n: int) -> tuple[DataFrame, list[float]]:
    """Principal components pc0, pc1, ... of centred features, and the shares of variance."""
    centred = df.join(F.broadcast(df.agg(*(F.avg(c).alias(f"_c_{c}") for c in features)))).withColumns({f"_z_{c}": F.col(c) - F.col(f"_c_{c}") for c in features})
    vectors = VectorAssembler(inputCols=[f"_z_{c}" for c in features], outputCol="_v").transform(centred)
    model = PCA(k=n, inputCol="_v", outputCol="_p").fit(vectors)
    out = model.transform(vectors).withColumn("_a", vector_to_array("_p"))
    return out.select(*df.columns, *(F.col("_a")[i].alias(f"pc{i}") for i in range(n))), model.explainedVariance.toArray().tolist()


def separation(df: DataFrame, features: list[str], label: str, noise: int = -1) -> DataFrame:
    """Davies-Bouldin and Calinski-Harabasz of a labelling, noise left out; the pairs compared are of clusters, not rows."""
    rows = df.filter(F.col(label) != noise)
    centres = rows.groupBy(label).agg(F.count("*").alias("n"), F.array(*(F.avg(c) for c in features)).alias("c"))
    distance = lambda a, b: F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    own = rows.join(centres, label).withColumn("d", distance(F.array(*(F.col(f).cast("double") for f in features)), F.col("c")))
    spread = own.groupBy(label).agg(F.first("n").alias("n"), F.first("c").alias("c"), F.avg("d").alias("s"), F.sum(F.col("d") * F.col("d")).alias("w"))
    left, right = spread.select(F.col(label).alias("i"), F.col("c").alias("ci"), F.col("s").alias("si")), spread.select(F.col(label).alias("j"), F.col("c").alias("cj"), F.col("s").alias("sj"))
    db = left.join(right, F.col("i") != F.col("j")).withColumn("r", F.try_divide(F.col("si") + F.col("sj"), distance(F.col("ci"), F.col("cj")))).groupBy("i").agg(F.max("r").alias("r")).agg(F.avg("r").alias("davies_bouldin"))
    grand = rows.agg(F.array(*(F.avg(c) for c in features)).alias("g"))
    ch = spread.join(F.broadcast(grand)).agg(F.sum(F.col("n") * F.pow(distance(F.col("c"), F.col("g")), F.lit(2))).alias("b"), F.sum("w").alias("w"), F.sum("n").alias("N"), F.count("*").alias("k"))
    score = (F.col("b") / (F.col("k") - 1)) / F.nullif(F.col("w") / (F.col("N") - F.col("k")), F.lit(0.0))
    return ch.select(F.col("k").alias("clusters"), score.alias("calinski_harabasz")).join(F.broadcast(db))


def silhouette(df: DataFrame, vector: str, label: str, id: str, sample: DataFrame) -> DataFrame:
    """Mean silhouette of a stated sample of rows (its rows against all of itself): (id, s)."""
    a = sample.select(F.col(id).alias("a"), F.col(vector).alias("va"), F.col(label).alias("la"))
    b = sample.select(F.col(id).alias("b"), F.col(vector).alias("vb"), F.col(label).alias("lb"))
    gap = F.sqrt(F.aggregate(F.zip_with("va", "vb", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    means = a.join(F.broadcast(b), F.col("a") != F.col("b")).groupBy("a", "la", "lb").agg(F.avg(gap).alias("d"))
    own = F.max(F.when(F.col("la") == F.col("lb"), F.col("d")))
    other = F.min(F.when(F.col("la") != F.col("lb"), F.col("d")))
    return means.groupBy("a").agg(own.alias("x"), other.alias("y")).select(F.col("a").alias(id), F.when(F.col("x").isNull(), 0.0).otherwise((F.col("y") - F.col("x")) / F.greatest("x", "y")).alias("s"))


def clip01(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def candidate_score(silhouette: Column, davies_bouldin: Column, calinski_harabasz: Column, noise: Column | None = None, clusters: Column | None = None) -> Column:
    """0.4 of the silhouette, 0.3 each of the other two, all brought to 0 to 1, less what a large share of noise and too few or too many clusters cost; null where a measure is missing."""
    score = 0.4 * clip01((silhouette + 1) / 2) + 0.3 * clip01(1 / (1 + F.greatest(davies_bouldin, F.lit(0.0)))) + 0.3 * clip01(calinski_harabasz / (calinski_harabasz + 1000))
    share, k = clip01(F.lit(0.0) if noise is None else F.coalesce(noise, F.lit(0.0))), F.lit(3) if clusters is None else clusters
    cost = F.when(share > 0.3, F.least(F.lit(0.2), (share - 0.3) * 0.4)).otherwise(0.0)
    cost += F.when(k < 2, 0.3).when(k == 2, 0.05).when(k > 12, F.least(F.lit(0.2), (k - 12) * 0.02)).otherwise(0.0)
    return F.greatest(F.lit(0.0), score - cost)


def cluster_profile(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """For each label and feature: finite values, mean, median, deviation, deciles, and the mean in units of the whole table."""
    long = df.select(label, *(F.when(~_bad(c), F.col(c)).alias(c) for c in features)).unpivot([label], features, "feature", "x").filter("x is not null")
    whole = long.groupBy("feature").agg(F.avg("x").alias("gm"), F.stddev_pop("x").alias("gs"))
    own = long.groupBy(label, "feature").agg(F.count("*").alias("n"), F.avg("x").alias("mean"), F.percentile("x", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9))).alias("q"), F.stddev_pop("x").alias("std"))
    return own.join(whole, "feature").select(label, "feature", "n", "mean", F.col("q")[1].alias("median"), "std", F.col("q")[0].alias("p10"), F.col("q")[2].alias("p90"), F.when(F.col("gs") > 1e-12, (F.col("mean") - F.col("gm")) / F.col("gs")).alias("standing"))


def outlier_factor(near: DataFrame, id: str, other: str, distance: str, k: int) -> DataFrame:
    """Local outlier factor (id, lof) from each point's k nearest others (distance ascending)."""
    reach = near.groupBy(id).agg(F.max(distance).alias("kd"))
    lrd = near.join(reach.withColumnsRenamed({id: other, "kd": "okd"}), other).groupBy(id).agg((1 / (F.avg(F.greatest("okd", distance)) + 1e-10)).alias("lrd"))
    return near.join(lrd.withColumnsRenamed({id: other, "lrd": "olrd"}), other).groupBy(id).agg(F.avg("olrd").alias("m")).join(lrd, id).select(id, (F.col("m") / F.col("lrd")).alias("lof"))


def group_split(df: DataFrame, group: str, label: str, share: float, seed: str = "42") -> DataFrame:
    """Add ``part`` (test or train): whole groups go to test, the same share of each label's groups, by a seeded hash."""
    groups = df.groupBy(group).agg(F.max(label).alias("_l"))
    place = F.row_number().over(W.partitionBy("_l").orderBy(F.md5(F.concat(F.col(group).cast("string"), F.lit(seed))), group))
    parts = groups.withColumns({"_r": place, "_n": F.count("*").over(W.partitionBy("_l"))}).select(group, F.when(F.col("_r") <= F.ceil(F.col("_n") * share), "test").otherwise("train").alias("part"))
    return df.join(parts, group)


def group_folds(df: DataFrame, group: str, label: str, k: int, seed: str = "42") -> DataFrame:
    """Add ``fold`` (0 to k - 1): whole groups, dealt evenly within each label."""
    groups = df.groupBy(group).agg(F.max(label).alias("_l"))
    place = F.row_number().over(W.partitionBy("_l").orderBy(F.md5(F.concat(F.col(group).cast("string"), F.lit(seed))), group)) - 1
    return df.join(groups.select(group, F.pmod(place, F.lit(k)).cast("long").alias("fold")), group)


def in_ranges(df: DataFrame, order: Column, sums: list[str]) -> tuple[DataFrame, W]:
    """``df`` cut into ranges of ``order``, with the sums of all earlier ranges as _before_, and the window of what comes up to a row within its range.

    A running sum over all rows then needs no task that sees them all: only one
    row for each range passes through one.
    """
    cut = checkpointed(df.repartitionByRange(order).withColumn("_range", F.spark_partition_id()))
    before = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    earlier = cut.groupBy("_range").agg(*(F.sum(c).alias(c) for c in sums)).select("_range", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_before_{c}") for c in sums))
    within = W.partitionBy("_range").orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return cut.join(F.broadcast(earlier), "_range"), within


def exact_quantiles(df: DataFrame, columns: list[str], shares: list[float]) -> dict[str, list[float | None]]:
    """Interpolated quantiles of each column over all its finite values.

    Counts of each value are summed in the map tasks, and ranks come from sums
    over ranges of values, so no task holds a whole column.
    """
    values = df.select(*(F.when(~_bad(c), F.col(c).cast("double")).alias(c) for c in columns)).unpivot([], columns, "_c", "_x").filter("_x is not null")
    counts, upto = in_ranges(values.groupBy("_c", "_x").agg(F.count("*").alias("_n")), F.struct("_c", "_x"), ["_n"])
    ends = counts.withColumn("_end", F.sum("_n").over(upto) + F.col("_before__n"))
    total = {r._c: (r.low, r.n) for r in ends.groupBy("_c").agg(F.min(F.col("_end") - F.col("_n")).alias("low"), F.sum("_n").alias("n")).collect()}
    wanted = {(c, q): low + q * (n - 1) for c, (low, n) in total.items() for q in shares}
    ranks = sorted({int(math.floor(r)) + d for r in wanted.values() for d in (0, 1)})
    hits = ends.select("_x", F.explode(F.filter(F.array(*map(F.lit, ranks)), lambda r: (r >= F.col("_end") - F.col("_n")) & (r < F.col("_end")))).alias("r")) if ranks else None
    at = {r.r: r._x for r in hits.collect()} if ranks else {}
    out: dict[str, list[float | None]] = {c: [None] * len(shares) for c in columns}
    for (c, q), rank in wanted.items():
        low = math.floor(rank)
        out[c][shares.index(q)] = at[low] + (at[low + 1] - at[low]) * (rank - low) if rank > low else at[low]
    return out


def roc(df: DataFrame, score: str, label: str) -> DataFrame:
    """threshold, tpr and fpr at each distinct score, from counts by score."""
    counts = df.groupBy(score).agg(F.sum(label).alias("p"), F.sum(1 - F.col(label)).alias("n"))
    counts, upto = in_ranges(counts, F.desc(score), ["p", "n"])
    total = counts.agg(F.sum("p").alias("all_p"), F.sum("n").alias("all_n"))
    return counts.select(score, *((F.sum(c).over(upto) + F.col(f"_before_{c}")).alias(c) for c in "pn")).join(F.broadcast(total)).select(F.col(score).alias("threshold"), F.try_divide("p", "all_p").alias("tpr"), F.try_divide("n", "all_n").alias("fpr"))



def best_threshold(df: DataFrame, score: str, label: str) -> DataFrame:
    """The threshold with most tpr - fpr, the greatest of equals."""
    return roc(df, score, label).agg(F.max(F.struct(F.round(F.col("tpr") - F.col("fpr"), 9).alias("gain"), "threshold", "tpr", "fpr")).alias("b")).select("b.threshold", "b.tpr", "b.fpr")


def confidence(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean and its 95 per cent band by the sample deviation, not below 0."""
    half = F.lit(1.959963984540054) * F.stddev_samp(value)
    return df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.greatest(F.lit(0.0), F.avg(value) - half).alias("low"), F.greatest(F.lit(0.0), F.avg(value) + half).alias("high"))


def productivity(df: DataFrame, columns: list[str], out: str = "index") -> DataFrame:
    """Product of the columns brought to 0 to 1; a constant column counts as 0."""
    stats = df.agg(*(F.min(c).alias(f"_a_{c}") for c in columns), *(F.max(c).alias(f"_b_{c}") for c in columns))
    unit = lambda c: F.coalesce((F.col(c) - F.col(f"_a_{c}")) / F.nullif(F.col(f"_b_{c}") - F.col(f"_a_{c}"), F.lit(0.0)), F.lit(0.0))
    product = F.lit(1.0)
    for c in columns:
        product = product * unit(c)
    return df.join(F.broadcast(stats)).withColumn(out, product).select(*df.columns, out)


def search_space(clusters: list[int], scalers: list[str], projections: list[float | None], methods: list[str]) -> list[dict]:
    """All settings of a tuning run, in a fixed order."""
    return [{"method": m, "clusters": k, "scaler": s, "projection": p} for s in scalers for p in projections for m in methods for k in clusters]


def sample_size(n: int, k: int, most: int = 5000, least: int = 400) -> int:
    """Rows of a silhouette's sample: 24 sqrt(n) k for at least two clusters, within bounds; a coarse stage takes ``most`` as 1,500."""
    return min(most, max(least, int(24 * math.sqrt(max(n, 1)) * max(k, 2))))
