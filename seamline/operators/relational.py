"""Relational building blocks: names and aliases, synchronisation, pivots, summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import plain_name


def resolve(rows: DataFrame, aliases: DataFrame, name: str, alias: str = "alias", canonical: str = "canonical") -> DataFrame:
    """Add the canonical name of each row's name, null where no alias matches. Small alias tables are broadcast by the planner."""
    known = aliases.select(plain_name(F.col(alias)).alias("_alias"), F.col(canonical).alias("canonical")).dropDuplicates(["_alias"])
    return rows.join(known, plain_name(F.col(name)) == F.col("_alias"), "left").drop("_alias")


def unassigned(rows: DataFrame, aliases: DataFrame, name: str, alias: str = "alias") -> DataFrame:
    """Names that no alias covers, with their counts."""
    counts = rows.groupBy(plain_name(F.col(name)).alias("name")).agg(F.count("*").alias("uses"))
    return counts.join(aliases.select(plain_name(F.col(alias)).alias("name")), "name", "left_anti")


def coverage(rows: DataFrame, aliases: DataFrame, name: str, alias: str = "alias", canonical: str = "canonical") -> DataFrame:
    """For each canonical name: aliases, aliases in use, and the share of all names in use that it covers (per cent)."""
    used = rows.select(plain_name(F.col(name)).alias("_name")).filter("_name is not null").distinct()
    total = used.agg(F.count("*").alias("total"))
    known = aliases.select(F.col(canonical).alias("canonical"), plain_name(F.col(alias)).alias("_alias"))
    found = known.join(used, F.col("_alias") == F.col("_name"), "left").groupBy("canonical").agg(F.count("_alias").alias("aliases"), F.count_distinct("_name").alias("covered"))
    return found.join(F.broadcast(total)).select("canonical", "aliases", "covered", F.round(100.0 * F.col("covered") / F.nullif(F.col("total"), F.lit(0)), 2).alias("coverage"))


def frequencies(rows: DataFrame, name: str) -> DataFrame:
    """Uses of each name regardless of case, named by the least raw spelling, most used first."""
    return rows.groupBy(plain_name(F.col(name)).alias("key")).agg(F.min(name).alias("name"), F.count("*").alias("uses")).orderBy(F.desc("uses"), "key")


def missing(source: DataFrame, target: DataFrame, hash: str) -> DataFrame:
    """Source rows whose hash the target lacks; rows without a hash are left out."""
    return source.filter(F.col(hash).isNotNull()).join(target.select(hash), hash, "left_anti").select(*source.columns)


def missing_children(source: DataFrame, children: DataFrame, target: DataFrame, target_children: DataFrame, id: str, hash: str, natural: list[str]) -> DataFrame:
    """Children of source parents that the target has by hash, keyed to the target's parents, without those it has already."""
    ids = source.select(F.col(id).alias("_source"), hash).join(target.select(F.col(id).alias("_target"), hash), hash)
    mapped = children.join(ids, F.col(id) == F.col("_source")).select(F.col("_target").alias(id), *(c for c in children.columns if c != id))
    return mapped.join(target_children.select(id, *natural), [id, *natural], "left_anti").select(*children.columns)


def pivot(rows: DataFrame, keys: list[str], name: str, value: str, names: list[str]) -> DataFrame:
    """Measurements in long form to a column each; what is missing is null, the least of repeats counts."""
    return rows.groupBy(*keys).agg(*(F.min(F.when(F.col(name) == n, F.col(value))).alias(n) for n in names))


def titles(rows: DataFrame, keys: list[str], name: str, value: str, names: list[str]) -> DataFrame:
    """As ``pivot`` for texts, repeats joined in order by a semicolon."""
    joined = lambda n: F.nullif(F.array_join(F.array_sort(F.collect_list(F.when(F.col(name) == n, F.col(value).cast("string")))), "; "), F.lit(""))
    return rows.groupBy(*keys).agg(*(joined(n).alias(n) for n in names))


def latest(rows: DataFrame, keys: list[str], order: str, tie: str) -> DataFrame:
    """The row of each key with the greatest order, then tie."""
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rows.columns), F.struct(order, tie)).alias("_row"))
    return best.select("_row.*")


def first_copies(rows: DataFrame, keys: list[str], content: str, id: str) -> DataFrame:
    """The row with the least id of each key and content."""
    marked = rows.withColumn("_mark", F.md5(content))
    return marked.groupBy(*keys, "_mark").agg(F.min_by(F.struct(*rows.columns), id).alias("_row")).select("_row.*")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old rows with those of the same keys replaced by the new ones, and new keys added."""
    return old.join(new.select(*keys), keys, "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def top_by_group(rows: DataFrame, keys: list[str], order: list, k: int) -> DataFrame:
    return rows.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter(F.col("_r") <= k).drop("_r")


def stratified(rows: DataFrame, stratum: str, id: str, quota: int, seed: str = "42") -> DataFrame:
    """At most ``quota`` rows of each stratum, by the order of a seeded hash: a sampling operator that gives the same rows each time."""
    return top_by_group(rows, [stratum], [F.md5(F.concat(F.col(id).cast("string"), F.lit(seed))), F.col(id)], quota)


def diverse(rows: DataFrame, key: str, order: list, k: int) -> DataFrame:
    """The k best rows, those that are best of their key before all others: a top-k report."""
    ranked = rows.withColumn("_of_key", F.row_number().over(W.partitionBy(key).orderBy(*order)))
    return ranked.orderBy(F.least("_of_key", F.lit(2)), *order).limit(k).drop("_of_key")


def partition_mark(rows: DataFrame, keys: list[str], label: str, id: str) -> DataFrame:
    """A mark of each key's partition into labels that is the same whatever the labels are called: 12 hexadecimal digits."""
    groups = rows.groupBy(*keys, label).agg(F.array_join(F.array_sort(F.collect_list(id)).cast("array<string>"), ",").alias("_group"), F.min(id).alias("_first"))
    ordered = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_first", "_group"))), lambda g: g["_group"]), "|")
    return groups.groupBy(*keys).agg(F.substring(F.sha1(ordered), 1, 12).alias("mark"))


def parts_of_total(rows: DataFrame, keys: list[str], label: str) -> DataFrame:
    """Count and share (per cent) of each label of a key."""
    counts = rows.groupBy(*keys, label).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.round(100.0 * F.col("n") / F.sum("n").over(W.partitionBy(*keys)), 4))


def side_by_side(predictions: DataFrame, keys: list[str], model: str, value: str, corrected: str, models: list) -> DataFrame:
    """One column for each model, the corrected value before the raw one; only rows that all models have."""
    best = F.coalesce(corrected, value)
    wide = predictions.groupBy(*keys).agg(*(F.min(F.when(F.col(model) == m, best)).alias(f"m_{m}") for m in models))
    return wide.dropna(subset=[f"m_{m}" for m in models])
