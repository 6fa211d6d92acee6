"""Fixity audit of archive replicas: Merkle trees over records and ordered offset ranges, compared from the roots down."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, table

#: A node of a tree covers the ranges of 2 ** BITS nodes below it.
BITS = 4
MOST_BROADCAST = 20_000


def record_digest(*columns: str) -> Column:
    """SHA-256 over the columns with their lengths, so that null, empty and shifted texts differ."""
    parts = []
    for c in columns:
        text = F.col(c).cast("string")
        parts += [F.coalesce(F.octet_length(text).cast("string"), F.lit("null")), F.lit(":"), F.coalesce(text, F.lit(""))]
    return F.sha2(F.concat(*parts), 256)


def leaves(left: DataFrame, right: DataFrame, offset: str, columns: list[str]) -> DataFrame:
    """(side, node, n, digest): a row for each place of each replica. Records at one place are summed, whatever their order."""
    place = F.coalesce(F.col(offset).cast("long"), F.lit(-1)).alias("node")
    side = lambda df, k: df.select(F.lit(k).alias("side"), place, record_digest(*columns).alias("d"))
    sums = side(left, 0).unionByName(side(right, 1)).groupBy("side", "node").agg(
        F.count("*").alias("n"), F.min("d").alias("low"), F.max("d").alias("high"), F.bit_xor(F.xxhash64("d")).alias("x"), F.sum(F.crc32(F.col("d").cast("binary"))).alias("y")
    )
    return sums.select("side", "node", "n", F.sha2(F.concat_ws(",", "n", "low", "high", "x", "y"), 256).alias("digest"))


def parents(nodes: DataFrame, bits: int = BITS) -> DataFrame:
    """One level up: the digest of each range is that of its parts' digests in order, of which there are at most 2 ** bits."""
    parts = F.array_sort(F.collect_list(F.struct("node", "digest")))
    text = F.array_join(F.transform(parts, lambda p: F.concat(p["node"].cast("string"), F.lit(":"), p["digest"])), ",")
    return nodes.groupBy("side", F.shiftright("node", bits).alias("node")).agg(F.sum("n").alias("n"), F.sha2(text, 256).alias("digest"))


def mismatches(nodes: DataFrame) -> DataFrame:
    """(node, n_left, n_right, left, right) of nodes whose digests differ, or that one replica lacks."""
    of = lambda k, c: F.max(F.when(F.col("side") == k, F.col(c)))
    both = nodes.groupBy("node").agg(
        F.coalesce(of(0, "n"), F.lit(0)).alias("n_left"), F.coalesce(of(1, "n"), F.lit(0)).alias("n_right"), of(0, "digest").alias("left"), of(1, "digest").alias("right")
    )
    return both.filter(~F.col("left").eqNullSafe(F.col("right")))


def audit(left: DataFrame, right: DataFrame, offset: str, columns: list[str], bits: int = BITS) -> DataFrame:
    """(place, kind, n_left, n_right, left, right) for each place at which two replicas differ.

    ``offset`` (a whole number of at least 0) orders an archive's records,
    ``columns`` are their content. kind is missing (the right replica has no
    record there), extra (the left has none), count (numbers differ) or
    changed. Trees of both replicas are built upward by range of offsets and
    compared downward: only ranges that differ are joined to the level below.
    Null content is content of its own; records with a null offset share the
    place -1 and so may repeated offsets; other columns are ignored; equal or
    empty replicas give no rows.
    """
    levels = [checkpointed(leaves(left, right, offset, columns))]
    # -1 stays -1 when it is shifted, so a root has one node, or two where offsets are null.
    most = levels[0].agg(F.max("node")).first()[0] or 0
    while most > 0:
        levels.append(checkpointed(parents(levels[-1], bits)))
        most >>= bits
    found = checkpointed(mismatches(levels[-1]))
    for level in reversed(levels[:-1]):
        open_ = found.select(F.col("node").alias("_up"))
        open_ = F.broadcast(open_) if found.count() <= MOST_BROADCAST else open_
        inside = level.withColumn("_up", F.shiftright("node", bits)).join(open_, "_up", "left_semi").drop("_up")
        found = checkpointed(mismatches(inside))
    kind = F.when(F.col("n_right") == 0, "missing").when(F.col("n_left") == 0, "extra").when(F.col("n_left") != F.col("n_right"), "count").otherwise("changed")
    return found.select(F.col("node").alias("place"), kind.alias("kind"), "n_left", "n_right", "left", "right")


def damaged(pages: DataFrame) -> DataFrame:
    """A replica with known faults: some pages lost, some changed by one character, some written twice."""
    kept = pages.filter("page_id is null or page_id % 211 <> 5")
    changed = kept.withColumn("html", F.when(F.col("page_id") % 89 == 7, F.concat(F.coalesce("html", F.lit("")), F.lit("x"))).otherwise(F.col("html")))
    return changed.unionByName(changed.filter("page_id % 223 = 11"))


def op2_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as an archive in order of page_id, against a replica with known faults."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return audit(pages, damaged(pages), "page_id", ["url", "html"]).select(F.col("place").alias("page_id"), "kind", "n_left", "n_right")


SQL = """
with p as (select page_id, count(*) as n_left from pages where page_id is not null group by 1)
select page_id, case when page_id % 211 = 5 then 'missing' when page_id % 223 = 11 then 'count' else 'changed' end as kind, n_left,
  case when page_id % 211 = 5 then 0 when page_id % 223 = 11 then 2 * n_left else n_left end as n_right
from p where page_id % 211 = 5 or page_id % 223 = 11 or page_id % 89 = 7"""
