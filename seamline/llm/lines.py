"""Site-relative line frequency: lines that many pages of one host share are boilerplate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, checkpointed, table

RATIO = 0.05
#: Every host is counted as if it had so many more pages without the line: on few pages a share says little.
MORE_PAGES = 20


def line_key(line: Column) -> Column:
    """96 bits that stand for a line without outer blanks; a line without a word has none."""
    bare = F.trim(line)
    return F.when(bare.rlike(WORD), F.struct(F.xxhash64(bare).alias("a"), F.hash(bare).alias("b")))


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def page_lines(pages: DataFrame) -> DataFrame:
    """(host, key) for each different line of each page (host, text, ...)."""
    keys = F.array_distinct(F.array_compact(F.transform(lines_of(F.col("text")), line_key)))
    return pages.withColumn("key", F.explode(keys)).drop("text")


def boilerplate(pages: DataFrame, ratio: float = RATIO, more_pages: int = MORE_PAGES) -> DataFrame:
    """(host, key) of lines whose smoothed share of a host's pages is over ``ratio``.

    The share is that of a page's chance to have the line besides the one it
    is seen on: (pages with it - 1) / (the host's pages + ``more_pages``). So a
    line of one page alone is none, small hosts need more of their pages to
    agree, and for large ones it is the plain ratio.

    Counts are summed in the map tasks first, so a host or a line that holds a
    third of all rows sends one row for each task. Host totals meet only lines
    that would pass if all the host's pages had them.
    """
    over = lambda total: F.col("n") - 1 > (total + more_pages) * F.lit(ratio)
    counts = page_lines(pages.select("host", "text")).groupBy("host", "key").agg(F.count("*").alias("n")).filter(over(F.col("n")))
    totals = pages.groupBy("host").agg(F.count("*").alias("total"))
    return counts.join(totals, "host").filter(over(F.col("total"))).select("host", "key")


def drop_boilerplate(docs: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, more_pages: int = MORE_PAGES, most_broadcast: int = 50_000) -> DataFrame:
    """(row, text, n_lines, n_dropped) for each row of ``docs``, which is row as a struct, so no names clash.

    text is without the boilerplate lines of the row's host; n_lines counts
    lines with a word and n_dropped those of them that went. A null text stays
    null with no lines; pages without a host are a host of their own. Every
    repeated row counts as a page. A text that loses all lines becomes empty; a
    very long one is one page like others. No rows give no rows.

    A host has at most 1 / ratio times the mean number of a page's lines as
    boilerplate, so its list is one short row. Where all lists together have at
    most ``most_broadcast`` lines they are broadcast and texts are filtered
    where they are read. Else texts are joined to the lists by host, in which
    join Spark splits a hot host's pages.
    """
    pages = docs.select(F.struct("*").alias("row"), F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"), F.col(text).cast("string").alias("text"))
    found = checkpointed(boilerplate(pages, ratio, more_pages))
    lists = found.groupBy("host").agg(F.collect_list("key").alias("drop"))
    joined = pages.join(F.broadcast(lists) if found.count() <= most_broadcast else lists, "host", "left")
    drop = F.coalesce("drop", F.array().cast("array<struct<a:bigint,b:int>>"))
    kept = F.filter(lines_of(F.col("text")), lambda line: ~F.coalesce(F.array_contains(drop, line_key(line)), F.lit(False)))
    full = lambda lines: F.size(F.filter(lines, lambda line: F.trim(line).rlike(WORD)))
    new = F.when(F.size(drop) == 0, F.col("text")).otherwise(F.array_join(kept, "\n"))
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(full(lines_of(F.col("text"))))
    n_left = F.when(F.col("text").isNull(), 0).otherwise(full(kept))
    return joined.select("row", new.alias("text"), n_lines.cast("long").alias("n_lines"), (n_lines - n_left).cast("long").alias("n_dropped"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their source as host."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return drop_boilerplate(docs).select("row.doc_id", "n_lines", "n_dropped", F.md5("text").alias("text_md5"))


SQL = rf"""
with pages as (select row_number() over () as k, doc_id, coalesce(source, '') as host, text from documents),
lines as (select k, host, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as i from pages),
full_lines as (select *, trim(line) as bare from lines where regexp_matches(trim(line), '{WORD}')),
boilerplate as (select host, bare from (select host, bare, count(distinct k) as n from full_lines group by all) join (select host, count(*) as total from pages group by host) using (host)
  where n - 1 > (total + {MORE_PAGES}) * {RATIO}),
kept as (select k, string_agg(line, chr(10) order by i) as text from (select * from lines l where not exists (select 1 from boilerplate b where b.host = l.host and b.bare = trim(l.line))) group by k),
counts as (select k, count(*) as n_lines, count(b.bare) as n_dropped from full_lines f left join boilerplate b on b.host = f.host and b.bare = f.bare group by k)
select doc_id, coalesce(n_lines, 0) as n_lines, coalesce(n_dropped, 0) as n_dropped, case when p.text is not null then md5(coalesce(kept.text, '')) end as text_md5
from pages p left join kept using (k) left join counts using (k)"""
