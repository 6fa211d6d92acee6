"""Quality rules whose thresholds come from mergeable quantile sketches per language and source."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACE, checkpointed, codes, table, text_slices, texts_of, utf8, words_of, written

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct_words", "n_upper", "n_punct")

#: rule: (measure in SQL, side, floor). A text breaks it beyond q50 + SPREAD * (q50 - q10) + floor, or below
#: q50 - SPREAD * (q90 - q50) - floor, where the quantiles are those of its language and source.
RULES = {
    "word_length": ("100 * word_chars div nullif(n_words, 0)", "upper", 50),
    "symbols": ("1000 * n_symbols div nullif(word_chars, 0)", "upper", 20),
    "capitals": ("1000 * n_upper div nullif(word_chars, 0)", "upper", 60),
    "punctuation": ("1000 * n_punct div nullif(word_chars, 0)", "upper", 40),
    "dup_lines": ("1000 * n_dup_lines div nullif(n_lines, 0)", "upper", 400),
    "repeats": ("1000 * n_repeat_words div nullif(n_words, 0)", "upper", 450),
    "variety": ("1000 * n_distinct_words div nullif(n_words, 0)", "lower", 50),
}
SPREAD = 6
#: A group's limits are drawn to those of its language as if so many of its texts had these, and a language's to those of all texts.
DRAWN = 30


def _bytes_of(classes: str) -> np.ndarray:
    found = np.zeros(256, bool)
    found[list(classes.encode())] = True
    return found


_SPACE, _SYMBOL, _UPPER, _PUNCT = map(_bytes_of, (SPACE, "#*$%&|<>", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "!?.,;:"))
_FIRST = (np.arange(256) & 0xC0) != 0x80  # bytes that begin a code point


def _per_text(found: np.ndarray, starts: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(found, dtype=np.int64)])
    return total[starts[1:]] - total[starts[:-1]]


def measures(texts: pa.Array) -> list[np.ndarray]:
    """COUNTS of each text."""
    n = len(texts)
    data, starts = utf8(texts)
    rows, word, distinct = words_of(texts)
    words = np.bincount(rows, minlength=n)
    own = codes(rows * max(1, len(distinct)) + word)  # one number for each word of each text
    variety = np.bincount(rows[np.unique(own, return_index=True)[1]], minlength=n)
    repeat = np.zeros(len(rows), bool)
    if len(rows) > 2:
        at = np.flatnonzero(rows[2:] == rows[:-2])
        base = int(own.max()) + 1
        window = codes(codes(own[at] * base + own[at + 1]) * base + own[at + 2])
        at = at[np.bincount(window)[window] > 1] if len(at) else at
        for k in range(3):
            repeat[at + k] = True
    lines = pc.split_pattern(texts, pattern="\n")
    line, of = lines.flatten(), np.asarray(pc.list_parent_indices(lines)).astype(np.int64)
    full = np.asarray(pc.match_substring_regex(line, r"[^\x20\x09-\x0D]"))
    line, of = line.filter(pa.array(full)).dictionary_encode(), of[full]
    n_lines = np.bincount(of, minlength=n)
    line = codes(of * max(1, len(line.dictionary)) + np.asarray(line.indices))
    n_dup = n_lines - np.bincount(of[np.unique(line, return_index=True)[1]], minlength=n)
    chars = _per_text(_FIRST[data] & ~_SPACE[data], starts)
    return [words, chars, _per_text(_SYMBOL[data], starts), n_dup, np.bincount(rows[repeat], minlength=n), n_lines, variety, _per_text(_UPPER[data], starts), _per_text(_PUNCT[data], starts)]


def measured(docs: DataFrame, row: str | None = None) -> DataFrame:
    """``docs`` with COUNTS of its column text, or of the field text of the struct ``row``, so that a text needs to be sent only once."""
    columns = docs.columns

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = (pa.RecordBatch.from_arrays([*b.columns, b[row].field("text") if row else b["text"]], [*columns, "\n"]) for b in batches)
        for batch in text_slices(texts, "\n"):
            found = [pa.array(x, pa.int64()) for x in measures(texts_of(batch, "\n"))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *found], [*columns, *COUNTS])

    return docs.mapInArrow(add, T.StructType([*docs.schema.fields, *(T.StructField(name, T.LongType()) for name in COUNTS)]))


def base_failed() -> Column:
    return F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words")


def bucket(x: str) -> str:
    """Number of the log-linear bucket of an integer: exact below 64, 32 buckets for each power of two above."""
    shift = f"greatest(length(bin({x})) - 6, 0)"
    return f"32 * {shift} + shiftright({x}, {shift})"


def bucket_floor(b: str) -> str:
    return f"if({b} < 64, {b}, shiftleft({b} - 32 * ({b} div 32 - 1), cast({b} div 32 - 1 as int)))"


def sketch(counts: DataFrame) -> DataFrame:
    """Quantile sketches of all rules per language and source: how many texts lie in each bucket.

    Two sketches merge by adding their counts, so partial ones are made before
    the shuffle, and sketches of larger groups are sums of these.
    """
    rows = counts.filter(~base_failed()).selectExpr(
        "coalesce(lang, '') as lang", "coalesce(source, '') as source",
        "inline(array(" + ", ".join(f"named_struct('rule', '{r}', 'x', cast({m} as bigint))" for r, (m, _, _) in RULES.items()) + "))",
    )
    return rows.groupBy("lang", "source", "rule", F.expr(bucket("x")).cast("long").alias("bucket")).agg(F.count("*").alias("n"))


def quantiles(sketches: DataFrame, *keys: str) -> DataFrame:
    """n, q10, q50 and q90 of each rule's sketch in each group of keys; sketches of a group are merged."""
    merged = sketches.groupBy(*keys, "rule", "bucket").agg(F.sum("n").alias("n"))
    within = W.partitionBy(*keys, "rule").orderBy("bucket")
    ranked = merged.withColumn("upto", F.sum("n").over(within)).withColumn("total", F.sum("n").over(W.partitionBy(*keys, "rule")))
    value = F.expr(bucket_floor("bucket"))
    return ranked.groupBy(*keys, "rule").agg(
        F.max("total").alias("total"), *(F.min(F.when(F.col("upto") * 100 >= F.col("total") * q, value)).alias(f"q{q}") for q in (10, 50, 90))
    )


def _limit(side: str, floor: int) -> str:
    """A rule's limit in SQL from its quantiles; never below 0, as no measure is."""
    return f"q50 + {SPREAD} * (q50 - q10) + {floor}" if side == "upper" else f"greatest(q50 - {SPREAD} * (q90 - q50) - {floor}, 0)"


def _drawn(div: str) -> str:
    """The limit of a group (n0 texts, limit l0) in SQL, drawn to that of its language (1), which is drawn to that of all (2); whole numbers, so every engine agrees."""
    return f"(n0 * l0 + {DRAWN} * ((n1 * l1 + {DRAWN} * l2) {div} (n1 + {DRAWN}))) {div} (n0 + {DRAWN})"


def thresholds(counts: DataFrame) -> DataFrame:
    """A row for each language and source with the limit of each rule."""
    sketches = checkpointed(sketch(counts))
    limit = F.expr("case rule " + " ".join(f"when '{r}' then {_limit(side, floor)}" for r, (_, side, floor) in RULES.items()) + " end")
    level = lambda n, *keys: quantiles(sketches, *keys).select(*keys, "rule", F.col("total").alias(f"n{n}"), limit.alias(f"l{n}"))
    joined = level(0, "lang", "source").join(level(1, "lang"), ["lang", "rule"]).join(level(2), "rule").withColumn("own", F.expr(_drawn("div")))
    return joined.groupBy("lang", "source").agg(*(F.max(F.when(F.col("rule") == r, F.col("own"))).alias(f"limit_{r}") for r in RULES))


def broadcast_if_small(small: DataFrame, most: int = 20_000) -> DataFrame:
    """A broadcast hint for a checkpointed table of at most ``most`` rows; others are left to the planner."""
    return F.broadcast(small) if small.count() <= most else small


def verdicts(counts: DataFrame, limits: DataFrame) -> DataFrame:
    """``counts`` with base_failed and kept; every limit holds for the texts of its language and source."""
    joined = counts.withColumns({"_lang": F.coalesce("lang", F.lit("")), "_source": F.coalesce("source", F.lit(""))}).join(
        limits.withColumnsRenamed({"lang": "_lang", "source": "_source"}), ["_lang", "_source"], "left"
    )
    broken = [F.expr(f"({m}) {'>' if side == 'upper' else '<'} limit_{r}") for r, (m, side, _) in RULES.items()]
    bad = F.greatest(*(F.coalesce(b, F.lit(False)).cast("int") for b in broken)) == 1
    return joined.withColumn("base_failed", base_failed()).withColumn("kept", F.when(F.col("base_failed"), False).otherwise(~bad))


def judge(docs: DataFrame) -> DataFrame:
    """Judge ``docs`` (doc_id, text, lang, source): doc_id, COUNTS, base_failed, kept. Texts are measured whole, very long ones too.

    A null text has no words and fails the base rules; a null language or
    source counts as the empty string. Repeated rows get a row each and count
    each; other columns are ignored; no rows give no rows.
    """
    counts = checkpointed(measured(docs.select("doc_id", "lang", "source", F.col("text").cast("string").alias("text"))).drop("text"))
    limits = checkpointed(thresholds(counts))
    return verdicts(counts, broadcast_if_small(limits)).select("doc_id", *COUNTS, "base_failed", "kept")


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, all columns as they are.

    Rows that pass the base rules are written with their counts, so each text
    is measured once; the others can't be kept and are in no sketch.
    """
    apart = docs.select(F.struct("*").alias("_row"), "lang", "source")
    rows = written(measured(apart, "_row").filter(~base_failed()))
    limits = checkpointed(thresholds(rows))
    return verdicts(rows, broadcast_if_small(limits)).filter("kept").select("_row.*")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents")).select("doc_id", *COUNTS[:5], "base_failed", "kept")


def _sql() -> str:
    at = lambda q: f"min(case when upto * 100 >= total * {q} then floor_ end)"
    sql = lambda m: m.replace(" div ", " // ")
    own = "case rule " + " ".join(f"when '{r}' then {_limit(side, f)}" for r, (_, side, f) in RULES.items()) + " end"
    levels = "".join(
        f", ranked{n} as (select {keys}rule, bucket, sum(n) as m from sketches group by all)"
        f", quantiles{n} as (select {keys}rule, total as n{n}, {own} as l{n} from (select {keys}rule, max(total) as total, {at(10)} as q10, {at(50)} as q50, {at(90)} as q90 from (select *, case when bucket < 64 then bucket else (bucket - 32 * (bucket // 32 - 1)) << (bucket // 32 - 1) end as floor_,"
        f" sum(m) over (partition by {keys}rule order by bucket) as upto, sum(m) over (partition by {keys}rule) as total from ranked{n}) group by {keys}rule))"
        for n, keys in enumerate(("lang, source, ", "lang, ", ""))
    )
    limits = ", ".join(f"max(case when a.rule = '{r}' then {_drawn('//')} end) as limit_{r}" for r in RULES)
    bad = " or ".join(f"coalesce({sql(m)} {'>' if side == 'upper' else '<'} limit_{r}, false)" for r, (m, side, _) in RULES.items())
    return rf"""
with texts as (select row_number() over () as k, doc_id, coalesce(lang, '') as lang, coalesce(source, '') as source, coalesce(text, '') as text from documents),
words as (select *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l from texts),
windows as (select k, i, [w[i], w[i + 1], w[i + 2]] as t from (select k, w, unnest(range(1, len(w) - 1)) as i from words)),
twice as (select k, i from (select k, i, count(*) over (partition by k, t) as c from windows) where c > 1),
repeats as (select k, count(distinct p) as n_repeat_words from (select k, unnest([i, i + 1, i + 2]) as p from twice) group by k),
counts as (select doc_id, lang, source, len(w) as n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) as word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as n_symbols,
  len(l) - len(list_distinct(l)) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words, len(l) as n_lines, len(list_distinct(w)) as n_distinct_words,
  length(regexp_replace(text, '[^A-Z]', '', 'g')) as n_upper, length(regexp_replace(text, '[^!?.,;:]', '', 'g')) as n_punct from words left join repeats using (k)),
judged as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from counts),
measured as ({" union all ".join(f"select lang, source, '{r}' as rule, cast({sql(m)} as bigint) as x from judged where not base_failed" for r, (m, _, _) in RULES.items())}),
sketches as (select lang, source, rule, 32 * greatest(length(bin(x)) - 6, 0) + (x >> greatest(length(bin(x)) - 6, 0)) as bucket, count(*) as n from measured group by all){levels},
limits as (select a.lang, a.source, {limits} from quantiles0 a join quantiles1 b on a.lang = b.lang and a.rule = b.rule join quantiles2 c on a.rule = c.rule group by a.lang, a.source)
select doc_id, cast(n_words as bigint) as n_words, cast(word_chars as bigint) as word_chars, cast(n_symbols as bigint) as n_symbols, cast(n_dup_lines as bigint) as n_dup_lines, cast(n_repeat_words as bigint) as n_repeat_words,
  base_failed, case when base_failed then false else not ({bad}) end as kept from judged left join limits using (lang, source)"""


SQL = _sql()
