"""Toxicity scores: gradient-boosted trees over dense features of a text, calibrated by isotonic regression."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpointed, table, text_slices, texts_of, utf8, words_of

#: Words that count without being learned.
LEXICON = ("idiot", "moron", "stupid", "loser", "trash", "scum", "pathetic", "worthless", "disgusting", "clown", "dumb", "ugly", "hate", "kill", "shut")
SECOND_PERSON = ("you", "your", "yours", "yourself", "u", "ur", "du", "dich", "dir", "dein", "deine", "sie", "ihr", "tu", "te", "toi", "ton", "ta", "vous", "votre", "tú", "ti", "usted", "ustedes", "vosotros")
PREFIX, NEAR, MOST_LEARNED = 4, 5, 2000
#: At most so many labelled rows are learned from: those with the smallest hashes.
MOST_ROWS = 12_000
FEATURES = ("fixed_hits", "weights", "top_weight", "fixed", "learned", "prefixes", "weight", "hits", "near_you", "you", "capitals", "exclamations", "punctuation", "obfuscated", "stretched", "log_words")


def fold(id: Column) -> Column:
    return F.crc32(id.cast("string").cast("binary")) % 5


def learned_lexicon(rows: DataFrame, least_share: float = 0.02, least: int = 3, ratio: float = 8.0) -> dict[str, float]:
    """Words and word beginnings (``^abcd``) that toxic rows (text, toxic) hold far more often than others, at most MOST_LEARNED, with the log of how much more."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), 0))
    begins = F.transform(F.filter(words, lambda w: F.length(w) >= PREFIX), lambda w: F.concat(F.lit("^"), F.substring(w, 1, PREFIX)))
    counts = rows.select("toxic", F.explode(F.array_distinct(F.concat(words, begins))).alias("token")).groupBy("token").agg(F.sum("toxic").alias("p"), F.sum(1 - F.col("toxic")).alias("n"))
    total = rows.agg(F.coalesce(F.sum("toxic"), F.lit(0)).alias("p"), F.coalesce(F.sum(1 - F.col("toxic")), F.lit(0)).alias("n")).first()
    if not total.p or not total.n:
        return {}
    odds = ((F.col("p") + 0.5) / (total.p + 1)) / ((F.col("n") + 0.5) / (total.n + 1))
    found = counts.filter(F.col("p") >= max(least, least_share * total.p)).select("token", F.log(odds).alias("w")).filter(F.col("w") >= float(np.log(ratio)))
    return {r.token: r.w for r in found.orderBy(F.desc("w"), "token").limit(MOST_LEARNED).collect()}


def features(texts: pa.Array, lexicon: dict[str, float]) -> list[np.ndarray]:
    """FEATURES of each text; rates are per word, or per byte for signs."""
    n = len(texts)
    rows, word, distinct = words_of(texts)
    plain = pc.utf8_lower(pc.replace_substring_regex(distinct, r"^[^\pL]+|[^\pL]+$", "")).to_pylist()
    fixed, you = set(LEXICON), set(SECOND_PERSON)
    of = lambda f, kind: np.fromiter(map(f, plain), kind, len(plain))[word] if len(plain) else np.zeros(0, kind)
    is_fixed, is_you = of(fixed.__contains__, bool), of(you.__contains__, bool)
    whole, begin = of(lambda w: lexicon.get(w, 0.0), float), of(lambda w: lexicon.get(f"^{w[:PREFIX]}", 0.0) if len(w) >= PREFIX else 0.0, float)
    match = lambda p: np.asarray(pc.match_substring_regex(distinct, p))[word] if len(word) else np.zeros(0, bool)
    hit = is_fixed | (whole > 0) | (begin > 0)
    near = np.zeros(len(rows), bool)
    at = np.flatnonzero(is_you)
    for step in range(-NEAR, NEAR + 1):
        to = at + step
        ok = (to >= 0) & (to < len(rows))
        ok[ok] = rows[to[ok]] == rows[at[ok]]
        near[to[ok]] = True
    total = lambda x: np.bincount(rows, weights=x, minlength=n)
    words = np.maximum(total(np.ones(len(rows))), 1)
    data, starts = utf8(texts)
    size = np.maximum(starts[1:] - starts[:-1], 1)
    signs = lambda s: np.diff(np.concatenate([[0], np.cumsum(np.isin(data, list(s.encode())), dtype=np.int64)])[starts]) / size
    weight = np.maximum(whole, begin)
    top = np.zeros(n)
    np.maximum.at(top, rows[weight > 0], weight[weight > 0])
    return [
        np.minimum(total(is_fixed), 20), np.minimum(total(weight), 50), top,
        total(is_fixed) / words, total(whole > 0) / words, total(begin > 0) / words, total(weight) / words, np.minimum(total(hit), 20), total(hit & near) / words, total(is_you) / words,
        total(match(r"^[^a-z]*[A-Z][^a-z]*[A-Z][^a-z]*$")) / words, signs("!"), signs(".,;:?!"), total(match(r"\pL[0-9@$*#]+\pL")) / words, total(match("|".join(f"{c}{c}{c}" for c in "aeioushmln"))) / words, np.log1p(total(np.ones(len(rows)))),
    ]


def with_features(docs: DataFrame, lexicon: dict[str, float]) -> DataFrame:
    """``docs`` with its column ``text`` replaced by FEATURES."""
    keep = [c for c in docs.columns if c != "text"]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            found = [pa.array(x, pa.float64()) for x in features(texts_of(batch), lexicon)]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in keep), *found], [*keep, *FEATURES])

    fields = [docs.schema[c] for c in keep]
    return docs.mapInArrow(add, T.StructType([*fields, *(T.StructField(f, T.DoubleType()) for f in FEATURES)]))


def training_rows(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """(text, toxic, part): the labelled rows outside the held-out fold, at most ``most``, part 0 to 9 by another hash."""
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).filter("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    some = known.filter(fold(F.col("doc_id")) != 0).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    some = some.withColumn("part", F.pmod(F.hash("doc_id"), F.lit(10)))
    return docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(some), "doc_id").drop("doc_id")  # at most ``most`` short rows


def score(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS, trees: int = 20) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted for each row of ``docs`` (doc_id, text).

    The lexicon is learned from four tenths of the training rows, the trees
    from four more and the calibration from the rest, so none of them sees what
    an earlier step has learned by heart. A thousandth of the trees' own score
    orders texts within a step of the calibration. Where training rows are
    missing or all of one class, the score is the smoothed share of toxic rows.
    Null and empty texts have features of zero and get a score; a null doc_id
    is not held out; repeated rows get a row each; other columns are ignored.
    """
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    out = ["doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out")]
    sample = checkpointed(training_rows(docs, labels, most_rows))
    n = {r.part: (r.n, r.p) for r in sample.groupBy("part").agg(F.count("*").alias("n"), F.sum("toxic").alias("p")).collect()}
    both = lambda parts: 0 < sum(n[p][1] for p in parts if p in n) < sum(n[p][0] for p in parts if p in n)
    if not both(range(4, 8)):
        share = (sum(p for _, p in n.values()) + 1) / (sum(k for k, _ in n.values()) + 2)
        return rows.select(*out, F.lit(float(share)).alias("score"), F.lit(int(share >= 0.5)).alias("predicted"))
    lexicon = learned_lexicon(sample.filter("part < 4"))
    assembler = VectorAssembler(inputCols=list(FEATURES), outputCol="vector")
    fit = checkpointed(assembler.transform(with_features(sample.filter("part >= 4"), lexicon)).select("part", F.col("toxic").cast("double").alias("toxic"), "vector").coalesce(2))
    gbt = GBTClassifier(featuresCol="vector", labelCol="toxic", maxIter=trees, maxDepth=4, maxBins=64, minInstancesPerNode=5, stepSize=0.3, seed=1)
    model = gbt.fit(fit.filter("part < 8"))
    raw = lambda df: model.transform(df).withColumn("own", vector_to_array("probability")[1])
    scored = raw(assembler.transform(with_features(rows, lexicon)))
    value = F.col("own")
    if both(range(8, 10)):
        steps = IsotonicRegression(featuresCol="own", labelCol="toxic", predictionCol="step").fit(raw(fit.filter("part >= 8")).select("own", "toxic"))
        scored, value = steps.transform(scored.drop("prediction")), 0.999 * F.col("step") + 0.001 * F.col("own")
    scored = scored.select(*out, F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0)).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "toxic"))
