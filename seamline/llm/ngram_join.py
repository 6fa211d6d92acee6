"""All texts whose sets of word n-grams are similar: MinHash banding, then exact verification."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, mix64, table, text_slices, texts_of, word_hashes, words_of
from .components import components

WORDS, SIMILARITY, RECALL, MOST_HASHES = 5, 0.8, 0.9999, 256
#: Most texts that are compared with each other in one piece of work.
BLOCK = 512
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def bands_for(similarity: float = SIMILARITY, recall: float = RECALL, most_hashes: int = MOST_HASHES) -> tuple[int, int]:
    """(bands, rows of a band): the most rows, so the fewest chance candidates, with which a pair of just ``similarity`` shares a band with at least ``recall``."""
    fits = [(math.ceil(math.log(1 - recall) / math.log(1 - similarity**r)), r) for r in range(1, 33)]
    return max((f for f in fits if f[0] * f[1] <= most_hashes), key=lambda f: f[1])


def shingles(texts: pa.Array, n: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(text number, 64-bit hash) of each n-gram of words; a text of fewer words has one, of all its words."""
    rows, word, distinct = words_of(texts)
    value = word_hashes(distinct)[word]
    ends = np.searchsorted(rows, np.arange(len(texts)), "right")
    left = ends[rows] - np.arange(len(rows))  # words from here to the end of the text
    first = np.append(True, rows[1:] != rows[:-1]) if len(rows) else np.zeros(0, bool)
    at = np.flatnonzero((left >= n) | first)
    out = np.zeros(len(at), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            inside = left[at] > k
            out[inside] = mix64(out[inside] * _GOLDEN + value[at[inside] + k])
    return rows[at], out


def signatures(rows: np.ndarray, grams: np.ndarray, n: int, bands: int, depth: int) -> np.ndarray:
    """Band hashes (n, bands) of texts that each have at least one n-gram or none; zero for those without."""
    starts = np.searchsorted(rows, np.arange(n + 1))
    full = starts[1:] > starts[:-1]
    random = np.random.default_rng(20)
    factor, shift = random.integers(0, 2**63, (2, bands, depth), dtype=np.uint64)
    out, buffer = np.zeros((n, bands), np.uint64), np.empty_like(grams)
    if full.any():
        with np.errstate(over="ignore"):
            for b in range(bands):
                own = np.full(int(full.sum()), b + 1, np.uint64)
                for d in range(depth):
                    np.multiply(grams, factor[b, d] | np.uint64(1), out=buffer)
                    np.add(buffer, shift[b, d], out=buffer)
                    own = mix64(own * _GOLDEN + (np.minimum.reduceat(buffer, starts[:-1][full]) >> np.uint64(16)))
                out[full, b] = own
    return out


def _sign(batches: Iterator[pa.RecordBatch], n: int, bands: int, depth: int) -> Iterator[pa.RecordBatch]:
    for batch in text_slices(batches):
        texts = texts_of(batch)
        found = signatures(*shingles(texts, n), len(texts), bands, depth).view(np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * bands), pa.array(found.ravel()), mask=pa.array(~found.any(axis=1)))
        yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["key"], lists], ["doc_id", "key", "bands"])


def _compare(rows: np.ndarray, grams: np.ndarray, n: int, similarity: float) -> np.ndarray:
    """Which of n texts are similar to which; rows and grams as from ``shingles``."""
    order = np.lexsort((grams, rows))
    rows, grams = rows[order], grams[order]
    new = np.append(True, (rows[1:] != rows[:-1]) | (grams[1:] != grams[:-1])) if len(rows) else np.zeros(0, bool)
    rows, grams = rows[new], grams[new]
    size = np.bincount(rows, minlength=n)
    _, code, count = np.unique(grams, return_inverse=True, return_counts=True)
    shared = count[code] > 1
    rows, code = rows[shared], np.unique(code[shared], return_inverse=True)[1]
    common = np.zeros((n, n), np.float32)
    step = 4096
    order = np.argsort(code, kind="stable")
    rows, code = rows[order], code[order]
    for low in range(0, int(code.max()) + 1 if len(code) else 0, step):
        a, b = np.searchsorted(code, [low, low + step])
        some = np.zeros((n, step), np.float32)
        some[rows[a:b], code[a:b] - low] = 1
        common += some @ some.T
    union = size[:, None] + size[None, :] - common
    return (common >= similarity * union - 1e-6) & (common > 0) & ~np.eye(n, dtype=bool)


def _forest(links: np.ndarray) -> list[tuple[int, int]]:
    """Edges that connect what the links connect."""
    left, edges = set(range(len(links))), []
    while left:
        queue = [left.pop()]
        while queue:
            a = queue.pop()
            for b in [b for b in np.flatnonzero(links[a]).tolist() if b in left]:
                left.discard(b)
                edges.append((a, b))
                queue.append(b)
    return edges


LINKS = "a long, b long, n_texts long, n_documents long"


def _verify(batches: Iterator[pa.RecordBatch], n: int, similarity: float) -> Iterator[pa.RecordBatch]:
    """Per text (a) of a piece of work how many others it is similar to, and edges (a, b) that connect them.

    Rows come sorted by piece. A piece that is one band's bucket (band >= 0)
    leaves a pair to the first band that both texts share; one that pairs two
    blocks (side 1 and 2) only compares across.
    """

    def piece(t: pa.Table) -> pa.RecordBatch:
        out: list[tuple] = []
        names = np.asarray(t["piece"])
        rows, grams = shingles(texts_of(t.select(["text"]).combine_chunks().to_batches()[0]), n)
        cuts = [0, *(np.flatnonzero(names[1:] != names[:-1]) + 1).tolist(), len(names)]
        ids, copies, side, band = (np.asarray(t[c]) for c in ("rep", "copies", "side", "band"))
        for a, b in zip(cuts, cuts[1:]):
            u, v = np.searchsorted(rows, [a, b])
            like = _compare(rows[u:v] - a, grams[u:v], b - a, similarity)
            like &= ids[a:b, None] != ids[None, a:b]
            if len(set(side[a:b].tolist())) > 1:
                like &= side[a:b, None] != side[None, a:b]
            if band[a] >= 0:
                own = np.array(t["bands"].slice(a, b - a).to_pylist(), np.int64)
                for k in range(int(band[a])):
                    like &= own[:, None, k] != own[None, :, k]
            n_texts, n_documents = like.sum(axis=1), like @ copies[a:b]
            out += [(i, None, x, y) for i, x, y in zip(ids[a:b].tolist(), n_texts.tolist(), n_documents.tolist()) if x]
            out += [(int(ids[a + i]), int(ids[a + j]), None, None) for i, j in _forest(like)]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out) if out else ((),) * 4)], ["a", "b", "n_texts", "n_documents"])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        names = np.asarray(batch["piece"])
        start = int(np.searchsorted(names != names[-1], False)) if names[0] == names[-1] else int(np.flatnonzero(names != names[-1])[-1]) + 1
        if held and (start or held[-1]["piece"][-1] != batch["piece"][0]):
            yield piece(pa.Table.from_batches([*held, batch.slice(0, start)]))
            held = []
        elif start:
            yield piece(pa.Table.from_batches([batch.slice(0, start)]))
        held.append(batch.slice(start))
    if held:
        yield piece(pa.Table.from_batches(held))


def _small(df: DataFrame, most: int) -> DataFrame:
    """A broadcast hint for a checkpointed table of numbers with at most ``most`` rows."""
    return F.broadcast(df) if df.count() <= most else df


def ngram_join(docs: DataFrame, n: int = WORDS, similarity: float = SIMILARITY, recall: float = RECALL, block: int = BLOCK, most_broadcast: int = 500_000) -> DataFrame:
    """(doc_id, class_id, n_links, n_text_links) for each row of ``docs`` (doc_id, text).

    class_id is the least doc_id that a row reaches over links, n_links the
    number of other rows that are copies or similar, n_text_links the number of
    similar texts that differ. Words are split at ASCII white space; a text of
    fewer than n words has one n-gram of them all. Texts without words (null
    ones too) and rows with a null doc_id have no links; rows that share a
    doc_id are one document. Other columns are ignored; no rows give no rows.

    Copies become one text first. Texts that share a band bucket are joined
    into candidate components by one edge to the bucket's least text, so a
    bucket of m texts gives m rows. A component of up to ``block`` texts is one
    piece of work: its texts travel once and all its pairs are compared. A
    larger one is compared bucket by bucket, and a larger bucket by pairs of
    blocks. Pieces return counts and connecting edges, never all pairs.
    """
    bands, depth = bands_for(similarity, recall)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("key", F.md5("text"))
    signed = checkpointed(texts.mapInArrow(lambda it: _sign(it, n, bands, depth), "doc_id long, key string, bands array<long>"))
    named = signed.filter("doc_id is not null and bands is not null")
    reps = checkpointed(named.groupBy("key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("bands").alias("bands")))
    cells = reps.select("rep", F.posexplode("bands").alias("band", "bucket"))
    buckets = cells.groupBy("bucket").agg(F.min("rep").alias("least"), F.count("*").alias("size")).filter("size > 1")
    shared = checkpointed(cells.join(buckets, "bucket"))
    candidates = components(shared.select(F.col("rep").alias("a"), F.col("least").alias("b")))
    sizes = candidates.groupBy("component").agg(F.count("*").alias("members"))
    placed = checkpointed(candidates.join(sizes, "component"))

    whole = placed.filter(F.col("members") <= block).select(F.col("node").alias("rep"), F.col("component").alias("piece"), F.lit(0).alias("side"), F.lit(-1).alias("band"))
    large = shared.join(placed.filter(F.col("members") > block).select(F.col("node").alias("rep")), "rep")
    blocks = F.ceil(F.col("size") / block).cast("int")
    mine = F.pmod(F.hash("rep"), blocks)
    split = large.withColumns({"mine": mine, "other": F.explode(F.sequence(F.lit(0), blocks - 1))})
    # a block's own pairs are compared once, in the piece that pairs it with itself
    by_bucket = split.select("rep", F.xxhash64("bucket", F.least("mine", "other"), F.greatest("mine", "other")).alias("piece"), F.when(F.col("mine") == F.col("other"), 0).when(F.col("mine") < F.col("other"), 1).otherwise(2).alias("side"), "band")
    work = whole.join(reps.withColumn("bands", F.lit(None).cast("array<bigint>")), "rep").unionByName(by_bucket.join(reps, "rep"))
    work = checkpointed(work)
    fetched = texts.select(F.col("doc_id").alias("rep"), "key", "text").join(_small(work, most_broadcast // 5), ["rep", "key"])
    pieces = fetched.select("piece", "rep", "copies", "side", "band", "bands", "text").repartition("piece").sortWithinPartitions("piece", "rep")
    links = checkpointed(pieces.mapInArrow(lambda it: _verify(it, n, similarity), LINKS))

    counts = links.filter("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("n_texts").alias("n_texts"), F.sum("n_documents").alias("n_documents"))
    classes = components(links.filter("b is not null").select("a", "b")).withColumnRenamed("node", "rep")
    groups = reps.filter("copies > 1").select("key", F.col("rep").alias("of"), "copies")
    rows = signed.select("doc_id", F.when(F.col("doc_id").isNotNull() & F.col("bands").isNotNull(), F.col("key")).alias("key"))
    rows = rows.join(_small(checkpointed(groups), most_broadcast), "key", "left").withColumn("rep", F.coalesce("of", "doc_id"))
    found = checkpointed(classes.join(counts, "rep", "left"))
    rows = rows.join(_small(found, most_broadcast), "rep", "left")
    return rows.select(
        "doc_id", F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.coalesce("component", "rep")).alias("class_id"),
        (F.coalesce("copies", F.lit(1)) - 1 + F.when(F.col("key").isNull(), 0).otherwise(F.coalesce("n_documents", F.lit(0)))).cast("long").alias("n_links"),
        F.when(F.col("key").isNull(), 0).otherwise(F.coalesce("n_texts", F.lit(0))).cast("long").alias("n_text_links"),
    )


def keep_one(docs: DataFrame, most_broadcast: int = 500_000) -> DataFrame:
    """``docs`` with one document of each class, the one with the least doc_id; all columns as they are. Rows with a null doc_id stay."""
    judged = ngram_join(docs)
    gone = checkpointed(judged.filter("class_id <> doc_id").select("doc_id").distinct())
    left = docs.join(_small(gone, most_broadcast), "doc_id", "left_anti").select(*docs.columns)
    twice = checkpointed(docs.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").select("doc_id"))
    if twice.isEmpty():
        return left
    again = _small(twice, most_broadcast)
    return left.join(again, "doc_id", "left_anti").unionByName(left.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id"])).select(*docs.columns)


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(table(spark, sf_dir, "documents").select("doc_id", "text"))
