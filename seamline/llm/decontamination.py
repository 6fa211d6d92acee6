"""Benchmark decontamination: a BM25 index of test items, searched by every passage of the corpus."""

from __future__ import annotations

import math
import pickle
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, table, text_slices, texts_of, words_of

K1, B = 1.2, 0.75
#: Least share of an item's own BM25 score that a passage must reach, and least shares of its question's and answer's word triples.
THRESHOLD, QUESTION, ANSWER = 0.6, 0.6, 0.6
#: MOST_ITEMS items make one part of the index, and AT_ONCE parts are searched in one pass over the corpus.
GRAM, BLOCK, MOST_ITEMS, AT_ONCE = 3, 16, 20_000, 8


def normal(words: pa.Array) -> pa.Array:
    """Lower-case words without signs at their edges; items and texts are both brought to this form."""
    return pc.utf8_lower(pc.replace_substring_regex(words, r"^[^\pL\pN]+|[^\pL\pN]+$", ""))


def plain_words(text: str | None) -> list[str]:
    """Normal words of a text; words of signs alone are left out."""
    return [w for w in normal(pa.array(re.findall(r"[^\x20\x09-\x0D]+", text or ""), pa.large_string())).to_pylist() if w]


def question_and_answer(text: str | None) -> tuple[list[str], list[str]]:
    """The last sentence is the answer; of a single sentence, its last quarter."""
    parts = [p for p in map(plain_words, re.split(r"(?<=[.!?])\s+", text or "")) if p]
    if len(parts) > 1:
        return [w for p in parts[:-1] for w in p], parts[-1]
    words = parts[0] if parts else []
    cut = len(words) - math.ceil(len(words) / 4)
    return words[:cut], words[cut:]


def grams(words: list[str]) -> set[tuple[str, ...]]:
    n = min(GRAM, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if n else set()


def overlap(wanted: list[str], words: list[str]) -> float:
    """Share of the wanted words' n-grams (triples; all words where there are fewer) that occur; 1 if none are wanted."""
    need = grams(wanted)
    n = min(GRAM, len(wanted))
    return len(need & {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}) / len(need) if need else 1.0


@dataclass
class Whole:
    """What scores need of all items: their number, their words, the longest one's words, and in how many items each term is."""

    items: int
    words: int
    span: int
    df: dict


@dataclass
class Index:
    """Postings by term, with impacts that sum to 1 over an item's own terms, so a score is the share of an item that a passage covers.

    Terms in very many items are *common*: so many of them that no item has
    THRESHOLD by its common terms alone. A hit needs another term, so only
    those start a search; ``spare`` is what common terms may add at most.
    """

    ids: list
    questions: list[list[str]]
    answers: list[list[str]]
    terms: pa.Array
    at: np.ndarray  # postings of term t: at[t] to at[t + 1]
    item: np.ndarray
    impact: np.ndarray
    common: np.ndarray
    spare: np.ndarray
    block_at: np.ndarray  # the same for blocks of items
    block: np.ndarray
    block_first: np.ndarray  # a term's postings in a block are these, up to the next entry's
    block_max: np.ndarray
    block_spare: np.ndarray
    span: int  # words of the longest item

    @staticmethod
    def of(items: list[tuple], threshold: float = THRESHOLD, whole: Whole | None = None) -> Index:
        """Index of some items (id, text); document frequencies, mean length and span are those of the whole collection, so scores don't depend on the cut into parts."""
        split = [question_and_answer(text) for _, text in items]
        counts = [Counter(q + a) for q, a in split]
        lengths = [max(1, sum(c.values())) for c in counts]
        whole = whole or Whole(len(items), sum(lengths), max([1, *lengths]), Counter(t for c in counts for t in c))
        mean, n = whole.words / max(1, whole.items), len(items)
        idf = {t: math.log(1 + (whole.items - whole.df[t] + 0.5) / (whole.df[t] + 0.5)) for c in counts for t in c}
        weight = [{t: idf[t] * f * (K1 + 1) / (f + K1 * (1 - B + B * size / mean)) for t, f in c.items()} for c, size in zip(counts, lengths)]
        own = [sum(w.values()) for w in weight]
        terms = sorted(idf)
        code = {t: k for k, t in enumerate(terms)}
        posts = sorted((code[t], i, x / own[i]) for i, w in enumerate(weight) for t, x in w.items())
        term, item, impact = (np.array(x, k) for x, k in zip(zip(*posts) if posts else ((), (), ()), (np.int64, np.int64, float)))
        at = np.searchsorted(term, np.arange(len(terms) + 1))
        common, spare = np.zeros(len(terms), bool), np.zeros(n)
        for t in sorted(range(len(terms)), key=lambda t: (at[t] - at[t + 1], t)):
            more = spare.copy()
            more[item[at[t] : at[t + 1]]] += impact[at[t] : at[t + 1]]
            if more.max() >= threshold - 1e-9:
                break
            spare, common[t] = more, True
        pair, first, where = np.unique(term * (n // BLOCK + 1) + item // BLOCK, return_index=True, return_inverse=True)
        block_max = np.zeros(len(pair))
        np.maximum.at(block_max, where, impact)
        block_at = np.searchsorted(pair // (n // BLOCK + 1), np.arange(len(terms) + 1))
        block_spare = np.zeros(n // BLOCK + 1)
        np.maximum.at(block_spare, np.arange(n) // BLOCK, spare)
        return Index(
            [i for i, _ in items], [q for q, _ in split], [a for _, a in split], pa.array(terms, pa.large_string()), at, item, impact, common, spare,
            block_at, pair % (n // BLOCK + 1), np.append(first, len(term)), block_max, block_spare, whole.span,
        )


def _expand(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Numbers first[k] to first[k] + sizes[k] for each k in a row."""
    return np.repeat(first - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


def _sums(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys, where = np.unique(keys, return_inverse=True)
    return keys, np.bincount(where, weights=values, minlength=len(keys))


def search(index: Index, passage: np.ndarray, term: np.ndarray, threshold: float = THRESHOLD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All (passage, item, score) of at least ``threshold``; (passage, term) are distinct pairs, sorted.

    Block-max WAND for many passages at once. The pivot is found by block: a
    block of items is open for a passage if the largest impacts of its uncommon
    terms there, and what common ones may add, reach the threshold. Postings of
    other blocks are skipped unread. In open blocks the items are bounded in
    the same way, and exact scores by all terms are summed for the rest.
    """
    n_blocks, n_items = len(index.block_spare), max(1, len(index.ids))

    def entries(p: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(passage and block, entry of the block list) of each pair."""
        sizes = index.block_at[t + 1] - index.block_at[t]
        at = _expand(index.block_at[t], sizes)
        return np.repeat(p, sizes) * n_blocks + index.block[at], at

    def postings(key: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(passage and item, impact) of each posting of entries."""
        sizes = index.block_first[at + 1] - index.block_first[at]
        post = _expand(index.block_first[at], sizes)
        return np.repeat(key // n_blocks, sizes) * n_items + index.item[post], index.impact[post]

    rare = ~index.common[term]
    key, at = entries(passage[rare], term[rare])
    blocks, bound = _sums(key, index.block_max[at])
    open_ = blocks[bound + index.block_spare[blocks % n_blocks] >= threshold - 1e-9]
    inside = np.isin(key, open_)
    items, part = _sums(*postings(key[inside], at[inside]))
    items = items[part + index.spare[items % n_items] >= threshold - 1e-9]
    mine = np.isin(passage, items // n_items)
    key, at = entries(passage[mine], term[mine])
    inside = np.isin(key, items // n_items * n_blocks + items % n_items // BLOCK)
    full, impact = postings(key[inside], at[inside])
    inside = np.isin(full, items)
    key, score = _sums(full[inside], impact[inside])
    good = score >= threshold - 1e-9
    return key[good] // n_items, key[good] % n_items, score[good]


def matches(texts: pa.Array, index: Index) -> dict[tuple[int, int], tuple[float, float, float]]:
    """(text number, item number): best score and the overlaps of question and answer, for verified items.

    Passages are windows of two item lengths, each one item length after the
    last, so every stretch as long as an item lies whole in one of them.
    """
    rows, word, distinct = words_of(texts)
    plain = normal(distinct)
    keep = np.asarray(pc.binary_length(plain))[word] > 0 if len(word) else np.zeros(0, bool)
    rows, word = rows[keep], word[keep]
    starts = np.searchsorted(rows, np.arange(len(texts) + 1))
    term = np.asarray(pc.fill_null(pc.index_in(plain, value_set=index.terms), -1)).astype(np.int64)[word]
    position = np.arange(len(rows)) - starts[rows]
    base = int(position.max()) // index.span + 2 if len(rows) else 1
    known = term >= 0
    passage = rows[known] * base + position[known] // index.span
    both = np.concatenate([passage, passage[position[known] >= index.span] - 1])
    terms = np.concatenate([term[known], term[known][position[known] >= index.span]])
    pairs = np.unique(both * (len(index.terms) + 1) + terms)
    found: dict[tuple[int, int], tuple[float, float, float]] = {}
    for p, item, score in zip(*(x.tolist() for x in search(index, pairs // (len(index.terms) + 1), pairs % (len(index.terms) + 1)))):
        row, start = p // base, starts[p // base] + p % base * index.span
        words = plain.take(pa.array(word[start : min(start + 2 * index.span, starts[row + 1])])).to_pylist()
        question, answer = overlap(index.questions[item], words), overlap(index.answers[item], words)
        if question >= QUESTION and answer >= ANSWER:
            found[row, item] = max(found.get((row, item), (0.0, 0.0, 0.0)), (score, question, answer))
    return found


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each item's number of words and distinct words; items without words are left out."""
    for batch in batches:
        found = [Counter(w for part in question_and_answer(t) for w in part) for t in texts_of(batch).to_pylist()]
        kept = pa.array([bool(c) for c in found])
        columns = [pa.array([sum(c.values()) for c in found], pa.int64()), pa.array([list(c) for c in found], pa.list_(pa.string()))]
        yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, "n", "words"]).filter(kept)


def indexes(items: DataFrame, id: str = "item_id", text: str = "text", most_items: int = MOST_ITEMS) -> Iterator[Index]:
    """The index in parts of at most ``most_items`` items each; all items are covered.

    Statistics are summed by Spark over all items. Parts are ranges of the
    items' order and each is built by one task; the driver passes on a finished
    part at a time.
    """
    kept = items.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text"))
    fields = [f"id {kept.schema['id'].dataType.simpleString()}", "text string"]
    kept = checkpointed(kept.mapInArrow(_split, ", ".join([*fields, "n long", "words array<string>"])))
    total = kept.agg(F.count("*").alias("items"), F.sum("n").alias("words"), F.max("n").alias("span")).first()
    if not total["items"]:
        return
    df = checkpointed(kept.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("df")))
    parts = -(-total["items"] // most_items)
    dealt = kept.select("id", "text").repartitionByRange(parts, "id", "text").sortWithinPartitions("id", "text") if parts > 1 else kept.select("id", "text").coalesce(1).sortWithinPartitions("id", "text")
    shared = kept.sparkSession.sparkContext.broadcast(Whole(total["items"], total["words"], total["span"], {r.word: r.df for r in df.toLocalIterator()}))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [tuple(r.values()) for batch in batches for r in batch.to_pylist()]
        for k in range(0, len(rows), most_items):
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(Index.of(rows[k : k + most_items], whole=shared.value))], pa.binary())], ["part"])

    for row in dealt.mapInArrow(build, "part binary").toLocalIterator():
        yield pickle.loads(row.part)


def _searched(docs: DataFrame, items: DataFrame, find: Callable) -> Iterator[Callable]:
    """For each AT_ONCE parts of the index a function for mapInArrow, which calls ``find`` with each slice of ``docs`` and its hits: (row, item id) to (score, question, answer)."""
    sc = docs.sparkSession.sparkContext
    shared: list = []

    def search_all(batches: Iterator[pa.RecordBatch], parts: list) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            hits: dict = {}
            for part in parts:
                own = part.value
                for (row, item), found in matches(texts_of(batch), own).items():
                    hits.setdefault((row, own.ids[item]), []).append(found)
            yield find(batch, hits)

    for own in indexes(items):
        shared.append(sc.broadcast(own))
        if len(shared) == AT_ONCE:
            yield lambda batches, parts=tuple(shared): search_all(batches, parts)
            shared = []
    if shared:
        yield lambda batches, parts=tuple(shared): search_all(batches, parts)


def contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap) for each text of ``docs`` that holds an item.

    Whole texts are searched, very long ones too. Null and empty texts, and
    items without words, match nothing; items alike in text each match, and
    items that share an id give a row each; a repeated row gives its rows
    again; other columns are ignored; empty tables give no rows. Each task
    searches its own rows by the broadcast index: there is no shuffle.
    """
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    item_type = dict(items.dtypes)["item_id"]
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, item_id {item_type}, score double, question_overlap double, answer_overlap double"

    def pairs(batch: pa.RecordBatch, hits: dict) -> pa.RecordBatch:
        flat = [(r, i, *v) for (r, i), values in hits.items() for v in values]
        row, item, *numbers = zip(*flat) if flat else ((),) * 5
        ids = batch["doc_id"].take(pa.array(row, pa.int64()))
        return pa.RecordBatch.from_arrays([ids, pa.array(item, pa.int64() if item_type == "bigint" else None if item else pa.string()), *(pa.array(x, pa.float64()) for x in numbers)], ["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])

    out = docs.sparkSession.createDataFrame([], schema)
    for find in _searched(rows, items, pairs):
        out = out.unionByName(rows.mapInArrow(find, schema))
    return out


def decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text holds no item, all columns as they are."""

    def clean(batch: pa.RecordBatch, hits: dict) -> pa.RecordBatch:
        bad = {r for r, _ in hits}
        return batch.filter(pa.array([r not in bad for r in range(batch.num_rows)]))

    for find in _searched(docs, items, clean):
        docs = docs.mapInArrow(find, docs.schema)
    return docs


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
