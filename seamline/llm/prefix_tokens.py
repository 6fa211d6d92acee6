"""Exact token counts at every prefix of a text, by dynamic programming over the pieces of a byte-pair model."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_slices, texts_of

#: The model's sign for a blank; one stands before every text that isn't empty.
BLANK = "▁"
#: Runs of signs that no cut divides are followed one by one from this length; shorter ones are followed side by side.
LONG = 256
LIMIT = 4096


class Lookup:
    """Numbers by non-negative 64-bit keys, for arrays of keys; -1 for others."""

    def __init__(self, found: dict[int, int]):
        self.sorted = np.array(sorted(found), np.int64)
        self.values = np.array([found[int(k)] for k in self.sorted], np.int64)
        self.shift = np.uint64(64 - max(10, (16 * len(found)).bit_length()))
        self.keys = np.full(1 << (64 - int(self.shift)), -1, np.int64)
        self.own = np.full(len(self.keys), -1, np.int32)
        at = self._slot(self.sorted)
        self.keys[at], self.own[at] = self.sorted, self.values

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        at = self._slot(keys)
        there = self.keys[at]
        out = np.where(there == keys, self.own[at], np.int32(-1))
        odd = np.flatnonzero((there != keys) & (there >= 0))  # another key has the slot
        if len(odd):
            i = np.minimum(np.searchsorted(self.sorted, keys[odd]), len(self.sorted) - 1)
            out[odd] = np.where(self.sorted[i] == keys[odd], self.values[i], -1)
        return out


class Pieces:
    """What the rule needs of a model; its size is bounded by the vocabulary.

    A text's tokens come from joining signs: again and again the neighbours
    whose joint piece has the best score, the leftmost of equals. So the tokens
    of a text without its last token are those of the shorter text, and tokens
    are those of their text just when each two neighbours are those of theirs.
    Hence each prefix has one last token that fits the last token before it,
    and its count is one more than the count there.
    """

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        if model.normalize(" a ﬁ  b ") != f"{BLANK}{BLANK}a{BLANK}ﬁ{BLANK}{BLANK}b{BLANK}":
            raise ValueError("the model changes texts beyond blanks")
        normal = [i for i in range(model.get_piece_size()) if not (model.is_unknown(i) or model.is_control(i) or model.is_byte(i) or model.is_unused(i))]
        self.text = [model.id_to_piece(i) for i in normal]
        self.id = {p: k for k, p in enumerate(self.text)}
        self.score = [model.get_score(i) for i in normal]
        signs = sorted({c for p in self.text for c in p})
        if not all(c in self.id for c in signs):
            raise ValueError("each sign of a piece must be a piece")
        self.code = np.zeros(0x110000, np.uint16)
        self.code[[ord(c) for c in signs]] = np.arange(1, len(signs) + 1)
        self.code[ord(" ")] = self.code[ord(BLANK)]
        self.signs = len(signs) + 1
        self._splits()
        self._trie()
        self.inside = np.zeros((self.signs, self.signs), bool)
        for p in self.text:
            own = self.code[[ord(c) for c in p]]
            self.inside[own[:-1], own[1:]] = True
        self.known = np.full(1 << 19, -1, np.int64)
        self.fit = np.zeros(1 << 19, bool)

    def joined(self, signs: list[str]) -> tuple[list[str], tuple[str, str] | None]:
        """The pieces of a few signs by the model's own joining, and the last two that were joined."""
        last = None
        while True:
            best = max(((self.score[k], -i) for i in range(len(signs) - 1) if (k := self.id.get(signs[i] + signs[i + 1])) is not None), default=None)
            if best is None:
                return signs, last
            i = -best[1]
            last = signs[i], signs[i + 1]
            signs = [*signs[:i], signs[i] + signs[i + 1], *signs[i + 2 :]]

    def _splits(self) -> None:
        """The two pieces that each piece is joined from last, and whether all joins below have better scores."""
        n = len(self.text)
        place = {s: k for k, s in enumerate(sorted({-s for s in self.score}))}
        self.rank = np.array([-1 if len(p) == 1 else place[-s] for p, s in zip(self.text, self.score)], np.int64)
        self.joint = np.array([place[-s] for s in self.score], np.int64)
        self.left, self.right, self.whole, self.steady = np.full(n, -1), np.full(n, -1), np.ones(n, bool), np.ones(n, bool)
        for k in sorted(range(n), key=lambda k: len(self.text[k])):
            if len(self.text[k]) == 1:
                continue
            parts, last = self.joined(list(self.text[k]))
            self.whole[k] = len(parts) == 1
            if self.whole[k]:
                a, b = self.id[last[0]], self.id[last[1]]
                self.left[k], self.right[k] = a, b
                self.steady[k] = self.steady[a] and self.steady[b] and max(self.rank[a], self.rank[b]) < self.rank[k]
        pairs = {}
        for k, p in enumerate(self.text):
            for i in range(1, len(p)):
                a, b = self.id.get(p[:i]), self.id.get(p[i:])
                if a is not None and b is not None:
                    pairs[a * n + b] = k
        self.pair = Lookup(pairs)

    def _trie(self) -> None:
        """Nodes for the beginnings of pieces, and the piece that ends in each."""
        edges, ends = {}, [-1]
        for k, p in enumerate(self.text):
            node = 0
            for c in self.code[[ord(c) for c in p]].tolist():
                key = node * self.signs + c
                if key not in edges:
                    edges[key] = len(ends)
                    ends.append(-1)
                node = edges[key]
            if self.whole[k]:
                ends[node] = k
        self.edges, self.child, self.end = edges, Lookup(edges), np.array(ends, np.int32)
        self.longest = max(map(len, self.text))

    def _fits(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the text of pieces a and b has just these tokens.

        Their joins are undone from the last one back: at no time may the
        piece that reaches over the boundary be better than the next join. Of
        equals the leftmost comes first, so a's does and b's doesn't.
        """
        n = len(self.text)
        out = np.ones(len(a), bool)
        odd = np.flatnonzero(~(self.steady[a] & self.steady[b]))
        for i in odd.tolist():
            x, y = self.text[a[i]], self.text[b[i]]
            out[i] = self.joined(list(x + y))[0] == [x, y]
        at = np.flatnonzero(self.steady[a] & self.steady[b])
        x, y, limit = a[at].astype(np.int64), b[at].astype(np.int64), np.full(len(at), len(self.joint) + 1)
        while len(at):
            over = self.pair(x * n + y)
            bad = (over >= 0) & (self.joint[over] < limit)
            out[at[bad]] = False
            go = ~bad & ((self.rank[x] >= 0) | (self.rank[y] >= 0))
            at, x, y = at[go], x[go], y[go]
            first = self.rank[x] > self.rank[y]
            limit = np.where(first, self.rank[x], self.rank[y] + 1)
            x, y = np.where(first, self.right[x], x), np.where(first, y, self.left[y])
        return out

    def fits(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The same with a memory of fixed size; a of -1 is the beginning, which all fit."""
        key = (a.astype(np.int64) + 1) * (len(self.text) + 1) + b
        slot = ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(45)).astype(np.int64)
        out = self.fit[slot] | (a < 0)
        miss = np.flatnonzero((self.known[slot] != key) & (a >= 0))
        if len(miss):
            keys, first, into = np.unique(key[miss], return_index=True, return_inverse=True)
            first = miss[first]
            own = self._fits(a[first], b[first])
            self.known[slot[first]], self.fit[slot[first]] = keys, own
            out[miss] = own[into]
        return out

    def counts(self, codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Token counts at every prefix of runs of signs that lie end to end in ``codes``."""
        out, last = np.zeros(len(codes), np.int32), np.full(len(codes), -1, np.int32)
        for k in np.flatnonzero(sizes > LONG).tolist():
            out[starts[k] : starts[k] + sizes[k]] = self._one(codes[starts[k] : starts[k] + sizes[k]].tolist())
        order = np.flatnonzero(sizes <= LONG)
        order = order[np.argsort(-sizes[order], kind="stable")]
        begins, ends = starts[order], (starts + sizes)[order]
        for i in range(int(sizes[order].max(initial=0))):
            n = int(np.searchsorted(begins - ends, -i))  # runs longer than i
            at, until = begins[:n] + i, ends[:n]
            before = last[at - 1] if i else np.full(n, -1, np.int32)
            base = out[at - 1] if i else np.zeros(n, np.int32)
            node = np.zeros(n, np.int64)
            for _ in range(self.longest):
                node = self.child(node * self.signs + codes[at])
                piece = self.end[node]
                hit = np.flatnonzero((node >= 0) & (piece >= 0))
                hit = hit[self.fits(before[hit], piece[hit])]
                last[at[hit]], out[at[hit]] = piece[hit], base[hit] + 1
                go = np.flatnonzero((node >= 0) & (at + 1 < until))
                if not len(go):
                    break
                node, at, until, before, base = node[go].astype(np.int64), at[go] + 1, until[go], before[go], base[go]
        return out

    def _one(self, codes: list[int]) -> list[int]:
        """The same for one run, sign by sign."""
        edges, end, signs, seen = self.edges, self.end.tolist(), self.signs, {}
        count, last = [0] * (len(codes) + 1), [-1] * (len(codes) + 1)
        for i in range(len(codes)):
            node, before = 0, last[i]
            for j in range(i, min(len(codes), i + self.longest)):
                node = edges.get(node * signs + codes[j])
                if node is None:
                    break
                piece = end[node]
                if piece >= 0:
                    ok = seen.get((before, piece))
                    if ok is None:
                        ok = seen[before, piece] = bool(self.fits(np.array([before]), np.array([piece]))[0])
                    if ok:
                        count[j + 1], last[j + 1] = count[i] + 1, piece
        return count[1:]

    def prefixes(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Token counts at every prefix of each text, end to end, and the number of signs of each text.

        A sign that no piece holds is as many tokens as it has bytes. Texts are
        cut where no piece holds both neighbours, and equal runs are followed once.
        """
        sizes = np.asarray(pc.utf8_length(texts)).astype(np.int64)
        full = sizes + (sizes > 0)
        ends = np.cumsum(full)
        points = np.frombuffer("".join(f" {t}" if t else "" for t in texts.to_pylist()).encode("utf-32-le"), np.uint32)
        codes = self.code[points]
        cut = np.ones(len(codes), bool)
        cut[1:] = ~self.inside[codes[:-1], codes[1:]]
        heads = (ends - full)[full > 0]
        cut[heads] = True
        starts = np.flatnonzero(cut)
        lengths = np.diff(starts, append=len(codes))
        runs = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(2 * np.append(starts, len(codes)).astype(np.int64)), pa.py_buffer(codes)])
        coded = runs.dictionary_encode()
        which = np.asarray(coded.indices).astype(np.int64)
        own = pc.binary_length(coded.dictionary).to_numpy(zero_copy_only=False).astype(np.int64) // 2
        at = np.cumsum(own) - own
        flat = np.frombuffer(b"".join(coded.dictionary.to_pylist()), np.uint16)
        tables = self.counts(flat, at, own)
        within = tables[np.repeat(at[which] - starts, lengths) + np.arange(len(codes))].astype(np.int64)
        unknown = codes == 0
        within[unknown] = 1 + (points[unknown] > 0x7F) + (points[unknown] > 0x7FF) + (points[unknown] > 0xFFFF)
        total = within[starts + lengths - 1] if len(starts) else np.zeros(0, np.int64)
        upto = np.cumsum(total) - total
        upto -= np.repeat(upto[np.searchsorted(starts, heads)], np.diff(np.searchsorted(starts, heads), append=len(starts)))
        found = within + np.repeat(upto, lengths)
        keep = np.ones(len(codes), bool)
        keep[heads] = False
        return found[keep], sizes


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def longest_within(counts: np.ndarray, sizes: np.ndarray, limit: int) -> np.ndarray:
    """Signs of each text's longest prefix of at most ``limit`` tokens."""
    starts = np.cumsum(sizes) - sizes
    ok = np.flatnonzero(counts <= limit)
    last = np.searchsorted(ok, starts + sizes) - 1
    found = ok[np.maximum(last, 0)] + 1 - starts if len(ok) else np.zeros(len(sizes), np.int64)
    return np.where((last >= 0) & (found > 0), found, 0)


def count_prefixes(docs: DataFrame, model: str, limit: int = LIMIT, keep_counts: bool = False, slice_bytes: int = 2 << 20) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, fits_chars[, counts]) for each row of ``docs`` (doc_id, text).

    counts[i] is the exact number of tokens of the first i + 1 code points, as
    the model's library gives it for that prefix; n_tokens is its last entry
    and fits_chars the length of the longest prefix of at most ``limit``
    tokens. With ``keep_counts`` the counts are a column, from which
    ``tokens_of_prefix`` and ``prefix_within`` answer any other limit without
    encoding again; Parquet stores them in about a byte for each sign.

    Every task works on its own rows, about ``slice_bytes`` of text at once, so
    nothing is shuffled; one very long text is one slice. A null text counts as
    empty: no bytes and no tokens. A null doc_id stays null, repeated rows are
    counted each for itself, other columns are ignored and no rows give no rows.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pieces(model)
        for batch in text_slices(batches, most=slice_bytes):
            texts = texts_of(batch)
            counts, sizes = own.prefixes(texts)
            ends = np.cumsum(sizes)
            total = np.zeros(len(sizes), np.int64)
            total[sizes > 0] = counts[ends[sizes > 0] - 1]
            columns = [batch["doc_id"], pc.binary_length(texts).cast(pa.int64()), pa.array(total), pa.array(longest_within(counts, sizes, limit))]
            if keep_counts:
                columns.append(pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(counts.astype(np.int32))))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_tokens", "fits_chars", "counts"][: len(columns)])

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_bytes long, n_tokens long, fits_chars long" + ", counts array<int>" * keep_counts
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(rows, schema)


def tokens_of_prefix(counts: Column, chars: Column) -> Column:
    """Tokens of the first ``chars`` code points, from stored counts; of all where the text is shorter."""
    at = F.least(chars, F.size(counts))
    return F.when(at <= 0, 0).otherwise(F.get(counts, at - 1)).cast("long")


def prefix_within(counts: Column, limit: Column) -> Column:
    """Code points of the longest prefix of at most ``limit`` tokens, from stored counts. A longer prefix may have fewer tokens, so the last one counts."""
    ok = F.array_position(F.transform(F.reverse(counts), lambda n: n <= limit), True)
    return F.when(ok == 0, 0).otherwise(F.size(counts) + 1 - ok).cast("long")


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op11_prefix_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = count_prefixes(table(spark, sf_dir, "documents").select("doc_id", "text"), model_path())
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"), "fits_chars")
