"""Harmonic packing of token sequences."""

from __future__ import annotations

import os
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_slices, texts_of, words_of

#: Stands between words that are encoded as one text.
SEPARATOR = "•"
PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


class WordTokens:
    """Token ids of texts by way of their words.

    The tokenizer turns white space into a separator and never joins what
    stands on either side, so a text's ids are its words' ids in order. Words
    recur, so each is encoded once while it stays among the last ``most``.
    """

    def __init__(self, path: str, most: int = 600_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.stops = pa.array([self.tokenizer.encode(c, add_special_tokens=False).ids[0] for c in ".,"], pa.uint32())
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True
        self.apart = self.tokenizer.encode(SEPARATOR, add_special_tokens=False).ids
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {"": 0}
        self.pool, self.at, self.uses = np.zeros(1 << 20, np.uint32), np.zeros(1 << 18, np.int64), np.zeros(1 << 18, np.int32)

    def shrink(self) -> None:
        """Forget all but the words that are used most, half of ``most``."""
        n = len(self.known)
        keep = np.sort(np.argsort(-self.uses[1:n], kind="stable")[: self.most // 2] + 1)
        old, uses = (self.at, self.pool), self.uses[keep]
        number = np.full(n, -1)
        number[keep] = np.arange(1, len(keep) + 1)
        known = {w: k for w, i in self.known.items() if (k := int(number[i])) > 0}
        self.clear()
        self.known.update(known)
        sizes = old[0][keep + 1] - old[0][keep]
        self._grow(len(keep) + 1, int(sizes.sum()))
        self.at[2 : len(keep) + 2] = np.cumsum(sizes)
        self.pool[: sizes.sum()] = old[1][np.repeat(old[0][keep] - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))]
        self.uses[1 : len(keep) + 1] = uses // 2

    def _grow(self, entries: int, ids: int) -> None:
        while len(self.at) < entries + 1:
            self.at, self.uses = (np.concatenate([x, np.zeros_like(x)]) for x in (self.at, self.uses))
        while len(self.pool) < ids:
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])

    def add(self, stems: list[str], letters: bool) -> None:
        for k in range(0, len(stems), 4096):
            part = stems[k : k + 4096]
            ids, sizes = self.encoded(part, letters)
            n = len(self.known)
            ends = self.at[n] + np.cumsum(sizes)
            self._grow(n + len(part), int(ends[-1]))
            self.pool[self.at[n] : ends[-1]] = ids
            self.at[n + 1 : n + 1 + len(part)] = ends
            self.known.update(zip(part, range(n, n + len(part))))

    def encoded(self, stems: list[str], letters: bool) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, and how many each has. Many words are encoded as one text: words of letters alone have one id that ends a word each, others get a separator between them. Where that doesn't add up, each is encoded alone."""
        if letters:
            ids = np.array(self.tokenizer.encode(" ".join(stems), add_special_tokens=False).ids, np.uint32)
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) == len(stems):
                return ids, np.diff(ends, prepend=0)
        elif len(self.apart) == 1:
            ids = np.array(self.tokenizer.encode(f" {SEPARATOR} ".join(stems), add_special_tokens=False).ids, np.uint32)
            apart = ids == self.apart[0]
            ends = np.append(np.flatnonzero(apart), len(ids))
            if len(ends) == len(stems):
                return ids[~apart], np.diff(ends, prepend=-1) - 1
        lists = [e.ids for e in self.tokenizer.encode_batch_fast(stems, add_special_tokens=False)]
        return np.fromiter(chain.from_iterable(lists), np.uint32), np.array([len(x) for x in lists], np.int64)

    def entries(self, stems: list[str]) -> np.ndarray:
        if len(self.known) + len(stems) > self.most:
            self.shrink()
        found = np.fromiter(map(self.known.get, stems, repeat(-1)), np.int64, len(stems))
        new = np.flatnonzero(found < 0)
        letters = np.fromiter((stems[i].isalpha() for i in new.tolist()), bool, len(new))
        for kind in (True, False):
            some, n = new[letters == kind], len(self.known)
            self.add([stems[i] for i in some.tolist()], kind)
            found[some] = np.arange(n, n + len(some))
        self.uses[found] += 1
        return found

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the number of them that each text has."""
        rows, word, distinct = words_of(texts)
        # A lone full stop or comma after letters that stay letters is a token by itself, and case is dropped: fewer words to encode.
        body = pc.utf8_slice_codeunits(distinct, 0, -1)
        stop = np.asarray(pc.ends_with(distinct, ".")).astype(np.int8) + 2 * np.asarray(pc.ends_with(distinct, ",")).astype(np.int8)
        stop *= ends_in_letter(body).astype(np.int8)
        stem = pc.if_else(pa.array(stop > 0), body, distinct)
        stem = pc.if_else(pc.ascii_is_alpha(stem), pc.ascii_lower(stem), stem).dictionary_encode()
        entry = self.entries(stem.dictionary.to_pylist())[np.asarray(stem.indices)]
        # Each distinct word's ids are its stem's, then the stop's.
        first, sizes = self.at[entry], self.at[entry + 1] - self.at[entry]
        ends = np.cumsum(sizes + (stop > 0))
        ids = np.empty(int(ends[-1]) if len(ends) else 0, np.uint32)
        ids[ends[stop > 0] - 1] = np.asarray(self.stops)[stop[stop > 0] - 1]
        begins = ends - sizes - (stop > 0)
        into = np.repeat(begins - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
        ids[into] = self.pool[np.repeat(first - begins, sizes) + into]
        own = pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int64)), pa.array(ids))
        total = (sizes + (stop > 0))[word]
        found = own.take(pa.array(word)).values if len(word) else pa.array([], pa.uint32())
        upto = np.concatenate([[0], np.cumsum(total)])
        last = np.searchsorted(rows, np.arange(len(texts)), "right")
        return np.asarray(found), np.diff(upto[last], prepend=0)


def ends_in_letter(words: pa.Array) -> np.ndarray:
    """Which words are letters alone, also as the tokenizer writes them: some letters become a letter and a mark, and a mark joins the sign after it."""
    found = np.array(pc.utf8_is_alpha(words))
    odd = np.flatnonzero(found & ~np.asarray(pc.string_is_ascii(words)))
    if len(odd):
        own = words.take(pa.array(odd))
        # the one letter whose lower case is a letter and a mark
        found[odd] = np.asarray(pc.utf8_is_alpha(pc.utf8_normalize(own, "NFC"))) & ~np.asarray(pc.match_substring(own, "\u0130"))
    return found


def cut(tokens: int, capacity: int, slack: int, cuts: int = 3) -> list[int]:
    """Lengths of a document's pieces: full bins, then reciprocal shares of one, then a rest.

    A rest is cut at the largest share capacity/k that it holds, while leaving
    it whole would waste more than ``slack`` in its class.
    """
    sizes = [capacity] * (tokens // capacity)
    rest = tokens % capacity
    while rest and cuts and capacity // (capacity // rest) - rest > slack:
        sizes.append(capacity // -(-capacity // rest))
        rest -= sizes[-1]
        cuts -= 1
    return sizes + [rest] * (rest > 0)


def pack_partition(batches: Iterator[pa.RecordBatch], path: str, eos: int, capacity: int, slack: int, slice_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Fill bins from one partition's documents alone; class k holds lengths in (capacity/(k+1), capacity/k], k pieces to a bin."""
    tokens, bins = WordTokens(path), {}
    serial = TaskContext.get().partitionId() << 36
    out: list[tuple] = []

    def close(pieces: list[tuple]) -> None:
        nonlocal serial
        offset = 0
        for doc, start, ids, total in pieces:
            out.append((doc, start, len(ids), ids.tobytes(), total, serial, offset))
            offset += len(ids)
        serial += 1

    def flush() -> pa.RecordBatch:
        columns = list(zip(*out)) if out else [()] * 7
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [x.split()[0] for x in PIECES.split(", ")])

    for batch in text_slices(batches, most=slice_bytes):
        ids, counts = tokens(texts_of(batch))
        ends = np.cumsum(counts)
        for doc, n, end in zip(batch["doc_id"].to_pylist(), counts.tolist(), ends.tolist()):
            own, start = np.append(ids[end - n : end], np.uint32(eos)).astype("<u4"), 0
            for size in cut(n + 1, capacity, slack):
                piece = (doc, start, own[start : start + size], n + 1)
                start += size
                k = capacity // size
                bins.setdefault(k, []).append(piece)
                if len(bins[k]) == k:
                    close(bins.pop(k))
        yield flush()
    # Bins that lack pieces: their content in one row, cut at the capacity; the last cut at powers of two, which need no padding.
    left = [p for k in sorted(bins) for p in bins[k]]
    bound, room, current = sum(len(p[2]) for p in left), 0, []
    for doc, start, piece, total in left:
        while len(piece):
            if not room:
                room = capacity if bound >= capacity else 1 << (bound.bit_length() - 1)
            n = min(room, len(piece))
            current.append((doc, start, piece[:n], total))
            start, piece, room, bound = start + n, piece[n:], room - n, bound - n
            if not room:
                close(current)
                current = []
    yield flush()


def harmonic_pack(docs: DataFrame, tokenizer_path: str, eos: int = 2, capacity: int = 4096, slack: int = 32, slice_bytes: int = 4 << 20) -> DataFrame:
    """Pack ``docs`` (doc_id, text) into sequences of at most ``capacity`` tokens.

    Every task packs its own partition: no shuffle, and no state beyond one
    open bin for each class. A piece of length l belongs to class
    k = capacity // l and a bin of class k takes k pieces, so a bin never
    overflows. Long documents give full bins; a rest is cut at reciprocal
    shares (see ``cut``). At a partition's end, what lies in unfinished bins is
    laid end to end and cut into sequences of ``capacity`` and then of powers
    of two. A task encodes about ``slice_bytes`` of text at once: more takes
    less time, as words recur within a slice, and more memory.

    Returns a row for each piece: doc_id, start, length, ids (little-endian
    unsigned 32-bit), doc_tokens, sequence_id, offset. A null or empty text is
    the end token alone. Repeated rows are packed each for itself; a null
    doc_id stays null; other columns are ignored; no rows give no rows.
    """
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")).mapInArrow(
        lambda it: pack_partition(it, tokenizer_path, eos, capacity, slack, slice_bytes), PIECES
    )


def digest(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op3_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(harmonic_pack(table(spark, sf_dir, "documents"), vocabulary(), slice_bytes=8 << 20))
