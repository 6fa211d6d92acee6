"""Removal of long byte strings that occur earlier in the collection, by column-wise suffix sorting."""

from __future__ import annotations

import sys
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, mix64, removed, shared_folder, table, text_slices, texts_of, utf8, written

LENGTH, GRAM = 100, 32
#: A string of LENGTH bytes has so many places for its anchor, a run of GRAM bytes.
LEFT = LENGTH - GRAM
WIDTH = LEFT + LENGTH
_BYTES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_FACTORS = mix64(np.arange(1, 9, dtype=np.uint64)) | np.uint64(1)


def _run_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the GRAM and of the 64 bytes from each position; those that reach over the end are short and unused."""
    x, step, k = _BYTES[data], 1, 0
    gram = x
    with np.errstate(over="ignore"):
        while step < 64:
            if step == GRAM:
                gram = mix64(x)
            y = x * _FACTORS[k]
            y[:-step] += x[step:]
            x, step, k = y ^ (y >> np.uint64(29)), step * 2, k + 1
    return gram, x


def anchors(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Anchors of concatenated texts: text number, position in the text, hash of the anchor, hash of all around it, bytes to the left and to the right.

    Of the runs in a string of LENGTH bytes, the one with the least hash (the
    first of equals) is its anchor, so equal strings have equal anchors at
    equal places. What lies within LEFT bytes before and LENGTH bytes from an
    anchor holds all strings that it stands for.
    """
    import xxhash

    n = len(data)
    none = np.zeros(0, np.int64)
    if n < LENGTH:
        return none, none, none.astype(np.uint64), none.astype(np.uint64), none, none
    gram, run = _run_hashes(data)
    low = np.uint64(0xFFFFFFFF)
    key = (gram & ~low) | np.arange(n, dtype=np.uint64)
    step = 1
    while step * 2 <= LEFT + 1:
        key = np.minimum(key[:-step], key[step:])
        step *= 2
    rest = LEFT + 1 - step
    key = np.minimum(key[: len(key) - rest], key[rest:]) if rest else key
    size = starts[1:] - starts[:-1]
    ends = np.repeat(starts[1:], size)[: len(key)]
    key = key[np.arange(len(key)) + LENGTH <= ends] & low
    at = key[np.append(True, key[1:] != key[:-1])].astype(np.int64) if len(key) else none
    text = np.searchsorted(starts, at, "right") - 1
    left, right = np.minimum(LEFT, at - starts[text]), np.minimum(LENGTH, starts[text + 1] - at)
    whole = (left == LEFT) & (right == LENGTH)
    around = np.zeros(len(at), np.uint64)
    with np.errstate(over="ignore"):
        for offset in (-LEFT, 64 - LEFT, LENGTH - 64):
            around[whole] = mix64(around[whole] * _FACTORS[0] + run[at[whole] + offset])
    for i in np.flatnonzero(~whole).tolist():
        around[i] = xxhash.xxh3_64_intdigest(data[at[i] - left[i] : at[i] + right[i]].tobytes(), int(left[i]))
    return text, at - starts[text], gram[at], around, left, right


def merged(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of each document with those that touch or overlap joined."""
    if not len(doc):
        return doc, start, end
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    # a running maximum that starts anew with each document
    new_doc = np.append(True, doc[1:] != doc[:-1])
    number = np.cumsum(new_doc)
    base = int(end.max()) + 1
    reach = np.maximum.accumulate(end + number * base) - number * base
    first = np.append(True, new_doc[1:] | (start[1:] > reach[:-1]))
    return doc[first], start[first], np.maximum.reduceat(end, np.flatnonzero(first))


def _packed(at: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return at << 16 | left << 8 | right


def _unpacked(packed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return packed >> 16, packed >> 8 & 0xFF, packed & 0xFF


def _groups(doc: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A number for each different (doc, row), and what doc and row the numbers mean."""
    order = np.lexsort((row, doc))
    d, r = doc[order], row[order]
    new = np.append(True, (d[1:] != d[:-1]) | (r[1:] != r[:-1]))[: len(d)]
    number = np.empty(len(d), np.int64)
    number[order] = np.cumsum(new) - 1
    return number, d[new], r[new]


def _later(anchor: np.ndarray, around: np.ndarray, doc: np.ndarray, row: np.ndarray, packed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by content, then place; and which rows of it repeat an earlier place."""
    turn = np.maximum(row, KNOWN)
    order = np.lexsort((packed, turn, doc, around, anchor))
    a, s, d, t, p = anchor[order], around[order], doc[order], turn[order], packed[order]
    first = np.append(True, (a[1:] != a[:-1]) | (s[1:] != s[:-1])) if len(a) else np.zeros(0, bool)
    of = np.maximum.accumulate(np.where(first, np.arange(len(a)), 0))
    return order, (d != d[of]) | (t != t[of]) | (p != p[of])


ROWS = "anchor long, around long, doc long, row long, at long, until long"
#: Segments are places of an anchor with what stands around it; columns lo to hi are the starts of strings that they stand for.
SEGMENTS = "key long, around long, lo long, hi long, doc long, row long, at long, until long, bytes binary"
#: The row of texts with a doc_id of their own; from 0 up are texts without one, in their order, and below are texts that share one.
KNOWN = -1
#: Frequent anchors are looked for in one of SAMPLED texts; those met HEAVY times there, at most MOST_HEAVY, are dealt by their surroundings.
SAMPLED, HEAVY, MOST_HEAVY = 32, 16, 4_096


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def _batch(*columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], _names(ROWS))


def _joined(doc: np.ndarray, row: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
    number, doc, row = _groups(doc, row)
    number, start, end = merged(number, start, end)
    return _batch(np.zeros(len(number)), np.zeros(len(number)), doc[number], row[number], start, end)


def _spans(doc: np.ndarray, row: np.ndarray, packed: np.ndarray) -> pa.RecordBatch:
    at, left, right = _unpacked(packed)
    return _joined(doc, row, at - left, at + right)


def _find(batches: Iterator[pa.RecordBatch], heavy: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Anchors (until -1), and spans of those whose surroundings occurred before in the same slice (until their end); part decides who meets: what has one anchor, or one anchor and surroundings if it is heavy."""

    def dealt(found: pa.RecordBatch, part: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*found.columns, pa.array(part.view(np.int64))], [*found.schema.names, "part"])

    for batch in text_slices(batches):
        data, starts = utf8(texts_of(batch))
        text, at, anchor, around, left, right = anchors(data, starts)
        doc, row, packed = np.asarray(batch["doc"])[text], np.asarray(batch["row"])[text], _packed(at, left, right)
        order, later = _later(anchor, around, doc, row, packed)
        spans = _spans(doc[order[later]], row[order[later]], packed[order[later]])
        yield dealt(spans, mix64(np.arange(spans.num_rows, dtype=np.uint64)))
        one = order[~later]
        part = anchor[one] ^ np.where(np.isin(anchor[one], heavy), mix64(around[one]), np.uint64(0))
        yield dealt(_batch(anchor[one].view(np.int64), around[one].view(np.int64), doc[one], row[one], packed[one], np.full(len(one), -1)), part)


def _heavy(rows: DataFrame) -> np.ndarray:
    """Anchors that very many slices of text would send to one task. This only decides who sorts them, never what is found."""
    some = rows.select("doc", "row", "text").filter(F.pmod(F.xxhash64("text"), F.lit(SAMPLED)) == 0)
    none = np.zeros(0, np.uint64)
    counts = some.mapInArrow(lambda it: _find(it, none), f"{ROWS}, part long").filter("until < 0").groupBy("anchor").agg(F.count("*").alias("n"))
    found = counts.filter(F.col("n") >= HEAVY).orderBy(F.desc("n"), "anchor").limit(MOST_HEAVY).collect()
    return np.array(sorted(r.anchor for r in found), np.int64).view(np.uint64)


def whole_groups(batches: Iterator[pa.RecordBatch], name: str, least: int = 1) -> Iterator[pa.Table]:
    """Tables that hold all rows of each value of a sorted column, of at least ``least`` rows but for the last."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows < least:
            continue
        last = batch[name][-1]
        t = pa.Table.from_batches(held)
        start = int(np.searchsorted(np.asarray(t[name]), last.as_py()))
        if start:
            yield t.slice(0, start)
            held, rows = t.slice(start).to_batches(), t.num_rows - start
    if held:
        yield pa.Table.from_batches(held)


def _same_surroundings(batches: Iterator[pa.RecordBatch], heavy: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Of anchors sorted by hash: spans of those whose surroundings occur earlier; and, of anchors with several surroundings or heavy ones, the first place of each."""
    for t in whole_groups(batches, "anchor", 20_000):
        anchor, around, doc, row, packed = (np.asarray(t[c]) for c in ("anchor", "around", "doc", "row", "at"))
        order, later = _later(anchor, around, doc, row, packed)
        yield _spans(doc[order[later]], row[order[later]], packed[order[later]])
        # several rows where texts that share a doc_id have the same at one place
        one = order[~later]
        a, s = anchor[one], around[one]
        start = np.flatnonzero(np.append(True, a[1:] != a[:-1])[: len(a)])
        size = np.diff(np.append(start, len(a)))
        one = one[np.repeat((s[start] != s[start + size - 1]) | np.isin(a[start].view(np.uint64), heavy), size)]
        yield _batch(anchor[one], around[one], doc[one], row[one], packed[one], np.full(len(one), -1))


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments of texts with the list of anchors wanted."""
    for batch in text_slices(batches):
        data, starts = utf8(texts_of(batch))
        of = np.asarray(batch["wanted"].value_lengths())
        places = batch["wanted"].flatten()
        anchor, packed = (np.asarray(places.field(k)) for k in ("anchor", "at"))
        at, left, right = _unpacked(packed)
        text = np.repeat(np.arange(len(of)), of)
        low, high = starts[text] + at - left, starts[text] + at + right
        raw = data.tobytes()
        pieces = pa.array([raw[a:b] for a, b in zip(low.tolist(), high.tolist())], pa.binary())
        doc, row = (np.asarray(batch[c])[text] for c in ("doc", "row"))
        yield _segments(anchor, np.zeros(len(at)), np.zeros(len(at)), np.full(len(at), LEFT), doc, row, packed, np.full(len(at), -1), pieces)


def _segments(*columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*(pa.array(c.astype(np.int64)) for c in columns[:-1]), columns[-1]], _names(SEGMENTS))


def _halve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Two segments for each: one for the strings that start in the lower half of its columns, one for the rest.

    All strings of a half share more bytes than the anchor, and these make its
    key, so a group of equal keys becomes several smaller ones. Equal halves
    become one here already.
    """
    import xxhash

    for batch in batches:
        out: list[tuple] = []
        for r in batch.to_pylist():
            at, left, right = r["at"] >> 16, r["at"] >> 8 & 0xFF, r["at"] & 0xFF
            middle = (r["lo"] + r["hi"]) // 2
            for lo, hi in ((r["lo"], middle), (middle + 1, r["hi"])):
                a, b = max(lo, LEFT - left), min(hi + LENGTH, LEFT + right)
                if a > hi or b < lo + LENGTH:  # no string of this half lies in the text
                    continue
                own = r["bytes"][a - LEFT + left : b - LEFT + left]
                shared = own[hi - a : lo + LENGTH - a]
                key, around = xxhash.xxh3_64_intdigest(shared, lo * 256 + hi), xxhash.xxh3_64_intdigest(own, a)
                out.append((key, around, lo, hi, r["doc"], r["row"], at << 16 | LEFT - a << 8 | b - LEFT, own))
        columns = list(zip(*out)) if out else [()] * 8
        hashes = [np.array(c, np.uint64).view(np.int64) for c in columns[:2]]
        halves = _segments(*hashes, *(np.array(c, np.int64) for c in columns[2:7]), np.full(len(out), -1), pa.array(columns[7], pa.binary()))
        yield from _collapsed(pa.Table.from_batches([halves]))


def _collapsed(t: pa.Table) -> Iterator[pa.RecordBatch]:
    """Spans of segments equal to an earlier one, and the others. Spans are dealt anywhere."""
    key, around, doc, row, packed = (np.asarray(t[c]) for c in ("key", "around", "doc", "row", "at"))
    order, later = _later(key, around, doc, row, packed)
    of = order[later]
    at, left, right = _unpacked(packed[of])
    zero = np.zeros(len(of), np.int64)
    yield _segments(mix64(at.view(np.uint64)).view(np.int64), doc[of], zero, zero, doc[of], row[of], at - left, at + right, pa.nulls(len(of), pa.binary()))
    yield from t.take(pa.array(order[~later])).combine_chunks().to_batches()


def _collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same for segments sorted by key, of several tasks; their spans are passed on."""
    for t in whole_groups(batches, "key", 20_000):
        done = pa.array(np.asarray(t["until"]) >= 0)
        yield from t.filter(done).combine_chunks().to_batches()
        yield from _collapsed(t.filter(pc.invert(done)))


BLOCK, PASS = 4_000, 42
_LISTS = ("order", "prefix", "left", "right", "rank", "doc", "row", "at", "span_doc", "span_row", "start", "until")
#: The state of the construction over a block of whole groups: one symbol of each segment is put in a round.
STATE = "n long, columns long, symbols binary, " + ", ".join(f"{c} array<long>" for c in _LISTS)


def _state(n: int, columns: int, symbols: np.ndarray, *lists: np.ndarray) -> pa.RecordBatch:
    arrays = [pa.array([n], pa.int64()), pa.array([columns], pa.int64()), pa.array([symbols.tobytes()], pa.binary())]
    return pa.RecordBatch.from_arrays([*arrays, *(pa.array([x.astype(np.int64)], pa.list_(pa.int64())) for x in lists)], _names(STATE))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state before the first round, from segments sorted by key; a row holds whole groups, aligned at their anchors."""
    for t in whole_groups(batches, "key", BLOCK):
        key, doc, own, packed = (np.asarray(t[c]) for c in ("key", "doc", "row", "at"))
        at, left, right = _unpacked(packed)
        n, size = len(doc), left + right
        grid = np.zeros((n, WIDTH), np.uint8)
        flat = np.frombuffer(b"".join(t["bytes"].to_pylist()), np.uint8)
        row = np.repeat(np.arange(n), size)
        grid[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(LEFT - left, size)] = flat
        turn = np.maximum(own, KNOWN)
        place = np.lexsort((at, turn, doc))
        rank = np.empty(n, np.int64)
        rank[place] = np.cumsum(np.append(True, np.any([x[place][1:] != x[place][:-1] for x in (doc, turn, at)], 0)))
        none = np.zeros(0, np.int64)
        yield _state(n, WIDTH, grid, np.arange(n), np.zeros(n), left, right, rank, doc, own, at, none, none, none, none)


def put_symbols(grid: np.ndarray, order: np.ndarray, prefix: np.ndarray, left: np.ndarray, right: np.ndarray, rank: np.ndarray, low: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rounds from the last column of ``grid`` down to ``low``: the new order and common prefixes, and (row, column) of LENGTH-byte strings that also stand in a row of smaller rank.

    Column-wise construction over the collection: a round puts one symbol of
    each row before its suffix. These symbols, in the order of the suffixes,
    are the column's part of the Burrows-Wheeler transform; a stable sort of
    them maps each suffix to its place in the new order. The common prefix of
    new neighbours is the least of the old ones between them, plus the symbol.
    Runs of neighbours that share LENGTH bytes hold equal strings.
    """
    n = len(order)
    rows, columns = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for column in range(grid.shape[1] - 1, low - 1, -1):
        transform = grid[order, column]
        perm = np.argsort(transform, kind="stable")
        least = np.zeros(n, np.int64)
        a, b = perm[:-1], perm[1:]
        same = transform[a] == transform[b]
        next_ = same & (b == a + 1)
        least[1:][next_] = prefix[b[next_]] + 1
        far = same & ~next_
        if far.any():
            cut = np.stack([a[far] + 1, b[far] + 1], 1).ravel()
            least[1:][far] = np.minimum.reduceat(np.append(prefix, 0), cut)[::2] + 1
        order, prefix = order[perm], least
        if column <= LEFT:
            valid = (column >= LEFT - left[order]) & (column + LENGTH <= LEFT + right[order])
            own = np.where(valid, rank[order], sys.maxsize)
            first = np.minimum.reduceat(own, np.flatnonzero(prefix < LENGTH))
            found = order[valid & (own > first[np.cumsum(prefix < LENGTH) - 1])]
            rows.append(found)
            columns.append(np.full(len(found), column))
    return order, prefix, np.concatenate(rows), np.concatenate(columns)


def earlier_windows(grid: np.ndarray, left: np.ndarray, right: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Which LENGTH-byte strings of aligned rows also stand in a row of smaller rank; a column for each of LEFT + 1 starts."""
    out = np.zeros((len(grid), LEFT + 1), bool)
    *_, row, column = put_symbols(grid, np.arange(len(grid)), np.zeros(len(grid), np.int64), left, right, rank, 0)
    out[row, column] = True
    return out


def _put(batches: Iterator[pa.RecordBatch], low: int) -> Iterator[pa.RecordBatch]:
    """The state after the rounds down to column ``low``; symbols that are used up are left out."""
    for batch in batches:
        for k in range(batch.num_rows):
            n, width = batch["n"][k].as_py(), batch["columns"][k].as_py()
            grid = np.frombuffer(batch["symbols"][k].as_buffer(), np.uint8).reshape(n, width)
            order, prefix, left, right, rank, doc, row, at, *old = (np.asarray(batch[c][k].values) for c in _LISTS)
            order, prefix, of, column = put_symbols(grid, order, prefix, left, right, rank, low)
            start = at[of] - LEFT + column
            spans = _joined(doc[of], row[of], start, start + LENGTH)
            new = (np.concatenate([x, np.asarray(spans[c])]) for x, c in zip(old, ("doc", "row", "at", "until")))
            yield _state(n, low, np.ascontiguousarray(grid[:, :low]), order, prefix, left, right, rank, doc, row, at, *new)


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_slices(batches):
        data, starts = utf8(texts_of(batch))
        raw, out = data.tobytes(), []
        for i, spans in enumerate(batch["spans"].to_pylist()):
            a, b = int(starts[i]), int(starts[i + 1])
            kinds = [np.array([min(s[k], b - a) for s in spans or ()], np.int64) for k in ("start", "until")]
            _, low, high = merged(np.zeros(len(kinds[0]), np.int64), *kinds)
            spans = [(x, y) for x, y in zip(low.tolist(), high.tolist()) if x < y]
            edges = [0, *(e for s in spans for e in s), b - a]
            kept = b"".join(raw[a + x : a + y] for x, y in zip(edges[::2], edges[1::2]))
            out.append((b - a, [{"start": x, "until": y} for x, y in spans], kept))
        kinds = [pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("until", pa.int64())])), pa.binary()]
        yield pa.RecordBatch.from_arrays([batch["doc_id"], *(pa.array(c, k) for c, k in zip(zip(*out), kinds))], ["doc_id", "n_bytes", "spans", "kept"])


def _small(df: DataFrame, most: int) -> DataFrame:
    return F.broadcast(df) if df.count() <= most else df


def remove_repeats(docs: DataFrame, most_broadcast: int = 2_000, most: int = 1_000) -> DataFrame:
    """(doc_id, n_bytes, spans, kept) for each row of ``docs`` (doc_id, text).

    spans are the removed runs (start, until) in UTF-8 bytes: all bytes of
    strings of LENGTH bytes that also start earlier, in a smaller doc_id or
    before in the same document. kept is what is left, as bytes.

    Null texts are empty; texts shorter than LENGTH lose nothing; very long ones
    are treated whole. Rows with a null doc_id come after all others, each a
    document of its own, in the order in which they are read. Rows that share a
    doc_id are ranked as one document: equal places in them are not earlier than
    each other; but each row loses only what it repeats itself. Other columns
    are ignored; no rows give no rows.

    Each text is cut to segments around anchors chosen by content (one for about
    35 bytes), so that equal strings lie in equal columns of segments with equal
    anchors. Equal segments become one first, by hash, in each slice of text
    before they are dealt. The different segments of each anchor then go
    through the column-wise construction (``put_symbols``), a symbol of each in
    every round; PASS rounds at a time read the state of the transform and its
    common prefixes from the last pass's files in the shared folder, in
    sequence, and write the next ones. An anchor with more than ``most``
    different segments is split by what half of its strings share, again and
    again, until no group is larger: strings of one column are all equal.
    """
    spark = docs.sparkSession
    folder = f"{shared_folder(spark)}/repeats-{uuid.uuid4().hex}"
    rows, key = _numbered(docs.select("doc_id", F.col("doc_id").cast("long").alias("doc"), F.col("text").cast("string").alias("text")))
    heavy = _heavy(rows)
    dealt = rows.select("doc", "row", "text").mapInArrow(lambda it: _find(it, heavy), f"{ROWS}, part long").repartition("part").drop("part")
    found = written(dealt.sortWithinPartitions(F.col("until") < 0, "anchor").mapInArrow(lambda it: _split(it, heavy), ROWS), f"{folder}/found")
    spans = [found.filter("until >= 0").select("doc", "row", F.col("at").alias("start"), "until")]
    wanted = written(found.filter("until < 0").groupBy(*key).agg(F.collect_list(F.struct("anchor", "at")).alias("wanted")), f"{folder}/wanted")
    part = written(rows.join(_small(wanted, most_broadcast), key).select("doc", "row", "text", "wanted").mapInArrow(_cut_out, SEGMENTS), f"{folder}/segments-0")
    groups, level = [], 0
    while True:
        large = checkpointed(part.groupBy("key").count().filter(F.col("count") > most).select("key"))
        if large.isEmpty():
            break
        level += 1
        groups.append(part.join(_small(large, 100_000), "key", "left_anti"))
        halves = part.join(_small(large, 100_000), "key", "left_semi").select(*_names(SEGMENTS)).mapInArrow(_halve, SEGMENTS)
        split = written(halves.repartition("key", "around").sortWithinPartitions("key").mapInArrow(_collapse, SEGMENTS), f"{folder}/segments-{level}")
        spans.append(split.filter("until >= 0").select("doc", "row", F.col("at").alias("start"), "until"))
        part = split.filter("until < 0")
    segments = reduce(DataFrame.unionByName, [*groups, part])
    state = written(segments.repartition("key").sortWithinPartitions("key").mapInArrow(_blocks, STATE), f"{folder}/columns-{WIDTH}")
    for low in [*range(WIDTH - PASS, 0, -PASS), 0]:
        state = written(state.mapInArrow(lambda it, low=low: _put(it, low), STATE), f"{folder}/columns-{low}")
    spans.append(state.selectExpr("inline(arrays_zip(span_doc, span_row, start, until))").selectExpr("span_doc as doc", "span_row as row", "start", "until"))
    # what is still needed is written first
    all_spans = written(reduce(DataFrame.unionByName, spans).groupBy(*key).agg(F.collect_list(F.struct("start", "until")).alias("spans")), f"{folder}-spans")
    removed(spark, folder)
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, n_bytes long, spans array<struct<start: long, until: long>>, kept binary"
    return rows.join(all_spans, key, "left").select("doc_id", "doc", "row", "text", "spans").mapInArrow(_remove, schema)


def _numbered(rows: DataFrame) -> tuple[DataFrame, list[str]]:
    """With a row for each text, as at KNOWN, and the columns that tell texts apart. Only texts without a doc_id of their own are numbered, and written to keep their numbers."""
    named = rows.filter("doc is not null")
    shared = checkpointed(named.groupBy("doc").count().filter("count > 1").select("doc"))
    plain, others = named, rows.filter("doc is null")
    if not shared.isEmpty():
        plain, others = named.join(shared, "doc", "left_anti"), others.unionByName(named.join(shared, "doc", "left_semi"))
    elif others.isEmpty():
        return _placed(rows, F.lit(KNOWN)), ["doc"]
    number = F.monotonically_increasing_id()
    others = checkpointed(_placed(others, F.when(F.col("doc").isNull(), number).otherwise(KNOWN - 1 - number)))
    return _placed(plain, F.lit(KNOWN)).unionByName(others), ["doc", "row"]


def _placed(rows: DataFrame, row: Column) -> DataFrame:
    # never null, so that no join adds a filter which would keep Spark from sharing the shuffle of the texts
    return rows.select("doc_id", F.coalesce("doc", F.lit(sys.maxsize)).alias("doc"), "text", F.coalesce(row.cast("long"), F.lit(0).cast("long")).alias("row"))


def _split(batches: Iterator[pa.RecordBatch], heavy: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Pass on spans, which come first, and judge the anchors."""

    def rest() -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = int(np.count_nonzero(np.asarray(batch["until"]) >= 0))
            if n:
                passed.append(batch.slice(0, n))
            yield batch.slice(n)

    passed: list[pa.RecordBatch] = []
    for out in _same_surroundings(rest(), heavy):
        yield from passed
        passed.clear()
        yield out
    yield from passed


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["until"] - s["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
