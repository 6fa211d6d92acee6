"""Medians of the similarities of some arrays to all others, by products of matrices."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..checkpoints import checkpointed

#: Arrays of a block on either side, bins between -1 and 1, and how far values on their edges may lie beyond them.
SOME, MANY, BINS, EDGE = 1000, 8000, 512, 1e-9
KINDS = ("cosine", "pearson")
_NAN = 4.0


def _matrices(t: pa.Table, a: str) -> dict[int, tuple[np.ndarray, dict[str, np.ndarray]]]:
    """By length: places of the arrays without nulls, and for each kind of similarity the rows of length 1 (NaN where there is none)."""
    arrays, out = t[a].combine_chunks(), {}
    size = np.array([len(x) if x is not None and None not in x else 0 for x in arrays.to_pylist()]) if arrays.null_count or arrays.flatten().null_count else arrays.value_lengths().to_numpy()
    for length in np.unique(size[size > 0]):
        at = np.flatnonzero(size == length)
        m = arrays.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, length)
        out[int(length)] = at, {kind: v / np.where((n := np.linalg.norm(v, axis=1)) == 0, np.nan, n)[:, None] for kind, v in (("cosine", m), ("pearson", m - m.mean(axis=1)[:, None]))}
    return out


def _values(some: pa.Table, many: pa.Table, kind: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places in ``some``, their similarities to a part of ``many``, NaN where there is none): pairs of equal ids have none."""
    left, right = _matrices(some, "a"), _matrices(many, "a")
    ids, others = some["id"].to_numpy(), many["id"].to_numpy()
    for length in left.keys() & right.keys():
        (at, u), (to, w) = left[length], right[length]
        u, w = u[kind], w[kind]
        none = np.isnan(u).all(axis=1), np.isnan(w).all(axis=1)
        for k in range(0, len(to), 1000):
            v = u @ w[k : k + 1000].T
            v[np.isnan(v)] = _NAN
            v[none[0]] = np.nan
            v[:, none[1][k : k + 1000]] = np.nan
            v[ids[at][:, None] == others[to[k : k + 1000]]] = np.nan
            yield at, v


def _met(tests: DataFrame, others: DataFrame, blocks: int, parts: int):
    """Both sides dealt to all pairs of a block and a part."""
    a = tests.withColumns({"k": F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"), "j": F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))})
    b = others.withColumns({"j": F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int"), "k": F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))})
    return a.groupBy("k", "j").cogroup(b.groupBy("k", "j"))


def median_similarities(tests: DataFrame, others: DataFrame, id: str, a: str) -> DataFrame:
    """(id, cosine, pearson): medians over all ``others`` of another id. Arrays with nulls, of other lengths or without a direction have no similarity.

    Blocks of tests meet parts of the others as matrices, twice: the first time
    their similarities are counted in bins, the second time those in the bin of
    a median are kept and the ones below are counted, so medians are exact and
    few values are shuffled. ``id`` is a whole number.
    """
    tests, others = (t.select(F.col(id).alias("id"), F.col(a).alias("a")).filter("id is not null") for t in (tests, others))
    blocks, parts = (max(1, -(-t.count() // size)) for t, size in ((tests, SOME), (others, MANY)))

    def counted(some: pa.Table, many: pa.Table) -> pa.Table:
        counts = {kind: np.zeros((len(some), BINS), np.int32) for kind in KINDS}
        for kind in KINDS if len(some) and len(many) else ():
            for at, v in _values(some, many, kind):
                ok = ~np.isnan(v)
                place = np.clip((np.where(ok, v, 0) + 1) * (BINS / 2), 0, BINS - 1).astype(np.int64) + np.arange(len(at))[:, None] * BINS
                counts[kind][at] += np.bincount(place[ok], minlength=len(at) * BINS).reshape(-1, BINS).astype(np.int32)
        ids, other = some["id"].to_numpy(), many["id"].to_numpy()
        met = len(other) - np.array([(other == i).sum() for i in ids], int)
        bins = [pa.ListArray.from_arrays(np.arange(len(some) + 1, dtype=np.int32) * BINS, counts[kind].ravel()) for kind in KINDS]
        return pa.table([some["k"], some["id"], pa.array(met, pa.int64()), *bins], names=["k", "id", "met", *KINDS])

    bins = _met(tests, others, blocks, parts).applyInArrow(counted, f"k int, id long, met long, {', '.join(f'{kind} array<int>' for kind in KINDS)}")

    def bracketed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: dict[int, int] = {}
        met, sums = np.zeros(0, np.int64), np.zeros((2, 0, BINS), np.int64)
        for b in batches:
            rows = np.array([at.setdefault(i, len(at)) for i in b["id"].to_pylist()], int)
            more = len(at) - len(met)
            met, sums = np.pad(met, (0, more)), np.pad(sums, ((0, 0), (0, more), (0, 0)))
            np.add.at(met, rows, b["met"].to_numpy())
            for c, kind in enumerate(KINDS):
                np.add.at(sums[c], rows, b[kind].flatten().to_numpy().reshape(-1, BINS))
        out = [pa.array(list(at), pa.int64()), pa.array(met)]
        for c in range(2):
            upto = sums[c].cumsum(axis=1)
            n = upto[:, -1]
            low, high = ((upto > rank[:, None]).argmax(axis=1) for rank in ((n - 1) // 2, n // 2))
            ends = np.where(low == 0, -np.inf, low * 2 / BINS - 1 - EDGE), np.where(high == BINS - 1, np.inf, (high + 1) * 2 / BINS - 1 + EDGE)
            out += [pa.array(n), *map(pa.array, ends)]
        yield pa.RecordBatch.from_arrays(out, ["id", "met", *(f"{c}_{kind}" for kind in KINDS for c in ("n", "low", "high"))])

    ends = bins.groupBy("k").applyInArrow(bracketed, "id long, met long, " + ", ".join(f"n_{kind} long, low_{kind} double, high_{kind} double" for kind in KINDS))
    ends = checkpointed(ends.filter("met > 0"))

    def kept(some: pa.Table, many: pa.Table) -> pa.Table:
        under, inside = ({kind: [[] for _ in range(len(some))] for kind in KINDS} for _ in range(2))
        for kind in KINDS if len(some) and len(many) else ():
            low, high = some[f"low_{kind}"].to_numpy(), some[f"high_{kind}"].to_numpy()
            for at, v in _values(some, many, kind):
                less, own = v < low[at][:, None], (v >= low[at][:, None]) & (v <= high[at][:, None])
                for r, p in enumerate(at):
                    under[kind][p].append(int(less[r].sum()))
                    inside[kind][p].append(v[r][own[r]])
        columns = [some["id"]]
        for kind in KINDS:
            flat = [np.concatenate(x) if x else np.zeros(0) for x in inside[kind]]
            columns += [pa.array([sum(x) for x in under[kind]], pa.int64()), pa.array(flat, pa.list_(pa.float64()))]
        return pa.table(columns, names=["id", *(f"{c}_{kind}" for kind in KINDS for c in ("under", "in"))])

    found = _met(tests.join(ends, "id"), others, blocks, parts).applyInArrow(kept, "id long, " + ", ".join(f"under_{kind} long, in_{kind} array<double>" for kind in KINDS))
    found = found.groupBy("id").agg(*(f for kind in KINDS for f in (F.sum(f"under_{kind}").alias(f"under_{kind}"), F.array_sort(F.flatten(F.collect_list(f"in_{kind}"))).alias(f"in_{kind}"))))

    def median(kind: str):
        at = lambda rank: F.get(f"in_{kind}", (rank - F.col(f"under_{kind}")).cast("int"))
        n = F.col(f"n_{kind}")
        low, high = at(F.floor((n - 1) / 2)), at(F.floor(n / 2))
        value = low + (high - low) / 2
        return F.when(n > 0, F.when(high >= _NAN / 2, float("nan")).otherwise(value)).alias(kind)

    return ends.join(found, "id").select("id", *map(median, KINDS))
