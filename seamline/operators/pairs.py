"""Pairs of near points, found in NumPy blocks inside tasks.

Points are dealt to square cells of the reach and a unit of work is a chunk of
a cell's points: it meets the later chunks of its cell and the four cells
ahead, so each pair is found once and a crowded cell is many units.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Points of a cell in a unit at most, on average, and pairs of points that are looked at at once.
CHUNK, AT_ONCE = 2000, 400_000


def _units(points: DataFrame, reach: float, id: str, x: str, y: str) -> DataFrame:
    """``points`` with the unit (_ux, _uy, _u) that they meet in, and whether they are of its chunk (_own)."""
    cell = lambda c: F.floor(F.col(c) / F.lit(float(reach))).cast("long")
    p = points.withColumns({"_cx": cell(x), "_cy": cell(y)})
    counts = p.groupBy("_cx", "_cy").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("_n"))
    p = p.join(counts, ["_cx", "_cy"]).withColumn("_part", F.pmod(F.xxhash64(id), F.col("_n")).cast("int")).drop("_n")
    ahead = F.array(*(F.struct((F.col("_cx") - i).alias("x"), (F.col("_cy") - j).alias("y"), F.lit(i == j == 0).alias("same")) for i, j in ((0, 0), (0, 1), (1, -1), (1, 0), (1, 1))))
    met = p.withColumn("_a", F.explode(ahead)).withColumns({"_ux": F.col("_a.x"), "_uy": F.col("_a.y"), "_same": F.col("_a.same")}).drop("_a", "_cx", "_cy")
    met = met.join(counts.withColumnsRenamed({"_cx": "_ux", "_cy": "_uy"}), ["_ux", "_uy"])
    last = F.when(F.col("_same"), F.col("_part")).otherwise(F.col("_n") - 1)
    return met.withColumn("_u", F.explode(F.sequence(F.lit(0), last))).withColumn("_own", F.col("_same") & (F.col("_u") == F.col("_part"))).drop("_n", "_same", "_part")


def _blocks(x: np.ndarray, y: np.ndarray, own: int, reach: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, square of the distance in units of the reach's power of two) of pairs i < j that may be within reach, i among the first ``own``, which are ordered by place."""
    scale = 2.0 ** -math.frexp(reach)[1]
    x, y, reach = x * scale, y * scale, reach * scale
    most, start = reach * reach * (1 + 1e-9), 0
    step = max(1, min(own, math.ceil(own / 16)))
    while start < own:
        end = min(own, start + step)
        near = (x[start:] >= x[start:end].min() - reach) & (x[start:] <= x[start:end].max() + reach) & (y[start:] >= y[start:end].min() - reach) & (y[start:] <= y[start:end].max() + reach)
        j = start + np.flatnonzero(near)
        rows = max(1, AT_ONCE // max(1, len(j)))
        for a in range(start, end, rows):
            i = np.arange(a, min(end, a + rows))
            d = x[i][:, None] - x[j]
            d *= d
            e = y[i][:, None] - y[j]
            e *= e
            d += e
            ok = d <= most
            ok &= j > i[:, None]
            at, to = np.nonzero(ok)
            yield i[at], j[to], d[ok]
        start = end


def near_in_tasks(points: DataFrame, reach: float, call: Callable[[pa.Table, Iterator], Iterator[pa.RecordBatch]], schema: str, id: str = "id", x: str = "x", y: str = "y") -> DataFrame:
    """What ``call`` gives for each unit, of its points and of blocks (i, j, distance, square) of pairs that may be within ``reach``.

    ``square`` is the sum of squares over the square of the reach: pairs are
    within reach if it is at most 1, or if the distance is at most the reach,
    as the caller likes. Coordinates are finite.
    """

    def unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches))
        own = t["_own"].to_numpy()
        if not own.any():
            return
        u, w = t[x].to_numpy(), t[y].to_numpy()
        # own ones first, in narrow squares, so that blocks of them have little around them
        square = np.floor(u / (reach / 4)), np.floor(w / (reach / 4))
        order = np.lexsort((w, u, square[1], square[0], ~own))
        t, u, w, n = t.take(pa.array(order)), u[order], w[order], int(own.sum())
        scale = 2.0 ** math.frexp(reach)[1]
        whole = (reach / scale) ** 2
        yield from call(t, ((i, j, np.sqrt(d) * scale, d / whole) for i, j, d in _blocks(u, w, n, reach)))

    return _units(points, reach, id, x, y).groupBy("_ux", "_uy", "_u").applyInArrow(unit, schema)
