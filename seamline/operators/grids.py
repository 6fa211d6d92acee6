"""Filters over traces and samples, smoothing of labelled grids, variograms and kriging."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..checkpoints import checkpointed
from .pairs import near_in_tasks
from .spatial import inverse_distance

PASSES = {"off": 0, "low": 1, "medium": 2, "high": 3}


def _with_neighbours(df: DataFrame, keys: list[str], at: str, a: str, half: int, block: int) -> DataFrame:
    """Add ``_near``, the traces of the same keys at most ``half`` places away.

    A profile is cut into blocks of ``block`` places, and a trace also goes to
    a next block whose traces need it, so a long profile has many tasks and few
    traces travel twice.
    """
    own = F.floor(F.col(at) / block)
    dealt = df.withColumn("_block", F.explode(F.sequence(F.floor((F.col(at) - half) / block), F.floor((F.col(at) + half) / block))))
    near = F.collect_list(a).over(W.partitionBy(*keys, "_block").orderBy(at).rangeBetween(-half, half))
    return dealt.withColumn("_near", near).filter(F.col("_block") == own).drop("_block")


def _each_window(a: str, half: int, call) -> Column:
    """``call`` of the samples that each sample's window holds, of all near traces in one array; nulls count as zero."""
    around = lambda k: F.flatten(F.transform("_near", lambda t: F.slice(t, F.greatest(k - half + 1, F.lit(1)), F.least(k, F.lit(half)) + half + 1)))
    each = F.transform(F.sequence(F.lit(0), F.size(a) - 1), lambda k: call(F.transform(around(k), lambda x: F.coalesce(x.cast("double"), F.lit(0.0)))))
    return F.when(F.size(a) > 0, each)


def _odd(*sizes: int) -> None:
    if any(s < 1 or s % 2 == 0 for s in sizes):
        raise ValueError("window sizes must be odd")


def median_2d(df: DataFrame, keys: list[str], at: str, a: str, traces: int, samples: int, out: str = "filtered", block: int = 512) -> DataFrame:
    """Add the median over ``traces`` by ``samples`` around each sample; outside a profile or trace are zeros.

    ``at`` is a trace's whole number along its profile, different for each
    trace; a place without a trace counts as zeros. Null and empty traces give
    null, null samples count as zero.
    """
    _odd(traces, samples)
    size = traces * samples
    middle = lambda v: F.get(F.array_sort(F.concat(v, F.array_repeat(F.lit(0.0), size - F.size(v)))), F.lit(size // 2))
    found = _with_neighbours(df, keys, at, a, traces // 2, block)
    return found.select(*df.columns, _each_window(a, samples // 2, middle).alias(out))


def median_cross(df: DataFrame, keys: list[str], at: str, a: str, size: int = 19, out: str = "filtered") -> DataFrame:
    """Three medians in a row: along the traces, over a square, along the samples."""
    once = median_2d(df, keys, at, a, size, 1, "_m1")
    twice = median_2d(once, keys, at, "_m1", size, size, "_m2")
    return median_2d(twice, keys, at, "_m2", 1, size, out).drop("_m1", "_m2")


def wiener_2d(df: DataFrame, keys: list[str], at: str, a: str, traces: int, samples: int, out: str = "filtered", block: int = 512) -> DataFrame:
    """Add the adaptive noise filter: near the local mean where the local variance is small against the profile's mean one. Edges as in ``median_2d``."""
    _odd(traces, samples)
    size = float(traces * samples)

    def moments(v: Column) -> Column:
        mean = F.aggregate(v, F.lit(0.0), lambda s, x: s + x) / size
        return F.struct(mean.alias("m"), (F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x) / size).alias("q"))

    near = _with_neighbours(df, keys, at, a, traces // 2, block)
    local = checkpointed(near.select(*df.columns, F.transform(_each_window(a, samples // 2, moments), lambda s: F.struct(s["m"].alias("m"), (s["q"] - s["m"] * s["m"]).alias("v"))).alias("_local")))
    noise = local.select(*keys, F.explode("_local.v").alias("_v")).groupBy(*keys).agg(F.avg("_v").alias("_noise"))
    noise = noise.select(*(F.col(k).alias(f"_k_{k}") for k in keys), "_noise")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    value = lambda x, s: s["m"] + F.when(s["v"] < F.col("_noise"), 0.0).otherwise((1 - F.coalesce(F.try_divide(F.col("_noise"), s["v"]), F.lit(1.0))) * (F.coalesce(x.cast("double"), F.lit(0.0)) - s["m"]))
    return local.join(noise, same, "left").select(*df.columns, F.zip_with(a, "_local", value).alias(out))


def smooth_grid(cells: DataFrame, level: str = "medium", x: str = "gx", y: str = "gy", label: str = "label") -> DataFrame:
    """(x, y, label) after passes of majority votes over a cell and its four neighbours; the least of tied labels wins.

    ``x`` and ``y`` are whole numbers, one row for each cell. Beyond the grid's
    edge the edge cell votes again. Cells with a null label stay null and don't
    vote. Each pass counts votes by cell and label before it shuffles.
    """
    now = cells.select(x, y, label)
    if not PASSES[level]:
        return now
    edge = cells.agg(F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1")).first()
    if edge.x0 is None:
        return now
    inside = lambda c, low, high: F.greatest(F.lit(low), F.least(F.lit(high), c))
    steps = [(0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)]
    # by symmetry a vote that would leave the grid returns to its own cell
    goals = F.array(*(F.struct(inside(F.col(x) + i, edge.x0, edge.x1).alias(x), inside(F.col(y) + j, edge.y0, edge.y1).alias(y)) for i, j in steps))
    for _ in range(PASSES[level]):
        votes = now.filter(F.col(label).isNotNull()).select(F.explode(goals).alias("_g"), F.col(label).alias("_l")).groupBy(F.col(f"_g.{x}").alias(x), F.col(f"_g.{y}").alias(y), "_l").agg(F.count("*").alias("_n"))
        best = votes.groupBy(x, y).agg(F.min(F.struct((-F.col("_n")).alias("n"), F.col("_l").alias("l"))).alias("_b"))
        now = checkpointed(now.join(best, [x, y], "left").select(x, y, F.when(F.col(label).isNotNull(), F.col("_b.l")).alias(label)))
    return now


def semivariances(points: DataFrame, most: float, lags: int, id: str = "id", x: str = "x", y: str = "y", value: str = "value") -> DataFrame:
    """(lag, distance, semivariance, pairs) over pairs of points at most ``most`` apart, in ``lags`` equal bins; points without finite numbers are left out. Ids differ."""
    p = points.filter((F.abs(x) < float("inf")) & (F.abs(y) < float("inf")) & (F.abs(value) < float("inf"))).select(F.col(id).alias("_id"), F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"), F.col(value).cast("double").alias("_v"))

    def sums(t: pa.Table, blocks: Iterator) -> Iterator[pa.RecordBatch]:
        v, total = t["_v"].to_numpy(), np.zeros((3, lags))
        for i, j, d, _ in blocks:
            ok = d <= most
            i, j, d = i[ok], j[ok], d[ok]
            lag = np.minimum((d / (most / lags)).astype(np.int64), lags - 1)
            total += [np.bincount(lag, w, lags) for w in (None, d, (v[i] - v[j]) ** 2)]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(lags)), *map(pa.array, total)], ["lag", "n", "d", "g"])

    found = near_in_tasks(p, most, sums, "lag long, n double, d double, g double", "_id", "_x", "_y").filter("n > 0").groupBy("lag").agg(*(F.sum(c).alias(c) for c in "ndg"))
    return found.select("lag", (F.col("d") / F.col("n")).alias("distance"), (F.col("g") / F.col("n") / 2).alias("semivariance"), F.col("n").cast("long").alias("pairs"))


def _shape(model: str, h: np.ndarray, reach: float) -> np.ndarray:
    """A model's share of the sill at distances ``h``; ``reach`` is the distance of (nearly) all of it."""
    if model == "spherical":
        r = np.minimum(h / reach, 1)
        return 1.5 * r - 0.5 * r**3
    if model == "exponential":
        return 1 - np.exp(-3 * h / reach)
    if model == "gaussian":
        return 1 - np.exp(-4 * (h / reach) ** 2)
    raise ValueError(f"no such model: {model}")


def fitted_variogram(bins: DataFrame, model: str = "spherical", steps: int = 400) -> tuple[float, float]:
    """(sill, reach) with the least squared error over the bins, weighted by their pairs; one row for each lag comes to the driver. No bins give (0, 1)."""
    rows = bins.select("distance", "semivariance", "pairs").collect()
    if not rows:
        return 0.0, 1.0
    h, g, n = (np.array(c, float) for c in zip(*sorted(rows)))
    best = (np.inf, 0.0, 1.0)
    for reach in np.linspace(max(h.max(), 1e-12) / steps, 2 * max(h.max(), 1e-12), 2 * steps):
        s = _shape(model, h, reach)
        sill = float((n * s * g).sum() / max((n * s * s).sum(), 1e-300))
        best = min(best, (float((n * (g - sill * s) ** 2).sum()), sill, float(reach)))
    return best[1], best[2]


def kriged(near: DataFrame, id: str, value: str, sill: float, reach: float, x: str = "sx", y: str = "sy", model: str = "spherical") -> DataFrame:
    """(id, value, variance, neighbours): ordinary kriging from each point's neighbours (id, distance, x, y, value).

    ``near`` holds a bounded number of neighbours for each id, as ``nearest``
    gives them; neighbours at one place should be merged before. Where the
    system has no finite result (no sill, neighbours at one place) the value is
    the mean by inverse squares of the distance, and the variance null.
    """
    kind = near.schema[id].dataType.simpleString()
    systems = near.groupBy(id).agg(F.array_sort(F.collect_list(F.struct(F.col("distance").alias("d"), F.col(x).alias("x"), F.col(y).alias("y"), F.col(value).cast("double").alias("v")))).alias("n"))
    systems = systems.select(F.col(id).alias("_id"), *(F.col(f"n.{c}").alias(c) for c in "dxyv"))

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            value, variance = np.full(len(f), np.nan), np.full(len(f), np.nan)
            sizes = f["d"].map(len).to_numpy()
            for k in np.unique(sizes):
                rows = np.flatnonzero(sizes == k)
                d, u, w, v = (np.stack(f[c].iloc[rows].to_numpy()).astype(float) for c in "dxyv")
                m = np.ones((len(rows), k + 1, k + 1))
                m[:, :k, :k] = _shape(model, np.hypot(u[:, :, None] - u[:, None], w[:, :, None] - w[:, None]), reach)
                m[:, k, k] = 0
                right = np.append(_shape(model, d, reach), np.ones((len(rows), 1)), axis=1)
                ok = (np.linalg.cond(m) < 1e12) & (sill > 0)  # weights don't depend on the sill
                weight = np.linalg.solve(m[ok], right[ok][:, :, None])[:, :, 0]
                value[rows[ok]] = (weight[:, :k] * v[ok]).sum(axis=1)
                variance[rows[ok]] = sill * (weight * right[ok]).sum(axis=1)
            yield pd.DataFrame({"_id": f["_id"], "_value": value, "variance": np.maximum(variance, 0)})

    solved = systems.mapInPandas(solve, f"_id {kind}, _value double, variance double")
    solved = solved.select(F.col("_id").alias(id), F.nanvl("_value", F.lit(None)).alias("_value"), F.nanvl("variance", F.lit(None)).alias("variance"))
    other = inverse_distance(near, id, value)
    return other.join(solved, id, "left").select(id, F.coalesce("_value", "value").alias("value"), "variance", "neighbours")
