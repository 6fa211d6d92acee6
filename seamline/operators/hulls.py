"""Convex hulls by group, and which points lie inside them."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _straight(ax: float, ay: float, bx: float, by: float, cx: float, cy: float) -> bool:
    """Whether c lies not on the left of the line from a to b, judged for the given doubles without rounding."""
    left, right = (bx - ax) * (cy - ay), (by - ay) * (cx - ax)
    # Rounding moves the difference by less than 4e-16 of both products together, and by less than 1e-300 where these underflow; overflow is never above it.
    if abs(left - right) > 4e-16 * (abs(left) + abs(right)) + 1e-300:
        return left < right
    parts = [v.as_integer_ratio() for v in (ax, ay, bx, by, cx, cy)]
    unit = max(d for _, d in parts)
    ax, ay, bx, by, cx, cy = (n * (unit // d) for n, d in parts)
    return (bx - ax) * (cy - ay) <= (by - ay) * (cx - ax)


def _lost(ax: float, ay: float, bx: float, by: float, cx: float, cy: float) -> bool:
    """Whether doubles take the left turn at b, on the way from a to c, for a straight way or a right turn, seen from b to c."""
    left, right = (cx - bx) * (ay - by), (cy - by) * (ax - bx)
    return left - right <= 0 and (left != 0 or right != 0)


def _shell(x: np.ndarray, y: np.ndarray, rounded: bool = False) -> np.ndarray:
    """Places of a hull's corners, counterclockwise from the least x, then y. Points on an edge are no corners.

    ``rounded`` leaves out corners that doubles don't tell from points on an edge.
    """
    order = np.lexsort((y, x))
    keep = np.ones(len(order), bool)
    keep[1:] = (np.diff(x[order]) != 0) | (np.diff(y[order]) != 0)
    order = order[keep]
    step = np.diff(x[order]) != 0
    order = order[np.append(True, step) | np.append(step, True)] if len(order) else order  # of one x, the least and the greatest y
    if len(order) < 3:
        return order
    xs, ys = x.tolist(), y.tolist()

    def chain(places: list[int], straight: Callable[..., bool]) -> list[int]:
        out: list[int] = []
        for k in places:
            while len(out) > 1 and straight(xs[out[-2]], ys[out[-2]], xs[out[-1]], ys[out[-1]], xs[k], ys[k]):
                out.pop()
            out.append(k)
        return out

    low, high = chain(order.tolist(), _straight), chain(order[::-1].tolist(), _straight)
    if rounded:
        low, high = chain(low, _lost), chain(high, _lost)
    return np.array(low[:-1] + high[:-1])


def _corners(points: DataFrame, keys: list[str]) -> DataFrame:
    """Corners of the hull of each task's rows, for each group; only corners are kept from batch to batch."""

    def shells(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, pd.DataFrame] = {}
        for f in frames:
            for name, part in f.groupby(keys, dropna=False, sort=False):
                name = tuple("\0null" if pd.isna(v) else v for v in name)
                both = pd.concat([held[name], part]) if name in held else part
                held[name] = both.iloc[_shell(both["x"].to_numpy(), both["y"].to_numpy())]
        for part in held.values():
            yield part

    return points.mapInPandas(shells, points.schema)


def hulls(points: DataFrame, keys: list[str], x: str = "x", y: str = "y", parts: int = 32) -> DataFrame:
    """(keys, i, x, y): the corners of each group's convex hull, counterclockwise from the least x, then y.

    The hull of all points is the hull of the corners of hulls of parts. So each
    task first keeps the corners of its own rows, then ``parts`` tasks for each
    group those of what they get, and only their corners meet: a group that
    holds a third of all rows sends no more than its corners. Groups of one or
    two places, or of places on one line, have their ends as corners. Parts
    keep each corner that the doubles have without rounding, so corners don't
    depend on how rows are dealt; of the last ones those stay whose turn is seen
    in double arithmetic from the corner to the next. Points without finite
    coordinates are left out; null keys are a group of their own.
    """
    finite = (F.abs("x") < float("inf")) & (F.abs("y") < float("inf"))
    p = points.select(*keys, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).filter(finite)
    first = _corners(p, keys)
    dealt = first.repartition(*keys, F.pmod(F.xxhash64("x", "y"), F.lit(parts)))
    second = _corners(dealt, keys)

    def last(frame: pd.DataFrame) -> pd.DataFrame:
        out = frame.iloc[_shell(frame["x"].to_numpy(), frame["y"].to_numpy(), rounded=True)].copy()
        out.insert(len(keys), "i", np.arange(len(out)))
        return out

    schema = ", ".join([*(f"`{k}` {points.schema[k].dataType.simpleString()}" for k in keys), "i long, x double, y double"])
    return second.groupBy(*keys).applyInPandas(last, schema)


def _edges(hull: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, edges): each hull's edges in order, the last one back to the first corner."""
    corners = F.transform(F.array_sort(F.collect_list(F.struct("i", "x", "y"))), lambda c: F.struct(c["x"].alias("x"), c["y"].alias("y")))
    at = lambda k: F.get("_c", k)
    edge = lambda c, k: F.struct(c["x"].alias("ax"), c["y"].alias("ay"), at((k + 1) % F.size("_c"))["x"].alias("bx"), at((k + 1) % F.size("_c"))["y"].alias("by"))
    return hull.groupBy(*keys).agg(corners.alias("_c")).select(*keys, F.transform("_c", edge).alias("edges"))


def shapes(hull: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, vertices, area, length) of each hull; a line's length goes there and back."""
    total = lambda f: F.aggregate(F.transform("edges", f), F.lit(0.0), lambda s, v: s + v)
    area = total(lambda e: e["ax"] * e["by"] - e["bx"] * e["ay"]) / 2
    length = total(lambda e: F.hypot(e["bx"] - e["ax"], e["by"] - e["ay"]))
    return _edges(hull, keys).select(*keys, F.size("edges").cast("long").alias("vertices"), area.alias("area"), length.alias("length"))


def inside(points: DataFrame, hull: DataFrame, keys: list[str], x: str = "x", y: str = "y") -> DataFrame:
    """``points`` with ``inside``: on no edge's right, so the border is inside.

    True for groups without a hull or with fewer than three corners, which
    bound nothing; null for points without coordinates.
    """
    edges = _edges(hull, keys)
    same = reduce(Column.__and__, (F.col(f"p.{k}").eqNullSafe(F.col(f"h.{k}")) for k in keys))
    ok = F.forall("edges", lambda e: (e["bx"] - e["ax"]) * (F.col(f"p.{y}") - e["ay"]) - (e["by"] - e["ay"]) * (F.col(f"p.{x}") - e["ax"]) >= 0)
    return points.alias("p").join(edges.alias("h"), same, "left").select("p.*", F.when(F.coalesce(F.size("edges"), F.lit(0)) < 3, True).otherwise(ok).alias("inside"))
