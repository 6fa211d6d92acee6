"""Fractal dimensions of sets of points, from counts in cells of several sizes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def counting_dimensions(points: DataFrame, keys: list[str], columns: list[str], sizes: list[float]) -> DataFrame:
    """(keys, n, counting, information, correlation): dimensions of each group's points over ``columns``.

    All sizes are counted in one pass: how many cells hold points, the entropy
    of the cells' shares and the sum of the shares' squares; a dimension is the
    slope of its log over the log of the size. Counts are summed in the map
    tasks first, so a group or a cell with a third of all rows sends a row for
    each task. Points with a null or infinite coordinate are left out; null keys
    are a group of their own; points at one place have dimension 0, and one
    size gives none.
    """
    if not sizes or any(not s > 0 for s in sizes):
        raise ValueError("cell sizes must be above 0")
    ok = reduce(Column.__and__, (F.abs(F.col(c)) < float("inf") for c in columns))
    spread = points.filter(ok).select(*keys, *columns, F.explode(F.array(*(F.lit(float(s)) for s in sorted(set(sizes))))).alias("_s"))
    cells = [F.floor(F.col(c) / F.col("_s")).alias(f"_c{i}") for i, c in enumerate(columns)]
    counts = spread.groupBy(*keys, "_s", *cells).agg(F.count("*").alias("_n"))
    sums = counts.groupBy(*keys, "_s").agg(F.count("*").alias("_boxes"), F.sum("_n").alias("_all"), F.sum(F.col("_n") * F.log("_n")).alias("_nlogn"), F.sum(F.col("_n").cast("double") * F.col("_n")).alias("_nn"))
    order = F.col("_nlogn") / F.col("_all") - F.log("_all")
    met = F.log(F.col("_nn") / F.col("_all") / F.col("_all"))
    slope = lambda y: F.regr_slope(y, F.log("_s"))
    return sums.groupBy(*keys).agg(F.max("_all").alias("n"), (-slope(F.log("_boxes"))).alias("counting"), slope(order).alias("information"), slope(met).alias("correlation"))
