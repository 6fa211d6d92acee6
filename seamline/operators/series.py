"""Operators on ordered series: rows of (key, order columns, value).

All are window functions or joins on the key, so a long series is sorted and
spilled by Spark and never collected into one value, except where an operator
returns an array by definition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def numbered(df: DataFrame, keys: list[str], order: list[str], name: str = "i", count: str = "n") -> DataFrame:
    """Add each row's place in its series, from 0, and the series' length."""
    return df.withColumns({name: F.row_number().over(W.partitionBy(*keys).orderBy(*order)).cast("long") - 1, count: F.count("*").over(W.partitionBy(*keys))})


def derivative(df: DataFrame, keys: list[str], order: list[str], value: str, step: float, out: str = "derivative") -> DataFrame:
    """Central difference over twice the step, one-sided at the ends; a series of one point has none (null)."""
    w = W.partitionBy(*keys).orderBy(*order)
    before, after = F.lag(value).over(w), F.lead(value).over(w)
    span = before.isNotNull().cast("int") + after.isNotNull().cast("int")
    return df.withColumn(out, F.when(span > 0, (F.coalesce(after, F.col(value)) - F.coalesce(before, F.col(value))) / (span * F.lit(float(step)))))


def _clamped(df: DataFrame, keys: list[str], order: list[str], width: int, inner: Column, out: str) -> DataFrame:
    """A window that is shifted at the ends: rows near an end take the result of the nearest whole window."""
    w = W.partitionBy(*keys).orderBy(*order)
    half = width // 2
    place, n = F.row_number().over(w) - 1, F.count("*").over(W.partitionBy(*keys))
    found = df.withColumn("_inner", F.when((place >= half) & (place - half + width <= n), inner))
    ahead = F.first("_inner", ignorenulls=True).over(w.rowsBetween(W.currentRow, W.unboundedFollowing))
    behind = F.last("_inner", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, W.currentRow))
    return found.withColumn(out, F.coalesce("_inner", F.when(place < half, ahead).otherwise(behind))).drop("_inner")


def rolling_mean(df: DataFrame, keys: list[str], order: list[str], value: str, width: int, out: str = "rolling_mean") -> DataFrame:
    """Mean of ``width`` rows, the window never shrinking at the ends; null where the series is shorter than that."""
    frame = W.partitionBy(*keys).orderBy(*order).rowsBetween(-(width // 2), width - 1 - width // 2)
    return _clamped(df, keys, order, width, F.avg(value).over(frame), out)


def rolling_median(df: DataFrame, keys: list[str], order: list[str], value: str, width: int, out: str = "rolling_median") -> DataFrame:
    """As ``rolling_mean``; of an even number of rows the mean of the middle two."""
    frame = W.partitionBy(*keys).orderBy(*order).rowsBetween(-(width // 2), width - 1 - width // 2)
    ranked = F.array_sort(F.collect_list(value).over(frame))
    return _clamped(df, keys, order, width, (F.get(ranked, F.lit((width - 1) // 2)) + F.get(ranked, F.lit(width // 2))) / 2, out)


def _finite(value: str) -> Column:
    x = F.col(value)
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def zscore(df: DataFrame, keys: list[str], value: str, out: str = "zscore") -> DataFrame:
    """(x - mean) / population deviation of the finite values; ``error`` is zero_std where that is 0."""
    w = W.partitionBy(*keys)
    std = F.stddev_pop(_finite(value)).over(w)
    return df.withColumns({out: F.when(std > 0, (F.col(value) - F.avg(_finite(value)).over(w)) / std), "error": F.when(std == 0, "zero_std")})


def minmax(df: DataFrame, keys: list[str], value: str, out: str = "minmax") -> DataFrame:
    """(x - min) / range of the finite values; ``error`` is zero_range where the range is 0."""
    w = W.partitionBy(*keys)
    low, high = F.min(_finite(value)).over(w), F.max(_finite(value)).over(w)
    return df.withColumns({out: F.when(high > low, (F.col(value) - low) / (high - low)), "error": F.when(high == low, "zero_range")})


def robust(df: DataFrame, keys: list[str], value: str, out: str = "robust") -> DataFrame:
    """(x - median) / inter-quartile range with interpolated quartiles; ``error`` is zero_iqr where that is 0."""
    q = df.groupBy(*keys).agg(F.percentile(_finite(value), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("_q"))
    q = q.select(*(F.col(k).alias(f"_{k}") for k in keys), "_q")
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    iqr = F.col("_q")[2] - F.col("_q")[0]
    joined = df.join(q, on).withColumns({out: F.when(iqr > 0, (F.col(value) - F.col("_q")[1]) / iqr), "error": F.when(iqr == 0, "zero_iqr")})
    return joined.drop("_q", *(f"_{k}" for k in keys))


def gap_fill(df: DataFrame, keys: list[str], order: list[str], value: str, out: str = "filled") -> DataFrame:
    """Linear fill by place; ends take the nearest value; fewer than two values stay as they are."""
    w = W.partitionBy(*keys).orderBy(*order)
    back, ahead = w.rowsBetween(W.unboundedPreceding, W.currentRow), w.rowsBetween(W.currentRow, W.unboundedFollowing)
    df = df.withColumn("_i", F.row_number().over(w))
    at = F.when(F.col(value).isNotNull(), F.col("_i"))
    v0, v1 = F.last(value, True).over(back), F.first(value, True).over(ahead)
    i0, i1 = F.last(at, True).over(back), F.first(at, True).over(ahead)
    between = v0 + (v1 - v0) * (F.col("_i") - i0) / F.nullif(i1 - i0, F.lit(0))
    enough = F.count(value).over(W.partitionBy(*keys)) >= 2
    return df.withColumn(out, F.coalesce(value, F.when(enough, F.coalesce(between, v0, v1)))).drop("_i")


def run_lengths(df: DataFrame, keys: list[str], order: list[str], label: str, depth: str) -> DataFrame:
    """Runs of equal labels: keys, label, run (from 0), rows, top and bottom; a run ends where the next begins, the last at its own last depth."""
    w = W.partitionBy(*keys).orderBy(*order)
    new = F.coalesce((~F.col(label).eqNullSafe(F.lag(label).over(w))).cast("int"), F.lit(0))
    first = F.when(F.row_number().over(w) == 1, 0).otherwise(new)
    runs = df.withColumn("_new", first).withColumn("run", F.sum("_new").over(w))
    sums = runs.groupBy(*keys, "run").agg(F.first(label).alias(label), F.count("*").alias("rows"), F.min(depth).alias("top"), F.max(depth).alias("last"))
    after = F.lead("top").over(W.partitionBy(*keys).orderBy("run"))
    return sums.select(*keys, label, "run", "rows", "top", F.coalesce(after, F.col("last")).alias("bottom"))


def smooth_labels(df: DataFrame, keys: list[str], order: list[str], label: str, width: int, noise: int | str | None = None, out: str = "smoothed") -> DataFrame:
    """Majority label in a window that shrinks at the ends; the first seen wins ties; noise neither votes nor changes."""
    half = max(width // 2, 1)
    frame = W.partitionBy(*keys).orderBy(*order).rowsBetween(-half, half)
    votes = F.collect_list(label if noise is None else F.when(F.col(label) != noise, F.col(label))).over(frame)
    counts = F.transform(F.array_distinct("_votes"), lambda x: F.struct(F.size(F.filter("_votes", lambda y: y == x)).alias("n"), (-F.array_position("_votes", x)).alias("at"), x.alias("x")))
    df = df.withColumn("_votes", votes).withColumn(out, F.array_max(counts)["x"]).drop("_votes")
    return df if noise is None else df.withColumn(out, F.when(F.col(label) == noise, F.col(label)).otherwise(F.coalesce(out, label)))


def consecutive(df: DataFrame, keys: list[str], place: str, out: str = "stretch") -> DataFrame:
    """A number that is equal within runs of consecutive places, so that gaps break windows."""
    return df.withColumn(out, F.col(place) - F.row_number().over(W.partitionBy(*keys).orderBy(place)))


def boxcar(df: DataFrame, keys: list[str], order: list[str], value: str, width: int, out: str = "boxcar") -> DataFrame:
    """Moving mean of whole windows only: the result is shorter by width - 1 rows."""
    w = W.partitionBy(*keys).orderBy(*order)
    n = F.count("*").over(w.rowsBetween(0, width - 1))
    return df.withColumns({"_n": n, out: F.avg(value).over(w.rowsBetween(0, width - 1))}).filter(F.col("_n") == width).drop("_n")


def histogram(df: DataFrame, keys: list[str], value: str, bins: int) -> DataFrame:
    """Counts in equal bins from the least to the greatest value, the last edge inclusive; a constant series is all in bin 0."""
    w = W.partitionBy(*keys)
    low, high = F.min(value).over(w), F.max(value).over(w)
    bin_ = F.when(high > low, F.least(F.floor((F.col(value) - low) * bins / F.nullif(high - low, F.lit(0.0))), F.lit(bins - 1))).otherwise(0)
    return df.filter(F.col(value).isNotNull()).withColumn("bin", bin_.cast("int")).groupBy(*keys, "bin").agg(F.count("*").alias("n_values"))


def station_path(df: DataFrame, keys: list[str], order: list[str], length: str, dip: str, azimuth: str) -> DataFrame:
    """Running x, y, z of a survey of stations: each leg is the length gained, turned by 180 - dip and the azimuth (degrees)."""
    w = W.partitionBy(*keys).orderBy(*order)
    leg = F.col(length) - F.coalesce(F.lag(length).over(w), F.lit(0.0))
    tilt, turn = F.radians(180 - F.col(dip)), F.radians(azimuth)
    run = w.rowsBetween(W.unboundedPreceding, W.currentRow)
    df = df.withColumn("_leg", leg)
    return df.withColumns({
        "x": F.sum(F.col("_leg") * F.sin(tilt) * F.sin(turn)).over(run),
        "y": F.sum(F.col("_leg") * F.sin(tilt) * F.cos(turn)).over(run),
        "z": F.sum(F.col("_leg") * F.cos(tilt)).over(run),
    }).drop("_leg")


def path_length(df: DataFrame, keys: list[str], order: list[str], x: str, y: str) -> DataFrame:
    """Sum of the distances of consecutive points."""
    w = W.partitionBy(*keys).orderBy(*order)
    legs = df.withColumn("_leg", F.hypot(F.col(x) - F.lag(x).over(w), F.col(y) - F.lag(y).over(w)))
    return legs.groupBy(*keys).agg(F.coalesce(F.sum("_leg"), F.lit(0.0)).alias("length"))


def position_means(df: DataFrame, keys: list[str], value: str, most_spread: int = 30) -> DataFrame:
    """Means by position of the arrays of a key. Unequal arrays are cut to the shortest if their sizes differ by at most ``most_spread``, else left out."""
    sizes = W.partitionBy(*keys)
    cut = df.withColumns({"_low": F.min(F.size(value)).over(sizes), "_high": F.max(F.size(value)).over(sizes)}).filter(F.col("_high") - F.col("_low") <= most_spread)
    flat = cut.select(*keys, F.posexplode(F.slice(value, F.lit(1), F.col("_low"))).alias("position", "x"))
    return flat.groupBy(*keys, "position").agg(F.avg("x").alias("mean"), F.count("*").alias("n_arrays"))


def align(curves: DataFrame, names: list[str], keys: list[str], depth: str, name: str, value: str, order: str, digits: int = 6) -> DataFrame:
    """One row for each depth (rounded half to even) that has all named curves, a column for each; the first row of a depth wins."""
    rounded = curves.filter(F.col(name).isin(names)).withColumn("depth", F.bround(depth, digits))
    first = rounded.groupBy(*keys, "depth").agg(*(F.min_by(F.when(F.col(name) == c, F.col(value)), F.when(F.col(name) == c, F.col(order))).alias(c) for c in names), F.count_distinct(name).alias("_n"))
    return first.filter(F.col("_n") == len(names)).drop("_n")


def complete_depths(values: DataFrame, keys: list[str], depth: str, name: str, names: list[str]) -> DataFrame:
    """Depths at which every name has a value."""
    return values.filter(F.col(name).isin(names)).groupBy(*keys, depth).agg(F.count_distinct(name).alias("_n")).filter(F.col("_n") == len(set(names))).drop("_n")


def same_grid(curves: DataFrame, keys: list[str], curve: str, depth: str, digits: int = 6, tolerance: float = 1e-9) -> DataFrame:
    """Whether a key's curves lie on one grid: equal count, ends, step and rounded depths."""
    each = curves.groupBy(*keys, curve).agg(
        F.count("*").alias("n"), F.min(depth).alias("low"), F.max(depth).alias("high"), F.bit_xor(F.xxhash64(F.bround(depth, digits))).alias("mark")
    )
    step = (F.col("high") - F.col("low")) / F.nullif(F.col("n") - 1, F.lit(0))
    return each.withColumn("step", step).groupBy(*keys).agg(
        F.count("*").alias("curves"),
        ((F.count_distinct("n") == 1) & (F.count_distinct("mark") == 1) & (F.coalesce(F.max("step") - F.min("step"), F.lit(0.0)) <= tolerance)).alias("compatible"),
    )
