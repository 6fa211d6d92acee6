"""Velocity models, depth conversion, temperature series and component tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import arrays as A


def interval_velocity(picks: DataFrame, keys: list[str], layer: str, depth: str, sample: str, step: float = 8.0) -> DataFrame:
    """Velocity of each layer from the one above: 100 depth units over the time between them; the first from the surface."""
    w = W.partitionBy(*keys).orderBy(layer)
    d, s = F.col(depth) - F.coalesce(F.lag(depth).over(w), F.lit(0.0)), F.col(sample) - F.coalesce(F.lag(sample).over(w), F.lit(0))
    return picks.withColumn("velocity", F.try_divide(d * 100, s * step))


def between_picks(picks: DataFrame, places: DataFrame, keys: list[str], place: str, value: str) -> DataFrame:
    """Values at all places, linear between picks, the ends held; picks of 0 take the first value that isn't."""
    from .series import gap_fill

    first = picks.filter(F.col(value) != 0).groupBy(*keys).agg(F.min_by(value, place).alias("_first"))
    known = picks.join(first, keys, "left").withColumn(value, F.when(F.col(value) == 0, F.col("_first")).otherwise(F.col(value))).drop("_first")
    all_ = places.join(known, [*keys, place], "left")
    filled = gap_fill(all_, keys, [place], value, "filled")
    # one pick alone holds everywhere
    return filled.withColumn("filled", F.coalesce("filled", F.max(value).over(W.partitionBy(*keys))))


def to_depth(time: Column, layers: Column) -> Column:
    """Depth of a time through layers (array of top, bottom, velocity in samples and units), piecewise; the last layer goes on below."""
    passed = lambda x: F.greatest(F.lit(0.0), F.least(time, x["bottom"]) - x["top"])
    inside = F.aggregate(layers, F.lit(0.0), lambda s, x: s + passed(x) * x["velocity"])
    last = F.element_at(layers, F.lit(-1))
    return inside + F.greatest(F.lit(0.0), time - last["bottom"]) * last["velocity"]


def to_depth_trace(signal: Column, layers: Column, spacing: float = 10.0) -> Column:
    """A trace along depth: each layer's samples resampled to its thickness over the spacing, joined."""

    def part(x: Column) -> Column:
        n = F.greatest(F.lit(1), F.floor((x["bottom"] - x["top"]) * x["velocity"] / spacing).cast("int"))
        own = F.slice(signal, (x["top"] + 1).cast("int"), (x["bottom"] - x["top"]).cast("int"))
        last = F.size(own) - 1
        at = lambda k: F.try_divide(k * last, F.greatest(n - 1, F.lit(1)).cast("double"))
        value = lambda k: F.get(own, F.floor(at(k)).cast("int")) + (F.get(own, F.least(F.floor(at(k)).cast("int") + 1, last)) - F.get(own, F.floor(at(k)).cast("int"))) * (at(k) - F.floor(at(k)))
        return F.transform(F.sequence(F.lit(0), n - 1), value)

    return F.flatten(F.transform(layers, part))


def rank_correlation(rows: DataFrame, key: str, depth: str, value: str, chosen) -> DataFrame:
    """Spearman correlation of each key's series with that of the chosen key, over the depths that both have."""
    place = lambda c: F.rank().over(W.partitionBy(key).orderBy(c)) + (F.count("*").over(W.partitionBy(key, c)) - 1) / 2.0
    model = rows.filter(F.col(key) == chosen).select(F.col(depth), F.col(value).alias("_m"))
    both = rows.join(F.broadcast(model), depth)
    model_rank = F.rank().over(W.partitionBy(key).orderBy("_m")) + (F.count("*").over(W.partitionBy(key, "_m")) - 1) / 2.0
    return both.withColumns({"_a": place(value), "_b": model_rank}).groupBy(key).agg(F.corr("_a", "_b").alias("spearman"), F.count("*").alias("depths"))


def unit_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows scaled so that absolute values sum to 1; rows of zeros stay."""
    total = sum((F.abs(c) for c in columns), F.lit(0.0))
    return df.withColumns({c: F.coalesce(F.try_divide(F.col(c), total), F.lit(0.0)) for c in columns})


def yeo_johnson(c: Column, lam: float) -> Column:
    """Power transform for values of either sign."""
    up = F.log1p(c) if abs(lam) < 1e-9 else (F.pow(c + 1, F.lit(lam)) - 1) / lam
    down = -F.log1p(-c) if abs(lam - 2) < 1e-9 else -(F.pow(1 - c, F.lit(2 - lam)) - 1) / (2 - lam)
    return F.when(c >= 0, up).otherwise(down)


def yeo_johnson_lambda(df: DataFrame, column: str, low: float = -2.0, high: float = 4.0, rounds: int = 3, grid: int = 13) -> float:
    """The power with the greatest likelihood: each round tries a grid in one aggregation and narrows it."""
    sign = F.sum(F.signum(column) * F.log1p(F.abs(column)))
    for _ in range(rounds):
        step = (high - low) / (grid - 1)
        powers = [low + step * k for k in range(grid)]
        row = df.agg(F.count(column), sign, *(F.var_pop(yeo_johnson(F.col(column), p)) for p in powers)).first()
        import math

        score = [(-row[0] / 2 * math.log(v) + (p - 1) * row[1]) if v and v > 0 else -math.inf for p, v in zip(powers, row[2:])]
        best = powers[score.index(max(score))]
        low, high = best - step, best + step
    return best


def savgol_line(line: Column, width: int, degree: int = 3) -> Column:
    """A boundary smoothed and cut to whole samples."""
    return F.transform(A.savgol(line, width, degree), lambda x: x.cast("int"))


def below(line: Column, upper: Column) -> Column:
    """A boundary kept at least one sample below another."""
    return F.zip_with(line, upper, lambda y, u: F.greatest(y, u + 1))
