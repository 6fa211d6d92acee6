"""Scaling of traces, overlays of noise on them, and errors of cleaned ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import arrays as A


def clip(c: Column, low: float = 0.0, high: float = 256.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def additive(clean: Column, noise: Column, middle: float = 128.0) -> Column:
    """Clean plus the noise's swing about the middle, clipped."""
    return F.zip_with(clean, noise, lambda c, n: clip(c + n - middle))


def dominant(clean: Column, noise: Column, middle: float = 128.0) -> Column:
    """Whichever swings more about the middle; clean on ties."""
    return F.zip_with(clean, noise, lambda c, n: F.when(F.abs(n - middle) > F.abs(c - middle), n).otherwise(c))


def soft(clean: Column, noise: Column, middle: float = 128.0, temperature: float = 12.0) -> Column:
    """Blend by a sigmoid of the difference of swings, clipped."""

    def blend(c: Column, n: Column) -> Column:
        share = 1 / (1 + F.exp(-(F.abs(n - middle) - F.abs(c - middle)) / temperature))
        return clip(c * (1 - share) + n * share)

    return F.zip_with(clean, noise, blend)


def decibels(signal: Column, noise: Column, tiny: float = 1e-12) -> Column:
    """10 log10 of the ratio of mean powers."""
    power = lambda a: A.mean(F.transform(a, lambda x: x * x))
    return 10 * F.log10((power(signal) + tiny) / (power(noise) + tiny))


def gain_for(signal: Column, noise: Column, target: float) -> Column:
    """Factor for the noise that gives a target ratio (dB)."""
    return F.pow(F.lit(10.0), (decibels(signal, noise) - target) / 20)


def unsigned(df: DataFrame, keys: list[str], array: str) -> DataFrame:
    """Amplitudes as 0 to 256: a profile with any negative one is shifted by 128 first."""
    low = F.min(F.array_min(array)).over(W.partitionBy(*keys))
    return df.withColumn("_shift", F.when(low < 0, 128.0).otherwise(0.0)).withColumn(array, F.transform(array, lambda x: clip(x + F.col("_shift")))).drop("_shift")


def paired_metrics(df: DataFrame, id: str, predicted: str, target: str, span: float = 256.0, quantile: float = 0.75) -> DataFrame:
    """A row for each id: mae, rmse, snr_db and psnr_db (null where the error is 0), correlation, and the mean error where the target is strong."""
    flat = df.select(id, F.posexplode(F.arrays_zip(F.col(predicted).alias("p"), F.col(target).alias("t"))).alias("i", "z")).select(id, F.col("z.p").alias("p"), F.col("z.t").alias("t"))
    strong = flat.groupBy(id).agg(F.percentile(F.abs("t"), F.lit(quantile)).alias("q"))
    error = F.nullif(F.avg(F.pow(F.col("p") - F.col("t"), F.lit(2))), F.lit(0.0))
    return flat.join(strong, id).groupBy(id).agg(
        F.avg(F.abs(F.col("p") - F.col("t"))).alias("mae"), F.sqrt(F.coalesce(error, F.lit(0.0))).alias("rmse"), (10 * F.log10(F.avg(F.col("t") * F.col("t")) / error)).alias("snr_db"),
        (20 * F.log10(F.lit(span) / F.sqrt(error))).alias("psnr_db"), F.corr("p", "t").alias("correlation"), F.avg(F.when(F.abs("t") >= F.col("q"), F.abs(F.col("p") - F.col("t")))).alias("strong_error"),
    )


def blended(noisy: Column, cleaned: Column, share: float) -> Column:
    return F.zip_with(noisy, cleaned, lambda n, c: (1 - share) * n + share * c)


def overlap_add(pieces: DataFrame, keys: list[str], place: str, value: str, within: str, width: int) -> DataFrame:
    """Values of overlapping windows put together by Hann weights of the place within the window, never below a thousandth."""
    weight = F.greatest(F.lit(1e-3), 0.5 - 0.5 * F.cos(2 * F.pi() * F.col(within) / (width - 1)))
    return pieces.groupBy(*keys, place).agg((F.sum(weight * F.col(value)) / F.sum(weight)).alias(value))
