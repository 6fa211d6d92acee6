"""Functions of array columns, all as built-in higher-order functions."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x) with x computed once, however often f uses it and in whatever lambda."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def mean(a: Column) -> Column:
    return total(a) / F.nullif(F.size(a), F.lit(0))


def moment(a: Column, k: int) -> Column:
    """Central moment."""
    return let(mean(a), lambda m: F.aggregate(a, F.lit(0.0), lambda s, x: s + F.pow(x - m, F.lit(k)))) / F.nullif(F.size(a), F.lit(0))


def std(a: Column) -> Column:
    """Population deviation."""
    return F.sqrt(moment(a, 2))


def skewness(a: Column) -> Column:
    """Biased skewness; null for constants."""
    return moment(a, 3) / F.nullif(F.pow(moment(a, 2), F.lit(1.5)), F.lit(0.0))


def kurtosis(a: Column) -> Column:
    """Biased excess kurtosis; null for constants."""
    return moment(a, 4) / F.nullif(F.pow(moment(a, 2), F.lit(2.0)), F.lit(0.0)) - 3


def argmax(a: Column) -> Column:
    """Place of the first greatest element, from 0."""
    return F.array_position(a, F.array_max(a)) - 1


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def pearson(a: Column, b: Column) -> Column:
    centred = lambda v: let(mean(v), lambda m: F.transform(v, lambda x: x - m))
    return let(centred(a), lambda u: let(centred(b), lambda v: cosine(u, v)))


def angular(x: Column) -> Column:
    """(pi - arccos x) / pi."""
    return (F.pi() - F.acos(x)) / F.pi()


def resample(a: Column, n: int) -> Column:
    """n points evenly spaced over the array, linearly interpolated; arrays of one element repeat it."""
    last = F.size(a) - 1

    def at(k: Column) -> Column:
        place = k * last / F.lit(float(max(n - 1, 1)))
        low = F.floor(place).cast("int")
        x, y = F.get(a, low), F.get(a, F.least(low + 1, last))
        return x + (y - x) * (place - low)

    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.lit(n - 1)), at))


def block_means(a: Column, n: int) -> Column:
    """Means of n blocks of round(size / n) elements; blocks past the end are null."""
    size = F.greatest(F.bround(F.size(a) / n).cast("int"), F.lit(1))
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: mean(F.slice(a, k * size + 1, size)))


def histogram(a: Column, n: int) -> Column:
    """Counts in n equal bins; the last edge is inclusive, constants are all in bin 0."""

    def binned(low: Column, high: Column) -> Column:
        return F.transform(a, lambda x: F.when(high > low, F.least(F.floor((x - low) * n / F.nullif(high - low, F.lit(0.0))), F.lit(n - 1))).otherwise(0).cast("int"))

    bins = let(F.array_min(a), lambda low: let(F.array_max(a), lambda high: binned(low, high)))
    return let(bins, lambda own: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.size(F.filter(own, lambda b: b == k))))


def entropy(counts: Column) -> Column:
    """Entropy of counts, in bits."""

    def over(c: Column, n: Column) -> Column:
        return F.aggregate(c, F.lit(0.0), lambda s, x: s - F.when(x > 0, x / n * F.log2(x / n)).otherwise(0.0))

    return let(counts, lambda c: let(total(c), lambda n: over(c, n)))


def permutation_entropy(a: Column) -> Column:
    """Entropy of the order patterns of consecutive triples, in bits; ties keep their order."""
    last = F.size(a) - 3

    def pattern(i: Column) -> Column:
        x, y, z = F.get(a, i), F.get(a, i + 1), F.get(a, i + 2)
        return (x <= y).cast("int") * 4 + (y <= z).cast("int") * 2 + (x <= z).cast("int")

    seen = F.transform(F.sequence(F.lit(0), last), pattern)
    counts = let(seen, lambda own: F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.size(F.filter(own, lambda p: p == k))))
    return F.when(last >= 0, entropy(counts))


def teager(a: Column) -> Column:
    """Mean of x[i]^2 - x[i-1] x[i+1]."""
    inner = F.sequence(F.lit(1), F.size(a) - 2)
    return F.when(F.size(a) > 2, mean(F.transform(inner, lambda i: F.get(a, i) * F.get(a, i) - F.get(a, i - 1) * F.get(a, i + 1))))


def differences(a: Column) -> Column:
    return F.when(F.size(a) > 1, F.transform(F.sequence(F.lit(1), F.size(a) - 1), lambda i: F.get(a, i) - F.get(a, i - 1))).otherwise(F.array().cast("array<double>"))


def steepness(a: Column, width: int = 5) -> Column:
    """Mean of the greatest absolute difference in each run of ``width`` differences, but for the last run."""
    runs = lambda d: F.transform(F.sequence(F.lit(0), F.size(d) - width - 1), lambda i: F.array_max(F.slice(d, i + 1, width)))
    return F.when(F.size(a) > width + 1, let(let(F.transform(differences(a), F.abs), runs), mean))


def count_peaks(a: Column) -> Column:
    """Interior elements greater than both neighbours."""
    return F.when(F.size(a) > 2, F.size(F.filter(F.sequence(F.lit(1), F.size(a) - 2), lambda i: (F.get(a, i) > F.get(a, i - 1)) & (F.get(a, i) > F.get(a, i + 1))))).otherwise(0)


def extrema(a: Column, low: float = 0.0, middle: float = 128.0, high: float = 256.0) -> Column:
    """Keep only where local maxima (low) and minima (high) lie; all else is the middle."""

    def mark(x: Column, i: Column) -> Column:
        before, after = F.get(a, i - 1), F.get(a, i + 1)
        return F.when((x > before) & (x > after), low).when((x < before) & (x < after), high).otherwise(middle)

    return F.transform(a, lambda x, i: F.coalesce(mark(x, i), F.lit(middle)))


def ranks(a: Column) -> Column:
    """Ranks from 1, equal elements sharing their mean rank."""
    return F.transform(a, lambda x: F.size(F.filter(a, lambda y: y < x)) + (F.size(F.filter(a, lambda y: y == x)) + 1) / 2.0)


def trapezoid(a: Column) -> Column:
    """Area under the array at unit steps."""
    return F.when(F.size(a) > 0, total(a) - (F.get(a, F.lit(0)) + F.element_at(a, F.lit(-1))) / 2)


def savgol(a: Column, width: int, degree: int) -> Column:
    """Savitzky-Golay smoothing; the ends take the polynomial of the first and last whole window."""
    half = width // 2
    design = np.vander(np.arange(-half, half + 1), degree + 1, increasing=True)
    smoother = design @ np.linalg.pinv(design)  # row k: weights for the value at window place k
    table = F.array(*(F.array(*(F.lit(float(w)) for w in row)) for row in smoother))

    def at(_: Column, i: Column) -> Column:
        start = F.least(F.greatest(i - half, F.lit(0)), F.size(a) - width)
        return dot(F.slice(a, start + 1, width), F.get(table, i - start))

    return F.when(F.size(a) >= width, F.transform(a, at))


def windows(n: Column, width: int, stride: int) -> Column:
    """Starts of sliding windows over n places, with one at the very end where the stride misses it."""
    last = n - width
    starts = F.sequence(F.lit(0), last, F.lit(stride))
    return F.when(last >= 0, F.array_distinct(F.concat(starts, F.array(last))))


def label_window(at: Column, reach: int, n: Column) -> Column:
    """Places from at - reach up to before at + reach that lie in 0 to n - 1."""
    low, high = F.greatest(at - reach, F.lit(0)), F.least(at + reach, n) - 1
    return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))
