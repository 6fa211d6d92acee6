"""Signal features of array columns.

The Fourier transform is the one kernel that Spark lacks and comes from NumPy,
for whole Arrow batches; all features are built-in functions over its arrays.
Each function takes (id, a) columns of a table and returns a row for each row.
A feature that has no value is null; arrays of fewer than 32 elements, and null
ones, have none of them.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import wraps

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import arrays as A
from .arrays import let

#: Seconds between samples of a slice, and samples a second that spectra of whole traces assume: fixed values.
INTERVAL, RATE = 8e-9, 15e6
#: Decomposition low-pass filter of the Daubechies wavelet with four vanishing moments: fixed values.
DB4 = (
    -0.010597401785069032, 0.0328830116668852, 0.030841381835560764, -0.18703481171909309,
    -0.027983769416859854, 0.6308807679298589, 0.7148465705529157, 0.2303778133088965,
)
TINY, LEAST = 1e-12, 32
COMPLEX = T.StructType([T.StructField(c, T.ArrayType(T.DoubleType())) for c in ("re", "im")])


def _transformed(a: pd.Series, f) -> pd.DataFrame:
    out = pd.DataFrame({"re": None, "im": None}, index=a.index, dtype=object)
    for n, part in a.groupby(a.map(lambda x: 0 if x is None else len(x))):
        if n:
            z = f(np.stack(part.to_list()))
            out["re"] = out["re"].where(~out.index.isin(part.index), pd.Series(list(z.real), index=part.index))
            out["im"] = out["im"].where(~out.index.isin(part.index), pd.Series(list(z.imag), index=part.index))
    return out


@F.pandas_udf(COMPLEX)
def fourier(a: pd.Series) -> pd.DataFrame:
    """Discrete Fourier transform."""
    return _transformed(a, lambda x: np.fft.fft(x, axis=1))


@F.pandas_udf(COMPLEX)
def analytic(a: pd.Series) -> pd.DataFrame:
    """Analytic signal: the array, and its quadrature."""

    def f(x: np.ndarray) -> np.ndarray:
        n = x.shape[1]
        keep = np.zeros(n)
        keep[0] = 1
        keep[1 : (n + 1) // 2] = 2
        if n % 2 == 0:
            keep[n // 2] = 1
        return np.fft.ifft(np.fft.fft(x, axis=1) * keep, axis=1)

    return _transformed(a, f)


def _whole(family: Callable) -> Callable:
    """A family for all rows: too short arrays stand aside as zeros, and their features become null."""

    @wraps(family)
    def run(df: DataFrame, id: str, a: str, *args, **kwargs) -> DataFrame:
        ok = F.coalesce(F.size(a) >= LEAST, F.lit(False))
        values = F.when(ok, F.col(a).cast("array<double>")).otherwise(F.array_repeat(F.lit(0.0), LEAST))
        found = family(df.select(F.struct(F.col(id).alias("id"), ok.alias("ok")).alias("id"), values.alias("a")), "id", "a", *args, **kwargs)
        return found.select(F.col("id.id").alias("id"), *(F.when(F.col("id.ok"), F.col(c)).alias(c) for c in found.columns if c != "id"))

    return run


def _taken(df: DataFrame, id: str, a: str) -> DataFrame:
    return df.select(F.col(id).alias("id"), F.col(a).cast("array<double>").alias("a"))


def _ratio(x: Column, y: Column) -> Column:
    return x / F.nullif(y, F.lit(0.0))


def _places(a: Column) -> Column:
    return F.sequence(F.lit(0), F.size(a) - 1)


def _at(a: Column, i: Column | int) -> Column:
    return F.get(a, i if isinstance(i, Column) else F.lit(i))


def _weighted(a: Column, f) -> Column:
    """Sum of a[k] * f(k)."""
    return A.total(F.transform(a, lambda x, k: x * f(k)))


def _power(df: DataFrame, id: str, a: str) -> DataFrame:
    """id, a, n and p, the squared sizes of all n frequencies."""
    z = _taken(df, id, a).withColumn("z", fourier("a"))
    return z.select("id", "a", F.size("a").alias("n"), F.zip_with("z.re", "z.im", lambda x, y: x * x + y * y).alias("p"))


@_whole
def instantaneous(df: DataFrame, id: str, a: str) -> DataFrame:
    """id, At, Vt, Pht and Wt: envelope, quadrature, phase and phase steps, rounded to 2 digits."""
    z = _taken(df, id, a).withColumn("z", analytic("a")).select("id", F.col("z.re").alias("x"), F.col("z.im").alias("y"))
    phase = F.zip_with("y", "x", F.atan2)
    rounded = lambda c: F.transform(c, lambda x: F.round(x, 2))
    return z.select("id", rounded(F.zip_with("x", "y", lambda x, y: F.sqrt(x * x + y * y))).alias("At"), rounded("y").alias("Vt"), rounded(phase).alias("Pht"), rounded(let(phase, A.differences)).alias("Wt"))


@_whole
def spectrum(df: DataFrame, id: str, a: str, interval: float = INTERVAL) -> DataFrame:
    """Sn, wmf, Qf, Sn_wmf: area of the amplitude spectrum, mean frequency, quality (peak over its width at 0.7) and area over mean."""
    s = _power(df, id, a).select("id", "n", F.transform(F.slice("p", F.lit(1), F.floor(F.col("n") / 2).cast("int") + 1), F.sqrt).alias("s"))
    f = lambda k: k / (F.col("n") * interval)
    s = s.withColumn("peak", A.argmax(F.slice("s", F.lit(2), F.size("s"))) + 1)
    s = s.withColumn("low", F.filter(_places(F.col("s")), lambda k: _at(F.col("s"), k) < 0.7 * _at(F.col("s"), F.col("peak").cast("int"))))
    left = F.coalesce(F.array_max(F.filter("low", lambda k: k <= F.col("peak"))), F.lit(0))
    right = F.coalesce(F.array_min(F.filter("low", lambda k: k >= F.col("peak"))), F.size("s") - 1)
    s = s.select("id", (A.total(F.col("s")) / F.col("n")).alias("Sn"), _ratio(_weighted(F.col("s"), f), A.total(F.col("s"))).alias("wmf"), _ratio(F.col("peak"), (right - left).cast("double")).alias("Qf"))
    return s.withColumn("Sn_wmf", _ratio(F.col("Sn"), F.col("wmf")))


@_whole
def frequency(df: DataFrame, id: str, a: str, rate: float = RATE) -> DataFrame:
    """Shape of the power spectrum: centre, band, high to low ratio, slope, entropy, strongest frequencies but the first, moments."""
    s = _power(df, id, a).select("id", "n", F.slice("p", F.lit(1), F.floor(F.col("n") / 2).cast("int")).alias("p"))
    p, m, step = F.col("p"), F.size("p"), F.lit(rate) / F.col("n")
    s = s.withColumns({"total": A.total(p), "strong": let(F.array_max(F.slice(p, F.lit(2), m)), lambda top: F.filter(_places(p), lambda k: _at(p, k) > 0.5 * top)), "order": F.reverse(F.array_sort(F.transform(p, lambda x, k: F.struct(x.alias("x"), k.alias("k")))))})
    high, low = A.total(F.filter(p, lambda x, k: k * 2 >= m - 1)), A.total(F.filter(p, lambda x, k: k * 2 < m - 1))
    points = F.transform(F.slice(p, F.lit(2), m), lambda x, k: F.struct(F.log10(k + 1).alias("f"), F.log10(F.greatest(x, F.lit(1e-300))).alias("y")))
    s = s.withColumn("points", points)
    mean = lambda c: A.mean(F.transform("points", lambda q: q[c]))
    slope = let(mean("f"), lambda f0: let(mean("y"), lambda y0: A.total(F.transform("points", lambda q: (q["f"] - f0) * (q["y"] - y0))) / A.total(F.transform("points", lambda q: (q["f"] - f0) * (q["f"] - f0)))))
    total = F.greatest("total", F.lit(1e-300))
    moment = lambda j: _ratio(_weighted(p, lambda k: F.pow(k * step, F.lit(float(j)))), F.col("total"))
    return s.select(
        "id", moment(1).alias("central"), ((F.array_max("strong") - F.array_min("strong")) * step).alias("bandwidth"), _ratio(high, low).alias("high_low"), moment(1).alias("centroid"), slope.alias("slope"),
        A.total(F.transform(p, lambda x: -x / total * F.ln(F.when(x > 0, x / total).otherwise(1.0)))).alias("entropy"),
        *((_at(F.col("order"), j)["k"] * step).alias(f"dominant_{j}") for j in (1, 2, 3)), *(moment(j).alias(f"moment_{j}") for j in (1, 2, 3)),
    )


@_whole
def envelope(df: DataFrame, id: str, a: str) -> DataFrame:
    """Area, greatest value and its place, mean, deviation, skewness, kurtosis, peak factor and energy of thirds of the envelope."""
    s = _taken(df, id, a).withColumn("z", analytic("a")).select("id", F.zip_with("z.re", "z.im", lambda x, y: F.sqrt(x * x + y * y)).alias("e"))
    e, third = F.col("e"), F.floor(F.size("e") / 3).cast("int")
    return s.select(
        "id", A.trapezoid(e).alias("area"), F.array_max(e).alias("max"), A.argmax(e).cast("double").alias("time_to_max"), A.mean(e).alias("mean"), A.std(e).alias("std"), A.skewness(e).alias("skew"), A.kurtosis(e).alias("kurt"),
        _ratio(F.array_max(e), A.mean(e)).alias("max_to_mean"), *(let(F.slice(e, third * k + 1, third), lambda t: A.dot(t, t)).alias(f"energy_{k + 1}") for k in range(3)),
    )


@_whole
def autocorrelation(df: DataFrame, id: str, a: str) -> DataFrame:
    """First minimum, value at lag 10, decay over 10 lags, integral, width at half height and ratio of lags 10 and 20."""
    x = F.col("a")
    s = _taken(df, id, a).select("id", F.transform(_places(x), lambda k: A.total(F.zip_with(F.slice(x, F.lit(1), F.size(x) - k), F.slice(x, k + 1, F.size(x) - k), lambda u, v: u * v))).alias("c"))
    c, last = F.col("c"), F.size("c") - 1
    dip = F.filter(F.sequence(F.lit(1), last), lambda k: (_at(c, k) < _at(c, k - 1)) & ((k == last) | (_at(c, k) <= _at(c, k + 1))))
    below = F.filter(_places(c), lambda k: _at(c, k) <= 0.5 * _at(c, 0))
    return s.select(
        "id", _at(dip, 0).cast("double").alias("first_minimum"), _at(c, 10).alias("at_10"), (_weighted(F.slice(c, 1, 10), lambda k: k - 4.5) / 82.5).alias("decay"),
        A.trapezoid(c).alias("integral"), F.coalesce(_at(below, 0), last).cast("double").alias("width"), _ratio(_at(c, 10), _at(c, 20)).alias("ratio"),
    )


def _near(x: Column, width: int, reach: Column) -> Column:
    """For each window of ``width`` elements, how many windows differ by at most ``reach`` everywhere."""
    starts = F.sequence(F.lit(0), F.size(x) - width)

    def alike(i: Column, j: Column) -> Column:
        found = F.lit(True)
        for d in range(width):
            found = found & (F.abs(_at(x, i + d) - _at(x, j + d)) <= reach)
        return found

    return F.transform(starts, lambda i: F.size(F.filter(starts, lambda j: alike(i, j))))


@_whole
def entropies(df: DataFrame, id: str, a: str, scales: int = 10) -> DataFrame:
    """Histogram entropy of the array and of coarser ones, order patterns, approximate and sample entropy, spectral entropies."""
    x, n = F.col("a"), F.col("n")
    s = _power(df, id, a)
    s = s.withColumns({"reach": 0.2 * A.std(x), "q": let(A.total(F.col("p")), lambda t: F.transform("p", lambda v: v / t))})
    s = s.withColumns({"two": _near(x, 2, F.col("reach")), "three": _near(x, 3, F.col("reach"))})
    coarse = lambda k: F.transform(F.sequence(F.lit(0), F.floor(n / k).cast("int") - 1), lambda i: A.mean(F.slice(x, i * k + 1, F.lit(k))))
    shannon = lambda k: F.when(F.floor(n / k) > 1, let(coarse(k), lambda c: A.entropy(A.histogram(c, 50))))
    phi = lambda c: A.mean(let(F.size(c), lambda m: F.transform(c, lambda v: F.ln(v / m))))
    pairs = lambda c: A.total(F.transform(F.slice(c, F.lit(1), n - 2), lambda v: v - 1.0))
    return s.select(
        "id", *(shannon(k).alias(f"shannon_{k}") for k in range(1, scales + 1)), A.permutation_entropy(x).alias("permutation"), F.abs(phi("three") - phi("two")).alias("approximate"),
        (-F.ln(_ratio(pairs("three"), pairs("two")))).alias("sample"), A.total(F.transform("q", lambda v: -v * F.log2(v + TINY))).alias("fourier"), F.exp(A.total(F.transform("q", lambda v: v * F.ln(v + TINY)))).alias("hirschman"),
    )


def slope(x: Column, y: Column) -> Column:
    """Least-squares slope of y over x."""
    return let(x, lambda u: let(y, lambda v: let(A.mean(u), lambda m: let(A.mean(v), lambda k: A.total(F.zip_with(u, v, lambda p, q: (p - m) * (q - k))) / F.nullif(A.total(F.transform(u, lambda p: (p - m) * (p - m))), F.lit(0.0))))))


def running(a: Column) -> Column:
    """Running sums."""
    return F.aggregate(a, F.array().cast("array<double>"), lambda s, x: F.array_append(s, F.coalesce(F.get(s, F.size(s) - 1), F.lit(0.0)) + x))


def _cut(a: Column, w: Column) -> Column:
    """Whole blocks of w elements."""
    return F.transform(F.sequence(F.lit(0), F.floor(F.size(a) / w).cast("int") - 1), lambda i: F.slice(a, i * w + 1, w))


@_whole
def fractal(df: DataFrame, id: str, a: str, orders: int = 20) -> DataFrame:
    """Lacunarity, rescaled-range exponent and the singularity spectrum of detrended fluctuations."""
    x, n = F.col("a"), F.size("a")
    s = _taken(df, id, a).withColumns({"sums": F.concat(F.array(F.lit(0.0)), running(x)), "walk": let(A.mean(x), lambda m: running(F.transform(x, lambda v: v - m)))})
    log2 = F.floor(F.log2(n.cast("double"))).cast("int")
    powers = lambda low, high: F.transform(F.sequence(F.lit(low), high), lambda k: F.pow(F.lit(2.0), k).cast("int"))
    mass = lambda s, w: F.zip_with(F.slice(s, w + 1, n + 1 - w), F.slice(s, F.lit(1), n + 1 - w), lambda u, v: u - v)
    lacunarity = A.mean(let(F.col("sums"), lambda s: F.transform(powers(1, log2 - 1), lambda w: let(mass(s, w), lambda b: _ratio(A.moment(b, 2), let(A.mean(b), lambda m: m * m))))))
    ranged = lambda b: let(let(A.mean(b), lambda m: running(F.transform(b, lambda v: v - m))), lambda r: _ratio(F.array_max(r) - F.array_min(r), A.std(b)))
    sizes = F.filter(powers(3, F.lit(11)), lambda w: w <= F.floor(n / 2))
    hurst = slope(F.transform(sizes, lambda w: F.ln(w)), F.transform(sizes, lambda w: F.ln(A.mean(F.array_compact(F.transform(_cut(x, w), ranged))))))
    high = F.log10(F.greatest(F.floor(n / 2), F.lit(11)).cast("double"))
    scales = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(19)), lambda k: F.floor(F.pow(F.lit(10.0), 1 + (high - 1) * k / 19) + 1e-9).cast("int")))
    s = s.select("id", "walk", lacunarity.alias("lacunarity"), F.when(F.size(sizes) > 1, hurst).alias("hurst"), F.filter(scales, lambda w: w <= n).alias("scales"))

    def rest(b: Column) -> Column:
        """Mean square of a block about its own line."""
        middle = (F.size(b) - 1) / 2.0
        along = let(A.mean(b), lambda m: A.total(F.transform(b, lambda v, i: (v - m) * (i - middle))))
        across = A.total(F.transform(b, lambda v, i: (i - middle) * (i - middle)))
        return F.greatest(A.moment(b, 2) - along * along / across / F.size(b), F.lit(1e-300))

    # let: a column that a lambda uses is computed once, not once for each element
    s = s.withColumn("squares", let(F.col("walk"), lambda y: F.transform("scales", lambda w: F.transform(_cut(y, w), rest))))
    q = F.array(*(F.lit(-5 + 10 * k / (orders - 1)) for k in range(orders)))
    logs = lambda squares, k: F.transform(squares, lambda b: F.ln(F.pow(A.mean(F.transform(b, lambda v: F.pow(v, k / 2))), 1 / k)))
    s = s.withColumn("h", let(F.transform("scales", lambda w: F.ln(w)), lambda x: let(F.col("squares"), lambda y: F.transform(q, lambda k: slope(x, logs(y, k))))))
    s = s.withColumn("tau", F.zip_with("h", q, lambda h, k: h * k - 1))
    s = s.withColumn("alpha", F.transform(let(F.col("tau"), A.differences), lambda d: d / (10 / (orders - 1))))
    s = s.withColumn("f", let(F.col("tau"), lambda t: F.transform("alpha", lambda v, k: F.get(q, k) * v - F.get(t, k))))
    alpha, f = F.col("alpha"), F.col("f")
    top = F.get("alpha", A.argmax(f).cast("int"))
    return s.select(
        "id", "lacunarity", "hurst", (F.array_max(alpha) - F.array_min(alpha)).alias("mf_width"), top.alias("mf_position"), _ratio(top - _at(alpha, 0), F.element_at(alpha, -1) - top).alias("mf_asymmetry"), F.array_max(f).alias("mf_height"),
        A.mean(alpha).alias("mf_mean_alpha"), A.mean(f).alias("mf_mean_f"), A.std(alpha).alias("mf_std_alpha"), A.std(f).alias("mf_std_f"),
    )


def _halves(a: Column) -> tuple[Column, Column]:
    """One level of the wavelet transform with mirrored ends: approximation and detail."""
    k = len(DB4)
    ends = F.concat(F.reverse(F.slice(a, 1, k - 1)), a, F.reverse(F.slice(a, F.size(a) - k + 2, F.lit(k - 1))))
    low = F.array(*(F.lit(x) for x in reversed(DB4)))
    high = F.array(*(F.lit(x * (1 if i % 2 == 0 else -1)) for i, x in enumerate(DB4)))
    starts = lambda e: F.sequence(F.lit(1), F.size(e) - k, F.lit(2))
    filtered = lambda g: let(ends, lambda e: F.transform(starts(e), lambda i: A.dot(F.slice(e, i + 1, F.lit(k)), g)))
    return filtered(low), filtered(high)


@_whole
def wavelet(df: DataFrame, id: str, a: str, levels: int = 5) -> DataFrame:
    """Energy, mean, deviation, extremes and entropy of each level's coefficients, and ratios of energies."""
    s = _taken(df, id, a).withColumn("rest", F.col("a"))
    for level in range(1, levels + 1):
        low, high = _halves(F.col("rest"))
        s = s.withColumns({f"D{level}": high, "rest": low})
    s = s.withColumnRenamed("rest", f"A{levels}")
    bands = [*(f"D{k}" for k in range(1, levels + 1)), f"A{levels}"]
    of = lambda b, c: {"energy": A.dot(c, c), "mean": A.mean(c), "std": A.std(c), "skew": A.skewness(c), "kurt": A.kurtosis(c), "max": F.array_max(c), "min": F.array_min(c), "entropy": let(A.total(F.transform(c, F.abs)), lambda t: A.total(F.transform(c, lambda v: -F.abs(v) / t * F.ln(F.when(v != 0, F.abs(v) / t).otherwise(1.0)))))}
    s = s.select("id", *(v.alias(f"{b}_{k}") for b in bands for k, v in of(b, F.col(b)).items()))
    pairs = [(f"D{k}", other) for k in range(1, levels + 1) for other in ([f"A{levels}"] + ([f"D{k + 1}"] if k < levels else []))]
    return s.select("*", *(_ratio(F.col(f"{b}_energy"), F.col(f"{o}_energy")).alias(f"{b}_{o}") for b, o in pairs))


@_whole
def recurrence(df: DataFrame, id: str, a: str) -> DataFrame:
    """Share of the closest tenth of pairs of embedded points (three elements in a row), of it on the first diagonal, and that diagonal's mean."""
    x, last = F.col("a"), F.size("a") - 3
    gap = lambda i, j: F.sqrt(sum(((_at(x, i + d) - _at(x, j + d)) * (_at(x, i + d) - _at(x, j + d)) for d in range(3)), F.lit(0.0)))
    places = F.sequence(F.lit(0), last)
    s = _taken(df, id, a).withColumn("d", F.transform(places, lambda i: F.transform(places, lambda j: gap(i, j))))
    s = s.withColumn("all", F.array_sort(F.flatten("d"))).withColumn("place", 0.1 * (F.size("all") - 1))
    low = F.floor("place").cast("int")
    s = s.withColumn("limit", F.get("all", low) + (F.get("all", low + 1) - F.get("all", low)) * (F.col("place") - low))
    near = F.size(F.filter("all", lambda v: v < F.col("limit"))).cast("double")
    on = F.size(F.filter(F.sequence(F.lit(0), F.size("d") - 2), lambda i: F.get(F.get("d", i), i + 1) < F.col("limit"))).cast("double")
    return s.select("id", (near / F.size("all")).alias("rate"), (on / F.greatest(near, F.lit(1.0))).alias("determinism"), (on / (F.size("d") - 1)).alias("diagonal"))


@_whole
def morphology(df: DataFrame, id: str, a: str) -> DataFrame:
    """Shares that erosion leaves and dilation makes of what lies above half the greatest value."""
    s = _taken(df, id, a).select("id", let(F.array_max("a"), lambda m: F.transform("a", lambda x: x > 0.5 * m)).alias("on"))
    on = lambda i: F.coalesce(F.get("on", i), F.lit(False))
    count = F.size(F.filter("on", lambda v: v)).cast("double")
    kept, grown = (F.size(F.filter(_places(F.col("on")), f)).cast("double") for f in (lambda i: on(i - 1) & on(i) & on(i + 1), lambda i: on(i - 1) | on(i) | on(i + 1)))
    return s.select("id", _ratio(kept, count).alias("erosion"), _ratio(grown, count).alias("dilation"))


def cosines(a: Column, back: bool = False) -> Column:
    """Orthonormal cosine transform, or its inverse."""

    def one(n: Column, k: Column) -> Column:
        scale = lambda j: F.when(j == 0, F.sqrt(1 / n)).otherwise(F.sqrt(2 / n))
        turn = lambda j, i: F.cos(math.pi * (i + 0.5) * j / n)
        return _weighted(a, (lambda i: scale(i) * turn(i, k)) if back else (lambda i: scale(k) * turn(k, i)))

    return let(F.size(a).cast("double"), lambda n: F.transform(_places(a), lambda k: one(n, k)))


@_whole
def rank_cepstrum(df: DataFrame, id: str, a: str) -> DataFrame:
    """id and CRL: ranks of the inverse cosine transform of the logarithm of the ranks of the cosine transform."""
    ranks = let(let(F.transform(let(cosines(F.col("a")), A.ranks), F.ln), lambda r: cosines(r, back=True)), A.ranks)
    return _taken(df, id, a).select("id", ranks.alias("CRL"))


FAMILIES = {"spectrum": spectrum, "frequency": frequency, "envelope": envelope, "acf": autocorrelation, "entropy": entropies, "fractal": fractal, "wavelet": wavelet, "recurrence": recurrence, "morphology": morphology}
