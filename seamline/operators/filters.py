"""Filters of traces and of whole profiles: wavelet denoising, zero-phase recursive filters, and transforms along samples and places.

Kernels are NumPy over Arrow batches of arrays of one length; a trace is one
array. Profiles are (keys, place, array) rows and never meet in one task.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.signal import DB4

LOW = np.array(DB4)
HIGH = LOW[::-1] * np.where(np.arange(len(LOW)) % 2, 1.0, -1.0)
WIDTH = len(LOW)


def _by_length(a: pd.Series, kernel: Callable[[np.ndarray], np.ndarray | None]) -> pd.Series:
    """The kernel for all arrays of each length at once; null for null and empty arrays and where it has no value."""
    out = pd.Series([None] * len(a), index=a.index, dtype=object)
    for n, part in a.groupby(a.map(lambda x: 0 if x is None else len(x))):
        made = kernel(np.stack(part.to_list()).astype(float)) if n else None
        if made is not None:
            out.loc[part.index] = pd.Series(list(made), index=part.index)
    return out


def split_band(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Coarse and fine halves of each row, which is mirrored at its ends."""
    n = x.shape[1]
    ext = np.pad(x, ((0, 0), (WIDTH - 1, WIDTH - 1)), "symmetric")
    windows = np.lib.stride_tricks.sliding_window_view(ext, WIDTH, axis=1)[:, 1::2][:, : (n + WIDTH - 1) // 2]
    return windows @ LOW[::-1], windows @ HIGH[::-1]


def joined_band(coarse: np.ndarray, fine: np.ndarray) -> np.ndarray:
    """What ``split_band`` was made from; one value more where that had an odd length."""
    m = coarse.shape[1]
    out = np.zeros((len(coarse), 2 * m + WIDTH - 2))
    for j in range(WIDTH):
        out[:, j : j + 2 * m : 2] += coarse * LOW[WIDTH - 1 - j] + fine * HIGH[WIDTH - 1 - j]
    return out[:, WIDTH - 2 : 2 * m]


def denoised(a: Column, levels: int | None = None, threshold: float | None = None, soft: bool = True) -> Column:
    """Arrays without the small coefficients of their wavelet levels.

    Each level's threshold is its median size over 0.6745 times the root of
    twice the log of its length, or the one given; ``soft`` also draws what
    stays toward zero. Without ``levels`` there are as many as the filter fits
    into; an array too short for one is returned as it is.
    """

    def kernel(x: np.ndarray) -> np.ndarray:
        n = x.shape[1]
        most = max(0, int(math.log2(n / (WIDTH - 1)))) if n >= WIDTH - 1 else 0
        fine, coarse = [], x
        for _ in range(most if levels is None else min(levels, most)):
            coarse, d = split_band(coarse)
            size = np.abs(d)
            t = np.median(size, axis=1, keepdims=True) / 0.6745 * math.sqrt(2 * math.log(d.shape[1])) if threshold is None else threshold
            fine.append(np.sign(d) * np.maximum(size - t, 0) if soft else np.where(size < t, 0, d))
        for d in fine[::-1]:
            coarse = joined_band(coarse[:, : d.shape[1]], d)
        return coarse[:, :n]

    @F.pandas_udf("array<double>")
    def run(values: pd.Series) -> pd.Series:
        return _by_length(values, kernel)

    return run(a.cast("array<double>"))


def butterworth(order: int, cut: float, high: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Numerator and denominator of a digital filter of maximal flatness; ``cut`` is a share of half the sampling rate, where the gain is the root of one half."""
    if order < 1 or not 0 < cut < 1:
        raise ValueError("a filter has an order of at least 1 and a cut between 0 and 1")
    poles = np.exp(1j * np.pi * (2 * np.arange(order) + order + 1) / (2 * order))
    warped = 4 * math.tan(math.pi * cut / 2)
    poles = warped / poles if high else warped * poles
    roots = (4 + poles) / (4 - poles)
    a = np.poly(roots).real
    b = np.poly(np.full(order, 1.0 if high else -1.0))
    at = -1.0 if high else 1.0  # the gain there is 1
    return b * (np.polyval(a, at) / np.polyval(b, at)), a


def _passed(b: np.ndarray, a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """One pass over rows, begun in the steady state of their first values."""
    m = len(a) - 1
    step = np.eye(m) - np.column_stack([-a[1:], np.eye(m)[:, : m - 1]])
    state = np.linalg.solve(step, b[1:] - a[1:] * b[0])[None, :] * x[:, :1]
    out = np.empty_like(x)
    for t in range(x.shape[1]):
        out[:, t] = b[0] * x[:, t] + state[:, 0]
        state = np.column_stack([state[:, 1:], np.zeros(len(x))]) + x[:, t, None] * b[1:] - out[:, t, None] * a[1:]
    return out


def zero_phase(a: Column, order: int, cut: float, high: bool = False) -> Column:
    """Arrays filtered forward and back, so that nothing shifts and the gain is squared.

    Ends are continued by their point reflection over three filter lengths;
    arrays no longer than that have no value.
    """
    b, den = butterworth(order, cut, high)
    pad = 3 * len(den)

    def kernel(x: np.ndarray) -> np.ndarray | None:
        if x.shape[1] <= pad:
            return None
        ends = 2 * x[:, :1] - x[:, pad:0:-1], 2 * x[:, -1:] - x[:, -2 : -pad - 2 : -1]
        there = _passed(b, den, np.concatenate([ends[0], x, ends[1]], axis=1))
        return _passed(b, den, there[:, ::-1])[:, ::-1][:, pad:-pad]

    @F.pandas_udf("array<double>")
    def run(values: pd.Series) -> pd.Series:
        return _by_length(values, kernel)

    return run(a.cast("array<double>"))


def cosines(x: np.ndarray, axis: int) -> np.ndarray:
    """Orthonormal cosine transform (second kind)."""
    x = np.moveaxis(x, axis, -1)
    n = x.shape[-1]
    z = np.fft.fft(np.concatenate([x, x[..., ::-1]], axis=-1), axis=-1)[..., :n]
    y = (z * np.exp(-0.5j * np.pi * np.arange(n) / n)).real * math.sqrt(1 / (2 * n))
    y[..., 0] /= math.sqrt(2)
    return np.moveaxis(y, -1, axis)


def cosines_back(y: np.ndarray, axis: int) -> np.ndarray:
    y = np.moveaxis(y, axis, -1).copy()
    n = y.shape[-1]
    y[..., 0] *= math.sqrt(2)
    half = y * math.sqrt(2 * n) * np.exp(0.5j * np.pi * np.arange(n) / n)
    z = np.concatenate([half, np.zeros((*half.shape[:-1], 1)), np.conj(half[..., :0:-1])], axis=-1)
    return np.moveaxis(np.fft.ifft(z, axis=-1).real[..., :n], -1, axis)


#: name: (along samples first, kernel along samples, kernel along places)
KINDS: dict[str, tuple[bool, Callable, Callable]] = {
    "fourier": (True, lambda z, n: np.fft.rfft(z.real, axis=1), lambda z: np.fft.fft(z, axis=0)),
    "fourier_back": (False, lambda z, n: np.fft.irfft(z, n, axis=1).astype(complex), lambda z: np.fft.ifft(z, axis=0)),
    "cosine": (True, lambda z, n: cosines(z.real, 1).astype(complex), lambda z: cosines(z.real, 0).astype(complex)),
    "cosine_back": (False, lambda z, n: cosines_back(z.real, 1).astype(complex), lambda z: cosines_back(z.real, 0).astype(complex)),
}


def _along_samples(df: DataFrame, kernel: Callable, n: int | None) -> DataFrame:
    @F.pandas_udf("re array<double>, im array<double>")
    def run(re: pd.Series, im: pd.Series) -> pd.DataFrame:
        both = pd.Series([None if a is None or len(a) == 0 else a + (0 if b is None else 1j * b) for a, b in zip(re, im)], index=re.index, dtype=object)
        out = pd.DataFrame({"re": None, "im": None}, index=re.index, dtype=object)
        for _, part in both.groupby(both.map(lambda z: 0 if z is None else len(z))):
            if part.iloc[0] is not None:
                z = kernel(np.stack(part.to_list()), n or 2 * (len(part.iloc[0]) - 1))
                out.loc[part.index, "re"], out.loc[part.index, "im"] = pd.Series(list(z.real), index=part.index), pd.Series(list(z.imag), index=part.index)
        return out

    return df.withColumn("_z", run("re", "im")).withColumns({"re": F.col("_z.re"), "im": F.col("_z.im")}).drop("_z")


def _along_places(df: DataFrame, keys: list[str], kernel: Callable, block: int) -> DataFrame:
    """Each block of ``block`` samples of all places is one group; then the blocks of a place are laid end to end."""
    cut = lambda c: F.transform(F.sequence(F.lit(0), F.floor((F.size(c) - 1) / block).cast("int")), lambda k: F.slice(c, k * block + 1, F.lit(block)))
    blocks = df.filter(F.size("re") > 0).select(*keys, "place", F.posexplode(F.arrays_zip(cut(F.col("re")).alias("re"), cut(F.col("im")).alias("im"))).alias("b", "z")).select(*keys, "place", "b", "z.re", "z.im")

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("place", kind="stable")
        z = kernel(np.stack(frame["re"].to_list()) + 1j * np.stack(frame["im"].to_list()))
        return frame.assign(re=list(z.real), im=list(z.imag))

    made = blocks.groupBy(*keys, "b").applyInPandas(run, blocks.schema)
    parts = made.groupBy(*keys, "place").agg(F.array_sort(F.collect_list(F.struct("b", "re", "im"))).alias("_p"))
    return parts.select(*keys, "place", F.flatten(F.transform("_p", lambda p: p["re"])).alias("re"), F.flatten(F.transform("_p", lambda p: p["im"])).alias("im"))


def transformed(profile: DataFrame, keys: list[str], place: str, kind: str, re: str = "re", im: str | None = None, places: bool = True, samples: int | None = None, block: int = 16) -> DataFrame:
    """(keys, place, re, im): a profile's transform along its samples and, with ``places``, along its places.

    ``kind`` is one of KINDS; ``fourier`` has only the frequencies that a real
    trace's others follow from, and ``samples`` is the length that
    ``fourier_back`` gives (twice the last frequency by default). Places are
    ordered, differ within a profile, and its traces have one length; rows
    without an array are left out along places. One group holds ``block``
    samples of all places of a profile.
    """
    first, own, across = KINDS[kind]
    df = profile.select(*keys, F.col(place).alias("place"), F.col(re).cast("array<double>").alias("re"), (F.col(im) if im else F.lit(None)).cast("array<double>").alias("im"))
    df = df.withColumn("im", F.coalesce("im", F.transform("re", lambda _: F.lit(0.0))))
    steps = [lambda d: _along_samples(d, own, samples), lambda d: _along_places(d, keys, across, block) if places else d]
    for step in steps if first else steps[::-1]:
        df = step(df)
    return df.withColumnRenamed("place", place)
