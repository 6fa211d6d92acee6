"""Filters against their definitions: reconstruction, gain and phase, and NumPy's own transforms."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from seamline.operators import filters as K


def test_bands_join_again():
    r = np.random.default_rng(1)
    for n in (7, 8, 9, 31, 64, 101):
        x = r.normal(size=(3, n))
        coarse, fine = K.split_band(x)
        assert coarse.shape == fine.shape == (3, (n + 7) // 2)
        assert np.allclose(K.joined_band(coarse, fine)[:, :n], x)


def test_denoising(spark):
    r = np.random.default_rng(2)
    clean = np.sin(np.arange(256) / 15) * 10
    noisy = clean + r.normal(size=256)
    rows = [(1, noisy.tolist()), (2, None), (3, []), (4, [1.0, 2.0, 3.0]), (5, [5.0] * 90)]
    df = spark.createDataFrame(rows, "id long, a array<double>")
    got = {x.id: x for x in df.select("id", K.denoised(F.col("a"), levels=2).alias("soft"), K.denoised(F.col("a"), levels=2, soft=False).alias("hard"), K.denoised(F.col("a"), threshold=0.0).alias("none")).collect()}
    assert np.allclose(got[1].none, noisy)
    for way in (got[1].soft, got[1].hard):
        assert np.mean((np.array(way) - clean) ** 2) < 0.6 * np.mean((noisy - clean) ** 2)
    assert got[2].soft is None and got[3].soft is None and got[4].soft == [1.0, 2.0, 3.0] and np.allclose(got[5].soft, 5.0)


@pytest.mark.parametrize("order,cut,high", [(1, 0.3, False), (4, 0.2, False), (3, 0.4, True)])
def test_gain_and_phase(spark, order, cut, high):
    b, a = K.butterworth(order, cut, high)
    gain = lambda w: abs(np.polyval(b, np.exp(1j * math.pi * w)) / np.polyval(a, np.exp(1j * math.pi * w)))
    assert math.isclose(gain(cut), math.sqrt(0.5), rel_tol=1e-9) and math.isclose(gain(1.0 if high else 0.0), 1.0, rel_tol=1e-9) and gain(0.0 if high else 1.0) < 1e-3
    n = np.arange(2000)
    waves = {k: np.cos(math.pi * w * n + 0.7) for k, w in enumerate((cut / 2, cut, (1 + cut) / 2))}
    df = spark.createDataFrame([(k, w.tolist()) for k, w in waves.items()] + [(9, [1.0] * 5), (10, None)], "id long, a array<double>")
    got = {x.id: x.f for x in df.select("id", K.zero_phase(F.col("a"), order, cut, high).alias("f")).collect()}
    assert got[9] is None and got[10] is None
    for k, w in enumerate((cut / 2, cut, (1 + cut) / 2)):
        assert np.allclose(np.array(got[k])[400:1600], gain(w) ** 2 * waves[k][400:1600], atol=1e-6)


def test_transforms_of_profiles(spark):
    r = np.random.default_rng(3)
    profiles = {"p": r.normal(size=(7, 33)), "q": r.normal(size=(4, 20)), None: r.normal(size=(1, 5))}
    df = spark.createDataFrame([(k, 10 * i, row.tolist()) for k, m in profiles.items() for i, row in enumerate(m)], "line string, at long, a array<double>").repartition(3)

    def matrix(found, k, c):
        return np.array([x[c] for x in sorted(found, key=lambda x: x["at"]) if x.line == k])

    z = K.transformed(df, ["line"], "at", "fourier", "a", block=4)
    found, back = z.collect(), {}
    for k, m in profiles.items():
        want = np.fft.fft(np.fft.rfft(m, axis=1), axis=0)
        assert np.allclose(matrix(found, k, "re"), want.real) and np.allclose(matrix(found, k, "im"), want.imag)
        back[k] = K.transformed(z.filter(F.col("line").eqNullSafe(k)), ["line"], "at", "fourier_back", "re", "im", samples=m.shape[1], block=4).collect()
        assert np.allclose(matrix(back[k], k, "re"), m)
    c = K.transformed(df, ["line"], "at", "cosine", "a", block=5)
    again = K.transformed(c, ["line"], "at", "cosine_back", "re", block=5).collect()
    one = K.transformed(df, ["line"], "at", "cosine", "a", places=False).collect()
    for k, m in profiles.items():
        n = m.shape[1]
        basis = np.array([[math.cos(math.pi * (j + 0.5) * f / n) * math.sqrt((1 if f == 0 else 2) / n) for j in range(n)] for f in range(n)])
        assert np.allclose(matrix(one, k, "re"), m @ basis.T) and np.allclose(matrix(again, k, "re"), m)
