import numpy as np
import plain_signal as P
import pytest

from seamline.functions import signal as G

PLAIN = {"spectrum": P.spectrum, "frequency": P.frequency, "envelope": P.envelope, "acf": P.autocorrelation, "entropy": P.entropies, "fractal": P.fractal, "wavelet": P.wavelet, "recurrence": P.recurrence, "morphology": P.morphology}


def arrays():
    rng = np.random.default_rng(3)
    out = [rng.normal(size=n) + np.sin(np.arange(n) / 3) for n in (64, 64, 64, 100, 33)]
    return [*out, 5 + np.cos(2 * np.pi * 5 * np.arange(64) / 64) + 0.01 * rng.normal(size=64)]


def table(spark, rows):
    return spark.createDataFrame([(i, None if a is None else [float(x) for x in a], "x") for i, a in enumerate(rows)], "vec_id long, a array<double>, n string")


@pytest.mark.parametrize("family", sorted(PLAIN))
def test_family_against_numpy(spark, family):
    rows = [*arrays(), None, [], [1.0] * 8, [2.0], [float(k) for k in range(31)]]
    got = {r.id: r.asDict() for r in G.FAMILIES[family](table(spark, rows), "vec_id", "a").collect()}
    assert set(got) == set(range(11))
    assert all(v is None for i in range(6, 11) for k, v in got[i].items() if k != "id")
    for i, a in enumerate(arrays()):
        with np.errstate(all="ignore"):
            want = {k: float(v[0]) for k, v in PLAIN[family](a[None]).items()}
        mine = {k: v for k, v in got[i].items() if k != "id"}
        assert set(want) <= set(mine)
        for k, v in want.items():
            assert (mine[k] is None and not np.isfinite(v)) or mine[k] == pytest.approx(v, rel=1e-6, abs=1e-8), (i, k)


def test_constant_arrays_have_features(spark):
    df = table(spark, [[2.0] * 40])
    for f in G.FAMILIES.values():
        assert f(df, "vec_id", "a").count() == 1


def test_attributes_and_cepstrum_against_numpy(spark):
    df = table(spark, arrays())
    for r in G.instantaneous(df, "vec_id", "a").collect():
        for k, v in P.instantaneous(arrays()[r.id][None]).items():
            assert np.allclose(r[k], v[0], atol=0.0101)
    for r in G.rank_cepstrum(df, "vec_id", "a").collect():
        assert r.CRL == P.rank_cepstrum(arrays()[r.id][None])[0].tolist()


def test_envelope_of_a_cosine_is_one(spark):
    r = G.envelope(table(spark, [np.cos(2 * np.pi * 5 * np.arange(64) / 64)]), "vec_id", "a").first()
    assert r.mean == pytest.approx(1) and r.std == pytest.approx(0, abs=1e-9)


def test_wavelet_keeps_energy():
    assert sum(x * x for x in G.DB4) == pytest.approx(1) and sum(G.DB4) == pytest.approx(2**0.5)
