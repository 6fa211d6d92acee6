"""Signal features in plain NumPy, which the tests hold the library's column functions against: a matrix of traces in, columns out."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

#: Seconds between samples of a slice, and samples a second that spectra of whole traces assume: fixed values.
INTERVAL, RATE = 8e-9, 15e6
#: Decomposition low-pass filter of the Daubechies wavelet with four vanishing moments: fixed values.
DB4 = np.array([
    -0.010597401785069032, 0.0328830116668852, 0.030841381835560764, -0.18703481171909309,
    -0.027983769416859854, 0.6308807679298589, 0.7148465705529157, 0.2303778133088965,
])
TINY = 1e-12


def analytic(x: np.ndarray) -> np.ndarray:
    """Analytic signal of each row."""
    n = x.shape[1]
    keep = np.zeros(n)
    keep[0] = 1
    keep[1 : (n + 1) // 2] = 2
    if n % 2 == 0:
        keep[n // 2] = 1
    return np.fft.ifft(np.fft.fft(x, axis=1) * keep, axis=1)


def instantaneous(x: np.ndarray) -> dict[str, np.ndarray]:
    """Envelope, quadrature, phase and phase steps of each row, rounded to 2 digits."""
    z = analytic(x)
    phase = np.angle(z)
    return {"At": np.round(np.abs(z), 2), "Vt": np.round(z.imag, 2), "Pht": np.round(phase, 2), "Wt": np.round(np.diff(phase, axis=1), 2)}


def _ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(b != 0, a / np.where(b == 0, 1, b), np.nan)


def spectrum(x: np.ndarray) -> dict[str, np.ndarray]:
    """Area of the spectrum, mean frequency, quality (peak over the width at 0.7 of it) and their ratio; NaN under 3 samples."""
    m, n = x.shape
    if n < 3:
        return {k: np.full(m, np.nan) for k in ("Sn", "wmf", "Qf", "Sn_wmf")}
    size, f = np.abs(np.fft.rfft(x, axis=1)), np.fft.rfftfreq(n, INTERVAL)
    area, mean = size.sum(axis=1) / n, _ratio(size @ f, size.sum(axis=1))
    peak = size[:, 1:].argmax(axis=1) + 1
    low = size < 0.7 * size[np.arange(m), peak][:, None]
    place = np.arange(len(f))
    left = np.where(low & (place <= peak[:, None]), place, -1).max(axis=1)
    right = np.where(low & (place >= peak[:, None]), place, len(f)).min(axis=1)
    width = f[np.where(right == len(f), len(f) - 1, right)] - f[np.maximum(left, 0)]
    return {"Sn": area, "wmf": mean, "Qf": _ratio(f[peak], width), "Sn_wmf": _ratio(area, mean)}


def _power(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = x.shape[1]
    return np.fft.fftfreq(n, 1 / RATE)[: n // 2], (np.abs(np.fft.fft(x, axis=1)) ** 2)[:, : n // 2]


def frequency(x: np.ndarray) -> dict[str, np.ndarray]:
    """Shape of the power spectrum: centre, band, high to low ratio, slope, entropy, strongest frequencies, moments."""
    f, p = _power(x)
    total = p.sum(axis=1)
    centre = _ratio(p @ f, total)
    strong = p > 0.5 * p[:, 1:].max(axis=1)[:, None]
    band = np.where(strong, f, -np.inf).max(axis=1) - np.where(strong, f, np.inf).min(axis=1)
    low = f < np.median(f)
    lf, lp = np.log10(f[1:]), np.log10(np.maximum(p[:, 1:], 1e-300))
    slope = ((lf - lf.mean()) * (lp - lp.mean(axis=1)[:, None])).sum(axis=1) / ((lf - lf.mean()) ** 2).sum()
    q = p / np.maximum(total, 1e-300)[:, None]
    top = np.argsort(p, axis=1, kind="stable")[:, ::-1][:, 1:4]
    out = {"central": centre, "bandwidth": band, "high_low": _ratio(p[:, ~low].sum(axis=1), p[:, low].sum(axis=1)), "centroid": centre, "slope": slope, "entropy": -(q * np.log(np.where(q > 0, q, 1))).sum(axis=1)}
    out |= {f"dominant_{k + 1}": f[top[:, k]] for k in range(3)}
    return out | {f"moment_{k}": _ratio(p @ f**k, total) for k in (1, 2, 3)}


def envelope(x: np.ndarray) -> dict[str, np.ndarray]:
    """Area, greatest value and its place, mean, deviation, skewness, kurtosis, peak factor and energy of thirds of the envelope."""
    e = np.abs(analytic(x))
    m, s = e.mean(axis=1), e.std(axis=1)
    z = _ratio(e - m[:, None], s[:, None])
    third = e.shape[1] // 3
    out = {"area": np.trapezoid(e, axis=1), "max": e.max(axis=1), "time_to_max": e.argmax(axis=1).astype(float), "mean": m, "std": s, "skew": (z**3).mean(axis=1), "kurt": (z**4).mean(axis=1) - 3, "max_to_mean": _ratio(e.max(axis=1), m)}
    return out | {f"energy_{k + 1}": (e[:, k * third : (k + 1) * third] ** 2).sum(axis=1) for k in range(3)}


def autocorrelation(x: np.ndarray) -> dict[str, np.ndarray]:
    """First minimum, value at lag 10, decay over 10 lags, integral, width at half height and ratio of lags 10 and 20."""
    m, n = x.shape
    size = 1 << (2 * n - 1).bit_length()
    acf = np.fft.irfft(np.abs(np.fft.rfft(x, size, axis=1)) ** 2, size, axis=1)[:, :n]
    place = np.arange(n)
    dip = np.zeros((m, n), bool)
    dip[:, 1:-1] = (acf[:, 1:-1] < acf[:, :-2]) & (acf[:, 1:-1] <= acf[:, 2:])
    dip[:, -1] = acf[:, -1] < acf[:, -2]
    first = np.where(dip.any(axis=1), dip.argmax(axis=1), np.nan)
    k = min(10, n)
    t = place[:k] - (k - 1) / 2
    below = acf <= 0.5 * acf[:, :1]
    out = {"first_minimum": first, "at_10": acf[:, 10] if n > 10 else np.full(m, np.nan), "decay": (acf[:, :k] @ t) / (t @ t), "integral": np.trapezoid(acf, axis=1)}
    out["width"] = np.where(below.any(axis=1), below.argmax(axis=1), n - 1).astype(float)
    return out | {"ratio": _ratio(acf[:, 10], acf[:, 20]) if n > 20 else np.full(m, np.nan)}


def _histogram_entropy(x: np.ndarray, bins: int) -> np.ndarray:
    low, high = x.min(axis=1, keepdims=True), x.max(axis=1, keepdims=True)
    span = np.where(high > low, high - low, 1)
    at = np.minimum(((x - np.where(high > low, low, low - 0.5)) / span * bins).astype(int), bins - 1)
    counts = np.stack([(at == b).sum(axis=1) for b in range(bins)], axis=1) / x.shape[1]
    return -(counts * np.log2(np.where(counts > 0, counts, 1))).sum(axis=1)


def _alike(x: np.ndarray, width: int, reach: np.ndarray) -> np.ndarray:
    """For each row of a matrix, which pairs of its windows differ by at most ``reach`` everywhere."""
    w = np.lib.stride_tricks.sliding_window_view(x, width, axis=1)
    return np.abs(w[:, :, None, :] - w[:, None, :, :]).max(axis=3) <= reach[:, None, None]


def entropies(x: np.ndarray) -> dict[str, np.ndarray]:
    """Histogram entropy of the trace and of coarser ones, order patterns, approximate and sample entropy, spectral entropy."""
    m, n = x.shape
    out = {f"shannon_{s}": _histogram_entropy(x[:, : n // s * s].reshape(m, -1, s).mean(axis=2), 50) for s in range(1, 11) if n // s > 1}
    order = np.argsort(np.lib.stride_tricks.sliding_window_view(x, 3, axis=1), axis=2, kind="stable")
    code = order[:, :, 0] * 3 + order[:, :, 1]
    share = np.stack([(code == c).mean(axis=1) for c in range(9)], axis=1)
    out["permutation"] = -(share * np.log2(np.where(share > 0, share, 1))).sum(axis=1)
    reach = 0.2 * x.std(axis=1)
    phi, pairs = [], []
    for k in (2, 3):
        near = np.concatenate([_alike(x[i : i + 8], k, reach[i : i + 8]).sum(axis=2) for i in range(0, m, 8)])
        phi.append(np.log(near / near.shape[1]).mean(axis=1))
        pairs.append((near[:, : n - 2] - 1).sum(axis=1))
    out["approximate"] = np.abs(phi[1] - phi[0])
    out["sample"] = -np.log(_ratio(pairs[1].astype(float), pairs[0].astype(float)))
    q = np.abs(np.fft.fft(x, axis=1)) ** 2
    q = q / q.sum(axis=1, keepdims=True)
    return out | {"fourier": -(q * np.log2(q + TINY)).sum(axis=1), "hirschman": np.exp((q * np.log(q + TINY)).sum(axis=1))}


def fractal(x: np.ndarray) -> dict[str, np.ndarray]:
    """Lacunarity, rescaled-range exponent and the singularity spectrum of detrended fluctuations."""
    m, n = x.shape
    total = np.concatenate([np.zeros((m, 1)), np.cumsum(x, axis=1)], axis=1)
    masses = [total[:, w:] - total[:, :-w] for w in (2**i for i in range(1, int(np.log2(n))))]
    out = {"lacunarity": np.mean([_ratio(b.var(axis=1), b.mean(axis=1) ** 2) for b in masses], axis=0)}
    sizes, ranges = [w for w in (2**i for i in range(3, 12)) if w <= n // 2], []
    for w in sizes:
        part = x[:, : n // w * w].reshape(m, -1, w)
        walk = np.cumsum(part - part.mean(axis=2, keepdims=True), axis=2)
        ranges.append(np.nanmean(_ratio(walk.max(axis=2) - walk.min(axis=2), part.std(axis=2)), axis=1))
    slope = lambda t, y: ((t - t.mean()) @ (y - y.mean(axis=0))) / ((t - t.mean()) ** 2).sum()
    out["hurst"] = slope(np.log(sizes), np.log(np.stack(ranges))) if len(sizes) > 1 else np.full(m, np.nan)
    walk, q = np.cumsum(x - x.mean(axis=1, keepdims=True), axis=1), np.linspace(-5, 5, 20)
    scales = np.unique((np.logspace(1, np.log10(max(n // 2, 11)), 20) + 1e-9).astype(int))
    rows = []
    for w in scales[scales <= n]:
        part, t = walk[:, : n // w * w].reshape(m, -1, w), np.arange(w) - (w - 1) / 2
        part = part - part.mean(axis=2, keepdims=True)
        square = np.maximum((part**2).mean(axis=2) - (part @ t) ** 2 / (t @ t) / w, 1e-300)
        rows.append(np.stack([np.mean(square ** (k / 2), axis=1) ** (1 / k) for k in q]))
    h = np.stack([slope(np.log(scales[: len(rows)]), np.log(np.stack(rows)[:, k])) for k in range(len(q))])
    tau = h * q[:, None] - 1
    alpha = np.diff(tau, axis=0) / np.diff(q)[:, None]
    f = q[:-1, None] * alpha - tau[:-1]
    at = f.argmax(axis=0)
    top = alpha[at, np.arange(m)]
    return out | {
        "mf_width": alpha.max(axis=0) - alpha.min(axis=0), "mf_position": top, "mf_asymmetry": _ratio(top - alpha[0], alpha[-1] - top), "mf_height": f.max(axis=0),
        "mf_mean_alpha": alpha.mean(axis=0), "mf_mean_f": f.mean(axis=0), "mf_std_alpha": alpha.std(axis=0), "mf_std_f": f.std(axis=0),
    }


def _halves(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One level of the wavelet transform with mirrored ends: approximation and detail."""
    k = len(DB4)
    ends = np.pad(x, ((0, 0), (k - 1, k - 1)), mode="symmetric")
    high = DB4[::-1] * np.where(np.arange(k) % 2, 1.0, -1.0)
    windows = np.lib.stride_tricks.sliding_window_view(ends, k, axis=1)[:, 1::2]
    return windows @ DB4[::-1], windows @ high[::-1]


def wavelet(x: np.ndarray, levels: int = 5) -> dict[str, np.ndarray]:
    """Energy, mean, deviation, extremes and entropy of each level's coefficients, and ratios of energies."""
    bands, rest = {}, x
    for level in range(1, levels + 1):
        rest, bands[f"D{level}"] = _halves(rest)
    bands[f"A{levels}"] = rest
    out = {}
    for name, c in bands.items():
        share = _ratio(np.abs(c), np.abs(c).sum(axis=1, keepdims=True))
        z = _ratio(c - c.mean(axis=1, keepdims=True), c.std(axis=1, keepdims=True))
        out |= {f"{name}_energy": (c**2).sum(axis=1), f"{name}_mean": c.mean(axis=1), f"{name}_std": c.std(axis=1), f"{name}_skew": (z**3).mean(axis=1), f"{name}_kurt": (z**4).mean(axis=1) - 3,
                f"{name}_max": c.max(axis=1), f"{name}_min": c.min(axis=1), f"{name}_entropy": -(share * np.log(np.where(share > 0, share, 1))).sum(axis=1)}
    for level in range(1, levels + 1):
        out[f"D{level}_A{levels}"] = _ratio(out[f"D{level}_energy"], out[f"A{levels}_energy"])
        if level < levels:
            out[f"D{level}_D{level + 1}"] = _ratio(out[f"D{level}_energy"], out[f"D{level + 1}_energy"])
    return out


def dct_matrix(n: int) -> np.ndarray:
    """Orthonormal cosine transform as a matrix."""
    k = np.arange(n)[:, None]
    c = np.sqrt(2 / n) * np.cos(np.pi * (np.arange(n) + 0.5) * k / n)
    c[0] /= np.sqrt(2)
    return c


def mean_ranks(x: np.ndarray) -> np.ndarray:
    """Ranks from 1 within each row, equal values sharing their mean rank."""
    s = np.sort(x, axis=1)
    left = np.stack([np.searchsorted(a, b, "left") for a, b in zip(s, x)])
    right = np.stack([np.searchsorted(a, b, "right") for a, b in zip(s, x)])
    return (left + right + 1) / 2


def rank_cepstrum(x: np.ndarray) -> np.ndarray:
    """Ranks of the inverse cosine transform of the logarithm of the ranks of the cosine transform."""
    c = dct_matrix(x.shape[1])
    return mean_ranks(np.log(mean_ranks(x @ c.T)) @ c)


def recurrence(x: np.ndarray) -> dict[str, np.ndarray]:
    """Share of the closest tenth of pairs of embedded points, of it on the first diagonal, and that diagonal's mean."""
    w = np.lib.stride_tricks.sliding_window_view(x, 3, axis=1)
    rate, determinism, diagonal = [], [], []
    for e in w:
        d = np.sqrt(((e[:, None] - e[None]) ** 2).sum(axis=2))
        near = d < np.percentile(d, 10)
        on = np.diagonal(near, 1)
        rate.append(near.mean())
        determinism.append(on.sum() / max(near.sum(), 1))
        diagonal.append(on.mean())
    return {"rate": np.array(rate), "determinism": np.array(determinism), "diagonal": np.array(diagonal)}


def morphology(x: np.ndarray) -> dict[str, np.ndarray]:
    """Shares that erosion leaves and dilation makes of what lies above half the greatest value."""
    on = np.pad(x > 0.5 * x.max(axis=1, keepdims=True), ((0, 0), (1, 1)))
    count = on.sum(axis=1).astype(float)
    eroded, grown = on[:, :-2] & on[:, 1:-1] & on[:, 2:], on[:, :-2] | on[:, 1:-1] | on[:, 2:]
    return {"erosion": _ratio(eroded.sum(axis=1).astype(float), count), "dilation": _ratio(grown.sum(axis=1).astype(float), count)}


FAMILIES: dict[str, Callable[[np.ndarray], dict[str, np.ndarray]]] = {
    "spectrum": spectrum, "frequency": frequency, "envelope": envelope, "acf": autocorrelation, "entropy": entropies, "fractal": fractal, "wavelet": wavelet, "recurrence": recurrence, "morphology": morphology,
}
