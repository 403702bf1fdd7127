"""Spectra, filterbanks, descriptors and gain envelopes."""

from __future__ import annotations

import numpy as np

from cutloom.kernels.pcm import FLOOR_DB, dry_wet, fit_length, to_mono


def hann(n: int) -> np.ndarray:
    return 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)


def stft(x: np.ndarray, n_fft: int = 1024, hop: int = 256) -> np.ndarray:
    """Frames by bins, centred on multiples of the hop."""
    frames = -(-len(x) // hop) + 1
    padded = np.concatenate([np.zeros(n_fft // 2), x, np.zeros(n_fft + hop)])
    index = np.arange(n_fft)[None, :] + hop * np.arange(frames)[:, None]
    return np.fft.rfft(padded[index] * hann(n_fft), axis=1)


def istft(spectrum: np.ndarray, n: int, n_fft: int = 1024, hop: int = 256) -> np.ndarray:
    window = hann(n_fft)
    parts = np.fft.irfft(spectrum, n_fft, axis=1) * window
    out = np.zeros(hop * len(parts) + n_fft)
    weight = np.zeros_like(out)
    for i, p in enumerate(parts):
        out[i * hop : i * hop + n_fft] += p
        weight[i * hop : i * hop + n_fft] += window**2
    return fit_length((out / np.maximum(weight, 1e-8))[n_fft // 2 :], n)


def _triangles(edges: np.ndarray, frequencies: np.ndarray) -> np.ndarray:
    low, mid, high = edges[:-2, None], edges[1:-1, None], edges[2:, None]
    return np.maximum(0, np.minimum((frequencies - low) / np.maximum(mid - low, 1e-9), (high - frequencies) / np.maximum(high - mid, 1e-9)))


def _unit_rows(bank: np.ndarray) -> np.ndarray:
    return bank / np.maximum(bank.sum(axis=1, keepdims=True), 1e-12)


def mel_filterbank(bands: int, n_fft: int, rate: int, lowest: float = 20.0) -> np.ndarray:
    """Triangular filters, evenly spaced in mel (2595 log10(1 + f / 700)) from 20 Hz up, each with sum one."""
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(mel(lowest), mel(rate / 2), bands + 2) / 2595) - 1)
    return _unit_rows(_triangles(edges, np.fft.rfftfreq(n_fft, 1 / rate)[None, :]))


def bark(f: np.ndarray) -> np.ndarray:
    return 13 * np.arctan(0.00076 * f) + 3.5 * np.arctan((f / 7500) ** 2)


def bark_filterbank(bands: int, n_fft: int, rate: int) -> np.ndarray:
    """Triangular filters, evenly spaced in Bark, each with sum one."""
    z = bark(np.fft.rfftfreq(n_fft, 1 / rate))
    return _unit_rows(_triangles(np.linspace(0, z[-1], bands + 2), z[None, :]))


def dct_basis(coefficients: int, bands: int) -> np.ndarray:
    """Orthonormal cosine basis of the second kind."""
    k, n = np.arange(coefficients)[:, None], np.arange(bands)[None, :]
    basis = np.cos(np.pi * k * (2 * n + 1) / (2 * bands)) * np.sqrt(2 / bands)
    basis[0] /= np.sqrt(2)
    return basis


def spectral_contrast(power: np.ndarray, frequencies: np.ndarray, bands: int = 6) -> np.ndarray:
    """90th over 10th percentile in dB, in bands evenly spaced on a logarithmic scale from 100 Hz."""
    edges = np.geomspace(100, max(101, frequencies[-1]), bands + 1)
    out = np.zeros(bands)
    for i in range(bands):
        own = power[(frequencies >= edges[i]) & (frequencies < edges[i + 1])]
        if own.size:
            low, high = np.percentile(own, [10, 90])
            out[i] = 10 * np.log10((high + 1e-12) / (low + 1e-12))
    return out


def harmonicity(mono: np.ndarray, rate: int) -> float:
    """Greatest autocorrelation, relative to lag 0, at lags of 50 to 1000 Hz."""
    x = mono - mono.mean() if len(mono) else mono
    full = np.fft.irfft(np.abs(np.fft.rfft(x, 2 * max(1, len(x)))) ** 2)
    low, high = int(rate / 1000), min(int(rate / 50), len(x) - 1)
    return float(np.clip(full[low : high + 1].max() / full[0], 0, 1)) if full.size and full[0] > 1e-12 and high > low else 0.0


def stereo_features(x: np.ndarray) -> tuple[float, float, float, float]:
    """Balance of left over right in dB, width (side over mid, as amplitudes), correlation, share of the amplitude lost when folded down."""
    if x.ndim < 2 or x.shape[1] < 2:
        return 0.0, 0.0, 1.0, 0.0
    left, right = x[:, 0].astype(float), x[:, 1].astype(float)
    power = lambda v: float(np.square(v).mean())
    a, b, mid, side = power(left), power(right), power((left + right) / 2), power((left - right) / 2)
    both, tiny = np.sqrt(a * b), 1e-12
    balance = np.clip(10 * np.log10(max(a, tiny) / max(b, tiny)), -120, 120)
    together = np.clip((left * right).mean() / both, -1, 1) if both > tiny else 1.0
    lost = np.clip(1 - np.sqrt(mid / max((a + b) / 2, tiny)), 0, 1)
    return float(balance), float(min(np.sqrt(side / max(mid, tiny)), 1e6)), float(together), float(lost)


def _biquad(kind: str, rate: float) -> tuple[np.ndarray, np.ndarray]:
    """The two stages of ITU-R BS.1770 weighting for any rate, from their analogue parameters (fixed values)."""
    if kind == "shelf":
        f0, gain, q = 1681.974450955533, 3.999843853973347, 0.7071752369554196
        k, vh = np.tan(np.pi * f0 / rate), 10 ** (gain / 20)
        vb = vh**0.4996667741545416
        a0 = 1 + k / q + k * k
        return np.array([vh + vb * k / q + k * k, 2 * (k * k - vh), vh - vb * k / q + k * k]) / a0, np.array([1, 2 * (k * k - 1) / a0, (1 - k / q + k * k) / a0])
    f0, q = 38.13547087602444, 0.5003270373238773
    k = np.tan(np.pi * f0 / rate)
    a0 = 1 + k / q + k * k
    return np.array([1.0, -2.0, 1.0]), np.array([1, 2 * (k * k - 1) / a0, (1 - k / q + k * k) / a0])


class KWeighting:
    """Loudness weighting of successive blocks; the filters' state is kept between them."""

    def __init__(self, rate: float, channels: int = 1) -> None:
        self.stages = [_biquad("shelf", rate), _biquad("pass", rate)]
        self.state = np.zeros((2, 2, channels))

    def process(self, block: np.ndarray) -> np.ndarray:
        x = np.atleast_2d(np.asarray(block, float).T).T
        for s, (b, a) in enumerate(self.stages):
            y, (z1, z2) = np.empty_like(x), self.state[s]
            for i, v in enumerate(x):
                o = b[0] * v + z1
                z1 = b[1] * v - a[1] * o + z2
                z2 = b[2] * v - a[2] * o
                y[i] = o
            self.state[s] = z1, z2
            x = y
        return x


def log_band_frames(mono: np.ndarray, rate: int, window_sec: float = 0.05, hop_sec: float = 0.025, bands: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """log(1 + mean power) of bands of bins, evenly spaced on a logarithmic scale, frame by frame; the frames' middles in seconds."""
    n, hop = max(16, round(window_sec * rate)), max(1, round(hop_sec * rate))
    x = fit_length(np.asarray(mono, float), max(n, len(mono)))
    frames = np.lib.stride_tricks.sliding_window_view(x, n)[::hop]
    power = np.abs(np.fft.rfft(frames * np.hanning(n), axis=1)) ** 2
    bins = power.shape[1]
    edges = np.clip(np.unique(np.rint(np.geomspace(1, bins, bands + 1)).astype(int)), 1, bins)
    spans = [(a, max(a + 1, b)) for a, b in zip(edges, edges[1:])] or [(1, bins)]
    out = np.stack([power[:, a:b].mean(axis=1) for a, b in spans], axis=1)
    return np.log1p(out), (np.arange(len(frames)) * hop + n / 2) / rate


def log_bands(mono: np.ndarray, rate: int, window_sec: float = 0.05, hop_sec: float = 0.025, bands: int = 16) -> np.ndarray:
    return log_band_frames(mono, rate, window_sec, hop_sec, bands)[0]


def fingerprint(mono: np.ndarray, rate: int, bands: int = 16) -> np.ndarray:
    """Mean of the log bands, of length one."""
    v = log_bands(mono, rate, bands=bands).mean(axis=0)
    return v / (np.linalg.norm(v) or 1)


def change_points(mono: np.ndarray, rate: int, window_sec: float, threshold: float) -> list[float]:
    """Middles of the windows whose bands are apart from the window before by the threshold (cosine), and no less than its neighbours are."""
    frames, times = log_band_frames(mono, rate, window_sec, window_sec)
    if len(frames) < 3:
        return []
    size = np.linalg.norm(frames, axis=1)
    both = size[1:] * size[:-1]
    apart = np.where(both > 0, 1 - np.einsum("ij,ij->i", frames[1:], frames[:-1]) / np.where(both > 0, both, 1), 1.0)
    peak = (apart[1:-1] >= threshold) & (apart[1:-1] >= apart[:-2]) & (apart[1:-1] >= apart[2:])
    return [float(times[i + 2]) for i in np.nonzero(peak)[0]]


def frame_features(mono: np.ndarray, rate: int, n_fft: int = 2048, hop: int = 512, bands: int = 40, coefficients: int = 13) -> dict[str, np.ndarray]:
    """Series of rms, centroid, bandwidth, rolloff, flatness, flux and zero crossings, and matrices of mel bands and cepstra."""
    power = np.abs(stft(mono, n_fft, hop)) ** 2
    f = np.fft.rfftfreq(n_fft, 1 / rate)
    total = power.sum(axis=1) + 1e-12
    centroid = power @ f / total
    magnitude = np.sqrt(power)
    flux = np.concatenate([[0], np.maximum(np.diff(magnitude, axis=0), 0).sum(axis=1)]) / (magnitude.sum(axis=1) + 1e-12)
    mel = np.log(power @ mel_filterbank(bands, n_fft, rate).T + 1e-12)
    signs = fit_length(np.abs(np.diff(np.signbit(mono).astype(int), prepend=0)), len(power) * hop).reshape(len(power), hop)
    cumulative = np.cumsum(power, axis=1)
    return {
        "rms": np.sqrt(total / n_fft), "centroid": centroid, "bandwidth": np.sqrt((power * (f[None, :] - centroid[:, None]) ** 2).sum(axis=1) / total),
        "rolloff": f[(cumulative >= 0.85 * cumulative[:, -1:]).argmax(axis=1)], "flatness": np.exp(np.log(power + 1e-12).mean(axis=1)) / (power.mean(axis=1) + 1e-12),
        "flux": flux, "zero_crossings": signs.mean(axis=1), "mel": mel, "mfcc": mel @ dct_basis(coefficients, bands).T,
    }


def self_similarity(x: np.ndarray) -> np.ndarray:
    """Cosines of all rows; 0 for zero rows."""
    size = np.linalg.norm(x, axis=1, keepdims=True)
    rows = np.where(size > 0, x / np.where(size > 0, size, 1), 0)
    return rows @ rows.T


def repeated_motifs(similarity: np.ndarray, hop_sec: float, threshold: float = 0.88, apart_sec: float = 1.0, most: int = 64) -> list[tuple[int, int, float]]:
    """Each row's best later row at some distance, the surest first; neighbours of one taken already are left out."""
    n, apart = len(similarity), max(1, int(np.ceil(apart_sec / hop_sec)))
    found = [(-float(similarity[i, i + apart :].max()), i, i + apart + int(similarity[i, i + apart :].argmax())) for i in range(max(0, n - apart))]
    taken: list[tuple[int, int, float]] = []
    for s, i, j in sorted(x for x in found if -x[0] >= threshold):
        if len(taken) == most:
            break
        if not any(abs(i - a) <= 1 and abs(j - b) <= 1 for a, b, _ in taken):
            taken.append((i, j, -s))
    return taken


def _window_max(x: np.ndarray, n: int) -> np.ndarray:
    """Greatest of each value and the n - 1 that follow it."""
    return np.lib.stride_tricks.sliding_window_view(np.concatenate([x, np.full(n - 1, x[-1])]), n).max(axis=1)


def ducking_envelope(detector: np.ndarray, rate: int, threshold: float, span: float, depth: float, attack_ms: float, hold_ms: float, release_ms: float) -> tuple[np.ndarray, np.ndarray]:
    """Activity of a detector (its level over `span` dB, held), and the gain under it: at most `depth` dB down, smoothed by attack and release.

    Levels are running means of power over 20 ms, looked at every 5 ms.
    """
    mono = to_mono(detector)
    if not mono.size:
        return np.empty(0), np.empty(0)
    n, hop = max(1, round(rate * 0.02)), max(1, round(rate * 0.005))
    total = np.cumsum(np.concatenate([[0], np.pad(np.square(mono), (n // 2, n - n // 2 - 1), "edge")]))
    level = np.sqrt(np.maximum((total[n:] - total[:-n])[::hop] / n, 0))
    db = np.where(level > 0, np.maximum(20 * np.log10(np.maximum(level, 1e-300)), FLOOR_DB), FLOOR_DB)
    active = _window_max(np.clip((db - threshold) / span, 0, 1), max(1, int(np.ceil(hold_ms * rate / (1000 * hop)))))
    wanted = 10 ** (-depth * active / 20)
    down, up = (float(np.exp(-hop / max(ms * rate / 1000, 1))) for ms in (attack_ms, release_ms))
    gain = wanted.tolist()
    for i in range(1, len(gain)):
        k = down if gain[i] < gain[i - 1] else up
        gain[i] = k * gain[i - 1] + (1 - k) * gain[i]
    at, places = np.arange(len(mono)), np.minimum(np.arange(len(gain)) * hop, len(mono) - 1)
    return np.clip(np.interp(at, places, active), 0, 1), np.clip(np.interp(at, places, gain), 10 ** (-depth / 20), 1)


def duck(background: np.ndarray, dialogue: np.ndarray, rate: int, depth: float = 9.0, amount: float = 1.0) -> np.ndarray:
    _, gain = ducking_envelope(fit_length(dialogue, len(background)), rate, -45.0, 20.0, depth, 20.0, 150.0, 400.0)
    return dry_wet(background, background * gain, amount)


def unmask(background: np.ndarray, dialogue: np.ndarray, depth: float = 9.0, n_fft: int = 1024) -> np.ndarray:
    """Background lowered, at most by the depth, in the bins where the dialogue has its power."""
    b, d = stft(background, n_fft, n_fft // 4), stft(fit_length(dialogue, len(background)), n_fft, n_fft // 4)
    share = np.abs(d) ** 2 / (np.abs(d) ** 2 + np.abs(b) ** 2 + 1e-12)
    return istft(b * 10 ** (-depth * share / 20), len(background), n_fft, n_fft // 4)


def project_on_original(original: np.ndarray, estimates: list[np.ndarray], n_fft: int = 2048, hop: int = 512, power: float = 1.5) -> list[np.ndarray]:
    """The original's spectrum shared out by the estimates' powers, so that the parts sum up to it."""
    whole = stft(original, n_fft, hop)
    weights = [np.abs(stft(fit_length(e, len(original)), n_fft, hop)) ** power for e in estimates]
    total = sum(weights) + 1e-9
    return [istft(whole * (w + 1e-9 / len(weights)) / total, len(original), n_fft, hop) for w in weights]


def encode_image(mono: np.ndarray, n_fft: int = 1024, hop: int = 256, db_range: float = 120.0) -> tuple[np.ndarray, float]:
    """Spectrum as an image (bins, frames, 4) of bytes: 16-bit level in dB under the greatest magnitude, 16-bit phase; the greatest magnitude."""
    s = stft(mono, n_fft, hop).T
    top = float(np.abs(s).max()) or 1.0
    level = 20 * np.log10(np.maximum(np.abs(s) / top, 1e-12))
    codes = np.where(level > -db_range, np.rint((level / db_range + 1) * 65534) + 1, 0).astype(np.uint16)
    phase = np.rint((np.angle(s) + np.pi) / (2 * np.pi) * 65535).astype(np.uint16)
    return np.stack([codes >> 8, codes & 255, phase >> 8, phase & 255], axis=-1).astype(np.uint8), top


def decode_image(image: np.ndarray, top: float, n: int, n_fft: int = 1024, hop: int = 256, db_range: float = 120.0) -> np.ndarray:
    x = image.astype(np.uint16)
    codes, phase = (x[..., 0] << 8) | x[..., 1], (x[..., 2] << 8) | x[..., 3]
    magnitude = np.where(codes > 0, top * 10 ** (((codes.astype(float) - 1) / 65534 - 1) * db_range / 20), 0)
    return istft((magnitude * np.exp(1j * (phase / 65535 * 2 * np.pi - np.pi))).T, n, n_fft, hop)


#: Krumhansl's key profiles, major and minor.
MAJOR = (6.35, 2.23, 3.48, 2.33, 4.38, 4.09, 2.52, 5.19, 2.39, 3.66, 2.29, 2.88)
MINOR = (6.33, 2.68, 3.52, 5.38, 2.60, 3.53, 2.54, 4.75, 3.98, 2.69, 3.34, 3.17)
NOTES = ("C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B")


#: The chords that are told apart, by root and kind, and none.
CHORDS = (*(f"{n}:maj" for n in NOTES), *(f"{n}:min" for n in NOTES), "N")


def _cosines(rows: np.ndarray, templates: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(rows, axis=1)[:, None] * np.linalg.norm(templates, axis=1)[None, :]
    return np.where(size > np.finfo(np.float32).eps, rows @ templates.T / np.where(size > 0, size, 1), 0.0)


def estimate_key(chroma: np.ndarray) -> tuple[str, str, float]:
    """Tonic, mode and confidence ((lead over the second best + 1) / 2) of a chroma vector or the mean of its frames (rows)."""
    v = np.asarray(chroma, float)
    v = np.atleast_2d(v.mean(axis=0) if v.ndim == 2 and len(v) else v)
    if not v.size:
        return "unknown", "", 0.0
    names = [(n, mode) for n in NOTES for mode in ("major", "minor")]
    scores = _cosines(v, np.array([np.roll(p, i) for i in range(12) for p in (MAJOR, MINOR)]))[0]
    order = np.argsort(-scores, kind="stable")
    return *names[order[0]], float(np.clip((scores[order[0]] - scores[order[1]] + 1) / 2, 0, 1))


def estimate_chords(chroma: np.ndarray, times: np.ndarray) -> list[tuple[float, float, str, float]]:
    """Runs of frames (rows of 12) with the same chord: start, end, chord, mean confidence. Frames with hardly any energy have none."""
    chroma = np.asarray(chroma, float)
    if not chroma.size:
        return []
    shapes = [sorted({0, third, 7}) for third in (4, 3)]
    templates = np.array([[float(p in {(root + s) % 12 for s in shape}) for p in range(12)] for shape in shapes for root in range(12)])
    scores, energy = _cosines(chroma, templates), chroma.sum(axis=1)
    quiet = energy <= max(float(np.percentile(energy, 10)) / 4, 1e-6)
    label = np.where(quiet, 24, scores.argmax(axis=1))
    sure = np.where(quiet, 0.0, np.clip(scores.max(axis=1), 0, 1))
    hop = float(np.median(np.diff(times))) if len(times) > 1 else 0.0
    begins = np.concatenate([[0], np.nonzero(np.diff(label))[0] + 1])
    ends = np.concatenate([begins[1:], [len(label)]])
    return [(float(times[a]), float(times[b - 1] + hop), CHORDS[label[a]], float(sure[a:b].mean())) for a, b in zip(begins, ends)]
