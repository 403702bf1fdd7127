"""PCM and float WAV as bytes, and elementary operations on samples (frames, channels)."""

from __future__ import annotations

import struct

import numpy as np

from cutloom.functions.levels import FLOOR_DB


def decode_samples(raw: bytes, width: int, is_float: bool = False) -> np.ndarray:
    """Samples between −1 and 1 of little-endian PCM of 1 (unsigned), 2, 3 or 4 bytes, or of IEEE floats of 4 or 8."""
    raw = raw[: len(raw) // width * width]
    if is_float:
        return np.frombuffer(raw, "<f4" if width == 4 else "<f8").astype(np.float64)
    if width == 1:
        return (np.frombuffer(raw, np.uint8).astype(np.float64) - 128) / 128
    if width == 2:
        return np.frombuffer(raw, "<i2") / 32768
    if width == 3:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        return (((b[:, 0] << 8) | (b[:, 1] << 16) | (b[:, 2] << 24)) >> 8) / 8388608
    if width == 4:
        return np.frombuffer(raw, "<i4") / 2147483648
    raise ValueError(f"sample width {width}")


def encode_samples(x: np.ndarray, width: int) -> bytes:
    """Little-endian PCM of the clipped samples."""
    top = float(1 << (8 * width - 1))
    codes = np.clip(np.rint(np.asarray(x, np.float64) * top), -top, top - 1).astype(np.int64).ravel()
    if width == 1:
        return (codes + 128).astype(np.uint8).tobytes()
    if width == 3:
        return np.stack([codes & 255, (codes >> 8) & 255, (codes >> 16) & 255], axis=1).astype(np.uint8).tobytes()
    return codes.astype({2: "<i2", 4: "<i4"}[width]).tobytes()


def read_wav(content: bytes) -> tuple[np.ndarray, int, int]:
    """Samples (frames, channels), rate and sample width of a WAV; a data size beyond the end is cut to what is there."""
    if content[:4] != b"RIFF" or content[8:12] != b"WAVE":
        raise ValueError("not a RIFF WAVE")
    at, form, data = 12, None, None
    while at + 8 <= len(content):
        name, size = content[at : at + 4], struct.unpack("<I", content[at + 4 : at + 8])[0]
        body = content[at + 8 : at + 8 + size]
        if name == b"fmt ":
            form = body
        elif name == b"data":
            data = body
            break
        at += 8 + size + (size & 1)
    if form is None or data is None:
        raise ValueError("no format or data chunk")
    tag, channels, rate, _, _, bits = struct.unpack("<HHIIHH", form[:16])
    if tag == 0xFFFE:
        tag = struct.unpack("<H", form[24:26])[0]
    if tag not in (1, 3):
        raise ValueError(f"format {tag}")
    x = decode_samples(data, bits // 8, tag == 3)
    return x[: len(x) // channels * channels].reshape(-1, channels), rate, bits // 8


def write_wav(x: np.ndarray, rate: int, width: int = 3, is_float: bool = False) -> bytes:
    x = np.atleast_2d(np.asarray(x, np.float64).T).T
    raw = x.astype("<f4").tobytes() if is_float else encode_samples(x, width)
    width = 4 if is_float else width
    n = x.shape[1]
    form = struct.pack("<HHIIHH", 3 if is_float else 1, n, rate, rate * n * width, n * width, 8 * width)
    return b"RIFF" + struct.pack("<I", 36 + len(raw)) + b"WAVEfmt " + struct.pack("<I", 16) + form + b"data" + struct.pack("<I", len(raw)) + raw


def to_mono(x: np.ndarray) -> np.ndarray:
    return x if x.ndim == 1 else x.mean(axis=1)


def to_channels(mono: np.ndarray, channels: int) -> np.ndarray:
    return np.repeat(np.asarray(mono)[:, None], channels, axis=1)


def match_channels(x: np.ndarray, channels: int) -> np.ndarray:
    """One channel spread to many, many averaged to one; other changes repeat or drop channels."""
    x = np.atleast_2d(np.asarray(x).T).T
    if x.shape[1] == channels:
        return x
    if channels == 1:
        return x.mean(axis=1, keepdims=True)
    return to_channels(x[:, 0], channels) if x.shape[1] == 1 else x[:, np.arange(channels) % x.shape[1]]


def fit_length(x: np.ndarray, n: int) -> np.ndarray:
    """Cut or filled with silence to n frames."""
    return x[:n] if len(x) >= n else np.concatenate([x, np.zeros((n - len(x), *x.shape[1:]), x.dtype)])


def resample(x: np.ndarray, rate: int, target: int) -> np.ndarray:
    """Band-limited resampling by the discrete Fourier transform of the whole signal."""
    if rate == target or len(x) == 0:
        return x
    n, m = len(x), max(1, round(len(x) * target / rate))
    spectrum = np.fft.rfft(x, axis=0)
    kept = min(n, m) // 2 + 1
    out = np.zeros((m // 2 + 1, *x.shape[1:]), complex)
    out[:kept] = spectrum[:kept]
    return np.fft.irfft(out, m, axis=0) * (m / n)


def slice_seconds(x: np.ndarray, rate: int, start: float, end: float, exact: bool = False) -> np.ndarray:
    """Frames of [start, end), cut at the signal's end; with exact, filled up to the length."""
    a, b = max(0, round(start * rate)), max(0, round(end * rate))
    out = x[a:b]
    return fit_length(out, b - a) if exact else out


def mix(tracks: list[np.ndarray]) -> np.ndarray:
    """Sum of tracks, short ones filled up, clipped to full scale."""
    n = max(map(len, tracks))
    return np.clip(sum(fit_length(t, n) for t in tracks), -1.0, 1.0)


def place(segments: list[tuple[float, np.ndarray]], rate: int, seconds: float) -> np.ndarray:
    """Segments summed at their starts on a silent line; one that doesn't fit is an error."""
    out = np.zeros(round(seconds * rate))
    for start, x in segments:
        a = round(start * rate)
        if a < 0 or a + len(x) > len(out):
            raise ValueError("segment beyond the line")
        out[a : a + len(x)] += x
    return out


def rms(x: np.ndarray) -> float:
    return float(np.sqrt(np.mean(np.square(x, dtype=np.float64)))) if np.size(x) else 0.0


def rms_dbfs(x: np.ndarray) -> float:
    v = rms(x)
    return 20 * np.log10(v) if v > 0 else float("-inf")


def peak_dbfs(x: np.ndarray) -> float:
    v = float(np.abs(x).max()) if np.size(x) else 0.0
    return 20 * np.log10(v) if v > 0 else float("-inf")


def hop_levels(mono: np.ndarray, rate: int, hop_sec: float = 0.02) -> tuple[np.ndarray, float]:
    """RMS level in dB of each hop (the last may be short), and the hop's length in seconds."""
    hop = max(1, round(hop_sec * rate))
    n = -(-len(mono) // hop)
    padded = fit_length(np.square(mono, dtype=np.float64), n * hop).reshape(n, hop)
    counts = np.minimum(hop, len(mono) - np.arange(n) * hop)
    power = padded.sum(axis=1) / np.maximum(counts, 1)
    return np.maximum(FLOOR_DB, 10 * np.log10(np.maximum(power, 1e-12))), hop / rate


def activity(mono: np.ndarray, rate: int, threshold: float = -50.0, hop_sec: float = 0.02) -> dict[str, float]:
    levels, _ = hop_levels(mono, rate, hop_sec)
    return {"peak_dbfs": peak_dbfs(mono), "rms_dbfs": rms_dbfs(mono), "voiced_ratio": float((levels > threshold).mean()) if len(levels) else 0.0}


def speech_rms(x: np.ndarray, fallback: np.ndarray) -> float:
    """RMS of the frames at a quarter of the 75th percentile of magnitudes (of the channels' mean) and above, 1e-5 at least; the fallback's where there are none."""
    if x.size:
        a = np.abs(to_mono(x))
        loud = a >= max(float(np.percentile(a, 75)) / 4, 1e-5)
        if loud.any():
            return rms(x[loud])
    return rms(fallback)


def limit_peak(x: np.ndarray, ceiling: float = 0.99) -> tuple[np.ndarray, float]:
    """Scaled down to the ceiling where it is exceeded; the gain."""
    top = float(np.abs(x).max()) if np.size(x) else 0.0
    gain = min(1.0, ceiling / top) if top > 0 else 1.0
    return x * gain, gain


def equal_power_ramp(n: int) -> np.ndarray:
    """Sine from 0 towards 1, which is not reached."""
    return np.sin(np.pi / 2 * np.arange(n) / n) if n > 0 else np.empty(0)


def segment_mask(n: int, rate: int, segments: list[tuple[float, float]], fade_ms: float) -> np.ndarray:
    """Gain 1 inside the segments, with equal-power fades inside their ends; the greater gain where they overlap."""
    out = np.zeros(n)
    for start, end in segments:
        a = min(n, max(0, round(start * rate)))
        b = min(n, max(a, round(end * rate)))
        fade = min(max(0, round(fade_ms / 1000 * rate)), (b - a) // 2)
        ramp = equal_power_ramp(fade)
        out[a:b] = np.maximum(out[a:b], np.concatenate([ramp, np.ones(b - a - 2 * fade), ramp[::-1]]))
    return out


def fade_edges(x: np.ndarray, n: int) -> np.ndarray:
    n = min(n, len(x) // 2)
    out = np.array(x, float)
    if n:
        ramp = np.square(np.sin(np.linspace(0, np.pi / 2, n))).reshape(-1, *[1] * (out.ndim - 1))
        out[:n] *= ramp
        out[-n:] *= ramp[::-1]
    return out


def tile(x: np.ndarray, n: int) -> np.ndarray:
    return np.resize(x, (n, *x.shape[1:])) if len(x) else np.zeros((n, *x.shape[1:]))


def granular_loop(donor: np.ndarray, n: int, grain: int, fade: int, rng: np.random.Generator | int) -> np.ndarray:
    """A loop of n samples of grains taken anywhere in the donor, faded with equal power where they overlap; what runs over its end is laid over its beginning."""
    rng, donor = np.random.default_rng(rng), to_mono(donor)
    if not donor.size or n <= 0:
        return np.zeros(max(0, n))
    grain = max(2, min(grain, donor.size))
    fade = max(1, min(fade, grain // 2))
    ramp = equal_power_ramp(fade)
    window = np.concatenate([ramp, np.ones(grain - 2 * fade), ramp[::-1]])
    out = np.zeros(n + grain)
    for at in range(0, n, max(1, grain - fade)):
        start = int(rng.integers(0, max(1, donor.size - grain)))
        out[at : at + grain] += donor[start : start + grain] * window
    over = out[n : n + min(fade, n)]
    out[: len(over)] += over
    return out[:n]


def dry_wet(dry: np.ndarray, wet: np.ndarray, amount: float) -> np.ndarray:
    return dry * (1 - amount) + wet * amount


def stereo_width(x: np.ndarray, width: float) -> np.ndarray:
    if x.ndim < 2 or x.shape[1] != 2:
        return x
    mid, side = (x[:, 0] + x[:, 1]) / 2, (x[:, 0] - x[:, 1]) / 2 * width
    return np.stack([mid + side, mid - side], axis=1)


def windows(x: np.ndarray, rate: int, seconds: float) -> list[np.ndarray]:
    """Windows of fixed length; a last one of less than half is dropped, a whole signal shorter than that kept."""
    n = max(1, round(seconds * rate))
    parts = [x[i : i + n] for i in range(0, len(x), n)]
    return [p for i, p in enumerate(parts) if len(p) >= n / 2 or (i == 0 and len(parts) == 1)]
