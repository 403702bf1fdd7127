"""Ten audio recipes over the roles of a programme: bounded parameters, seeded, never changing their input."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from cutloom.kernels import pcm
from cutloom.kernels.spectral import ducking_envelope, istft, stft

#: Parameters of each recipe with default, least and greatest value.
PARAMETERS: dict[str, dict[str, tuple[float, float, float]]] = {
    "dialogue_aware_ducking": {"threshold_dbfs": (-42, -80, -6), "depth_db": (10, 0, 30), "attack_ms": (30, 1, 500), "hold_ms": (80, 0, 2000), "release_ms": (250, 5, 5000), "activity_range_db": (24, 3, 60)},
    "spectral_unmasking": {"max_reduction_db": (8, 0, 18), "mask_power": (1, 0.25, 4), "frequency_smoothing_bins": (2, 0, 12), "time_smoothing_frames": (2, 0, 12), "fft_size": (1024, 64, 8192)},
    "dme_rebalance": {"dialogue_gain_db": (0, -24, 12), "music_gain_db": (-2, -24, 12), "effects_gain_db": (-2, -24, 12), "stereo_width": (1, 0, 2), "target_loudness_lufs": (-18, -36, -8), "max_master_gain_db": (12, 0, 24)},
    "perspective_matching": {"max_level_adjust_db": (4, 0, 12), "max_eq_db": (3, 0, 9), "max_width_change": (0.25, 0, 0.75), "room_tone_blend": (0, 0, 0.25), "fft_size": (1024, 64, 8192)},
    "review_region_variants": {"padding_seconds": (0.25, 0, 5), "fade_ms": (10, 0, 250)},
    "timbre_filter_modulation": {"base_cutoff_hz": (6000, 100, 20000), "modulation_depth": (0.55, 0, 1), "filter_order": (4, 1, 12), "fft_size": (1024, 64, 8192)},
    "granular_resynthesis": {"grain_ms": (80, 10, 500), "overlap": (0.6, 0.1, 0.9), "jitter_ms": (50, 0, 500), "reverse_probability": (0.08, 0, 0.5)},
    "stereo_spatial_animation": {"rate_hz": (0.12, 0.01, 8), "pan_depth": (0.45, 0, 1), "width_depth": (0.35, 0, 1)},
    "event_beat_modulation": {"depth": (0.35, 0, 0.95), "attack_ms": (5, 1, 100), "decay_ms": (180, 5, 2000), "fallback_bpm": (120, 20, 300)},
    "cross_stem_mapping": {"amount": (0.45, 0, 1), "envelope_ms": (40, 5, 1000), "texture_cutoff_hz": (1800, 100, 12000)},
}
#: Other names of the roles.
ROLES = {"dx": "dx", "d": "dx", "dialogue": "dx", "mx": "mx", "m": "mx", "music": "mx", "fx": "fx", "e": "fx", "effects": "fx", "target": "source"}


@dataclass
class Programme:
    """What a recipe gets: samples (frames, channels) by role, rate, parameters, a generator, events (seconds)."""

    roles: dict[str, np.ndarray]
    rate: int
    p: dict[str, float]
    rng: np.random.Generator
    events: list[tuple[float, float]]
    wet: float = 1.0
    ceiling_db: float = -1.0

    def limited(self, x: np.ndarray) -> np.ndarray:
        return pcm.limit_peak(x, 10 ** (self.ceiling_db / 20))[0]

    def any(self, *names: str) -> np.ndarray:
        for n in names:
            if n in self.roles:
                return self.roles[n]
        raise ValueError(f"none of the roles {', '.join(names)}")


def _filtered(x: np.ndarray, gain: Callable[[np.ndarray, np.ndarray], np.ndarray], rate: int, n_fft: int) -> np.ndarray:
    """Each channel with its spectrum scaled by gain(magnitudes, frequencies)."""
    n_fft = int(min(n_fft, 2 ** int(np.log2(max(64, len(x))))))
    f, out = np.fft.rfftfreq(n_fft, 1 / rate), np.empty_like(x)
    for c in range(x.shape[1]):
        s = stft(x[:, c], n_fft, n_fft // 4)
        out[:, c] = istft(s * gain(np.abs(s), f), len(x), n_fft, n_fft // 4)
    return out


def _smoothed(mask: np.ndarray, frames: float, bins: float) -> np.ndarray:
    """Gaussian smoothing with those deviations, edges repeated."""
    for axis, s in ((0, float(frames)), (1, float(bins))):
        if s > 0:
            n = int(4 * s + 0.5)
            kernel = np.exp(-0.5 * (np.arange(-n, n + 1) / s) ** 2)
            mask = np.apply_along_axis(lambda v: np.convolve(np.pad(v, n, "edge"), kernel / kernel.sum(), "valid"), axis, mask)
    return mask


def _mix(parts: list[np.ndarray]) -> np.ndarray:
    n, channels = max(map(len, parts)), max(x.shape[1] for x in parts)
    return sum(pcm.fit_length(pcm.match_channels(x, channels), n) for x in parts)


def ducking(g: Programme) -> dict[str, np.ndarray]:
    """The untouched dialogue, each background ducked under it, their mix, and by background its gain and the dialogue's activity."""
    dx, targets = g.any("dx"), [r for r in ("mx", "fx") if r in g.roles]
    if not targets:
        raise ValueError("dialogue_aware_ducking needs mx or fx")
    out = {"dx": dx.copy()}
    for r in targets:
        x = g.roles[r]
        activity, gain = ducking_envelope(pcm.fit_length(dx, len(x)), g.rate, g.p["threshold_dbfs"], g.p["activity_range_db"], g.p["depth_db"], g.p["attack_ms"], g.p["hold_ms"], g.p["release_ms"])
        out |= {r: pcm.dry_wet(x, x * gain[:, None], g.wet), f"{r}_gain": gain[:, None], f"{r}_dx_activity": activity[:, None]}
    return out | {"mix": g.limited(_mix([dx, *(out[r] for r in targets)]))}


def unmasking(g: Programme) -> dict[str, np.ndarray]:
    """The untouched dialogue, the background lowered where both overlap, their mix, and the gain by bin and frame."""
    name = next((r for r in ("background", "mx", "fx") if r in g.roles), None)
    if name is None:
        raise ValueError("spectral_unmasking needs a background, mx or fx")
    back, whole = g.roles[name], g.any("dx")
    dx = pcm.fit_length(pcm.match_channels(whole, back.shape[1]), len(back))
    n = int(min(g.p["fft_size"], 2 ** int(np.log2(max(64, len(back))))))
    d, b = (np.abs(stft(pcm.to_mono(x), n, n // 4)) for x in (dx, back))
    overlap = _smoothed(d / (d + b + 1e-12), g.p["time_smoothing_frames"], g.p["frequency_smoothing_bins"])
    mask = 10 ** (-g.p["max_reduction_db"] * np.clip(overlap, 0, 1) ** g.p["mask_power"] / 20)
    wet = np.stack([istft(stft(back[:, c], n, n // 4) * mask, len(back), n, n // 4) for c in range(back.shape[1])], axis=1)
    out = pcm.dry_wet(back, wet, g.wet)
    return {"dx": whole.copy(), name: out, "mix": g.limited(_mix([dx, out])), "spectral_gain_mask": mask}


def rebalance(g: Programme) -> dict[str, np.ndarray]:
    gains = {"dx": g.p["dialogue_gain_db"], "mx": g.p["music_gain_db"], "fx": g.p["effects_gain_db"]}
    own = [g.roles[r] * 10 ** (db / 20) for r, db in gains.items() if r in g.roles]
    n, channels = max(map(len, own)), max(x.shape[1] for x in own)
    out = pcm.stereo_width(sum(pcm.fit_length(pcm.match_channels(x, channels), n) for x in own), g.p["stereo_width"])
    master = min(g.p["target_loudness_lufs"] - (-0.691 + 20 * np.log10(max(pcm.rms(out), 1e-6))), g.p["max_master_gain_db"])
    return {"mix": out * 10 ** (master / 20)}


def perspective(g: Programme) -> dict[str, np.ndarray]:
    x, ref = g.any("source", "dx"), g.any("reference")
    limit = lambda v, most: float(np.clip(v, -most, most))
    level = limit(20 * np.log10(max(pcm.rms(ref), 1e-9) / max(pcm.rms(x), 1e-9)), g.p["max_level_adjust_db"])

    def gain(magnitude: np.ndarray, f: np.ndarray) -> np.ndarray:
        n = 2 * (len(f) - 1)
        want, have = np.abs(stft(pcm.to_mono(ref), n, n // 4)).mean(axis=0), magnitude.mean(axis=0)
        tilt = 20 * np.log10((want / (want.mean() + 1e-12) + 1e-6) / (have / (have.mean() + 1e-12) + 1e-6))
        return 10 ** (np.clip(_smoothed(tilt[None, :], 0, 8), -g.p["max_eq_db"], g.p["max_eq_db"]) / 20)

    out = _filtered(x, gain, g.rate, int(g.p["fft_size"])) * 10 ** (level / 20)
    if x.shape[1] == 2 and ref.shape[1] == 2:
        side = lambda v: pcm.rms(v[:, 0] - v[:, 1]) / max(pcm.rms(v[:, 0] + v[:, 1]), 1e-9)
        out = pcm.stereo_width(out, 1 + limit(side(ref) / max(side(x), 1e-9) - 1, g.p["max_width_change"]))
    if "room_tone" in g.roles and g.p["room_tone_blend"] > 0:
        out = pcm.dry_wet(out, pcm.match_channels(pcm.tile(g.roles["room_tone"], len(out)), out.shape[1]), g.p["room_tone_blend"])
    return {"source": out}


def review(g: Programme) -> dict[str, np.ndarray]:
    """The untouched source, and of each event an extract with some padding and faded ends, numbered from one as the events are."""
    x = g.any("source", "dx", "mix")
    out = {"bypass": x.copy()}
    for n, (a, b) in enumerate(g.events, 1):
        start, end = max(0, int(np.floor((a - g.p["padding_seconds"]) * g.rate))), min(len(x), int(np.ceil((b + g.p["padding_seconds"]) * g.rate)))
        if end > start:
            out[f"review_region_{n:03d}"] = pcm.fade_edges(x[start:end], round(g.p["fade_ms"] / 1000 * g.rate))
    return out


def timbre(g: Programme) -> dict[str, np.ndarray]:
    def gain(magnitude: np.ndarray, f: np.ndarray) -> np.ndarray:
        centroid = magnitude @ f / (magnitude.sum(axis=1) + 1e-12)
        spread = (centroid - centroid.min()) / max(float(np.ptp(centroid)), 1e-9)
        cutoff = g.p["base_cutoff_hz"] * (1 - g.p["modulation_depth"] * (1 - spread))
        return 1 / np.sqrt(1 + (f[None, :] / np.maximum(cutoff, 20)[:, None]) ** (2 * int(g.p["filter_order"])))

    return {"source": _filtered(g.any("source", "mx"), gain, g.rate, int(g.p["fft_size"]))}


def granular(g: Programme) -> dict[str, np.ndarray]:
    x = g.any("source", "mx")
    n = int(np.clip(g.p["grain_ms"] / 1000 * g.rate, 2, len(x)))
    step, jitter = max(1, int(n * (1 - g.p["overlap"]))), int(g.p["jitter_ms"] / 1000 * g.rate)
    out, weight, window = np.zeros_like(x), np.zeros((len(x), 1)), np.hanning(n + 2)[1:-1, None]
    for at in range(0, len(x), step):
        a = int(np.clip(at + g.rng.integers(-jitter, jitter + 1), 0, len(x) - n))
        grain = x[a : a + n][:: -1 if g.rng.random() < g.p["reverse_probability"] else 1]
        k = min(n, len(x) - at)
        out[at : at + k] += grain[:k] * window[:k]
        weight[at : at + k] += window[:k]
    return {"source": out / np.maximum(weight, 1e-3)}


def spatial(g: Programme) -> dict[str, np.ndarray]:
    x = g.any("source", "mx")
    if x.shape[1] != 2:
        return {"source": x.copy()}
    t = np.arange(len(x)) / g.rate
    pan, wide = (np.sin(2 * np.pi * (g.p["rate_hz"] * k * t + g.rng.random())) for k in (1.0, 0.7))
    mid, side = (x[:, 0] + x[:, 1]) / 2, (x[:, 0] - x[:, 1]) / 2 * (1 + g.p["width_depth"] * wide)
    angle = (1 + g.p["pan_depth"] * pan) * np.pi / 4
    return {"source": np.stack([(mid + side) * np.cos(angle), (mid - side) * np.sin(angle)], axis=1) * np.sqrt(2)}


def beats(g: Programme) -> dict[str, np.ndarray]:
    x = g.any("source", "mx")
    starts = [a for a, _ in g.events] or list(np.arange(0, len(x) / g.rate, 60 / g.p["fallback_bpm"]))
    attack, decay = (max(1, int(g.p[k] / 1000 * g.rate)) for k in ("attack_ms", "decay_ms"))
    shape = np.concatenate([np.linspace(0, 1, attack, endpoint=False), np.exp(-4 * np.arange(decay) / decay)])
    envelope = np.zeros(len(x))
    for s in starts:
        a = round(s * g.rate)
        if 0 <= a < len(x):
            k = min(len(shape), len(x) - a)
            envelope[a : a + k] = np.maximum(envelope[a : a + k], shape[:k])
    return {"source": x * (1 - g.p["depth"] * (1 - envelope))[:, None], "envelope": envelope[:, None]}


def mapping(g: Programme) -> dict[str, np.ndarray]:
    x = g.any("source", "mx")
    control = np.abs(pcm.fit_length(pcm.to_mono(g.any("control", "dx")), len(x)))
    n = max(1, int(g.p["envelope_ms"] / 1000 * g.rate))
    envelope = np.convolve(control, np.ones(n) / n, "same")
    envelope /= envelope.max() or 1.0
    texture = _filtered(x, lambda m, f: np.broadcast_to(1 / (1 + (g.p["texture_cutoff_hz"] / np.maximum(f, 1.0)) ** 4), m.shape), g.rate, 1024)
    return {"source": x + texture * (g.p["amount"] * envelope)[:, None]}


RECIPES: dict[str, Callable[[Programme], dict[str, np.ndarray]]] = {
    "dialogue_aware_ducking": ducking, "spectral_unmasking": unmasking, "dme_rebalance": rebalance, "perspective_matching": perspective, "review_region_variants": review,
    "timbre_filter_modulation": timbre, "granular_resynthesis": granular, "stereo_spatial_animation": spatial, "event_beat_modulation": beats, "cross_stem_mapping": mapping,
}


#: Recipes that mix and limit their outputs themselves.
FINISHED = ("dialogue_aware_ducking", "spectral_unmasking", "review_region_variants")


def resolved(name: str, given: dict[str, float] | None = None) -> dict[str, float]:
    """Parameters of a recipe with defaults; an unknown name or a value out of bounds is an error."""
    if name not in PARAMETERS:
        raise ValueError(f"no recipe {name}")
    out = {k: float(v[0]) for k, v in PARAMETERS[name].items()}
    for k, v in (given or {}).items():
        if k not in out:
            raise ValueError(f"{name} has no parameter {k}")
        _, low, high = PARAMETERS[name][k]
        if not (np.isfinite(v) and low <= v <= high):
            raise ValueError(f"{k} must be between {low} and {high}")
        out[k] = float(v)
    return out


def render(name: str, roles: dict[str, np.ndarray], rate: int, given: dict[str, float] | None = None, seed: int = 0, events: list[tuple[float, float]] = (), dry_wet: float = 1.0, ceiling_db: float = -1.0) -> dict[str, np.ndarray]:
    """The outputs of a recipe by name, mixed with the untouched role and kept under the ceiling; two names of one role are an error."""
    own: dict[str, np.ndarray] = {}
    for role, x in roles.items():
        key = ROLES.get(role, role)
        if key in own:
            raise ValueError(f"role {key} is given twice")
        own[key] = np.atleast_2d(np.asarray(x, float).T).T
    out = RECIPES[name](Programme(own, rate, resolved(name, given), np.random.default_rng(seed), list(events), dry_wet, ceiling_db))
    if name in FINISHED:
        return out
    for key in out:
        if key in own and out[key].shape == own[key].shape and dry_wet < 1:
            out[key] = pcm.dry_wet(own[key], out[key], dry_wet)
        if key not in ("gain", "envelope", "bypass"):
            out[key] = pcm.limit_peak(out[key], 10 ** (ceiling_db / 20))[0]
    return out


def run_recipe(df: DataFrame, by: list[str], name: str, given: dict[str, float] | None = None, seed: int = 0) -> DataFrame:
    """A recipe for every programme: rows by, role, rate, channels, samples (interleaved) in; by, output, rate, channels, samples out."""
    resolved(name, given)
    kinds = dict(df.dtypes)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        roles = {r.role: np.asarray(r.samples, float).reshape(-1, int(r.channels)) for r in rows.itertuples()}
        rate = int(rows["rate"].iloc[0])
        out = render(name, roles, rate, given, seed)
        head = {c: rows[c].iloc[0] for c in by}
        return pd.DataFrame([{**head, "output": k, "rate": rate, "channels": v.shape[1], "samples": v.ravel().tolist()} for k, v in sorted(out.items())])

    fields = ", ".join(f"`{c}` {kinds[c]}" for c in by)
    return df.groupBy(*by).applyInPandas(run, f"{fields}, output string, rate bigint, channels bigint, samples array<double>")
