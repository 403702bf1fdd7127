import numpy as np
import pytest

from cutloom.kernels import pcm, spectral


def tone(n=8000, rate=16000, f=440.0):
    return 0.5 * np.sin(2 * np.pi * f * np.arange(n) / rate)


def snr(a, b):
    return 10 * np.log10((a**2).sum() / ((a - b) ** 2).sum())


@pytest.mark.parametrize("width,floor", [(1, 35), (2, 80), (3, 120), (4, 160)])
def test_wav_round_trip(width, floor):
    x, rate, w = pcm.read_wav(pcm.write_wav(tone(), 16000, width))
    assert (rate, w, x.shape) == (16000, width, (8000, 1)) and snr(tone(), x[:, 0]) > floor


def test_float_wav_and_truncated_data():
    content = pcm.write_wav(tone(), 16000, is_float=True)
    assert snr(tone(), pcm.read_wav(content)[0][:, 0]) > 120
    assert len(pcm.read_wav(content[:-100])[0]) == 8000 - 25
    with pytest.raises(ValueError):
        pcm.read_wav(b"nothing")


def test_stft_and_image_round_trip():
    x = tone() + 0.1 * np.random.default_rng(0).standard_normal(8000)
    assert snr(x, spectral.istft(spectral.stft(x), len(x))) > 200
    image, top = spectral.encode_image(x)
    assert snr(x, spectral.decode_image(image, top, len(x))) > 75


def test_parts_sum_to_the_original():
    x, y = tone(), 0.2 * np.random.default_rng(1).standard_normal(8000)
    parts = spectral.project_on_original(x + y, [x, y])
    assert np.abs(sum(parts) - (x + y)).max() < 1e-6


def test_levels_masks_and_loops():
    levels, hop = pcm.hop_levels(np.concatenate([np.zeros(1600), np.ones(1600) * 0.5]), 16000)
    assert hop == 0.02 and levels[0] == -120 and abs(levels[-1] - 20 * np.log10(0.5)) < 1e-9
    mask = pcm.segment_mask(1000, 1000, [(0.2, 0.5)], 50)
    assert mask[300] == 1 and mask[199] == mask[200] == mask[500] == 0 and 0 < mask[225] < 1 and 0 < mask[475] < 1
    donor = tone(32000, 16000, 110.0)
    loop = pcm.granular_loop(donor, 16000, 4000, 800, 0)
    assert loop.size == 16000 and np.abs(np.diff(loop)).max() < 3 * np.abs(np.diff(donor)).max()
    ramp = pcm.equal_power_ramp(4)
    assert ramp[0] == 0 and ramp[-1] == pytest.approx(np.sin(3 * np.pi / 8))
    assert pcm.speech_rms(np.zeros(10), np.array([3.0, 4.0])) == pytest.approx(np.sqrt(12.5))
    a = pcm.granular_loop(tone(), 3000, 400, 50, 7)
    assert np.array_equal(a, pcm.granular_loop(tone(), 3000, 400, 50, 7)) and len(a) == 3000
    assert pcm.limit_peak(np.array([2.0, -1.0]))[1] == pytest.approx(0.495)
    assert len(pcm.resample(tone(), 16000, 8000)) == 4000
    assert [len(w) for w in pcm.windows(np.zeros(25), 10, 1.0)] == [10, 10, 5]


def test_loudness_weighting_keeps_state():
    x = np.random.default_rng(2).standard_normal(2000)
    whole = spectral.KWeighting(48000).process(x)
    k = spectral.KWeighting(48000)
    assert np.allclose(whole, np.concatenate([k.process(x[:700]), k.process(x[700:])]))


def test_filters_and_stereo():
    for bank in (spectral.mel_filterbank(40, 2048, 48000), spectral.bark_filterbank(24, 2048, 48000)):
        assert np.allclose(bank.sum(axis=1), 1)
    assert spectral.mel_filterbank(4, 2048, 48000)[0, 0] == 0
    t = tone()
    assert spectral.stereo_features(np.stack([t, t], 1)) == pytest.approx((0, 0, 1, 0), abs=1e-6)
    balance, width, together, lost = spectral.stereo_features(np.stack([t, -t], 1))
    assert (balance, together, lost) == pytest.approx((0, -1, 1), abs=1e-6) and width > 1e3
    assert spectral.stereo_features(np.stack([t, t / 10], 1))[0] == pytest.approx(20)
    frames, times = spectral.log_band_frames(tone(), 16000)
    assert frames.shape[0] == len(times) and times[0] == pytest.approx(0.025) and frames.shape[1] <= 16
    both = np.concatenate([tone(16000, f=200), tone(16000, f=3000)])
    assert spectral.change_points(both, 16000, 0.1, 0.05) == pytest.approx([1.05])
    c = np.zeros((6, 12))
    c[:3, [0, 4, 7]], c[3:5, [9, 0, 4]] = 1, 1
    assert [(round(a, 1), round(b, 1), n) for a, b, n, _ in spectral.estimate_chords(c, np.arange(6) * 0.5)] == [(0.0, 1.5, "C:maj"), (1.5, 2.5, "A:min"), (2.5, 3.0, "N")]
    label, mode, sure = spectral.estimate_key(np.roll(np.array(spectral.MAJOR), 7))
    assert (label, mode) == ("G", "major") and 0.5 < sure < 1


def test_descriptors():
    assert spectral.harmonicity(tone(), 16000) > 0.9 > spectral.harmonicity(np.random.default_rng(0).standard_normal(4000), 16000)
    f = spectral.frame_features(tone(16000), 16000)
    assert abs(np.median(f["centroid"]) - 440) < 60 and f["mfcc"].shape[1] == 13
    basis = spectral.dct_basis(13, 13)
    assert np.allclose(basis @ basis.T, np.eye(13))
    v = np.array([1.0, 0, 0]), np.array([0, 1.0, 0])
    s = spectral.self_similarity(np.array([v[0], v[1], v[0], v[1], np.zeros(3)]))
    assert spectral.repeated_motifs(s, 1.0, 0.9, 2.0)[0][:2] == (0, 2)
    c = np.roll(np.array(spectral.MAJOR), 7)
    assert spectral.estimate_key(c)[:2] == ("G", "major")
    quiet = np.concatenate([tone(), np.zeros(32000)])
    ducked = spectral.duck(np.ones(40000), quiet, 16000)
    assert ducked[7000] < 0.6 and ducked[-1] > 0.8
