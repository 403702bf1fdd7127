import numpy as np
import pytest

from cutloom.kernels import recipes

RATE = 8000


def roles(names, channels=2, seed=0):
    rng = np.random.default_rng(seed)
    t = np.arange(RATE) / RATE
    return {n: 0.3 * np.sin(2 * np.pi * (200 + 150 * i) * t)[:, None] * rng.uniform(0.5, 1, channels)[None, :] + 0.01 * rng.standard_normal((RATE, channels)) for i, n in enumerate(names)}


NEEDS = {"dialogue_aware_ducking": "dx mx fx", "spectral_unmasking": "dx background", "dme_rebalance": "d m e", "perspective_matching": "source reference room_tone", "cross_stem_mapping": "control target"}


@pytest.mark.parametrize("name", sorted(recipes.RECIPES))
def test_every_recipe_is_deterministic_bounded_and_leaves_its_input(name):
    own = roles(NEEDS.get(name, "source").split())
    before = {k: v.copy() for k, v in own.items()}
    a, b = (recipes.render(name, own, RATE, seed=3, events=[(0.2, 0.4)]) for _ in range(2))
    assert all(np.array_equal(own[k], before[k]) for k in own)
    assert a.keys() == b.keys() and all(np.array_equal(a[k], b[k]) and np.isfinite(a[k]).all() for k in a)
    assert all(np.abs(v).max() <= 10 ** (-1 / 20) + 1e-9 for k, v in a.items() if k not in ("envelope", "bypass") and not k.endswith("_gain") and not k.endswith("mask") and not k.endswith("activity"))


def test_effects():
    own = roles(["dx", "mx"], 1)
    own["dx"][4000:] = 0
    out = recipes.render("dialogue_aware_ducking", own, RATE)
    assert np.abs(out["mx"][2000:3500]).mean() < 0.5 * np.abs(own["mx"][2000:3500]).mean()
    regions = recipes.render("review_region_variants", {"source": own["mx"]}, RATE, {"padding_seconds": 0.1}, events=[(0.3, 0.5)])
    assert abs(len(regions["review_region_001"]) - round(0.4 * RATE)) <= 1 and np.array_equal(regions["bypass"], own["mx"]) and np.array_equal(out["dx"], own["dx"]) and set(out) == {"dx", "mx", "mix", "mx_gain", "mx_dx_activity"}
    assert set(recipes.render("review_region_variants", {"source": own["mx"]}, RATE)) == {"bypass"}
    assert out["mx_gain"].min() >= 10 ** (-10 / 20) - 1e-9 and out["mx_gain"][2000] < 0.5 < 0.85 < out["mx_gain"][-1]


def test_contracts():
    with pytest.raises(ValueError):
        recipes.resolved("dme_rebalance", {"stereo_width": 3})
    with pytest.raises(ValueError):
        recipes.resolved("dme_rebalance", {"other": 1})
    with pytest.raises(ValueError):
        recipes.resolved("nothing")
    with pytest.raises(ValueError):
        recipes.render("dme_rebalance", roles(["d", "dx"]), RATE)


def test_per_programme(spark):
    rows = [(p, r, RATE, 2, x.ravel().tolist()) for p in ("p", "q") for r, x in roles(["dx", "mx"]).items()]
    df = spark.createDataFrame(rows, "prog string, role string, rate bigint, channels bigint, samples array<double>")
    out = recipes.run_recipe(df, ["prog"], "dialogue_aware_ducking").collect()
    assert sorted((r.prog, r.output) for r in out) == [(p, o) for p in "pq" for o in ("dx", "mix", "mx", "mx_dx_activity", "mx_gain")]
