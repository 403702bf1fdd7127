import tracemalloc

import numpy as np
import pytest

from cutloom.llm import clusters, neighbours
from cutloom.llm.clusters import Mixture, describe_clusters, similarity_clusters
from cutloom.llm.neighbours import Router, balanced_parts, nearest_of_sample, similar_vectors

DIM = 64
SCHEMA = "k string, e array<double>, v int, vec string, n int"


def made(groups, per, lonely, seed=0, noise=0.45):
    rng = np.random.default_rng(seed)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    c = unit(rng.standard_normal((groups, DIM)))
    x = np.concatenate([unit(c[g] + unit(rng.standard_normal((per, DIM))) * noise) for g in range(groups)] + [unit(rng.standard_normal((lonely, DIM)))])
    return x * rng.uniform(0.2, 5, (len(x), 1))


def frame(spark, x, more=()):
    rows = [(f"k{i:05d}", [float(v) for v in row], 2, "clash", 1) for i, row in enumerate(x)] + [(f"k{i:05d}", [1.0] * DIM, 1, "old", 1) for i in range(0, len(x), 7)]
    return spark.createDataFrame(rows + list(more), SCHEMA)


BAD = [("bad1", None, 2, "", 1), ("bad2", [], 2, "", 1), ("bad3", [0.0] * DIM, 2, "", 1), ("bad4", [float("nan")] * DIM, 2, "", 1), ("bad5", [1.0] * (DIM - 1), 2, "", 1), ("bad6", [1.0] * (DIM - 1) + [None], 2, "", 1), (None, [1.0] * DIM, 2, "", 1), ("bad7", [1.0] * DIM, 1, "", 1), ("bad7", None, 2, "", 1)]


def nearest(x, k):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    return np.argsort(-s, axis=1)[:, :k], s


def test_recall_and_order(spark):
    x = made(60, 60, 500)
    got = {}
    for r in similar_vectors(frame(spark, x, BAD), "k", "e", DIM, "v", k=10).collect():
        got.setdefault(r.k, {})[r.rank] = (r.neighbour, r.similarity)
    near, s = nearest(x, 10)
    assert set(got) == {f"k{i:05d}" for i in range(len(x))}
    hits = [len({f"k{j:05d}" for j in near[i]} & {n for n, _ in got[f"k{i:05d}"].values()}) for i in range(len(x))]
    assert np.mean(hits) >= 9.0
    assert all(abs(sim - s[int(k[1:]), int(n[1:])]) < 1e-4 for k, ranks in list(got.items())[:50] for n, sim in ranks.values())


def test_recall_over_many_parts(spark, monkeypatch):
    """Neighbours of vectors that are near to nothing are found, too, when there are many more parts than are asked at least."""
    x = made(30, 40, 1800, seed=8)
    for name in ("PART", "WIDE"):
        monkeypatch.setattr(neighbours, name, 150, raising=False)
    got = {}
    for r in similar_vectors(frame(spark, x), "k", "e", DIM, "v", k=10).collect():
        got.setdefault(r.k, set()).add(r.neighbour)
    near, _ = nearest(x, 10)
    assert np.mean([len({f"k{j:05d}" for j in near[i]} & got[f"k{i:05d}"]) for i in range(len(x))]) >= 9.0


def test_parts_are_cut_again_where_the_sample_is_too_small(spark, monkeypatch):
    x = made(60, 50, 600, seed=10, noise=0.2)
    for name, value in (("PART", 100), ("SAMPLE", 512), ("LEAST_SAMPLE", 64), ("BLOCK", 700)):
        monkeypatch.setattr(neighbours, name, value)
    got = {}
    for r in similar_vectors(frame(spark, x, BAD), "k", "e", DIM, "v", k=10, least=0.9, near=True).collect():
        got.setdefault(r.k, set()).add(r.neighbour)
    near, s = nearest(x, 10)
    want = {f"k{i:05d}": {f"k{j:05d}" for j in near[i] if s[i, j] >= 0.9} for i in range(len(x))}
    found = sum(len(want[k] & got.get(k, set())) for k in want)
    assert sum(map(len, want.values())) > 20_000 and found >= 0.95 * sum(map(len, want.values()))


def test_a_third_of_all_rows_are_one_vector(spark, monkeypatch):
    x = made(20, 10, 200, seed=11)
    x = np.vstack([x, np.repeat(x[:1] * 2, 200, axis=0)])
    monkeypatch.setattr(neighbours, "COPIES", 30)
    got = {}
    for r in similar_vectors(frame(spark, x), "k", "e", DIM, "v", k=10).collect():
        got.setdefault(r.k, {})[r.rank] = (r.neighbour, r.similarity)
    same = [f"k{i:05d}" for i in (0, *range(400, 600))]
    for k in same:
        assert [got[k][n][0] for n in range(1, 11)] == [m for m in same if m != k][:10] and got[k][1][1] == 1
    near, s = nearest(x, 10)
    others = [np.sort(s[i])[-10:].sum() - sum(v for _, v in got[f"k{i:05d}"].values()) for i in range(1, 400)]
    assert np.mean(others) < 0.1


def test_most_similar_are_the_greatest():
    rng = np.random.default_rng(9)
    for width in (10, 300, 1000, 2077):
        sims = rng.standard_normal((40, width)).astype(np.float32)
        got = neighbours.most_similar(sims, 10)
        assert (np.sort(got, axis=1) == np.sort(np.argsort(-sims, axis=1)[:, :10], axis=1)).all()


def test_floor_keeps_ranks_and_copies_are_neighbours(spark):
    x = made(3, 5, 20, seed=2)
    x = np.vstack([x, x[0], x[0], x[0]])
    rows = similar_vectors(frame(spark, x), "k", "e", DIM, "v", k=2, least=0.99).collect()
    first = f"k{0:05d}"
    copies = {first, *(f"k{i:05d}" for i in range(35, 38))}
    assert {r.k for r in rows} == copies and all(r.neighbour in copies and r.rank in (1, 2) for r in rows) and len(rows) == 8
    assert [r.neighbour for r in sorted((r for r in rows if r.k == first), key=lambda r: r.rank)] == ["k00035", "k00036"]


@pytest.mark.parametrize("rows", [[], [("a", [1.0] * DIM, 1, "", 1)]])
def test_none_or_one_vector(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    assert similar_vectors(df, "k", "e", DIM, "v").collect() == []
    assert similarity_clusters(df, "k", "e", DIM, "v").collect() == []


def test_near_neighbours_are_a_short_plan(spark):
    """The driver plans anew after each stage: what was searched is a table by then, not a part of the plan."""
    x = made(10, 5, 100, seed=16, noise=0.1)
    x = np.vstack([x, x[:3]])
    found = similar_vectors(frame(spark, x, BAD), "k", "e", DIM, "v", k=10, least=0.95, near=True)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert not [step for step in ("MapInArrow", "FlatMapGroupsInArrow", "InMemoryRelation") if step in plan]
    near, s = nearest(x, 10)
    got = {(r.k, r.neighbour, r["rank"]) for r in found.collect()}
    assert {(a, b) for a, b, _ in got} == {(f"k{i:05d}", f"k{j:05d}") for i in range(len(x)) for j in near[i] if s[i, j] >= 0.95}
    assert all((f"k{i:05d}", f"k{150 + i:05d}", 1) in got for i in range(3))


def test_neighbours_of_the_sample_take_little_memory():
    x = np.random.default_rng(15).standard_normal((4096, 16)).astype(np.float32)
    tracemalloc.start()
    nearest_of_sample(x, 10)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 30e6


def test_parts_are_balanced_and_the_router_finds_them():
    x = made(40, 50, 0).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    parts = balanced_parts(x, nearest_of_sample(x, 10), 8)
    size = np.bincount(parts)
    assert len(size) == 8 and size.max() <= 1.15 * size.mean() and size.min() >= 0.85 * size.mean()
    router = Router(x, 8)
    near, _ = nearest(x, 1)
    asked, kept = router.route(x, 3), router.route(x, 1)[:, 0]
    assert np.mean([kept[j] in asked[i] for i, (j,) in enumerate(near)]) > 0.95


def test_clusters(spark):
    x = made(40, 25, 200, seed=3, noise=0.35)
    small = made(30, 3, 0, seed=4, noise=0.3)
    pairs = made(10, 2, 0, seed=5, noise=0.2)
    x = np.vstack([x, small, pairs])
    _, s = nearest(x, 1)
    np.fill_diagonal(s, 1)
    near = s >= 0.6
    first = near.argmax(axis=1)
    clique = {i for i in range(len(x)) if (near[i] == near[first[i]]).all()}
    want = {(f"k{i:05d}", f"k{first[i]:05d}") for i in clique if near[i].sum() >= 3 and all(j in clique for j in np.nonzero(near[i])[0])}
    members = similarity_clusters(frame(spark, x, BAD), "k", "e", DIM, "v", cell=300).cache()
    got = {(r.k, r.cluster) for r in members.collect()}
    assert len(want) > 500 and len(got & want) >= 0.95 * len(want)
    table = describe_clusters(members, "k").collect()
    assert sum(r["size"] for r in table) == len(got) and all(1 <= len(r.typical) <= 3 for r in table)


def test_clusters_of_a_small_table(spark):
    """A handful of rows has its clusters, too."""
    x = made(3, 4, 2, seed=12, noise=0.2)
    got = {(r.k, r.cluster) for r in similarity_clusters(frame(spark, x), "k", "e", DIM, "v").collect()}
    assert got == {(f"k{i:05d}", f"k{i - i % 4:05d}") for i in range(12)}


def test_members_are_judged_by_all_members(spark, monkeypatch):
    x = made(3, 200, 0, seed=14, noise=0.4)
    for name, value in (("SAMPLE", 40), ("LEAST_SAMPLE", 40)):
        monkeypatch.setattr(clusters, name, value, raising=False)
    rows = similarity_clusters(frame(spark, x), "k", "e", DIM, "v").collect()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    of = lambda k: u[int(k[1:])] @ u[int(k[1:]) // 200 * 200 :][:200].mean(axis=0)
    assert len(rows) == 600 and all(abs(r.typicality - of(r.k)) < 1e-3 for r in rows)


def test_information_criterion_finds_the_groups():
    x = made(12, 40, 60, seed=6, noise=0.3)
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    m = Mixture(x, 0.6, reduced=12)
    own, _ = m.assign(x, 0.6)
    assert len(set(own[:480])) == 12 and (own[480:] < 0).mean() > 0.9
