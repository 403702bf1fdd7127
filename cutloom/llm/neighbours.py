"""Most similar vectors of every vector, over learned partitions.

A graph of nearest neighbours of a bounded sample is cut into balanced parts; a softmax classifier learns to tell a
vector's part. Every vector is kept in its most probable part and asked for in its several most probable ones. Where the
sample is too small for as many parts as the vectors need, every part is cut again in the same way, from a sample of its
own. Nearest neighbours that are not near (cosine under 0.6) lie in any part, so for them the parts asked grow with their
number.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cutloom.common import cut_lineage, latest
from cutloom.llm.vectors import newest_vectors, packed, sample, unpack

#: Vectors from which the parts are learned; vectors that a part should hold; sample vectors a part needs at least.
SAMPLE, PART, LEAST_SAMPLE = 8_192, 2_048, 16
#: Parts in which a vector is asked for, at least.
PROBES = 3
#: For neighbours at any distance: vectors that a part should hold, share of the parts in which a vector is asked for.
WIDE, SHARE = 12_288, 0.6
#: Part's vectors that one task compares with; a part that the sample shows to be larger is split into blocks.
BLOCK = 16_384
#: Copies of one vector that one task expands.
COPIES = 20_000


def nearest_of_sample(x: np.ndarray, k: int) -> np.ndarray:
    """Numbers of the k nearest others of each row."""
    n = len(x)
    k = min(k, n - 1)
    out = np.empty((n, k), np.int32)
    for s in range(0, n, 256):  # the driver's memory holds a strip and its order
        sims = x[s : s + 256] @ x.T
        sims[np.arange(len(sims)), np.arange(s, s + len(sims))] = -2
        out[s : s + 256] = np.argpartition(-sims, k - 1, axis=1)[:, :k] if k else 0
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, slack: float = 0.1, rounds: int = 6) -> np.ndarray:
    """Cut the graph into parts of nearly equal size: halving along the widest direction, then moves towards neighbours.

    A move takes a vertex to the part of most of its neighbours, while that part has room and its own is not too small.
    """
    label = np.zeros(len(x), np.int32)
    stack, following = [(np.arange(len(x)), parts)], 0
    rng = np.random.default_rng(0)
    while stack:
        rows, p = stack.pop()
        if p == 1:
            label[rows] = following
            following += 1
            continue
        own = x[rows] - x[rows].mean(axis=0)
        v = rng.standard_normal(x.shape[1]).astype(np.float32)
        for _ in range(8):
            v = own.T @ (own @ v)
            v /= np.linalg.norm(v) + 1e-12
        left = p // 2
        order = np.argsort(own @ v, kind="stable")
        cut = round(len(rows) * left / p)
        stack += [(rows[order[cut:]], p - left), (rows[order[:cut]], left)]
    size = np.bincount(label, minlength=parts)
    most, least = int(np.ceil(len(x) / parts * (1 + slack))), int(len(x) / parts * (1 - slack))
    for _ in range(rounds):
        votes = np.zeros((len(x), parts), np.int16)
        np.add.at(votes, (np.repeat(np.arange(len(x)), graph.shape[1]), label[graph].ravel()), 1)
        best = votes.argmax(axis=1)
        gain = votes[np.arange(len(x)), best] - votes[np.arange(len(x)), label]
        moved = 0
        for i in np.argsort(-gain, kind="stable"):
            if gain[i] <= 0:
                break
            a, b = label[i], best[i]
            if size[b] < most and size[a] > least:
                label[i] = b
                size[a] -= 1
                size[b] += 1
                moved += 1
        if not moved:
            break
    return label


class Router:
    """Softmax classifier from a vector to its parts."""

    def __init__(self, x: np.ndarray, parts: int, k: int = 10, epochs: int = 12) -> None:
        self.parts = parts
        self.share = np.ones(1)
        if parts == 1:
            return
        graph = nearest_of_sample(x, k)
        label = balanced_parts(x, graph, parts)
        n = len(x)
        target = np.zeros((n, parts), np.float32)
        target[np.arange(n), label] = 0.5
        np.add.at(target, (np.repeat(np.arange(n), graph.shape[1]), label[graph].ravel()), 0.5 / graph.shape[1])
        self.weight = np.zeros((x.shape[1], parts), np.float32)
        np.add.at(self.weight.T, label, x)
        self.weight *= 10 / (np.linalg.norm(self.weight, axis=0) + 1e-9)
        self.bias = np.zeros(parts, np.float32)
        rng = np.random.default_rng(0)
        m, v, step = np.zeros_like(self.weight), np.zeros_like(self.weight), 0
        for _ in range(epochs):
            order = rng.permutation(n)
            for s in range(0, n, 512):
                rows = order[s : s + 512]
                p = self._softmax(x[rows]) - target[rows]
                step += 1
                g = x[rows].T @ p / len(rows) + 1e-5 * self.weight
                m = 0.9 * m + 0.1 * g
                v = 0.99 * v + 0.01 * g * g
                self.weight -= 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
                self.bias -= 0.5 * p.mean(axis=0)
        self.share = np.bincount(self.route(x, 1)[:, 0], minlength=parts) / n

    def _softmax(self, x: np.ndarray) -> np.ndarray:
        z = x @ self.weight + self.bias
        z -= z.max(axis=1, keepdims=True)
        np.exp(z, out=z)
        return z / z.sum(axis=1, keepdims=True)

    def route(self, x: np.ndarray, probes: int) -> np.ndarray:
        """The most probable parts of each row, the most probable first."""
        if self.parts == 1:
            return np.zeros((len(x), 1), np.int64)
        z = x @ self.weight + self.bias
        probes = min(probes, self.parts)
        top = np.argpartition(-z, probes - 1, axis=1)[:, :probes]
        return np.take_along_axis(top, np.argsort(-np.take_along_axis(z, top, axis=1), axis=1, kind="stable"), axis=1)


def most_similar(sims: np.ndarray, k: int, strips: int = 32) -> np.ndarray:
    """Places of the k greatest of each row: they stand where the greatest of so many values are among the k greatest of those."""
    n, width = sims.shape
    each = width // strips
    if each <= 2 * k:
        return np.argpartition(-sims, k - 1, axis=1)[:, :k] if k else np.empty((n, 0), np.int64)
    top = sims[:, : each * strips].reshape(n, strips, each).max(axis=1)
    best = np.argpartition(-top, k - 1, axis=1)[:, :k]
    places = (best[:, :, None] + np.arange(strips) * each).reshape(n, -1)
    places = np.hstack([places, np.broadcast_to(np.arange(each * strips, width), (n, width - each * strips))])
    own = np.argpartition(-np.take_along_axis(sims, places, axis=1), k - 1, axis=1)[:, :k]
    return np.take_along_axis(places, own, axis=1)


def local_neighbours(own: np.ndarray, x: np.ndarray, k: int, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every row its k most similar own rows of the block: rows, rows of neighbours, similarities."""
    index = np.nonzero(own)[0]
    base = np.ascontiguousarray(x[index].T)
    place = np.full(len(x), -1)
    place[index] = np.arange(len(index))
    a, b, c = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.float64)]
    k = min(k, len(index))
    for s in range(0, len(x), 512):
        sims = x[s : s + 512] @ base
        mine = place[s : s + 512]
        rows = np.nonzero(mine >= 0)[0]
        sims[rows, mine[rows]] = -2
        if least > -1:
            r, j = np.nonzero(sims >= least)
            if len(r):
                kept = np.lexsort((j, -sims[r, j], r))
                r, j = r[kept], j[kept]
                first = np.searchsorted(r, r, side="left")
                use = np.arange(len(r)) - first < k
                r, j = r[use], j[use]
        else:
            j = most_similar(sims, k)
            r, j = np.repeat(np.arange(len(sims)), k), j.ravel()
            use = sims[r, j] > -2
            r, j = r[use], j[use]
        a.append(s + r)
        b.append(index[j])
        c.append(sims[r, j].astype(np.float64))
    return np.concatenate(a), np.concatenate(b), np.concatenate(c)


def similar_vectors(df: DataFrame, key: str, vector: str, dim: int, version: str, k: int = 10, least: float = -2.0, near: bool = False) -> DataFrame:
    """The k most similar other vectors of every usable vector: key, neighbour, similarity (cosine), rank (from 1).

    Of each key the newest version counts; keys whose newest vector is null, of another length, not finite or all zero
    have no neighbours and are none. With `least`, only neighbours of at least that cosine are returned; their ranks are
    the same. Ties go to the smaller key. Exact copies are searched once, as their smallest key, and are each other's
    neighbours with cosine 1. With `near`, only neighbours of a cosine near 1 are needed: parts are small, and few are
    asked. One vector or none gives an empty result. Columns beyond the named ones are ignored.
    """
    copies = latest(packed(df, key, vector, dim, version).select(key, version, F.unhex(F.md5("vec")).alias("h")), key, version, ["h"]).where("h IS NOT NULL")
    groups = copies.groupBy("h").agg(F.min(key).alias("rep"), F.count(F.lit(1)).alias("size")).where("size > 1")
    groups = groups.select("h", "rep", F.ceil(F.col("size") / COPIES).cast("int").alias("salts"))
    large = F.broadcast(groups.where("salts > 1"))  # one row in COPIES vectors at most
    tagged = copies.join(large, "h", "left")
    small = tagged.where("rep IS NULL").select("h", key).join(groups.where("salts = 1"), "h")
    copies = cut_lineage(tagged.where("rep IS NOT NULL").select(key, "rep", "salts").unionByName(small.select(key, "rep", "salts")))
    total_vectors = newest_vectors(df, key, vector, dim, version)
    others = copies.where(F.col(key) != F.col("rep")).select(key)
    vectors = total_vectors.join(others, key, "left_anti")

    count = df.select(F.approx_count_distinct(key)).first()[0]
    x = sample(packed(df, key, vector, dim, version), key, version, SAMPLE, dim, count)
    wanted = max(1, -(-count // (PART if near else WIDE)))
    router = Router(x, max(1, min(wanted, len(x) // LEAST_SAMPLE)))
    fine = -(-wanted // router.parts) if len(x) >= SAMPLE else 1
    probes = PROBES if near else max(PROBES, int(np.ceil(router.parts * SHARE)))
    blocks = np.maximum(1, np.ceil(router.share * count / BLOCK)).astype(int)
    sent = df.sparkSession.sparkContext.broadcast((router, blocks))
    kind = dict(df.dtypes)[key]

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        router, blocks = sent.value
        for batch in batches:
            if not batch.num_rows:
                continue
            top = router.route(unpack(batch.column(1), dim), probes)
            rows, part, block, own = [], [], [], []
            for i, places in enumerate(top.tolist()):
                home = i % blocks[places[0]]
                for n, p in enumerate(places):
                    for b in range(blocks[p]):
                        rows.append(i)
                        part.append(p)
                        block.append(b)
                        own.append(n == 0 and b == home)
            taken = batch.take(pa.array(rows))
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(block, pa.int32()), pa.array(own), *taken.columns], names=["part", "block", "own", key, "vec"])

    def search(group: pa.Table) -> pa.Table:
        a, b, c = local_neighbours(group.column("own").to_numpy(), unpack(group.column("vec"), dim), k, least)
        keys = group.column(key)
        return pa.table({key: keys.take(pa.array(a)), "neighbour": keys.take(pa.array(b)), "similarity": pa.array(c, pa.float64())})

    form = f"part int, block int, own boolean, `{key}` {kind}, vec binary"
    if fine == 1:
        routed = vectors.select(key, "vec").mapInArrow(route, form)
    else:
        routed = _cut_again(vectors.select(key, "vec"), router, key, kind, dim, probes, fine, count)
    found = routed.groupBy("part", "block").applyInArrow(search, f"`{key}` {kind}, neighbour {kind}, similarity double")
    if near:  # few rows; the driver's memory holds one short plan at a time
        found = cut_lineage(found)

    salted = F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)).alias("s")
    many = copies.groupBy("rep").agg(F.first("salts").alias("salts"))
    members = copies.select("rep", F.col(key).alias("member"), F.when(F.col("salts") > 1, F.pmod(F.xxhash64(key), F.col("salts"))).otherwise(0).cast("int").alias("s"))
    n = F.row_number()
    first = members.withColumn("n", n.over(Window.partitionBy("rep", "s").orderBy("member"))).where(F.col("n") <= k + 1)
    first = first.withColumn("n", n.over(Window.partitionBy("rep").orderBy("member"))).where(F.col("n") <= k + 1).select("rep", F.col("member").alias("neighbour"))
    asked = found.join(many.withColumnRenamed("rep", key), key, "left").select(key, "neighbour", "similarity", salted)
    asked = asked.join(members.withColumnRenamed("rep", key), [key, "s"], "left").select(F.coalesce("member", key).alias(key), "neighbour", "similarity")
    asked = asked.join(first.select(F.col("rep").alias("neighbour"), F.col("neighbour").alias("member")), "neighbour", "left").select(key, F.coalesce("member", "neighbour").alias("neighbour"), "similarity")
    within = first.join(many, "rep").select("rep", "neighbour", salted).join(members, ["rep", "s"]).where("member != neighbour").select(F.col("member").alias(key), "neighbour", F.lit(1.0).alias("similarity"))
    ranked = Window.partitionBy(key).orderBy(F.desc("similarity"), "neighbour")
    return asked.unionByName(within).withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)


def _cut_again(vectors: DataFrame, router: Router, key: str, kind: str, dim: int, probes: int, fine: int, count: int) -> DataFrame:
    """Route vectors over the parts of each part: part, block (the part's part), own, key, vec.

    A router for each part is learned from at most SAMPLE of its vectors; those routers stay a table and meet the vectors
    of their part, which are spread over as many tasks as the part's share of the sample asks for.
    """
    spread = np.maximum(1, np.ceil(router.share * count * probes / BLOCK)).astype(int)
    shares = np.minimum(1.0, SAMPLE / np.maximum(1.0, router.share * count))
    sent = vectors.sparkSession.sparkContext.broadcast((router, spread, shares))

    def coarse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        router, spread, shares = sent.value
        rng = np.random.default_rng(0)
        for batch in batches:
            top = router.route(unpack(batch.column(1), dim), probes) if batch.num_rows else np.empty((0, 1), np.int64)
            part, at = top.ravel(), np.repeat(np.arange(len(top)), top.shape[1])
            own = np.tile(np.arange(top.shape[1]) == 0, len(top))
            chosen = own & (rng.random(len(part)) < shares[part])
            taken = batch.take(pa.array(at))
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(at % spread[part], pa.int32()), pa.array(own), pa.array(chosen), *taken.columns], names=["part", "s", "own", "chosen", key, "vec"])

    rows = cut_lineage(vectors.mapInArrow(coarse, f"part int, s int, own boolean, chosen boolean, `{key}` {kind}, vec binary"))

    def learn(group: pa.Table) -> pa.Table:
        x = unpack(group.column("vec"), dim)[: 2 * SAMPLE]
        made = Router(x, max(1, min(fine, len(x) // LEAST_SAMPLE)))
        return pa.table({"part": group.column("part").slice(0, 1), "router": pa.array([pickle.dumps(made)], pa.binary())})

    routers = rows.where("chosen").select("part", "vec").groupBy("part").applyInArrow(learn, "part int, router binary")
    copies = F.element_at(F.array(*[F.lit(int(n)) for n in spread]), F.col("part") + 1)
    routers = cut_lineage(routers).withColumn("s", F.explode(F.sequence(F.lit(0), copies - 1)))

    def place(group: pa.Table, routers: pa.Table) -> pa.Table:
        made = pickle.loads(routers.column("router")[0].as_py()) if routers.num_rows else None
        top = made.route(unpack(group.column("vec"), dim), probes) if made and group.num_rows else np.zeros((group.num_rows, 1), np.int64)
        taken = group.take(pa.array(np.repeat(np.arange(len(top)), top.shape[1])))
        first = np.tile(np.arange(top.shape[1]) == 0, len(top))
        own = taken.column("own").to_numpy(zero_copy_only=False).astype(bool) & first
        return pa.table({"part": taken.column("part"), "block": pa.array(top.ravel(), pa.int32()), "own": pa.array(own), key: taken.column(key), "vec": taken.column("vec")})

    return rows.drop("chosen").groupBy("part", "s").cogroup(routers.groupBy("part", "s")).applyInArrow(place, f"part int, block int, own boolean, `{key}` {kind}, vec binary")
