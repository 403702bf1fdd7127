"""Evaluation texts leaking into training text: prefix-filtered set join with exact verification."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cutloom.llm.normal import words

#: Words of a shingle; least words of a passage; a passage may have one edit in so many words.
SHINGLE, PASSAGE, EDIT_EVERY = 5, 20, 8
#: Most item words that are sent to every task; more items are joined in several passes over the corpus.
BROADCAST_WORDS = 2_000_000
#: Characters that count as one more word in that size, for texts without blanks.
LONG_WORD = 64


class Items:
    """The items' shingles, sorted, with the places where they stand."""

    def __init__(self, texts: list[tuple[int, str | None]]) -> None:
        self.keys = [i for i, _ in texts]
        found = [words(t) for _, t in texts]
        self.vocabulary = {w: n + 1 for n, w in enumerate(sorted({w for x in found for w in x}))}
        self.words = [np.array([self.vocabulary[w] for w in x], np.int64) for x in found]
        places = defaultdict(list)
        for i, x in enumerate(self.words):
            for p, h in enumerate(shingles(x).tolist()):
                places[h].append((i, p))
        self.hashes = np.array(sorted(places), np.uint64)
        self.places = [places[h] for h in self.hashes.tolist()]
        self.needed = np.ones(len(self.hashes), bool)
        self.own: list[dict[int, list[int]]] = [{} for _ in self.keys]
        for k, where in enumerate(self.places):
            for i, p in where:
                self.own[i].setdefault(k, []).append(p)

    def coded(self, text: str | None) -> np.ndarray:
        """The words as numbers of the items' vocabulary; 0 for other words."""
        get = self.vocabulary.get
        return np.array([get(w, 0) for w in words(text)], np.int64)

    def hits(self, coded: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in the text, and numbers of the shingles that stand there."""
        h = shingles(coded)
        at = np.searchsorted(self.hashes, h)
        at[at == len(self.hashes)] = 0
        ok = np.nonzero((self.hashes[at] == h) & (h != 0))[0] if len(self.hashes) and len(h) else np.empty(0, np.int64)
        return ok, at[ok]

    def keep_prefixes(self, frequency: np.ndarray) -> None:
        """Mark the shingles that a passage can't do without.

        A passage of L words with L // 8 edits keeps at least L - 4 - 5 (L // 8) of its L - 4 shingles, so one of its
        5 (L // 8) + 1 rarest ones stands in the text.
        """
        self.needed[:] = False
        order = np.argsort(np.argsort(frequency, kind="stable"), kind="stable")
        for x in self.words:
            own = np.searchsorted(self.hashes, shingles(x))
            for length in (PASSAGE, *range(-(-PASSAGE // EDIT_EVERY) * EDIT_EVERY, len(x) + 1, EDIT_EVERY)):
                prefix = SHINGLE * (length // EDIT_EVERY) + 1
                for s in range(len(x) - length + 1):
                    window = np.unique(own[s : s + length - SHINGLE + 1])
                    self.needed[window[np.argsort(order[window])[:prefix]]] = True


def shingles(coded: np.ndarray) -> np.ndarray:
    """A number for each run of SHINGLE words; 0 where one of them is no word of the items."""
    n = len(coded) - SHINGLE + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    code = coded.astype(np.uint64)
    h, known = np.zeros(n, np.uint64), np.ones(n, bool)
    for k in range(SHINGLE):
        h = (h + code[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        known &= coded[k : k + n] > 0
    return np.where(known, h | np.uint64(1), np.uint64(0))


def holds_passage(item: np.ndarray, text: np.ndarray) -> bool:
    """Whether some run of at least PASSAGE item words stands in the text with at most one edit in EDIT_EVERY words.

    One row per start in the item; step by step one more item word is taken; a cell holds the fewest edits that bring
    the words so far to the text's words up to there, from wherever they begin.
    """
    n, m = len(item), len(text)
    if n < PASSAGE:
        return False
    same = item[:, None] == text[None, :]
    column = np.arange(m + 1, dtype=np.int32)
    cost = np.zeros((n, m + 1), np.int32)
    starts = np.arange(n)
    for length in range(1, n + 1):
        rows = n - length + 1
        starts, cost = starts[:rows], cost[:rows]
        step = cost + 1
        np.minimum(step[:, 1:], cost[:, :-1] + ~same[starts + length - 1], out=step[:, 1:])
        cost = np.minimum.accumulate(step - column, axis=1) + column
        if length >= PASSAGE and EDIT_EVERY * int(cost.min()) <= length:
            return True
    return False


def leaked(items: Items, text: str | None) -> list[int]:
    """The numbers of the items of which the text holds a passage."""
    coded = items.coded(text)
    at, which = items.hits(coded)
    if not len(at) or not items.needed[which].any():
        return []
    held = list(zip(at.tolist(), which.tolist()))
    necessary = {i for k in set(which[items.needed[which]].tolist()) for i, _ in items.places[k]}
    out = []
    for i in sorted(necessary):
        item, own = items.words[i], items.own[i]
        pairs = [(p, q) for p, k in held if k in own for q in own[k]]
        reach = len(item) + len(item) // EDIT_EVERY
        groups = [[pairs[0]]]
        for x in pairs[1:]:
            if x[0] - groups[-1][-1][0] > reach:
                groups.append([])
            groups[-1].append(x)
        for g in groups:
            if len({q for _, q in g}) < SHINGLE:
                continue
            if _straight(g) or holds_passage(item, coded[max(0, g[0][0] - reach) : g[-1][0] + reach]):
                out.append(i)
                break
    return out


def _straight(pairs: list[tuple[int, int]]) -> bool:
    """Whether the hits hold PASSAGE words without any edit."""
    run: dict[int, tuple[int, int]] = {}
    for p, q in pairs:
        last, n = run.get(p - q, (-2, 0))
        n = n + 1 if p == last + 1 else 1
        if n >= PASSAGE - SHINGLE + 1:
            return True
        run[p - q] = (p, n)
    return False


def leaks(docs: DataFrame, items: DataFrame, doc_key: str = "doc_id", item_key: str = "item_id", text: str = "text") -> DataFrame:
    """Pairs of a document and an item of which it holds a passage: doc_key, item_key; each pair once per row of docs.

    Case, punctuation, accents, white space, invisible characters, markup and subtitle cues don't matter. Null and empty
    texts and items shorter than a passage give no pair. Documents aren't shuffled: the items' shingles go to every task,
    in as many parts as their size needs (a part has at most BROADCAST_WORDS words), and each part passes over all
    documents twice, once to count how many documents hold each shingle and once to join on the rarest necessary ones.
    """
    spark = docs.sparkSession
    rows = items.select(item_key, text).where(F.col(item_key).isNotNull() & F.col(text).isNotNull()).distinct()
    total = rows.agg(F.sum(F.regexp_count(text, F.lit(r"[\p{L}\p{N}]+")) + F.length(text) / LONG_WORD)).first()[0] or 0
    parts = int(-(-total // BROADCAST_WORDS)) or 1
    source = docs.select(doc_key, text).where(F.col(doc_key).isNotNull() & F.col(text).isNotNull())
    schema, found = f"`{doc_key}` {dict(docs.dtypes)[doc_key]}, `{item_key}` {dict(items.dtypes)[item_key]}", None
    for part in range(parts):
        own = rows.where(F.pmod(F.xxhash64(item_key), F.lit(parts)) == part) if parts > 1 else rows
        index = Items([(r[0], r[1]) for r in own.orderBy(item_key).collect()])
        sent = spark.sparkContext.broadcast(index)

        def count(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            total = np.zeros(len(sent.value.hashes), np.int64)
            for batch in batches:
                for t in batch.column(0).to_pylist():
                    total[np.unique(sent.value.hits(sent.value.coded(t))[1])] += 1
            seen = np.nonzero(total)[0]
            yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["shingle", "n"])

        frequency = np.zeros(len(index.hashes), np.int64)
        for r in source.select(text).mapInArrow(count, "shingle bigint, n bigint").groupBy("shingle").agg(F.sum("n").alias("n")).collect():
            frequency[r[0]] = r[1]
        index.keep_prefixes(frequency)
        ready = spark.sparkContext.broadcast(index)

        def join(batches: Iterator[pa.RecordBatch], ready=ready) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                pairs = [(d, i) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for i in leaked(ready.value, t)]
                types = batch.schema.types[0], pa.int64() if not ready.value.keys or isinstance(ready.value.keys[0], int) else pa.string()
                yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in pairs], types[0]), pa.array([ready.value.keys[i] for _, i in pairs], types[1])], names=[doc_key, item_key])

        pairs = source.mapInArrow(join, schema)
        found = pairs if found is None else found.unionByName(pairs)
    return found
