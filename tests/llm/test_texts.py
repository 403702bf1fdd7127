import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from cutloom.llm import leaks as lk
from cutloom.llm import subjects
from cutloom.llm.normal import sentences, words
from cutloom.llm.subjects import GROUPS, area_of_label, grown_patterns, subject_areas
from cutloom.llm.tokens import VOCABULARY, ChunkEncoder, encode_corpus, encoder


def test_words():
    assert words("1\n00:00:01,000 --> 00:00:02,000\nHé<b>l</b>lo&nbsp;wo­rld​!") == ["he", "l", "lo", "world"]
    assert words(None) == [] and words("  ﻿ ") == []
    assert sentences('{"id": 1, "text": "One two three. Four five \\"six\\" seven."}') == [["one", "two", "three"], ["four", "five", "six", "seven"]]


def test_ids_are_exact(spark):
    rnd = random.Random(1)
    letters = list("ab é'sß \n\t\r ​\x1c\x85 12.,!—'llre 　\U0001f600 ")
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randrange(0, 2000))) for _ in range(150)] + [None, "", "   ", "\n", "x" * 20_000, "<|endoftext|>", "the same passage of words " * 900]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumn("ids", F.lit("clash"))
    encode = encoder(VOCABULARY).encode_ordinary
    got = {r.doc_id: list(r.ids) for r in encode_corpus(df).collect()}
    assert got == {i: encode(t) if t else [] for i, t in enumerate(texts)}
    assert encode_corpus(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []


def test_shared_passages_are_encoded_once():
    rnd = random.Random(2)
    passage = " ".join("".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(2, 9))) for _ in range(600))
    coder = ChunkEncoder(VOCABULARY)
    for n in range(20):
        coder.ids(f"Own beginning {n} {rnd.random()} " + passage + f" own end {n}")
    assert coder.reused > 5 * coder.encoded


def brute_edits(item, text):
    """Least edits over all runs of at least 20 item words and all runs of text words, by plain dynamic programming."""
    for s in range(len(item) - 19):
        row = [0] * (len(text) + 1)
        for n, w in enumerate(item[s:], 1):
            new = [row[0] + 1]
            for j, t in enumerate(text, 1):
                new.append(min(row[j - 1] + (w != t), row[j] + 1, new[j - 1] + 1))
            row = new
            if n >= 20 and 8 * min(row) <= n:
                return True
    return False


def test_leaks_against_brute_force(spark):
    rnd = random.Random(3)
    vocabulary = [f"w{i}" for i in range(150)]
    items = [(i, " ".join(rnd.choice(vocabulary) for _ in range(rnd.randrange(15, 45)))) for i in range(8)]
    docs = []
    for d in range(160):
        item = items[rnd.randrange(8)][1].split()
        n = rnd.choice([8, 15, 19, 20, 21, 24, 30, 40])
        s = rnd.randrange(0, max(1, len(item) - n + 1))
        part = item[s : s + n]
        for _ in range(rnd.choice([0, 0, 1, 2, 3, 4])):
            at = rnd.randrange(len(part))
            part[at : at + 1] = rnd.choice([[], ["zz"], [part[at], "yy"]])
        if rnd.random() < 0.1:
            rnd.shuffle(part)
        before, after = ([rnd.choice(vocabulary) for _ in range(rnd.randrange(0, 25))] for _ in range(2))
        docs.append((d, " ".join(before) + " " + ", ".join(part).upper() + ". " + " ".join(after)))
    docs += [(900, None), (901, ""), (902, docs[0][1]), (903, items[0][1] * 60)]
    items += [(90, None), (91, ""), (92, "too short to leak")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("item_id", F.lit("clash"))
    got = {(r.doc_id, r.item_id) for r in lk.leaks(df, spark.createDataFrame(items, "item_id bigint, text string")).collect()}
    want = {(d, i) for d, t in docs if t and d != 903 for i, x in items if x and brute_edits(words(x), words(t))}
    assert got - {(903, 0)} == want and 20 < len(want) and ((903, 0) in got) == (len(items[0][1].split()) >= 20)
    assert lk.leaks(df.limit(0), spark.createDataFrame(items, "item_id bigint, text string")).collect() == []
    assert lk.leaks(df, spark.createDataFrame([], "item_id bigint, text string")).collect() == []


def test_items_in_several_parts(spark, monkeypatch):
    rnd = random.Random(4)
    items = [(i, " ".join(f"x{i}y{rnd.randrange(999)}" for _ in range(25))) for i in range(20)]
    docs = spark.createDataFrame([(i, t) for i, t in items], "doc_id bigint, text string")
    monkeypatch.setattr(lk, "BROADCAST_WORDS", 130)
    got = {(r.doc_id, r.item_id) for r in lk.leaks(docs, spark.createDataFrame(items, "item_id bigint, text string")).collect()}
    assert got == {(i, i) for i in range(20)}


AREAS = {"law": "judge court verdict bail appeal juror statute record", "sport": "goal referee match coach trophy hurdles serve record", "music": "choir melody tempo drummer cello chorus note record"}


def corpus(n, seed):
    rnd = random.Random(seed)
    filler = "camera lamp window street chair table river bridge door wall".split()
    docs, truth = [], {}
    for d in range(n):
        main = rnd.sample(sorted(AREAS), rnd.choice([0, 1, 1, 1, 2]))
        out = []
        for _ in range(16):
            if main and rnd.random() < 0.75:
                a, b = rnd.sample(AREAS[rnd.choice(main)].split(), 2)
                out.append(f"We see the {a} and then the {b} at once.")
            else:
                a, b = rnd.sample(filler, 2)
                out.append(f"We see the {a} and then the {b} at once.")
        if not main or rnd.random() < 0.3:
            other = rnd.choice(sorted(AREAS))
            out[3] = f"They talk about the {AREAS[other].split()[0]} for once."
        docs.append((d, " ".join(out)))
        truth[d] = main
    return docs, truth


def test_held_out_accuracy(spark):
    docs, truth = corpus(500, 7)
    rnd = random.Random(8)
    labels = [(d, (rnd.choice(truth[d]) if truth[d] else "none") if rnd.random() > 0.05 else "music", 1) for d in range(120)]
    labels = [(d, rnd.choice([a, a.upper(), f" {a}", a[:4] + ".", a + "s"]), x) for d, a, x in labels] + labels[:10] + [(None, "law", 1), (5000, "law", 1), (3, None, 1)]
    df = spark.createDataFrame(docs + [(600, None), (601, ""), (602, "!")], "doc_id bigint, text string").withColumn("area", F.lit("clash"))
    named = spark.createDataFrame(labels, "doc_id bigint, label string, x int").select("doc_id", area_of_label(F.col("label"), sorted(AREAS)).alias("area"))
    got = {(r.doc_id, r.area_code) for r in subject_areas(df, named).collect()}
    want = {(d, a) for d, m in truth.items() for a in m if d >= 120}
    found = {x for x in got if x[0] >= 120}
    assert len(found & want) >= 0.95 * len(want) and len(found & want) >= 0.95 * len(found)


def test_rules_are_mined_from_all_documents(spark, monkeypatch):
    """No bound of documents, and no bound of what a task holds, has a part in the rules."""
    docs, truth = corpus(300, 9)
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    named = spark.createDataFrame([(d, a) for d in range(120) for a in truth[d] or [None]], "doc_id bigint, area string")
    table = lambda r: {t: {a: round(p, 9) for a, p in x.items()} for t, x in zip([*r.terms, *[(r.terms[a], r.terms[b]) for a, b in r.pairs]], r.sure)}
    whole = table(subjects.mine_rules(df, named))
    for name, value in (("LABELLED", 30), ("HELD_TERMS", 20), ("HELD_BAGS", 10)):
        monkeypatch.setattr(subjects, name, value, raising=False)
    assert len(whole) > 20 and table(subjects.mine_rules(df, named)) == whole


@pytest.mark.parametrize("labels", [[], [(1, None)]])
def test_no_labels_give_no_areas(spark, labels):
    df = spark.createDataFrame([(1, "One two three four.")], "doc_id bigint, text string")
    assert subject_areas(df, spark.createDataFrame(labels, "doc_id bigint, area string")).collect() == []


def test_patterns_against_counting():
    rnd = random.Random(5)
    bags = [sorted(rnd.sample(range(60), rnd.randrange(1, 20))) for _ in range(300)]
    counts = np.array([[rnd.randrange(3), rnd.randrange(2)] for _ in bags], float)
    want = {}
    for bag, k in zip(bags, counts):
        for x in [(i, -1) for i in bag] + [(b, a) for a, b in combinations(bag, 2)]:
            want[x] = want.get(x, 0) + k
    got = {}
    for g in range(GROUPS):
        own = [(bag[: max(n for n, i in enumerate(bag) if i % GROUPS == g) + 1], k) for bag, k in zip(bags, counts) if any(i % GROUPS == g for i in bag)]
        if own:
            a, b, k = grown_patterns(np.concatenate([x for x, _ in own]), np.array([len(x) for x, _ in own]), np.array([k for _, k in own]), g, 2)
            got |= {(i, j): x for i, j, x in zip(a.tolist(), b.tolist(), k)}
    assert set(got) == {x for x, k in want.items() if k.sum() >= 2} and all((got[x] == want[x]).all() for x in got)


def test_labels(spark):
    rows = [("Musics", "music"), (" LAW.", "law"), ("musi.", "music"), ("nones", None), ("none", None), ("", None), ("spotr", None), ("spor", "sport"), ("sprt", "sport")]
    df = spark.createDataFrame(rows, "l string, want string")
    assert all(r.want == r.got for r in df.select("want", area_of_label(F.col("l"), sorted(AREAS)).alias("got")).collect())
