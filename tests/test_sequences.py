import random

from pyspark.sql import functions as F

from cutloom.operators import overlap, sequences


def test_overlap_join_against_brute_force(spark):
    rnd = random.Random(5)
    a = [(f"a{i}", rnd.choice("xy"), s := rnd.randrange(500), s + rnd.randrange(0, 80)) for i in range(120)] + [("an", "x", None, 5)]
    b = [(f"b{i}", rnd.choice("xy"), s := rnd.randrange(500), s + rnd.randrange(0, 80)) for i in range(120)]
    left = spark.createDataFrame(a, "i string, k string, s bigint, e bigint")
    right = spark.createDataFrame(b, "j string, k string, t bigint, f bigint")
    got = {(r.i, r.j, r.overlap) for r in overlap.overlap_join(left, right, ["k"], ("s", "e"), ("t", "f"), bucket=17).collect()}
    want = {(x[0], y[0], min(x[3], y[3]) - max(x[2], y[2])) for x in a for y in b if x[1] == y[1] and x[2] is not None and min(x[3], y[3]) > max(x[2], y[2]) and x[3] > x[2] and y[3] > y[2]}
    assert got == want


def fold(words, gap):
    groups, cur = [], None
    for s, e, who in words:
        if cur is None or s - cur[1] > gap or (who and cur[2] and who != cur[2]):
            groups.append(cur := [s, e, who, 1])
        else:
            cur[1], cur[2], cur[3] = e, cur[2] or who, cur[3] + 1
    return [tuple(g) for g in groups]


def test_sessions_with_blank_speakers_against_fold(spark):
    rnd = random.Random(9)
    rows, want = [], {}
    for k in range(20):
        t, words = 0, []
        for i in range(40):
            t += rnd.randrange(1, 12)
            words.append((t, t + rnd.randrange(1, 6), rnd.choice(["", "", "A", "B", "A"])))
        want[k] = fold(words, 4)
        rows += [(k, i, s, e, "w", who, "", False) for i, (s, e, who) in enumerate(words)]
    df = spark.createDataFrame(rows, "k int, pos int, start bigint, end bigint, text string, speaker string, transcription_source string, review_required boolean")
    got = {}
    for r in sequences.group_words(df, ["k"], 4).orderBy("k", "group_no").collect():
        got.setdefault(r.k, []).append((r.start, r.end, r.speaker, r.n_words))
    assert got == want


def test_islands_close_one_hop_early(spark):
    levels = [0, -90, -90, 0, -90, -90, -90, 0, 0]
    df = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(levels)], "k int, i bigint, level double")
    got = sorted((r.first, r.end) for r in sequences.level_islands(df, ["k"], -45.0, 2, 1).collect())
    assert got == [(0, 4), (7, 9)] or got == [(0, 1), (3, 4), (7, 9)]
    # a silence of two hops between loud ones leaves (i - 1) - (prev + 1) = 1 < 2: still one island
    assert got == [(0, 4), (7, 9)]


def test_kept_cuts(spark):
    def rule(cuts, total, gap):
        kept = []
        for f in sorted(set(cuts)):
            if 0 < f < total and f - (kept[-1] if kept else 0) >= gap:
                kept.append(f)
        if kept and total - kept[-1] < gap:
            kept.pop()
        return [0, *kept, total]

    rnd = random.Random(2)
    rows = [([rnd.randrange(-5, 110) for _ in range(rnd.randrange(0, 20))], rnd.randrange(20, 100), rnd.randrange(1, 20)) for _ in range(60)]
    df = spark.createDataFrame(rows, "f array<bigint>, total bigint, gap bigint")
    for r, e in zip(rows, df.select(sequences.kept_cuts(F.col("f"), F.col("total"), F.col("gap")).alias("e")).collect()):
        assert e.e == rule(*r)


def test_lanes_first_fit(spark):
    rnd = random.Random(4)
    clips = [(s := rnd.randrange(50), s + rnd.randrange(1, 15), f"c{i:02d}") for i in range(40)]
    ends, want = [], {}
    for s, e, c in sorted(clips):
        lane = next((i for i, x in enumerate(ends) if s >= x), len(ends))
        ends[lane : lane + 1] = [e]
        want[c] = lane
    df = spark.createDataFrame([(1, *c) for c in clips], "k int, start_frame bigint, end_frame bigint, clip string")
    assert {r.clip: r.lane for r in sequences.assign_lanes(df, ["k"]).collect()} == want


def test_scene_for_a_moment_in_a_gap_is_the_last_scene(spark):
    scenes = spark.createDataFrame([("r", "001", 10, 20), ("r", "002", 30, 40)], "k string, scene_id string, scene_start bigint, scene_end bigint")
    moments = spark.createDataFrame([("r", 5), ("r", 12), ("r", 25), ("r", 39), ("r", 50)], "k string, t bigint")
    got = {r.t: r.scene_id for r in overlap.scene_for_time(moments, scenes, ["k"], "t").collect()}
    assert got == {5: "001", 12: "001", 25: "002", 39: "002", 50: "002"}
