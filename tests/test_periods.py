import random

import pytest
from pyspark.sql import functions as F

from cutloom.common import latest, whole_ms
from cutloom.operators.periods import covered_periods


def brute(rows):
    out, by = set(), {}
    for e, s, t in rows:
        if e is not None and s is not None and t is not None and t > s:
            by.setdefault(e, []).append((s, t))
    for e, spans in by.items():
        merged = []
        for s, t in sorted(spans):
            if merged and s <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], t)
                merged[-1][2] += 1
            else:
                merged.append([s, t, 1])
        out |= {(e, "period", s, t, n) for s, t, n in merged}
        out |= {(e, "gap", a[1], b[0], None) for a, b in zip(merged, merged[1:])}
    return out


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_against_brute_force(spark, seed):
    rnd = random.Random(seed)
    rows = [(rnd.choice(["a", "b", "hot", "hot", "hot"]), s := rnd.randrange(0, 3000), s + rnd.choice([-1, 0, 1, 5, 20, 700])) for _ in range(400)]
    rows += [(None, 1, 2), ("a", None, 4), ("a", 4, None), ("b", 10, 11), ("b", 10, 11)]
    df = spark.createDataFrame(rows, "k string, s bigint, t bigint").withColumn("n", F.lit("clash")).withColumn("kind", F.lit(1))
    got = {tuple(r) for r in covered_periods(df, "k", "s", "t", shard_ms=100).collect()}
    assert got == brute(rows)


def test_long_interval_covers_empty_shards(spark):
    df = spark.createDataFrame([("a", 0, 10_000), ("a", 450, 460), ("a", 9_990, 9_995), ("a", 10_001, 10_002)], "k string, s bigint, t bigint")
    got = {tuple(r) for r in covered_periods(df, "k", "s", "t", shard_ms=100).collect()}
    assert got == {("a", "period", 0, 10_000, 3), ("a", "period", 10_001, 10_002, 1), ("a", "gap", 10_000, 10_001, None)}


def test_empty(spark):
    assert covered_periods(spark.createDataFrame([], "k string, s bigint, t bigint"), "k", "s", "t").collect() == []


def test_latest_keeps_the_greatest_version(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("a", 2, "y"), (None, 3, "z"), ("b", None, "w")], "k string, v int, c string")
    assert sorted(tuple(r) for r in latest(df, "k", "v", ["c"]).collect()) == [("a", "y"), ("b", "w")]


def test_whole_ms(spark):
    df = spark.createDataFrame([(1.0005,), (float("nan"),), (None,), (196.41997999999998,)], "x double")
    assert [r[0] for r in df.select(whole_ms("x")).collect()] == [1001, None, None, 196420]
