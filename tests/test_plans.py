"""Registered queries over whole tables: no share of the rows is left out."""

import datetime as dt
import random

import duckdb
import numpy as np
import pytest

from cutloom.operators import statistics
from cutloom.plans import media, signals


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """A folder with small orders and events, some words beyond the last frame."""
    rnd, d = random.Random(5), str(tmp_path_factory.mktemp("tables"))
    orders = [(k, rnd.randrange(60), rnd.uniform(1, 100)) for k in range(1, 201)]
    spark.createDataFrame(orders, "o_orderkey bigint, o_custkey bigint, o_totalprice double").write.parquet(f"{d}/orders.parquet")
    start = dt.datetime(2024, 1, 1)
    events = [(i, start + dt.timedelta(seconds=rnd.randrange(10_000)), rnd.randrange(50), rnd.choice(["a", "b", "c"]), rnd.uniform(0, 200)) for i in range(2_000)]
    spark.createDataFrame(events, "event_id bigint, ts timestamp, user_id bigint, event_type string, value double").write.parquet(f"{d}/events.parquet")
    return d


def sql_rows(d, sql, *names):
    con = duckdb.connect()
    for name in names:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{d}/{name}.parquet/*.parquet')")
    return sorted(con.sql(sql).fetchall())


def expected(orders, events):
    """Per word, in plain Python: the levels of each source over the frames it touches."""
    series = {}
    for r in sorted(events, key=lambda r: (r.ts, r.event_id)):
        series.setdefault(r.user_id % 5, {}).setdefault(r.event_type, []).append(round(r.value % 60 - 60, 6))
    for r in orders:
        s = r.o_custkey % 300 * 1.5
        first, last = int(s / 0.5), max(int(s / 0.5) + 1, -int(-(s + 1 + r.o_orderkey % 4) / 0.5 // 1))
        yield r.o_orderkey, {k: x[first:last] for k, x in series.get(r.o_orderkey % 5, {}).items() if x[first:last]}


def test_every_word_meets_the_frames(spark, tables):
    orders, events = (spark.read.parquet(f"{tables}/{n}.parquet").collect() for n in ("orders", "events"))
    want = dict(expected(orders, events))
    means = {r.k: r.level for r in media.line_frame_means(spark, tables).collect()}
    assert set(means) == {k for k, x in want.items() if x} and 100 < len(means) < 200
    for k, level in means.items():
        flat = [v for x in want[k].values() for v in x]
        assert abs(level - sum(flat) / len(flat)) < 2e-6

    def high(x):
        x, at = sorted(x), 0.9 * (len(x) - 1)
        return x[int(at)] + (at - int(at)) * (x[min(int(at) + 1, len(x) - 1)] - x[int(at)])

    got = {r.k: (r.source, r.level) for r in media.stem_activity(spark, tables).collect()}
    assert set(got) == set(want) == {r.o_orderkey for r in orders}
    for k, x in want.items():
        best = sorted(((-high(v), s) for s, v in x.items()))
        clear = best and -best[0][0] >= -50 and (len(best) == 1 or best[1][0] - best[0][0] >= 1)
        assert got[k][0] == (best[0][1] if clear else None) and (not clear or abs(got[k][1] + best[0][0]) < 1e-3)


@pytest.mark.parametrize("name", ["stem_activity", "line_frame_means"])
def test_words_agree_with_the_sql(spark, tables, name):
    """All rows, means and levels to the last rounded place but one."""
    sql = sql_rows(tables, media.ORACLE[name], "orders", "events")
    got = sorted(tuple(r) for r in media.QUERIES[name](spark, tables).collect())
    assert sql and len(got) == len(sql)
    for a, b in zip(got, sql):
        assert a[:-1] == b[:-1] and (a[-1] == b[-1] or abs(a[-1] - b[-1]) < 2e-6)


def outliers(rows):
    """Scores of (key, speaker, values) by plain leave-one-out medians."""
    out = {}
    for i, (k, s, xs) in enumerate(rows):
        peers = [r for j, r in enumerate(rows) if j != i and r[1] == s] if (s or "").strip() else []
        peers = peers if len(peers) >= 2 else [r for j, r in enumerate(rows) if j != i]
        terms = []
        for n, x in enumerate(xs):
            p = np.array([r[2][n] for r in peers if r[2][n] is not None])
            if x is not None and len(p) >= 2 and (scale := 1.4826 * np.median(np.abs(p - np.median(p)))) > 1e-6:
                terms.append(((x - np.median(p)) / scale) ** 2)
        score = float(np.sqrt(np.mean(terms))) if terms else 0.0
        if score >= 3.5:
            out[k] = score
    return out


def test_outliers_of_all_speakers(spark, tables):
    orders = spark.read.parquet(f"{tables}/orders.parquet").collect()
    want = outliers([(r.o_orderkey, str(r.o_custkey), [r.o_totalprice]) for r in orders])
    got = {r.k: r.score for r in signals.outliers(spark, tables).collect()}
    assert set(got) == set(want) and len(want) > 20 and all(abs(got[k] - v) <= 1e-6 + 1e-9 * v for k, v in want.items())
    sql = {r[0] for r in sql_rows(tables, signals.ORACLE["line_outliers_mad"], "orders")}
    assert sql == set(got)


def test_outliers_with_ties_and_without_peers(spark):
    rnd = random.Random(3)
    rows = [(f"k{i}", rnd.choice(["a", "b", "c", None, " "]), [float(rnd.choice([0, 1, 1, 2, 3, 40])), rnd.choice([None, rnd.gauss(0, 1)])]) for i in range(150)]
    rows += [("lone", "x", [99.0, 9.0]), ("p1", "y", [1.0, 0.0]), ("p2", "y", [-60.0, 0.0])] + [(f"h{i}", "huge", [rnd.gauss(0, 1) ** 3, float(i % 2)]) for i in range(300)]
    df = spark.createDataFrame([(k, s, *x) for k, s, x in rows], "k string, s string, x double, y double")
    want = outliers(rows)
    got = {r.k: r.score for r in statistics.line_outliers(df, "k", "s", ["x", "y"]).collect()}
    assert {"lone", "p2"} <= set(got) == set(want) and all(abs(got[k] - v) <= 1e-6 + 1e-9 * v for k, v in want.items())
