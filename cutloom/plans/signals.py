"""Queries on level series, vectors, powers and texts: events, embeddings, lineitem, documents, orders and names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cutloom.common import latest, table
from cutloom.functions import levels as lv
from cutloom.functions import names as nm
from cutloom.functions import timecode as tc
from cutloom.functions.vectors import dot, norm, unit
from cutloom.operators import activity as ac
from cutloom.operators import identity as idn
from cutloom.operators import sequences as sq
from cutloom.operators import statistics as st

QUERIES: dict = {}
ORACLE: dict = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return keep


# ---- level series: the events of a user are the hops of a source -------------------------------------------------

HOPS = "hp AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 i, value, round(value % 60 - 60, 6) level FROM events)"


def _hops(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, d, "events").select("user_id", (F.row_number().over(w) - 1).cast("bigint").alias("i"), "value", F.round(F.col("value") % 60 - 60, 6).alias("level"))


@query(
    "islands",
    f"""WITH {HOPS}, l AS (SELECT *, lag(i) OVER (PARTITION BY user_id ORDER BY i) p FROM hp WHERE level > -45),
    g AS (SELECT *, sum(CASE WHEN p IS NULL OR (i - 1) - (p + 1) >= 3 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY i ROWS UNBOUNDED PRECEDING) n FROM l)
    SELECT user_id, min(i) "first", max(i) + 1 "end" FROM g GROUP BY user_id, n HAVING max(i) + 1 - min(i) >= 2""",
)
def islands(spark: SparkSession, d: str) -> DataFrame:
    return sq.level_islands(_hops(spark, d), ["user_id"], -45.0, 3, 2)


@query("activity_segments", f'WITH {HOPS}, l AS (SELECT *, i - row_number() OVER (PARTITION BY user_id ORDER BY i) g FROM hp WHERE level > -45) SELECT user_id, min(i) "start", max(i) + 1 "end" FROM l GROUP BY user_id, g')
def activity(spark: SparkSession, d: str) -> DataFrame:
    return sq.activity_segments(_hops(spark, d), ["user_id"], -45.0)


@query("rolling_loudness", f"WITH {HOPS} SELECT user_id, i, round(avg(level) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), 6) mean_level FROM hp")
def rolling(spark: SparkSession, d: str) -> DataFrame:
    return sq.rolling_mean(_hops(spark, d), ["user_id"], ["i"], "level", 4, "m").select("user_id", "i", F.round("m", 6).alias("mean_level"))


LUFS = lambda x: f"greatest(-120, -0.691 + 10 * log10(greatest({x}, 1e-12)))"


@query(
    "integrated_loudness",
    f"""WITH e AS (SELECT user_id, pow(10, (value % 60 - 60) / 10) x FROM events), l AS (SELECT *, {LUFS("x")} l FROM e), m AS (SELECT user_id, avg(x) m FROM l WHERE l >= -70 GROUP BY 1),
    k AS (SELECT l.user_id, avg(x) x FROM l JOIN m USING (user_id) WHERE l >= -70 AND l >= {LUFS("m")} - 10 GROUP BY 1) SELECT u.user_id, round(coalesce({LUFS("k.x")}, -120), 6) loudness FROM (SELECT DISTINCT user_id FROM e) u LEFT JOIN k USING (user_id)""",
)
def integrated(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("user_id", F.pow(F.lit(10.0), (F.col("value") % 60 - 60) / 10).alias("energy"))
    return st.integrated_loudness(rows, ["user_id"], "energy").select("user_id", F.round("loudness", 6).alias("loudness"))


@query(
    "loudness_range",
    f"""WITH e AS (SELECT user_id, pow(10, (value % 60 - 60) / 10) x FROM events), l AS (SELECT *, {LUFS("x")} l FROM e), m AS (SELECT user_id, avg(x) m FROM l WHERE l >= -70 GROUP BY 1),
    k AS (SELECT l.user_id, {LUFS("avg(x)")} i FROM l JOIN m USING (user_id) WHERE l >= -70 AND l >= {LUFS("m")} - 10 GROUP BY 1), r AS (SELECT user_id, quantile_cont(l, 0.95) - quantile_cont(l, 0.1) r, count(*) n FROM l JOIN k USING (user_id) WHERE l >= -70 AND l >= i - 20 GROUP BY 1)
    SELECT u.user_id, round(coalesce(CASE WHEN n >= 2 THEN r END, 0), 5) "range" FROM (SELECT DISTINCT user_id FROM e) u LEFT JOIN r USING (user_id)""",
)
def loudness_range(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("user_id", F.pow(F.lit(10.0), (F.col("value") % 60 - 60) / 10).alias("energy"))
    return st.loudness_range(rows, rows, ["user_id"], "energy").select("user_id", F.round("range", 5).alias("range"))


@query(
    "event_boundaries",
    f"""WITH {HOPS}, a AS (SELECT *, abs(level - coalesce(lag(level) OVER (PARTITION BY user_id ORDER BY i), level)) d FROM hp), m AS (SELECT user_id, median(value) fm, median(d) dm, count(*) n FROM a GROUP BY 1),
    s AS (SELECT a.user_id, median(abs(value - fm)) fs, median(abs(d - dm)) ds FROM a JOIN m USING (user_id) GROUP BY 1),
    h AS (SELECT a.user_id, i, value, d, fm + 4 * greatest(fs, 1e-4) fl, dm + 4 * greatest(ds, 0.5) dl FROM a JOIN m USING (user_id) JOIN s USING (user_id) WHERE n >= 2),
    k AS (SELECT *, i - row_number() OVER (PARTITION BY user_id ORDER BY i) g FROM h WHERE value > fl OR d > dl)
    SELECT user_id, i, round(greatest(value / greatest(fl, 1e-12), d / greatest(dl, 1e-12)), 6) strength FROM k QUALIFY (i - min(i) OVER (PARTITION BY user_id, g)) % 2 = 0""",
)
def boundaries(spark: SparkSession, d: str) -> DataFrame:
    return sq.event_boundaries(_hops(spark, d), ["user_id"], flux="value")


@query(
    "db_scalars",
    f"""SELECT event_id, round(greatest(-120, 10 * log10(greatest(value / 1000, 1e-12))), 6) power_db, round(greatest(-120, 20 * log10(greatest(value / 1000, 1e-6))), 6) amplitude_db, round({LUFS("value / 1000")}, 6) lufs,
    round(pow(10, (value - 60) / 20), 6) gain, CASE WHEN value > 0 THEN round(greatest(-120, 20 * log10(value)), 6) ELSE -120 END gain_db FROM events""",
)
def db_scalars(spark: SparkSession, d: str) -> DataFrame:
    x = F.col("value") / 1000
    return table(spark, d, "events").select(
        "event_id", F.round(lv.power_db(x), 6).alias("power_db"), F.round(lv.amplitude_db(x), 6).alias("amplitude_db"), F.round(lv.lufs(x), 6).alias("lufs"),
        F.round(lv.db_to_gain(F.col("value") - 60), 6).alias("gain"), F.round(lv.gain_to_db(F.col("value")), 6).alias("gain_db"),
    )


@query("tumbling_blocks", f"WITH {HOPS} SELECT user_id, i // 8 AS block, round(avg(level), 6) level, count(*) n FROM hp GROUP BY 1, 2")
def blocks(spark: SparkSession, d: str) -> DataFrame:
    return st.aggregate_rows(_hops(spark, d), ["user_id"], "i", "level", 8).select("user_id", "block", F.round("level", 6).alias("level"), "n")


@query(
    "smooth_labels",
    """WITH o AS (SELECT event_id, event_type, lag(event_type) OVER w b, lead(event_type) OVER w a FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
    SELECT event_id, CASE WHEN b = a AND b != event_type THEN b ELSE event_type END smooth_event_type FROM o""",
)
def smooth(spark: SparkSession, d: str) -> DataFrame:
    return sq.smooth_labels(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], "event_type").select("event_id", "smooth_event_type")


@query(
    "local_maxima",
    f"""WITH {HOPS}, o AS (SELECT user_id, i, level, lag(level) OVER w b, lead(level) OVER w a FROM hp WINDOW w AS (PARTITION BY user_id ORDER BY i)) SELECT user_id, i, level FROM o WHERE level >= -20 AND coalesce(b < level, true) AND coalesce(a <= level, true)""",
)
def maxima(spark: SparkSession, d: str) -> DataFrame:
    return sq.local_maxima(_hops(spark, d), ["user_id"], ["i"], "level", -20.0).select("user_id", "i", "level")


@query("active_share", f"WITH {HOPS} SELECT user_id, round(max(level), 6) peak, round(avg(CASE WHEN level > -45 THEN 1.0 ELSE 0.0 END), 6) voiced, round(quantile_cont(level, 0.9), 5) p90 FROM hp GROUP BY 1")
def active_share(spark: SparkSession, d: str) -> DataFrame:
    return _hops(spark, d).groupBy("user_id").agg(F.round(F.max("level"), 6).alias("peak"), F.round(F.avg((F.col("level") > -45).cast("double")), 6).alias("voiced"), F.round(F.expr("percentile(level, 0.9)"), 5).alias("p90"))


FRAMES = "fr AS (SELECT user_id, CAST(floor(epoch(ts)) AS BIGINT) % 5000 f FROM events), ft AS (SELECT user_id, 5000 - user_id % 7 total FROM fr GROUP BY 1)"


@query(
    "build_shots_fold",
    f"""WITH RECURSIVE {FRAMES}, o AS (SELECT user_id, f, total, row_number() OVER (PARTITION BY user_id ORDER BY f) n FROM (SELECT DISTINCT user_id, f, total FROM fr JOIN ft USING (user_id) WHERE f > 0 AND f < total)),
    w AS (SELECT user_id, total, CAST(0 AS BIGINT) n, CAST(0 AS BIGINT) a, false k FROM ft UNION ALL
      SELECT w.user_id, w.total, o.n, CASE WHEN o.f - w.a >= 360 THEN o.f ELSE w.a END, o.f - w.a >= 360 FROM w JOIN o ON o.user_id = w.user_id AND o.n = w.n + 1),
    c AS (SELECT user_id, a, total FROM w WHERE k), c2 AS (SELECT * FROM c WHERE NOT (a = (SELECT max(a) FROM c x WHERE x.user_id = c.user_id) AND total - a < 360)),
    e AS (SELECT user_id, CAST(0 AS BIGINT) f FROM ft UNION ALL SELECT user_id, a FROM c2 UNION ALL SELECT user_id, total FROM ft),
    r AS (SELECT user_id, f start_frame, lead(f) OVER (PARTITION BY user_id ORDER BY f) end_frame, row_number() OVER (PARTITION BY user_id ORDER BY f) n FROM e)
    SELECT user_id, lpad(CAST(n AS VARCHAR), 3, '0') shot_id, start_frame, end_frame FROM r WHERE end_frame IS NOT NULL""",
)
def build_shots(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).alias("t"))
    rows = rows.select("user_id", (F.floor("t") % 5000).cast("bigint").alias("f"))
    packed = rows.groupBy("user_id").agg(F.collect_set("f").alias("frames")).withColumn("total", F.lit(5000).cast("bigint") - F.col("user_id") % 7)
    packed = packed.withColumn("edges", sq.kept_cuts(F.col("frames"), F.col("total"), F.lit(360)))
    return sq.ranges_of_edges(packed, "edges", ["user_id"])


@query(
    "cut_points_to_ranges",
    f"""WITH {FRAMES}, e AS (SELECT DISTINCT * FROM (SELECT user_id, f FROM fr JOIN ft USING (user_id) WHERE f > 0 AND f < total UNION ALL SELECT user_id, 0 FROM ft UNION ALL SELECT user_id, total FROM ft)),
    r AS (SELECT user_id, f start_frame, lead(f) OVER w end_frame, row_number() OVER w n FROM e WINDOW w AS (PARTITION BY user_id ORDER BY f)) SELECT user_id, CAST(n AS INTEGER) n, start_frame, end_frame FROM r WHERE end_frame > start_frame""",
)
def cut_points(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("user_id", (F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000) % 5000).cast("bigint").alias("frame"))
    totals = rows.select("user_id").distinct().withColumn("total", F.lit(5000).cast("bigint") - F.col("user_id") % 7)
    return sq.ranges_of_cut_points(rows, totals, ["user_id"])


TC = "CAST(lpad(CAST(event_id % 24 AS VARCHAR), 2, '0') || ':' || lpad(CAST(event_id % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST((event_id * 7) % 60 AS VARCHAR), 2, '0') || '{s}' || lpad(CAST(2 + event_id % 22 AS VARCHAR), 2, '0') AS VARCHAR)"


@query(
    "smpte_roundtrip",
    f"""WITH t AS (SELECT event_id, {TC.format(s=":")} tc, ((event_id % 24) * 3600 + (event_id % 60) * 60 + (event_id * 7) % 60) * 24 + 2 + event_id % 22 f FROM events) SELECT event_id, tc, f frame, round(f / (24000 / 1001.0), 6) "seconds", tc back FROM t""",
)
def smpte_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    n = F.col("event_id")
    rows = table(spark, d, "events").select("event_id", F.concat(two(n % 24), F.lit(":"), two(n % 60), F.lit(":"), two((n * 7) % 60), F.lit(":"), two(2 + n % 22)).alias("tc"))
    rate = 24000 / 1001
    return rows.select("event_id", "tc", tc.smpte_to_frames(F.col("tc"), rate).alias("frame"), F.round(tc.smpte_to_seconds(F.col("tc"), rate), 6).alias("seconds"), tc.frames_to_smpte(tc.smpte_to_frames(F.col("tc"), rate), rate).alias("back"))


@query(
    "drop_frame",
    """WITH t AS (SELECT event_id, event_id * 977 % 2589408 f FROM events), u AS (SELECT *, f // 17982 t10, f % 17982 r FROM t), v AS (SELECT *, f + 18 * t10 + CASE WHEN r > 2 THEN 2 * ((r - 2) // 1798) ELSE 0 END n FROM u)
    SELECT event_id, lpad(CAST(n // 108000 AS VARCHAR), 2, '0') || ':' || lpad(CAST(n // 1800 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(n // 30 % 60 AS VARCHAR), 2, '0') || ';' || lpad(CAST(n % 30 AS VARCHAR), 2, '0') tc, f back FROM v""",
)
def drop_frame(spark: SparkSession, d: str) -> DataFrame:
    rate = 30000 / 1001
    rows = table(spark, d, "events").select("event_id", (F.col("event_id") * 977 % 2589408).alias("f"))
    rows = rows.withColumn("tc", tc.frames_to_smpte(F.col("f"), rate, True))
    return rows.select("event_id", "tc", tc.smpte_to_frames(F.col("tc"), rate).alias("back"))


# ---- vectors ----------------------------------------------------------------------------------------------------

NORMED = "nv AS (SELECT vec_id, label, embedding, sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) nrm FROM embeddings)"
CENTRES = f"""{NORMED}, lg AS (SELECT label, i, avg(CAST(embedding[i] AS DOUBLE) / CASE WHEN nrm = 0 THEN 1 ELSE nrm END) x, count(*) n FROM nv, generate_series(1, 64) t(i) GROUP BY 1, 2),
    c1 AS (SELECT label, list(x ORDER BY i) c, max(n) members FROM lg GROUP BY 1), ct AS (SELECT label, members, list_transform(c, lambda v: v / sqrt(list_inner_product(c, c))) c FROM c1)"""
SIMS = f"{CENTRES}, sm AS (SELECT vec_id, ct.label, round(list_inner_product(list_transform(embedding::DOUBLE[], lambda v: v / nrm), c), 12) s FROM nv, ct WHERE nrm > 0), rk AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, label) r FROM sm)"


def _centroids(spark: SparkSession, d: str) -> DataFrame:
    return idn.centroids(table(spark, d, "embeddings"), ["label"], "embedding")


@query("centroids", f"WITH {CENTRES} SELECT label, members, round(c[1], 8) x0, round(c[64], 8) x63 FROM ct")
def centroids(spark: SparkSession, d: str) -> DataFrame:
    return _centroids(spark, d).select("label", "members", F.round(F.get("centroid", F.lit(0)), 8).alias("x0"), F.round(F.get("centroid", F.lit(63)), 8).alias("x63"))


def _matches(spark: SparkSession, d: str) -> DataFrame:
    known = _centroids(spark, d).select(F.col("label").alias("cluster_id"), F.concat(F.lit("S"), F.col("label").cast("string")).alias("speaker"), "centroid")
    return idn.best_two(table(spark, d, "embeddings").where(norm(F.col("embedding")) > 0), known, "vec_id")


@query("voice_match_top2", f"WITH {SIMS} SELECT a.vec_id, 'S' || a.label best_name, round(a.s, 6) best, 'S' || b.label second_name, round(b.s, 6) \"second\" FROM rk a JOIN rk b ON a.vec_id = b.vec_id AND a.r = 1 AND b.r = 2")
def voice_match(spark: SparkSession, d: str) -> DataFrame:
    return _matches(spark, d).select("vec_id", "best_name", F.round("best", 6).alias("best"), "second_name", F.round("second", 6).alias("second"))


@query("margin_abstain", f"WITH {SIMS} SELECT a.vec_id, CASE WHEN a.s >= 0.2 AND a.s - b.s >= 0.02 THEN 'S' || a.label END accepted FROM rk a JOIN rk b ON a.vec_id = b.vec_id AND a.r = 1 AND b.r = 2")
def margin_abstain(spark: SparkSession, d: str) -> DataFrame:
    return idn.accept(_matches(spark, d), 0.2, 0.02).select("vec_id", "accepted")


@query("clip_override", f"WITH {SIMS} SELECT a.vec_id, CASE WHEN a.vec_id % 4 >= 2 AND a.s - b.s >= 0.05 THEN 'S' || a.label END \"override\" FROM rk a JOIN rk b ON a.vec_id = b.vec_id AND a.r = 1 AND b.r = 2")
def override(spark: SparkSession, d: str) -> DataFrame:
    rows = _matches(spark, d).withColumn("seconds", (F.col("vec_id") % 4).cast("double"))
    return rows.select("vec_id", idn.clip_override(rows, "seconds", 1.5, 0.05).alias("override"))


@query(
    "votes",
    f"""WITH {SIMS}, dt AS (SELECT vec_id // 10 shot, 'S' || label AS name, vec_id FROM rk WHERE r = 1), c AS (SELECT shot, name, count(*) n, min(vec_id) f FROM dt GROUP BY 1, 2)
    SELECT shot, coalesce(string_agg(CASE WHEN n >= 2 THEN name END, ', ' ORDER BY n DESC, f), '') accepted, count(*) names, CAST(sum(n) AS BIGINT) votes FROM c GROUP BY 1""",
)
def votes(spark: SparkSession, d: str) -> DataFrame:
    rows = _matches(spark, d).select(F.floor(F.col("vec_id") / 10).alias("shot"), F.col("best_name").alias("name"), F.col("vec_id").alias("pos"))
    return idn.votes(rows, "shot", "name").withColumn("names", F.col("names").cast("bigint"))


@query(
    "cosine_topk",
    f"""WITH {NORMED}, q AS (SELECT vec_id qid, embedding qv, nrm qn FROM nv WHERE vec_id % 100 = 0), p AS (SELECT qid, vec_id, round(CASE WHEN nrm * qn = 0 THEN 0 ELSE list_inner_product(embedding::DOUBLE[], qv::DOUBLE[]) / (nrm * qn) END, 9) similarity FROM q, nv)
    SELECT qid, vec_id, similarity, CAST(row_number() OVER (PARTITION BY qid ORDER BY similarity DESC, vec_id) AS INTEGER) "rank" FROM p QUALIFY "rank" <= 5""",
)
def cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings")
    asked = rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"))
    return idn.top_k(asked, rows, "vec_id", "embedding", 5)


@query("prompt_softmax", f"WITH {SIMS}, x AS (SELECT vec_id, label, exp(s - max(s) OVER (PARTITION BY vec_id)) e FROM sm) SELECT vec_id, label, round(e / sum(e) OVER (PARTITION BY vec_id), 8) p FROM x")
def prompt_softmax(spark: SparkSession, d: str) -> DataFrame:
    prompts = F.broadcast(_centroids(spark, d).select(F.col("label").alias("prompt"), "centroid"))  # one row a label
    rows = table(spark, d, "embeddings").where(norm(F.col("embedding")) > 0).select("vec_id", unit(F.col("embedding")).alias("v")).join(prompts, how="cross")
    rows = rows.select("vec_id", F.col("prompt").alias("label"), F.round(dot(F.col("v"), F.col("centroid")), 12).alias("s"))
    return idn.softmax(rows, ["vec_id"], "s").select("vec_id", "label", F.round("p", 8).alias("p"))


@query(
    "energy_gate",
    "WITH c AS (SELECT event_id, user_id, round(value % 80 - 80, 6) peak, event_id % 5 = 0 h FROM events) SELECT event_id FROM c QUALIFY h OR peak >= max(peak) OVER (PARTITION BY user_id) - 30",
)
def energy_gate(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("event_id", "user_id", F.round(F.col("value") % 80 - 80, 6).alias("peak"), (F.col("event_id") % 5 == 0).alias("has_vector"))
    return idn.energy_gate(rows, "user_id", "peak", "has_vector").select("event_id")


@query(
    "fused_stem_pick",
    """WITH c AS (SELECT event_id, user_id, round(value % 80 - 80, 6) peak, (event_id % 97) / 97.0 sim FROM events), f AS (SELECT *, round(sim * sqrt(pow(10, (peak - max(peak) OVER (PARTITION BY user_id)) / 20)), 9) fused FROM c)
    SELECT user_id, event_id, fused FROM f QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY fused DESC, event_id) = 1""",
)
def fused_pick(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("event_id", "user_id", F.col("event_id").alias("pos"), F.round(F.col("value") % 80 - 80, 6).alias("peak"), ((F.col("event_id") % 97) / 97.0).alias("sim"))
    return idn.pick_stem(rows, "user_id", "sim", "peak").select("user_id", "event_id", "fused")


NOVELTY_DIM = 64


@query(
    "novelty_norm",
    f"""WITH lg AS (SELECT label, vec_id, i, avg(CAST(embedding[i] AS DOUBLE)) OVER (PARTITION BY label, i ORDER BY vec_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) a, avg(CAST(embedding[i] AS DOUBLE)) OVER (PARTITION BY label, i ORDER BY vec_id ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING) b
      FROM embeddings, generate_series(1, {NOVELTY_DIM}) t(i)), r AS (SELECT label, vec_id, CASE WHEN max(b) IS NULL THEN 0 ELSE 1 - sum(a * b) / ((sqrt(sum(a * a)) + 1e-9) * (sqrt(sum(b * b)) + 1e-9)) END x FROM lg GROUP BY 1, 2)
    SELECT vec_id, label, round(CASE WHEN max(x) OVER w > min(x) OVER w THEN (x - min(x) OVER w) / (max(x) OVER w - min(x) OVER w) ELSE 0 END, 6) novelty FROM r WINDOW w AS (PARTITION BY label)""",
)
def novelty(spark: SparkSession, d: str) -> DataFrame:
    return st.novelty(table(spark, d, "embeddings"), ["label"], "vec_id", "embedding", NOVELTY_DIM).select("vec_id", "label", F.round("novelty", 6).alias("novelty"))


# ---- powers and robust statistics ---------------------------------------------------------------------------------

ROLES = "CASE l_returnflag WHEN 'A' THEN 'D' WHEN 'N' THEN 'M' WHEN 'R' THEN CASE WHEN l_linenumber % 2 = 0 THEN 'E' ELSE 'ME' END END"


@query(
    "source_dominance",
    f"""WITH p AS (SELECT l_orderkey, {ROLES} r, l_quantity q FROM lineitem), f AS (SELECT l_orderkey, sum(CASE WHEN r = 'D' THEN q ELSE 0 END) d, sum(CASE r WHEN 'M' THEN q WHEN 'ME' THEN q / 2 ELSE 0 END) m, sum(CASE r WHEN 'E' THEN q WHEN 'ME' THEN q / 2 ELSE 0 END) e FROM p GROUP BY 1)
    SELECT l_orderkey, round(d, 6) d, round(m, 6) m, round(e, 6) e, round(d / (d + m + e), 6) d_share, round(m / (d + m + e), 6) m_share, round(e / (d + m + e), 6) e_share, round((m + e) / (d + m + e + 1e-12), 6) masking FROM f""",
)
def source_dominance(spark: SparkSession, d: str) -> DataFrame:
    role = F.when(F.col("l_returnflag") == "A", "D").when(F.col("l_returnflag") == "N", "M").when(F.col("l_returnflag") == "R", F.when(F.col("l_linenumber") % 2 == 0, "E").otherwise("ME"))
    rows = st.source_interactions(table(spark, d, "lineitem").select("l_orderkey", role.alias("role"), "l_quantity"), ["l_orderkey"], "role", "l_quantity")
    return rows.select("l_orderkey", *[F.round(c, 6).alias(c) for c in ("d", "m", "e", "d_share", "m_share", "e_share", "masking")])


@query("masking_risk", "SELECT l_orderkey, l_linenumber, round(least(1, greatest(0, l_tax / (l_discount + l_tax + 1e-12))), 6) risk FROM lineitem")
def masking(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(lv.masking_risk(F.col("l_discount"), F.col("l_tax")), 6).alias("risk"))


@query(
    "line_outliers_mad",
    """WITH r AS (SELECT o_orderkey k, CAST(o_custkey AS VARCHAR) s, o_totalprice x FROM orders), g AS (SELECT *, count(*) OVER (PARTITION BY s) n FROM r),
    o AS (SELECT a.k, a.s, a.x, b.x y FROM g a JOIN g b ON a.s = b.s AND a.k != b.k WHERE a.n >= 3 UNION ALL SELECT a.k, a.s, a.x, b.x y FROM g a JOIN g b ON a.k != b.k WHERE a.n < 3),
    p AS (SELECT k, s, x, median(y) m FROM o GROUP BY 1, 2, 3), q AS (SELECT p.k, p.s, p.x, p.m, 1.4826 * median(abs(o.y - p.m)) sc FROM p JOIN o ON o.k = p.k GROUP BY 1, 2, 3, 4)
    SELECT k, s, round(CASE WHEN sc > 1e-6 THEN abs((x - m) / sc) ELSE 0 END, 6) score FROM q WHERE CASE WHEN sc > 1e-6 THEN abs((x - m) / sc) ELSE 0 END >= 3.5""",
)
def outliers(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").cast("string").alias("s"), F.col("o_totalprice").alias("x"))
    return st.line_outliers(rows, "k", "s", ["x"])


#: Writings of roles and of stems' names that the two queries below meet.
ROLE_TEXTS = ("Dialogue", "dx", "D", "speaker:ann", "speakers", "dialogue_left", "speech", "Music", "mx", "music_cue:3", "musical", "music_effects", "M&E", "fx", "SFX", "effects:wind", "effects", "foley", "room_tone")
STEM_TEXTS = ("vocal", "x_dialogue1", "reel_DX", "redux", "music-bed", "mx_02", "mix", "instrumental", "sound_effects", "fx", "sfx", "take-fx-1")


def _texts_sql(texts: tuple[str, ...]) -> str:
    return f"[{', '.join(repr(t) for t in texts)}][p_partkey % {len(texts)} + 1]"


def _texts(texts: tuple[str, ...]) -> Column:
    return F.element_at(F.array(*[F.lit(t) for t in texts]), (F.col("p_partkey") % len(texts) + 1).cast("int"))


@query(
    "role_groups",
    f"""WITH t AS (SELECT p_partkey, lower({_texts_sql(ROLE_TEXTS)}) r FROM part) SELECT p_partkey, CASE WHEN r IN ('d', 'dx', 'dialogue') OR r LIKE 'speaker:%' OR starts_with(r, 'dialogue_') THEN 'D'
    WHEN r IN ('m', 'mx', 'music') OR r LIKE 'music:%' OR starts_with(r, 'music_cue:') OR starts_with(r, 'music_instrument:') THEN 'M' WHEN r IN ('e', 'fx', 'sfx', 'effects') OR r LIKE 'effects:%' THEN 'E'
    WHEN r IN ('me', 'm&e', 'music_effects') THEN 'ME' END grp FROM t""",
)
def role_groups(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", nm.role_group(_texts(ROLE_TEXTS)).alias("grp"))


@query(
    "stem_roles",
    f"""WITH t AS (SELECT p_partkey, lower({_texts_sql(STEM_TEXTS)}) r FROM part) SELECT p_partkey, CASE WHEN contains(r, 'dialogue') OR contains(r, 'dialog') OR contains(r, 'vocal') OR regexp_matches(r, '(^|[_-])dx($|[_-])') THEN 'dialogue'
    WHEN contains(r, 'music') OR regexp_matches(r, '(^|[_-])mx($|[_-])') THEN 'music_fx' WHEN contains(r, 'effect') OR regexp_matches(r, '(^|[_-])fx($|[_-])') THEN 'effects' END role FROM t""",
)
def stem_roles(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", nm.stem_role(_texts(STEM_TEXTS)).alias("role"))


@query(
    "probe_starts",
    """WITH s AS (SELECT p_partkey, p_size * 20.0::DOUBLE - 30 span FROM part), t AS (SELECT p_partkey, span, span * (i + (r + 0.5::DOUBLE) / 4) / 3 st FROM s, generate_series(0, 3) a(r), generate_series(0, 2) b(i) WHERE span > 0)
    SELECT p_partkey, round(st, 6) start_sec FROM t UNION SELECT p_partkey, 0 FROM s WHERE span <= 0""",
)
def probe_starts(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").select("p_partkey", F.explode(ac.probe_starts(F.col("p_size") * F.lit(20.0), 30.0, 3)).alias("start_sec"))
    return rows.select("p_partkey", F.round("start_sec", 6).alias("start_sec"))


# ---- names, texts, registries ---------------------------------------------------------------------------------------

@query("speaker_keys", "SELECT project_id, speaker_key, regexp_replace(upper(strip_accents(name)), '[^\\p{L}\\p{N}]+', '', 'g') AS key, upper(trim(name)) canonical FROM speakers")
def speaker_keys(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "speakers").select("project_id", "speaker_key", nm.speaker_key(F.col("name")).alias("key"), nm.canonical_speaker_name(F.col("name")).alias("canonical"))


@query(
    "alias_lookup",
    """WITH a AS (SELECT project_id, pos, speaker_key, unnest(list_concat([speaker_key, name], coalesce(aliases, []))) n FROM speakers), k AS (SELECT project_id, regexp_replace(upper(strip_accents(n)), '[^\\p{L}\\p{N}]+', '', 'g') AS key, arg_min(speaker_key, (pos, speaker_key)) r FROM a GROUP BY 1, 2),
    t AS (SELECT DISTINCT project_id, speaker AS text FROM dialogue_lines WHERE speaker IS NOT NULL) SELECT t.project_id, t.text, k.r registered FROM t LEFT JOIN k ON k.project_id = t.project_id AND k.key = regexp_replace(upper(strip_accents(t.text)), '[^\\p{L}\\p{N}]+', '', 'g') AND k.key != ''""",
)
def alias_lookup(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "dialogue_lines").where("speaker IS NOT NULL").select("project_id", F.col("speaker").alias("text")).distinct()
    return idn.alias_lookup(names, table(spark, d, "speakers"), ["project_id"])


@query("safe_name", "SELECT p_partkey, coalesce(nullif(trim(regexp_replace(trim(p_name), '[^A-Za-z0-9_.-]+', '_', 'g'), '._'), ''), 'item') safe, trim(regexp_replace(lower(trim(p_type)), '[^a-z0-9]+', '_', 'g'), '_') header FROM part")
def safe_names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", nm.safe_name(F.col("p_name")).alias("safe"), nm.normalize_header(F.col("p_type")).alias("header"))


@query(
    "source_group",
    """SELECT DISTINCT diarized_speaker, CASE WHEN regexp_extract(lower(diarized_speaker), 'speaker[_-]?(\\d+)', 1) != '' THEN 'speaker_' || lpad(CAST(CAST(regexp_extract(lower(diarized_speaker), 'speaker[_-]?(\\d+)', 1) AS INTEGER) AS VARCHAR), 2, '0') ELSE '' END grp FROM dialogue_lines WHERE diarized_speaker IS NOT NULL""",
)
def source_groups(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "dialogue_lines").where("diarized_speaker IS NOT NULL").select("diarized_speaker", nm.source_group_from_text(F.col("diarized_speaker")).alias("grp")).distinct()


CLEAN = "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(text, chr(10), ' '), '<[^>]+>', '', 'g'), '\\([^)]*\\)', '', 'g'), '(?i)Change Note:.*', '', 'g'), '\\s{2,}', ' ', 'g'), ' ,.\"')"


@query("clean_text", f"SELECT pos, {CLEAN} cleaned FROM dialogue_lines WHERE text IS NOT NULL")
def clean_texts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "dialogue_lines").where("text IS NOT NULL").select("pos", nm.clean_text(F.col("text")).alias("cleaned"))


@query(
    "plausible_speech",
    """WITH t AS (SELECT pos, lower(trim(trim(text), '.!?,')) p, end_sec - start_sec s FROM dialogue_lines WHERE text IS NOT NULL AND NOT isnan(start_sec) AND NOT isnan(end_sec) AND end_sec > start_sec)
    SELECT pos, coalesce(p NOT IN ('you', 'thank you', 'thank you so much', 'thanks for watching', 'bye', 'yeah', 'the end', 'so', 'oh', 'mm', 'hmm') AND s >= 0.3 AND len(list_filter(regexp_split_to_array(p, '\\s+'), lambda w: w != '')) >= 2 AND length(p) / s BETWEEN 2 AND 30, false) ok FROM t""",
)
def plausible(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "dialogue_lines").where("text IS NOT NULL AND NOT isnan(start_sec) AND NOT isnan(end_sec) AND end_sec > start_sec")
    return rows.select("pos", nm.plausible_speech(F.col("text"), F.col("end_sec") - F.col("start_sec")).alias("ok"))


@query(
    "char_interpolate",
    """WITH w AS (SELECT n_nationkey k, n_name t, n_nationkey * 1.0 s, n_nationkey + 2.0 e FROM nation) SELECT k, i - 1 AS i, substr(t, CAST(i AS INTEGER), 1) "character", round(s + (i - 1) * (e - s) / length(t), 6) "start", round(s + i * (e - s) / length(t), 6) "end" FROM w, generate_series(1, 40) g(i) WHERE i <= length(t)""",
)
def characters(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.lit(0).alias("pos"), F.col("n_name").alias("text"), (F.col("n_nationkey") * 1.0).alias("start"), (F.col("n_nationkey") + 2.0).alias("end"))
    return sq.interpolate_characters(rows, ["k"]).select("k", F.col("i").cast("bigint").alias("i"), "character", F.round("start", 6).alias("start"), F.round("end", 6).alias("end"))


@query(
    "ordered_distinct_speakers",
    """WITH k AS (SELECT project_id, speaker, pos, regexp_replace(upper(strip_accents(speaker)), '[^\\p{L}\\p{N}]+', '', 'g') AS key FROM dialogue_lines WHERE speaker IS NOT NULL) SELECT project_id, speaker, pos FROM k WHERE key != '' QUALIFY row_number() OVER (PARTITION BY project_id, key ORDER BY pos) = 1""",
)
def distinct_speakers(spark: SparkSession, d: str) -> DataFrame:
    return idn.ordered_distinct(table(spark, d, "dialogue_lines").select("project_id", "speaker", "pos"), ["project_id"], "speaker")


RESOLVE = """WITH s AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'anna; Ben , anna' ELSE '' END own, CASE WHEN o_orderkey % 5 < 2 THEN 'CARL' END f, CASE WHEN o_orderkey % 7 < 3 THEN 'DORA, CARL' END v FROM orders)
    SELECT CAST(o_orderkey AS VARCHAR) shot_id, CASE WHEN own != '' THEN 'ANNA, BEN' ELSE coalesce(f, v, '') END speakers, CASE WHEN own != '' THEN 'existing' WHEN f IS NOT NULL THEN 'face-db' WHEN v IS NOT NULL THEN 'voice-db' ELSE 'unresolved' END source FROM s"""


@query("resolve_priority", RESOLVE)
def resolve(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    rows = table(spark, d, "orders").select(k.cast("string").alias("shot_id"), F.when(k % 3 == 0, "anna; Ben , anna").otherwise("").alias("existing_speaker"), k)
    face = rows.where(k % 5 < 2).select("shot_id", F.array(F.lit("Carl")).alias("face_names"))
    voice = rows.where(k % 7 < 3).select("shot_id", F.array(F.lit("dora"), F.lit("carl"), F.lit("Dora")).alias("voice_names"))
    return idn.resolve_speakers(rows.drop("o_orderkey"), face, voice)


@query(
    "voice_db_plan",
    """WITH c AS (SELECT clip_id, b.l line_id, b.s shot_id FROM (SELECT clip_id, max_by(struct_pack(l := line_id, s := shot_id), ingested_at) b FROM voice_inputs WHERE clip_id IS NOT NULL GROUP BY 1)), k AS (SELECT *, CAST(regexp_extract(clip_id, '([0-9]+)$', 1) AS BIGINT) n FROM c),
    x AS (SELECT *, n % 11 = 0 missing, CASE WHEN n % 11 != 0 AND n % 7 != 0 THEN n % 5 END cluster_id FROM k)
    SELECT clip_id, line_id, shot_id, cluster_id, CASE WHEN NOT missing AND cluster_id IN (0, 1) THEN 'NAME ' || CAST(cluster_id AS VARCHAR) ELSE '' END speaker,
    CASE WHEN missing THEN 'missing' WHEN cluster_id IS NULL THEN 'ungrouped' WHEN cluster_id = 2 THEN 'skipped' WHEN cluster_id IN (0, 1) THEN 'matched' ELSE 'unlabeled' END status, CASE WHEN NOT missing AND cluster_id IN (0, 1) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END score FROM x""",
)
def voice_db_plan(spark: SparkSession, d: str) -> DataFrame:
    rows = latest(table(spark, d, "voice_inputs"), "clip_id", "ingested_at", ["line_id", "shot_id"])
    n = F.regexp_extract("clip_id", "([0-9]+)$", 1).cast("bigint")
    members = rows.where(n % 11 != 0).select("clip_id", F.when(n % 7 != 0, n % 5).alias("cluster_id"))
    names = spark.createDataFrame([(0, "Name 0"), (1, " name 1 "), (2, "Skip"), (3, "")], "cluster_id bigint, name string")
    return idn.plan_from_voice_db(rows, members, names)


@query(
    "apply_labels",
    """WITH l AS (SELECT s_nationkey cluster_id, s_suppkey pos, CASE WHEN s_suppkey % 4 = 0 THEN ' ' ELSE s_name END lb FROM supplier), m AS (SELECT cluster_id, arg_max(lb, pos) lb FROM l WHERE trim(lb) != '' GROUP BY 1)
    SELECT n_nationkey cluster_id, coalesce(upper(trim(lb)), n_name) AS name, lb IS NOT NULL applied FROM nation LEFT JOIN m ON m.cluster_id = n_nationkey""",
)
def apply_labels(spark: SparkSession, d: str) -> DataFrame:
    labels = table(spark, d, "supplier").select(F.col("s_nationkey").alias("cluster_id"), F.col("s_suppkey").alias("pos"), F.when(F.col("s_suppkey") % 4 == 0, " ").otherwise(F.col("s_name")).alias("label"))
    return idn.apply_labels(table(spark, d, "nation").select(F.col("n_nationkey").alias("cluster_id"), F.col("n_name").alias("name")), labels, ["cluster_id"])


LANG = "CASE WHEN lower(trim(lang)) IN ('en', 'english') THEN 'en' WHEN lower(trim(lang)) IN ('de', 'german', 'deutsch') THEN 'de' WHEN lower(trim(lang)) IN ('es', 'spanish', 'castilian', 'castellano') THEN 'es' END"


@query(
    "language_vote",
    f"""WITH v AS (SELECT project_id, doc_id pos, {LANG} code FROM documents WHERE project_id IS NOT NULL), c AS (SELECT project_id, code, count(*) n, min(pos) p FROM v WHERE code IS NOT NULL GROUP BY 1, 2)
    SELECT project_id, code AS language, n language_count, round(n / 3.0, 6) confidence, n / 3.0 >= 0.6 sure FROM c QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY n DESC, p) = 1""",
)
def language_vote(spark: SparkSession, d: str) -> DataFrame:
    from cutloom.functions.languages import language_code

    rows = table(spark, d, "documents").where("project_id IS NOT NULL").select("project_id", F.col("doc_id").alias("pos"), language_code(F.col("lang")).alias("code"))
    return idn.language_vote(rows, ["project_id"], 3).withColumn("confidence", F.round("confidence", 6))


@query(
    "fingerprint_diff",
    """WITH r AS (SELECT source AS owner, CAST(doc_id AS VARCHAR) AS name, sha256(coalesce(text, '')) f FROM documents WHERE doc_id % 5 != 0 AND source IS NOT NULL AND source NOT LIKE 'n%'),
    n AS (SELECT source AS owner, CAST(doc_id AS VARCHAR) AS name, CASE WHEN doc_id % 7 = 0 THEN sha256('x' || coalesce(text, '')) ELSE sha256(coalesce(text, '')) END f FROM documents WHERE source IS NOT NULL)
    SELECT n.owner, n.name, r.f IS NULL is_new FROM n LEFT JOIN r USING (owner, name) WHERE n.f IS DISTINCT FROM r.f AND n.owner IN (SELECT owner FROM r)""",
)
def fingerprint_diff(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("source IS NOT NULL").withColumn("text", F.coalesce("text", F.lit("")))
    named = docs.select(F.col("source").alias("owner"), F.col("doc_id").cast("string").alias("name"), F.sha2("text", 256).alias("fingerprint"), "doc_id")
    recorded = named.where("doc_id % 5 != 0 AND owner NOT LIKE 'n%'").drop("doc_id")
    current = docs.select(F.col("source").alias("owner"), F.col("doc_id").cast("string").alias("name"), F.when(F.col("doc_id") % 7 == 0, F.sha2(F.concat(F.lit("x"), F.col("text")), 256)).otherwise(F.sha2("text", 256)).alias("fingerprint"))
    return idn.changed_inputs(recorded, current, ["owner"])


@query("discover_dedup", "SELECT path, clip_id FROM (SELECT path, clip_id, row_number() OVER (PARTITION BY path ORDER BY CASE WHEN clip_type = 'dialogue_line' THEN 0 ELSE 1 END, pos) n FROM voice_inputs WHERE path IS NOT NULL) WHERE n = 1")
def discover_dedup(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "voice_inputs").where("path IS NOT NULL").withColumn("priority", F.when(F.col("clip_type") == "dialogue_line", 0).otherwise(1))
    return idn.first_by_path(rows, "path", "priority").select("path", "clip_id")


@query(
    "exemplars",
    """WITH q AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) k FROM events), h AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 i, count(*) OVER (PARTITION BY user_id) n FROM q WHERE k <= 8)
    SELECT user_id, event_id FROM h WHERE n <= 4 OR i IN (0, (n - 1) // 3, 2 * (n - 1) // 3, n - 1)""",
)
def exemplars(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").withColumn("pos", F.col("event_id"))
    return idn.exemplars(rows, ["user_id"], "value", "ts", 4).select("user_id", "event_id")
