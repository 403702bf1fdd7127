"""Queries on words against frames, boundary scores, placed clips, tracks and the registry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cutloom.common import latest, table
from cutloom.operators import activity as ac
from cutloom.operators import grouped as gr
from cutloom.operators import media as md
from cutloom.operators import registry as rg
from cutloom.operators import sequences as sq
from cutloom.operators import timeline as tl
from cutloom.plans.shared import CLIPS, LINES, SHOTS, clips, lines, shots

QUERIES: dict = {}
ORACLE: dict = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return keep


LEVELS = "lv AS (SELECT user_id % 5 AS prog, event_type source, row_number() OVER (PARTITION BY user_id % 5, event_type ORDER BY ts, event_id) - 1 i, round(value % 60 - 60, 6) level FROM events)"
WORDS = "wd AS (SELECT o_orderkey k, o_orderkey % 5 AS prog, o_custkey % 300 * 1.5 s, o_custkey % 300 * 1.5 + 1 + o_orderkey % 4 e FROM orders)"


def _levels(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("prog", "source").orderBy("ts", "event_id")
    rows = table(spark, d, "events").withColumn("prog", F.col("user_id") % 5).withColumn("source", F.col("event_type"))
    return rows.select("prog", "source", (F.row_number().over(w) - 1).cast("bigint").alias("i"), F.round(F.col("value") % 60 - 60, 6).alias("level"))


def _words(spark: SparkSession, d: str) -> DataFrame:
    at = F.col("o_custkey") % 300 * 1.5
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), (F.col("o_orderkey") % 5).alias("prog"), at.alias("start"), (at + 1 + F.col("o_orderkey") % 4).alias("end"))


HITS = f"{LEVELS}, {WORDS}, ht AS (SELECT wd.k, wd.prog, source, level FROM wd JOIN lv ON lv.prog = wd.prog AND lv.i >= floor(s / 0.5) AND lv.i < greatest(floor(s / 0.5) + 1, ceil(e / 0.5)))"


@query(
    "stem_activity",
    f"""WITH {HITS}, sc AS (SELECT prog, k, source, quantile_cont(level, 0.9) l FROM ht GROUP BY ALL), rk AS (SELECT *, row_number() OVER w n, lead(l) OVER w nx FROM sc WINDOW w AS (PARTITION BY prog, k ORDER BY l DESC, source))
    SELECT wd.prog, wd.k, CASE WHEN l >= -50 AND (nx IS NULL OR l - nx >= 1) THEN source END source, CASE WHEN l >= -50 AND (nx IS NULL OR l - nx >= 1) THEN round(l, 3) END level FROM wd LEFT JOIN rk ON rk.prog = wd.prog AND rk.k = wd.k AND n = 1""",
)
def stem_activity(spark: SparkSession, d: str) -> DataFrame:
    return ac.dominant_source(_words(spark, d), _levels(spark, d), ["prog"], "k", 0.5)


@query("line_frame_means", f"WITH {HITS} SELECT prog, k, round(avg(level), 6) level FROM ht GROUP BY 1, 2")
def line_frame_means(spark: SparkSession, d: str) -> DataFrame:
    return ac.means_over_frames(_words(spark, d), _levels(spark, d), ["prog"], "k", ["level"], 0.5).select("prog", "k", F.round("level", 6).alias("level"))


@query(
    "nearest_source",
    f"""WITH {LINES}, {SHOTS}, so AS (SELECT reel_id, 'v' || CAST(hash % 4 AS VARCHAR) source, start_ms s, end_ms e FROM (SELECT *, CAST(regexp_extract(shot_id, '([0-9]+)$', 1) AS BIGINT) hash FROM sh)),
    nr AS (SELECT l.line_id, source, min(greatest(s - end_ms, start_ms - e, 0)) d FROM ln l JOIN so ON so.reel_id = l.reel_id GROUP BY 1, 2), rk AS (SELECT *, row_number() OVER w n, lead(d) OVER w nx FROM nr WINDOW w AS (PARTITION BY line_id ORDER BY d, source))
    SELECT l.line_id, CASE WHEN d <= 750 AND (nx IS NULL OR nx - d > 50) THEN source END source FROM ln l LEFT JOIN rk ON rk.line_id = l.line_id AND n = 1""",
)
def nearest_source(spark: SparkSession, d: str) -> DataFrame:
    own = shots(spark, d).select("reel_id", F.concat(F.lit("v"), (F.regexp_extract("shot_id", "([0-9]+)$", 1).cast("bigint") % 4).cast("string")).alias("source"), F.col("start_ms").alias("start"), F.col("end_ms").alias("end"))
    words = lines(spark, d).select("reel_id", "line_id", F.col("start_ms").alias("start"), F.col("end_ms").alias("end"))
    return ac.nearest_source(words, own, ["reel_id"], "line_id").select("line_id", "source")


@query(
    "scene_fusion",
    "SELECT vec_id, round(1 / (1 + exp(-(3.8306::DOUBLE * abs(embedding[1]::DOUBLE) - 0.1764::DOUBLE * abs(embedding[2]::DOUBLE) + 4.4968::DOUBLE * abs(embedding[3]::DOUBLE) + 2.6071::DOUBLE * abs(embedding[4]::DOUBLE) - 0.177 * (vec_id % 2) - 3.9381))), 6) score, 'full' variant FROM embeddings",
)
def scene_fusion(spark: SparkSession, d: str) -> DataFrame:
    at = lambda i: F.abs(F.get("embedding", F.lit(i))).cast("double")
    rows = table(spark, d, "embeddings").select("vec_id", at(0).alias("clip_dp"), at(1).alias("clip_nov"), at(2).alias("dino_nov"), at(3).alias("audio_nov"), (F.col("vec_id") % 2).alias("dlg_span"))
    return ac.boundary_scores(rows).select("vec_id", F.round("score", 6).alias("score"), "variant")


@query("keyframes", f"""WITH {SHOTS}, f AS (SELECT shot_id, CAST(round_even(start_ms * 0.024, 0) AS BIGINT) a, CAST(round_even(end_ms * 0.024, 0) AS BIGINT) b FROM sh), g AS (SELECT shot_id, CASE WHEN b - 1 - a >= 7 THEN a + 2 ELSE a END lo, CASE WHEN b - 1 - a >= 7 THEN b - 3 ELSE b - 1 END hi FROM f),
    k AS (SELECT DISTINCT shot_id, CASE WHEN hi <= lo THEN (lo + hi) // 2 ELSE lo + CAST(round_even(i * (hi - lo) / 2.0::DOUBLE, 0) AS BIGINT) END frame FROM g, generate_series(0, 2) t(i)) SELECT shot_id, frame FROM k""")
def keyframes(spark: SparkSession, d: str) -> DataFrame:
    frame = lambda c: F.rint(F.col(c) * 0.024).cast("bigint")
    return shots(spark, d).select("shot_id", F.explode(ac.keyframes(frame("start_ms"), frame("end_ms"))).alias("frame"))


def _clips(spark: SparkSession, d: str) -> DataFrame:
    rows = lines(spark, d).select("reel_id", F.col("line_id").alias("clip"), F.coalesce("source_group", F.lit("")).alias("grp"), "text", "speaker", (F.col("start_ms") / 1000).alias("start_sec"), (F.col("end_ms") / 1000).alias("end_sec"))
    n = F.regexp_extract("clip", "([0-9]+)$", 1).cast("bigint")
    return rows.withColumn("media_sec", F.when(n % 3 == 0, (n % 4) * 0.5 + 0.25)).withColumn("status", F.when(n % 5 == 0, "unresolved").otherwise("matched"))


PLACED = f"""{LINES}, nn AS (SELECT *, CAST(regexp_extract(line_id, '([0-9]+)$', 1) AS BIGINT) n FROM ln), pc AS (SELECT *, CAST(round_even(start_ms / 1000.0::DOUBLE * 24, 0) AS BIGINT) start_frame, greatest(1, CAST(round_even(CASE WHEN n % 3 = 0 THEN least(end_ms / 1000.0::DOUBLE - start_ms / 1000.0::DOUBLE, n % 4 * 0.5 + 0.25) ELSE end_ms / 1000.0::DOUBLE - start_ms / 1000.0::DOUBLE END * 24, 0) AS BIGINT)) frames FROM nn)"""


@query(
    "placed_markers",
    f"""WITH {PLACED} SELECT line_id clip, start_frame, frames, CASE WHEN n % 3 != 0 THEN 'RED' WHEN n % 5 = 0 THEN 'ORANGE' ELSE 'GREEN' END color,
    CASE WHEN n % 3 != 0 THEN '[missing stem] ' WHEN n % 5 = 0 THEN '[unresolved] ' ELSE '' END || coalesce(nullif(speaker, ''), '?') || CASE WHEN trim(coalesce(text, '')) != '' THEN ': ' || substr(trim(text), 1, 64) ELSE '' END label FROM pc""",
)
def placed_markers(spark: SparkSession, d: str) -> DataFrame:
    rows = tl.placed(_clips(spark, d), 24.0)
    mark = tl.marker(F.col("speaker"), F.col("text"), F.col("status"), F.col("media_sec").isNotNull())
    return rows.select("clip", "start_frame", "frames", mark["color"].alias("color"), mark["label"].alias("label"))


@query("timeline_summary", f"WITH {PLACED} SELECT reel_id, grp, clips, CAST(frames AS BIGINT) frames, end_frame FROM (SELECT reel_id, coalesce(source_group, '') grp, count(*) clips, sum(frames) frames, max(start_frame + frames) end_frame FROM pc GROUP BY GROUPING SETS ((reel_id, coalesce(source_group, '')), (reel_id)))")
def timeline_summary(spark: SparkSession, d: str) -> DataFrame:
    return tl.summary(tl.placed(_clips(spark, d), 24.0), ["reel_id"], "grp").select("reel_id", "grp", "clips", "frames", "end_frame")


@query("timeline_tracks")
def timeline_tracks(spark: SparkSession, d: str) -> DataFrame:
    rows = tl.tracks(tl.placed(_clips(spark, d), 24.0), ["reel_id"], "grp")
    return tl.otio_json(rows, ["reel_id"], "grp", 24.0)


@query(
    "registry_seed",
    """WITH a AS (SELECT speaker_key, name, list_distinct(coalesce(aliases, [])) al, project_id, pos FROM speakers), u AS (SELECT speaker_key, al, name, pos, project_id = 'prj_0001' f FROM a)
    SELECT speaker_key, coalesce(min(CASE WHEN f THEN name END), min(name)) AS name, list_sort(list_distinct(flatten(list(al)))) aliases FROM u GROUP BY 1""",
)
def registry_seed(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "speakers").select("project_id", "speaker_key", "name", "aliases")
    known = rows.where("project_id = 'prj_0001'").drop("project_id")
    others = rows.where("project_id != 'prj_0001'").groupBy("speaker_key").agg(F.min("name").alias("name"), F.array_distinct(F.flatten(F.collect_list("aliases"))).alias("aliases"))
    return rg.seed(known, others)


@query("agglomerative")
def agglomerative(spark: SparkSession, d: str) -> DataFrame:
    return gr.cluster_groups(table(spark, d, "embeddings"), ["label"], "vec_id", "embedding", 0.8, 3)


@query("dp_segments")
def dp_segments(spark: SparkSession, d: str) -> DataFrame:
    return gr.scene_persistence(table(spark, d, "embeddings"), ["label"], "vec_id", "embedding")


# ---- faces, streams, clips, ambience, labels of segments ---------------------------------------------------------------

FACES = "fc AS (SELECT face_id, b.s shot_id, b.x box FROM (SELECT face_id, max_by(struct_pack(s := shot_id, x := box), ingested_at) b FROM face_observations WHERE face_id IS NOT NULL GROUP BY 1)), tg AS (SELECT shot_id, b.x box FROM (SELECT shot_id, max_by(struct_pack(x := target_face_box), ingested_at) b FROM shots WHERE shot_id IS NOT NULL GROUP BY 1) WHERE b.x IS NOT NULL)"


@query(
    "best_target_face",
    f"""WITH {FACES}, p AS (SELECT fc.shot_id, face_id, fc.box a, tg.box b FROM fc JOIN tg ON fc.shot_id = tg.shot_id), o AS (SELECT *, greatest(least(a[1] + a[3], b[1] + b[3]) - greatest(a[1], b[1]), 0)::DOUBLE * greatest(least(a[2] + a[4], b[2] + b[4]) - greatest(a[2], b[2]), 0) i, a[3]::DOUBLE * a[4] + b[3]::DOUBLE * b[4] u FROM p),
    r AS (SELECT shot_id, face_id, coalesce(CASE WHEN u - i > 0 THEN i / (u - i) END, 0) iou FROM o), k AS (SELECT *, row_number() OVER (PARTITION BY shot_id ORDER BY iou DESC, face_id) n FROM r) SELECT shot_id, face_id, round(iou, 6) iou FROM k WHERE n = 1 AND iou >= 0.1""",
)
def best_target_face(spark: SparkSession, d: str) -> DataFrame:
    faces = latest(table(spark, d, "face_observations"), "face_id", "ingested_at", ["shot_id", "box"]).where("shot_id IS NOT NULL")
    targets = latest(table(spark, d, "shots"), "shot_id", "ingested_at", ["target_face_box"]).where("target_face_box IS NOT NULL").withColumnRenamed("target_face_box", "box")
    return md.best_target_face(faces, targets, ["shot_id"], "face_id").select("shot_id", "face_id", F.round("iou", 6).alias("iou"))


@query(
    "clip_representatives",
    f"WITH {CLIPS}, u AS (SELECT coalesce(nullif(trim(line_id), ''), nullif(trim(shot_id), ''), clip_id) unit, clip_id, -(pos % 7)::DOUBLE lv FROM cl), k AS (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY lv DESC, clip_id) n FROM u) SELECT unit, clip_id, lv AS peak FROM k WHERE n = 1",
)
def clip_representatives(spark: SparkSession, d: str) -> DataFrame:
    rows = clips(spark, d).select("clip_id", md.clip_unit(F.col("line_id"), F.col("shot_id"), F.col("clip_id")).alias("unit"), (-(F.col("pos") % 7)).cast("double").alias("peak"))
    return md.representatives(rows, "unit", "clip_id", "peak")


STREAMS = "st AS (SELECT l_orderkey k, l_linenumber i, CASE WHEN l_orderkey % 3 = 0 THEN 1 ELSE CAST(l_quantity AS INT) % 8 END c, CASE CAST(l_quantity AS INT) % 9 WHEN 0 THEN 'Stereo' WHEN 1 THEN '5.1(side)' ELSE '' END y FROM lineitem)"


@query(
    "stereo_program",
    f"""WITH {STREAMS}, g AS (SELECT k, count(*) n, list(i ORDER BY i) ix, list(c ORDER BY i) cs, min(i) FILTER (c = 2 OR lower(y) = 'stereo') s2, min(i) FILTER (c >= 6 OR lower(y) LIKE '%5.1%') s6 FROM st GROUP BY 1),
    f AS (SELECT *, n >= 6 AND list_max(list_slice(cs, 1, 6)) = 1 AND list_min(list_slice(cs, 1, 6)) = 1 m6, n >= 8 AND list_max(list_slice(cs, 1, 8)) = 1 AND list_min(list_slice(cs, 1, 8)) = 1 m8 FROM g)
    SELECT k, CASE WHEN m8 THEN 'first_mono_pair_2_0_program' WHEN s2 IS NOT NULL THEN 'stereo_stream' WHEN s6 IS NOT NULL THEN 'downmix_5_1_stream' WHEN m6 THEN 'downmix_six_mono_5_1' ELSE 'first_audio_stream_to_stereo' END choice,
    array_to_string(CASE WHEN m8 THEN list_slice(ix, 1, 2) WHEN s2 IS NOT NULL THEN [s2] WHEN s6 IS NOT NULL THEN [s6] WHEN m6 THEN list_slice(ix, 1, 6) ELSE list_slice(ix, 1, 1) END, ',') indices FROM f""",
)
def stereo_program(spark: SparkSession, d: str) -> DataFrame:
    q = F.col("l_quantity").cast("int")
    channels, layout = F.when(F.col("l_orderkey") % 3 == 0, 1).otherwise(q % 8), F.when(q % 9 == 0, "Stereo").when(q % 9 == 1, "5.1(side)").otherwise("")
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("index"), channels.alias("channels"), layout.alias("layout"))
    return md.stereo_program(rows, ["k"]).select("k", "choice", F.array_join(F.transform("indices", lambda i: i.cast("string")), ",").alias("indices"))


@query(
    "residual_ambience",
    f"""WITH {LINES}, {SHOTS}, cv AS (SELECT reel_id, start_ms s, end_ms e FROM ln), am AS (SELECT reel_id, start_ms s, end_ms e FROM sh WHERE start_ms % 3 = 0), tt AS (SELECT reel_id, max(e) t FROM (SELECT * FROM cv UNION ALL SELECT reel_id, start_ms, end_ms FROM sh) GROUP BY 1),
    ge AS (SELECT reel_id, s, e FROM cv UNION ALL SELECT reel_id, t, t FROM tt), gp AS (SELECT reel_id, greatest(0, coalesce(max(e) OVER (PARTITION BY reel_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) f, s FROM ge),
    al AS (SELECT reel_id, f s, s e FROM gp WHERE s > f UNION ALL SELECT * FROM am), fl AS (SELECT *, CASE WHEN s > coalesce(max(e) OVER (PARTITION BY reel_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) THEN 1 ELSE 0 END w FROM al),
    nm AS (SELECT *, sum(w) OVER (PARTITION BY reel_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) n FROM fl) SELECT reel_id, min(s) "start", max(e) "end" FROM nm GROUP BY reel_id, n""",
)
def residual_ambience(spark: SparkSession, d: str) -> DataFrame:
    spans = lambda rows: rows.select("reel_id", F.col("start_ms").alias("start"), F.col("end_ms").alias("end"))
    covered, own = spans(lines(spark, d)), spans(shots(spark, d))
    totals = covered.unionByName(own).groupBy("reel_id").agg(F.max("end").alias("total"))
    return sq.residual_ambience(own.where("start % 3 = 0"), covered, totals, ["reel_id"])


@query(
    "scene_markers",
    f"WITH {SHOTS} SELECT reel_id, 'SC' || shot_id AS name, greatest(0, CAST(round_even(start_ms / 1000.0::DOUBLE * 24, 0) AS BIGINT)) start_frame, greatest(1, CAST(round_even((end_ms / 1000.0::DOUBLE - start_ms / 1000.0::DOUBLE) * 24, 0) AS BIGINT)) frames, 'PURPLE' color FROM sh",
)
def scene_markers(spark: SparkSession, d: str) -> DataFrame:
    rows = shots(spark, d).select("reel_id", F.col("shot_id").alias("scene_id"), (F.col("start_ms") / 1000).alias("scene_start"), (F.col("end_ms") / 1000).alias("scene_end"), F.array("shot_id").alias("shot_ids"))
    return tl.scene_markers(rows, ["reel_id"], 24.0).select("reel_id", "name", "start_frame", "frames", "color")


@query(
    "segment_labels",
    """WITH w AS (SELECT l_orderkey k, l_linenumber w, l_returnflag label, CAST(l_discount AS DOUBLE) s FROM lineitem), m AS (SELECT k, label, sum(s) t FROM w GROUP BY 1, 2), c AS (SELECT k, count(DISTINCT w) n FROM w GROUP BY 1),
    r AS (SELECT m.k, label, t / n p, row_number() OVER (PARTITION BY m.k ORDER BY round(t / n, 9) DESC, label) o FROM m JOIN c ON c.k = m.k) SELECT o_orderkey k, coalesce(label, 'ambience') label, round(coalesce(p, 0), 6) confidence FROM orders LEFT JOIN r ON r.k = o_orderkey AND o = 1""",
)
def segment_labels(spark: SparkSession, d: str) -> DataFrame:
    windows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("window"), F.col("l_returnflag").alias("label"), F.col("l_discount").cast("double").alias("score"))
    return md.segment_labels(windows, table(spark, d, "orders").select(F.col("o_orderkey").alias("k")), ["k"]).select("k", "label", F.round("confidence", 6).alias("confidence"))
