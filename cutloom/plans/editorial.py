"""Queries on lines, shots and clips: overlaps, maps, sessions, islands, scenes, lanes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cutloom.functions.names import speaker_list
from cutloom.functions.levels import truthy
from cutloom.operators import overlap as ov
from cutloom.operators import sequences as sq
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


def _shots(spark: SparkSession, d: str) -> DataFrame:
    return shots(spark, d).select("shot_id", "reel_id", "existing_speaker", F.col("start_ms").alias("shot_start_ms"), F.col("end_ms").alias("shot_end_ms"))


PAIRS = """pr AS (SELECT s.shot_id, l.line_id, s.reel_id, l.start_ms, l.end_ms, s.start_ms ss, s.end_ms se, s.existing_speaker, l.speaker, l.text,
    least(s.end_ms, l.end_ms) - greatest(s.start_ms, l.start_ms) overlap FROM sh s JOIN ln l ON s.reel_id = l.reel_id AND l.start_ms < s.end_ms AND s.start_ms < l.end_ms)"""


@query("overlap_join", f"WITH {LINES}, {SHOTS}, {PAIRS} SELECT shot_id, line_id, overlap overlap_ms FROM pr")
def overlap_pairs(spark: SparkSession, d: str) -> DataFrame:
    pairs = ov.overlap_join(_shots(spark, d), lines(spark, d), ["reel_id"], ("shot_start_ms", "shot_end_ms"), ("start_ms", "end_ms"))
    return pairs.select("shot_id", "line_id", F.col("overlap").alias("overlap_ms"))


@query(
    "line_shot_overlaps",
    f"""WITH {LINES}, {SHOTS}, {PAIRS} SELECT l.line_id, count(p.shot_id) shots, coalesce(string_agg(p.shot_id, ' ' ORDER BY greatest(p.ss, p.start_ms), p.shot_id), '') shot_ids,
    round(coalesce(sum(p.overlap / greatest(1, p.end_ms - p.start_ms)), 0), 6) covered FROM ln l LEFT JOIN pr p ON p.line_id = l.line_id GROUP BY 1""",
)
def nested_overlaps(spark: SparkSession, d: str) -> DataFrame:
    rows = ov.line_shot_overlaps(lines(spark, d), _shots(spark, d), ["reel_id"])
    total = F.aggregate("shot_overlaps", F.lit(0.0), lambda s, x: s + x["overlap_ratio"])
    return rows.select("line_id", F.size("shot_overlaps").cast("bigint").alias("shots"), F.array_join(F.transform("shot_overlaps", lambda x: x["shot_id"]), " ").alias("shot_ids"), F.round(total, 6).alias("covered"))


def _plan(spark: SparkSession, d: str) -> DataFrame:
    """A clip plan: kept clips are matched to the speaker of their group, scored by their length."""
    rows = clips(spark, d)
    return rows.select("clip_id", "line_id", "pos", F.upper("source_group").alias("speaker"), F.col("path").alias("stem_path"), "source_group", F.coalesce((F.col("end_ms") - F.col("start_ms")) / 1000, F.lit(0.0)).alias("score"), F.when(truthy(F.col("kept")), "matched").otherwise("unresolved").alias("status"))


PLAN = "pl AS (SELECT clip_id, line_id, pos, upper(source_group) speaker, path stem_path, source_group, coalesce((end_ms - start_ms) / 1000, 0.0) score, CASE WHEN coalesce(lower(trim(kept)) NOT IN ('', '0', 'false', 'no', 'n'), false) THEN 'matched' ELSE 'unresolved' END status FROM cl)"
BEST = "be AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY line_id ORDER BY score DESC, pos) n FROM pl WHERE status = 'matched' AND line_id IS NOT NULL AND line_id != '') WHERE n = 1)"


@query("best_clip_by_line", f"WITH {CLIPS}, {PLAN}, {BEST} SELECT line_id, clip_id, round(score, 6) score FROM be")
def best_clips(spark: SparkSession, d: str) -> DataFrame:
    return ov.best_clip_by_line(_plan(spark, d)).select("line_id", "clip_id", F.round("score", 6).alias("score"))


def _map(spark: SparkSession, d: str) -> DataFrame:
    s = _shots(spark, d).withColumn("on_screen", F.filter(speaker_list(F.coalesce("existing_speaker", F.lit("")), upper=True), lambda x: x.startswith("DX")))
    return ov.map_dialogue_to_shots(lines(spark, d).select("line_id", "reel_id", "start_ms", "end_ms", "text", "speaker"), s, _plan(spark, d), ["reel_id"], "on_screen")


MAP = """mp AS (SELECT p.shot_id, p.line_id, p.start_ms, greatest(p.ss, p.start_ms) o, p.overlap / greatest(1, p.end_ms - p.start_ms) ratio, coalesce(b.status, 'unresolved') status,
    coalesce(nullif(b.speaker, ''), p.speaker) speaker, coalesce(b.score, 0.0) score, b.stem_path FROM pr p LEFT JOIN be b ON b.line_id = p.line_id WHERE p.overlap / greatest(1, p.end_ms - p.start_ms) >= 0.01)"""


@query("dialogue_map", f"WITH {LINES}, {SHOTS}, {CLIPS}, {PLAN}, {BEST}, {PAIRS}, {MAP} SELECT shot_id, line_id, speaker, status, round(score, 6) score, round(ratio, 6) ratio FROM mp")
def dialogue_map(spark: SparkSession, d: str) -> DataFrame:
    return _map(spark, d).select("shot_id", "line_id", "speaker", "status", F.round("score", 6).alias("score"), F.round("overlap_ratio", 6).alias("ratio"))


@query(
    "shot_plan",
    f"""WITH {LINES}, {SHOTS}, {CLIPS}, {PLAN}, {BEST}, {PAIRS}, {MAP} SELECT shot_id, line_id, speaker, stem_path, candidate_count FROM (
    SELECT *, count(*) OVER (PARTITION BY shot_id) candidate_count FROM mp) WHERE status = 'matched' QUALIFY row_number() OVER (PARTITION BY shot_id ORDER BY score DESC, start_ms, line_id) = 1""",
)
def shot_plan(spark: SparkSession, d: str) -> DataFrame:
    return ov.shot_plan(_map(spark, d), ["start_ms", "line_id"]).select("shot_id", "line_id", "speaker", "stem_path", "candidate_count")


@query("shot_stems")
def shot_stems(spark: SparkSession, d: str) -> DataFrame:
    return ov.shot_stems(_map(spark, d).withColumn("overlap_start_ms", F.greatest("shot_start_ms", "start_ms")))


@query(
    "dialogue_span_semi",
    f"""WITH {LINES}, {SHOTS}, cut AS (SELECT *, lead(start_ms) OVER (PARTITION BY reel_id ORDER BY start_ms, shot_id) nx FROM sh)
    SELECT shot_id, reel_id, CAST(nx IS NOT NULL AND EXISTS (SELECT 1 FROM ln l WHERE l.reel_id = cut.reel_id AND l.start_ms < cut.end_ms - 40 AND l.end_ms > cut.end_ms + 40) AS INTEGER) span FROM cut""",
)
def dialogue_spans(spark: SparkSession, d: str) -> DataFrame:
    return ov.crossing_spans(_shots(spark, d), lines(spark, d), ["reel_id"])


def _words(spark: SparkSession, d: str) -> DataFrame:
    rows = lines(spark, d).withColumn("pos", F.col("line_id"))
    return rows.select("reel_id", "pos", F.col("start_ms").alias("start"), F.col("end_ms").alias("end"), "text", F.col("diarized_speaker").alias("speaker"), "transcription_source", "review_required")


SESSIONS = f"""{LINES}, w AS (SELECT *, nullif(trim(diarized_speaker), '') who, CASE WHEN start_ms - lag(end_ms) OVER o <= 500 THEN 0 ELSE 1 END g FROM ln WINDOW o AS (PARTITION BY reel_id ORDER BY start_ms, line_id)),
    w2 AS (SELECT *, sum(g) OVER (PARTITION BY reel_id ORDER BY start_ms, line_id ROWS UNBOUNDED PRECEDING) st FROM w),
    w3 AS (SELECT *, last_value(who IGNORE NULLS) OVER (PARTITION BY reel_id, st ORDER BY start_ms, line_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) known FROM w2),
    w4 AS (SELECT *, sum(CASE WHEN g = 1 OR (who IS NOT NULL AND known IS NOT NULL AND who != known) THEN 1 ELSE 0 END) OVER (PARTITION BY reel_id ORDER BY start_ms, line_id ROWS UNBOUNDED PRECEDING) grp FROM w3)"""


@query(
    "sessionize_gap_speaker",
    f"""WITH {SESSIONS} SELECT reel_id, CAST(grp AS BIGINT) group_no, min(start_ms) "start", arg_max(end_ms, (start_ms, line_id)) "end", count(*) n_words, coalesce(min(who), '') speaker,
    CASE WHEN count(DISTINCT nullif(transcription_source, '')) > 1 THEN 'mixed' ELSE coalesce(min(nullif(transcription_source, '')), '') END transcription_source, bool_or(coalesce(review_required, false)) review_required
    FROM w4 GROUP BY 1, 2""",
)
def sessions(spark: SparkSession, d: str) -> DataFrame:
    return sq.group_words(_words(spark, d), ["reel_id"], 500).drop("text").withColumn("n_words", F.col("n_words").cast("bigint"))


@query("dialogue_line_ids", f"WITH {LINES} SELECT line_id, reel_id, 'DL_' || lpad(CAST(row_number() OVER (PARTITION BY reel_id ORDER BY start_ms, line_id) AS VARCHAR), 6, '0') dl_id FROM ln")
def line_numbers(spark: SparkSession, d: str) -> DataFrame:
    return sq.numbered_ids(lines(spark, d), ["reel_id"], ["start_ms", "line_id"], name="dl_id").select("line_id", "reel_id", "dl_id")


def _segments(spark: SparkSession, d: str) -> DataFrame:
    return lines(spark, d).select("reel_id", F.col("start_ms").alias("start"), F.col("end_ms").alias("end"))


MERGED = f"""{LINES}, f AS (SELECT reel_id, start_ms s, end_ms e, max(end_ms) OVER (PARTITION BY reel_id ORDER BY start_ms, end_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) far FROM ln),
    g AS (SELECT *, sum(CASE WHEN far IS NULL OR s - far > 300 THEN 1 ELSE 0 END) OVER (PARTITION BY reel_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) n FROM f),
    mg AS (SELECT reel_id, min(s) s, max(e) e FROM g GROUP BY reel_id, n HAVING max(e) - min(s) >= 800)"""


@query("interval_union", f'WITH {MERGED} SELECT reel_id, s "start", e "end" FROM mg')
def interval_union(spark: SparkSession, d: str) -> DataFrame:
    return sq.merge_segments(_segments(spark, d), ["reel_id"], 300, 800)


GAPS = f"""{MERGED}, tot AS (SELECT reel_id, max(end_ms) + 1000 total FROM ln GROUP BY 1), al AS (SELECT reel_id, s, e FROM mg UNION ALL SELECT reel_id, total, total FROM tot),
    gp AS (SELECT a.reel_id, coalesce(max(e) OVER (PARTITION BY a.reel_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) f, least(s, total) t FROM al a JOIN tot USING (reel_id))"""


def _gaps(spark: SparkSession, d: str) -> DataFrame:
    totals = _segments(spark, d).groupBy("reel_id").agg((F.max("end") + 1000).alias("total"))
    return sq.gap_segments(sq.merge_segments(_segments(spark, d), ["reel_id"], 300, 800), totals, ["reel_id"], 250)


@query("interval_gaps", f'WITH {GAPS} SELECT reel_id, f "start", t "end" FROM gp WHERE t > f AND t - f >= 250')
def interval_gaps(spark: SparkSession, d: str) -> DataFrame:
    return _gaps(spark, d)


@query("inset_gaps", f'WITH {GAPS} SELECT reel_id, f + 100 "start", t - 100 "end" FROM gp WHERE t - f >= 250 AND t - f - 200 > 0 AND t - f - 200 >= 400')
def inset_gaps(spark: SparkSession, d: str) -> DataFrame:
    return sq.inset_gaps(_gaps(spark, d), 100, 400)


@query(
    "infer_windows",
    """WITH b AS (SELECT line_id, max_by(struct_pack(r := reel_id, s := start_sec, e := end_sec), ingested_at) x FROM dialogue_lines WHERE line_id IS NOT NULL GROUP BY 1),
    t AS (SELECT line_id, x.r reel_id, CAST(round(x.s * 1000) AS BIGINT) s, CASE WHEN NOT isnan(x.e) THEN CAST(round(x.e * 1000) AS BIGINT) END e FROM b WHERE x.r IS NOT NULL AND x.s >= 0 AND NOT isnan(x.s)),
    n AS (SELECT *, CASE WHEN e > s THEN e ELSE least(coalesce(lead(s) OVER (PARTITION BY reel_id ORDER BY s, line_id), s + 3000), s + 3000) END e2 FROM t)
    SELECT line_id, reel_id, s start_ms, CASE WHEN e2 - s < 300 THEN s + 300 ELSE e2 END end_ms FROM n""",
)
def infer_windows(spark: SparkSession, d: str) -> DataFrame:
    from cutloom.common import latest, table, whole_ms

    rows = latest(table(spark, d, "dialogue_lines"), "line_id", "ingested_at", ["reel_id", "start_sec", "end_sec"]).where("reel_id IS NOT NULL AND start_sec >= 0 AND NOT isnan(start_sec)")
    rows = rows.select("line_id", "reel_id", F.col("line_id").alias("pos"), whole_ms("start_sec").alias("start"), whole_ms("end_sec").alias("end"))
    return sq.infer_windows(rows, ["reel_id"], 3000, 300).select("line_id", "reel_id", F.col("start").alias("start_ms"), F.col("end").alias("end_ms"))


@query(
    "refine_cut_windows",
    f"""WITH {LINES}, {SHOTS}, h AS (SELECT l.line_id, min(s.start_ms) a, max(s.end_ms) b FROM ln l JOIN sh s ON s.reel_id = l.reel_id AND s.start_ms < l.end_ms AND l.start_ms < s.end_ms GROUP BY 1)
    SELECT l.line_id, CASE WHEN a IS NULL THEN greatest(0, start_ms - 180) ELSE greatest(0, least(greatest(0, start_ms - 180), greatest(a, start_ms - 600))) END cut_start,
    CASE WHEN a IS NULL THEN greatest(greatest(0, start_ms - 180), end_ms + 180) ELSE greatest(greatest(greatest(0, start_ms - 180), end_ms + 180), least(b, end_ms + 600)) END cut_end FROM ln l LEFT JOIN h USING (line_id)""",
)
def refine_cut_windows(spark: SparkSession, d: str) -> DataFrame:
    own = lines(spark, d).select("line_id", "reel_id", F.col("start_ms").alias("start"), F.col("end_ms").alias("end"))
    islands = shots(spark, d).select("reel_id", F.col("start_ms").alias("start"), F.col("end_ms").alias("end"))
    return sq.refine_windows(own, islands, ["reel_id"], 180, 600).select("line_id", "cut_start", "cut_end")


def _scored(spark: SparkSession, d: str) -> DataFrame:
    rows = shots(spark, d).withColumn("score", F.round((F.col("end_ms") - F.col("start_ms")) / 19_997, 6))
    return sq.assign_scenes(rows, ["reel_id"], ["start_ms", "shot_id"], "score", 0.6)


SCENES = f"""{SHOTS}, sc AS (SELECT *, round((end_ms - start_ms) / 19997, 6) score FROM sh),
    asg AS (SELECT *, 1 + coalesce(sum(CASE WHEN score >= 0.6 THEN 1 ELSE 0 END) OVER (PARTITION BY reel_id ORDER BY start_ms, shot_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) scene FROM sc),
    rol AS (SELECT reel_id, scene, lpad(CAST(scene AS VARCHAR), CAST(greatest(3, length(CAST(scene AS VARCHAR))) AS INTEGER), '0') scene_id, count(*) shot_count, arg_min(start_ms, (start_ms, shot_id)) scene_start, arg_max(end_ms, (start_ms, shot_id)) scene_end,
    string_agg(shot_id, ' ' ORDER BY start_ms, shot_id) shot_ids, round(arg_max(score, (start_ms, shot_id)), 6) boundary_score FROM asg GROUP BY 1, 2)"""


@query("scene_assign", f"WITH {SCENES} SELECT shot_id, reel_id, CAST(scene AS BIGINT) scene FROM asg")
def scene_assign(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).select("shot_id", "reel_id", "scene")


@query("scene_rollup", f"WITH {SCENES} SELECT reel_id, CAST(scene AS BIGINT) scene, scene_id, CAST(shot_count AS INTEGER) shot_count, scene_start, scene_end, shot_ids, boundary_score FROM rol")
def scene_rollup(spark: SparkSession, d: str) -> DataFrame:
    return sq.scene_rollup(_scored(spark, d), ["reel_id"], ["start_ms", "shot_id"], "score", 6)


@query(
    "scene_for_time",
    f"""WITH {SCENES}, {LINES} SELECT l.line_id, coalesce((SELECT max_by(r.scene_id, r.scene_start) FROM rol r WHERE r.reel_id = l.reel_id AND r.scene_start <= l.start_ms AND l.start_ms < r.scene_end
        AND r.scene_start = (SELECT max(q.scene_start) FROM rol q WHERE q.reel_id = l.reel_id AND q.scene_start <= l.start_ms)),
      CASE WHEN l.start_ms < (SELECT min(scene_start) FROM rol r WHERE r.reel_id = l.reel_id) THEN (SELECT min_by(scene_id, (scene_start, scene_id)) FROM rol r WHERE r.reel_id = l.reel_id) END,
      (SELECT max_by(scene_id, (scene_start, scene_id)) FROM rol r WHERE r.reel_id = l.reel_id)) scene_id FROM ln l""",
)
def scene_of_lines(spark: SparkSession, d: str) -> DataFrame:
    scenes = sq.scene_rollup(_scored(spark, d), ["reel_id"], ["start_ms", "shot_id"], "score").select("reel_id", "scene_id", "scene_start", "scene_end")
    return ov.scene_for_time(lines(spark, d).select("line_id", "reel_id", "start_ms"), scenes, ["reel_id"], "start_ms").select("line_id", "scene_id")


@query("lane_assign")
def lane_assign(spark: SparkSession, d: str) -> DataFrame:
    placed = lines(spark, d).select("reel_id", "source_group", F.rint(F.col("start_ms") * 0.024).cast("bigint").alias("start_frame"), F.rint(F.col("end_ms") * 0.024).cast("bigint").alias("end_frame"), F.col("line_id").alias("clip"))
    return sq.assign_lanes(placed, ["reel_id"])


@query(
    "dialogue_groups",
    f"""WITH {LINES} SELECT reel_id, coalesce(speaker, '') speaker, CAST(sum(end_ms - start_ms) AS BIGINT) total, CAST(row_number() OVER (PARTITION BY reel_id ORDER BY coalesce(speaker, '') = '', -sum(end_ms - start_ms), coalesce(speaker, '')) AS INTEGER) place FROM ln GROUP BY 1, 2""",
)
def dialogue_groups(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    rows = lines(spark, d).groupBy("reel_id", F.coalesce("speaker", F.lit("")).alias("speaker")).agg(F.sum(F.col("end_ms") - F.col("start_ms")).alias("total"))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("reel_id").orderBy(F.col("speaker") == "", F.desc("total"), "speaker")))


@query(
    "timeline_gaps",
    f"""WITH {SHOTS}, p AS (SELECT reel_id, shot_id, CAST(round_even(start_ms * 0.024, 0) AS BIGINT) s, greatest(1, CAST(round_even((end_ms - start_ms) * 0.024, 0) AS BIGINT)) n FROM sh),
    o AS (SELECT *, max(s + n) OVER (PARTITION BY reel_id ORDER BY s, s + n, shot_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) far FROM p)
    SELECT reel_id, shot_id, s start_frame, n frames, greatest(0, s - coalesce(far, 0)) gap_before FROM o""",
)
def timeline_gaps(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    rows = shots(spark, d).select("reel_id", "shot_id", F.greatest(F.lit(0), F.rint(F.col("start_ms") * 0.024)).cast("bigint").alias("start_frame"), F.greatest(F.lit(1), F.rint((F.col("end_ms") - F.col("start_ms")) * 0.024)).cast("bigint").alias("frames"))
    w = Window.partitionBy("reel_id").orderBy("start_frame", F.col("start_frame") + F.col("frames"), "shot_id").rowsBetween(Window.unboundedPreceding, -1)
    far = F.max(F.col("start_frame") + F.col("frames")).over(w)
    return rows.withColumn("gap_before", F.greatest(F.lit(0), F.col("start_frame") - F.coalesce(far, F.lit(0))))


@query(
    "status_report",
    f"WITH {LINES}, {SHOTS}, {CLIPS}, {PLAN}, {BEST}, {PAIRS}, {MAP} SELECT coalesce(speaker, 'all') speaker, coalesce(status, 'all') status, n FROM (SELECT coalesce(speaker, '') speaker, status, count(*) n FROM mp GROUP BY ROLLUP (coalesce(speaker, ''), status))",
)
def status_report(spark: SparkSession, d: str) -> DataFrame:
    rows = _map(spark, d).withColumn("speaker", F.coalesce("speaker", F.lit("")))
    return rows.rollup("speaker", "status").agg(F.count(F.lit(1)).alias("n")).select(F.coalesce("speaker", F.lit("all")).alias("speaker"), F.coalesce("status", F.lit("all")).alias("status"), "n")


@query(
    "range_validation",
    f"""WITH {SHOTS}, r AS (SELECT reel_id, shot_id, CAST(round_even(start_ms * 0.024, 0) AS BIGINT) s, CAST(round_even(end_ms * 0.024, 0) AS BIGINT) e FROM sh), t AS (SELECT reel_id, max(e) - 24 total FROM r GROUP BY 1),
    x AS (SELECT *, lag(least(e, total)) OVER (PARTITION BY reel_id ORDER BY s, e, shot_id) b FROM r JOIN t USING (reel_id))
    SELECT reel_id, shot_id, problem, frames FROM (
     SELECT reel_id, shot_id, 'not_positive' problem, e - s frames FROM x WHERE e <= s UNION ALL SELECT reel_id, shot_id, 'beyond_end', s - total FROM x WHERE s >= total
     UNION ALL SELECT reel_id, shot_id, CASE WHEN e - total = 1 THEN 'clamped' ELSE 'past_end' END, e - total FROM x WHERE e > total
     UNION ALL SELECT reel_id, shot_id, 'overlap', b - s FROM x WHERE s < b UNION ALL SELECT reel_id, shot_id, 'uncovered', s - b FROM x WHERE s > b)""",
)
def range_validation(spark: SparkSession, d: str) -> DataFrame:
    rows = shots(spark, d).select("reel_id", "shot_id", F.rint(F.col("start_ms") * 0.024).cast("bigint").alias("start_frame"), F.rint(F.col("end_ms") * 0.024).cast("bigint").alias("end_frame"))
    totals = rows.groupBy("reel_id").agg((F.max("end_frame") - 24).alias("total"))
    return sq.range_problems(rows.join(totals, "reel_id"), ["reel_id"])
