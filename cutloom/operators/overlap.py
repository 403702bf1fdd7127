"""Joins on time: overlapping intervals, a moment's interval, lines crossing a cut."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Width of the time buckets of an overlap join, in the unit of the bounds (milliseconds in the queries).
BUCKET = 10_000


def overlap(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Length of the shared stretch, 0 where there is none."""
    return F.greatest(F.lit(0), F.least(a_end, b_end) - F.greatest(a_start, b_start))


def overlap_join(left: DataFrame, right: DataFrame, on: list[str], left_bounds: tuple[str, str], right_bounds: tuple[str, str], bucket: int = BUCKET) -> DataFrame:
    """Pairs of rows, equal in `on`, whose intervals share more than a point: all columns of both and overlap.

    Both sides are spread over time buckets and joined on them, so the join is an equi-join that hashes or sorts and
    splits a large entity; a pair is kept only in the first bucket both have. Column names of the sides must differ
    except for `on`. Rows with null bounds or a null key have no partner.
    """
    (ls, le), (rs, re) = left_bounds, right_bounds
    first = lambda c: F.floor(F.col(c) / bucket)
    spread = lambda df, s, e: df.where(F.col(e) > F.col(s)).withColumn("__k", F.explode(F.sequence(first(s), F.floor((F.col(e) - 1e-9) / bucket))))
    pairs = spread(left, ls, le).join(spread(right, rs, re), [*on, "__k"])
    pairs = pairs.where((F.col(ls) < F.col(re)) & (F.col(rs) < F.col(le)) & (F.col("__k") == F.greatest(first(ls), first(rs))))
    return pairs.drop("__k").withColumn("overlap", overlap(F.col(ls), F.col(le), F.col(rs), F.col(re)))


def line_shot_overlaps(lines: DataFrame, shots: DataFrame, on: list[str]) -> DataFrame:
    """Each line with its overlapping shots in the order of their starts: shot_overlaps array<struct>; empty for none."""
    pairs = overlap_join(lines, shots, on, ("start_ms", "end_ms"), ("shot_start_ms", "shot_end_ms"))
    item = F.struct(
        F.greatest("start_ms", "shot_start_ms").alias("overlap_start_ms"), F.col("shot_id"), F.least("end_ms", "shot_end_ms").alias("overlap_end_ms"),
        (F.col("overlap") / F.greatest(F.lit(1), F.col("end_ms") - F.col("start_ms"))).alias("overlap_ratio"),
    )
    nested = pairs.groupBy("line_id").agg(F.array_sort(F.collect_list(item)).alias("shot_overlaps"))
    return lines.join(nested, "line_id", "left").withColumn("shot_overlaps", F.coalesce("shot_overlaps", F.array().cast(nested.schema["shot_overlaps"].dataType)))


def best_clip_by_line(plan: DataFrame) -> DataFrame:
    """The matched clip of greatest score of each line; the first by pos on ties. Null and blank lines are left out."""
    w = Window.partitionBy("line_id").orderBy(F.desc(F.coalesce("score", F.lit(0.0))), "pos")
    return plan.where("status = 'matched' AND line_id IS NOT NULL AND line_id != ''").withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def map_dialogue_to_shots(lines: DataFrame, shots: DataFrame, plan: DataFrame, on: list[str], on_screen: str, least_ratio: float = 0.01) -> DataFrame:
    """Every shot's lines with the line's best clip and a status.

    A line counts from a share of its length upwards. The status is the clip's, unresolved where there is none, and
    offscreen_speaker where a matched speaker isn't among the shot's speakers (`on_screen`: an array; empty matches all).
    """
    from cutloom.functions.names import matches_on_screen

    best = best_clip_by_line(plan).select("line_id", F.col("speaker").alias("clip_speaker"), "stem_path", "source_group", F.col("score").alias("clip_score"), F.col("status").alias("clip_status"))
    pairs = overlap_join(shots, lines, on, ("shot_start_ms", "shot_end_ms"), ("start_ms", "end_ms"))
    pairs = pairs.withColumn("overlap_ratio", F.col("overlap") / F.greatest(F.lit(1), F.col("end_ms") - F.col("start_ms"))).where(F.col("overlap_ratio") >= least_ratio)
    rows = pairs.join(best, "line_id", "left").withColumn("speaker", F.coalesce(F.nullif("clip_speaker", F.lit("")), "speaker"))
    rows = rows.withColumn("on_screen_match", matches_on_screen(F.col("speaker"), F.col(on_screen)))
    status = F.when((F.col("clip_status") == "matched") & ~F.col("on_screen_match"), "offscreen_speaker").otherwise(F.coalesce("clip_status", F.lit("unresolved")))
    return rows.withColumn("status", status).withColumn("score", F.coalesce("clip_score", F.lit(0.0))).drop("clip_speaker", "clip_status", "clip_score")


def shot_plan(mappings: DataFrame, order: list[str]) -> DataFrame:
    """Each shot's matched mapping of greatest score, with the number of all its mappings."""
    count = mappings.groupBy("shot_id").agg(F.count(F.lit(1)).alias("candidate_count"))
    w = Window.partitionBy("shot_id").orderBy(F.desc("score"), *order)
    return mappings.where("status = 'matched'").withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n").join(count, "shot_id")


def shot_stems(mappings: DataFrame) -> DataFrame:
    """Per shot and speaker: its lines in order, stems, groups, greatest score and joined text."""
    from cutloom.functions.names import speaker_key

    item = F.struct("overlap_start_ms", "line_id", "text")
    rows = mappings.where("status = 'matched'").withColumn("speaker_key", speaker_key(F.col("speaker")))
    out = rows.groupBy("shot_id", "speaker_key").agg(
        F.array_sort(F.collect_list(item)).alias("items"), F.array_sort(F.collect_set("stem_path")).alias("stems"), F.array_sort(F.collect_set("source_group")).alias("groups"), F.max("score").alias("score")
    )
    return out.select("shot_id", "speaker_key", F.transform("items", lambda x: x["line_id"]).alias("line_ids"), F.array_join(F.transform("items", lambda x: x["text"]), " ").alias("text"), "stems", "groups", "score")


def crossing_spans(shots: DataFrame, lines: DataFrame, on: list[str], margin_ms: int = 40) -> DataFrame:
    """Whether a line runs over the end of each shot by the margin on both sides (1 or 0); the last shot's end never counts."""
    cut = shots.withColumn("__cut", F.lead("shot_start_ms").over(Window.partitionBy(*on).orderBy("shot_start_ms", "shot_id")).isNotNull())
    cut = cut.withColumn("cut_from", F.when(F.col("__cut"), F.col("shot_end_ms") - margin_ms)).withColumn("cut_to", F.col("cut_from") + 2 * margin_ms)
    spans = lines.select(*on, F.col("start_ms").alias("l_start"), F.col("end_ms").alias("l_end")).where("l_end > l_start")
    hit = overlap_join(cut.select("shot_id", *on, "cut_from", "cut_to"), spans, on, ("cut_from", "cut_to"), ("l_start", "l_end"))
    hit = hit.where("l_start < cut_from AND l_end > cut_to").select("shot_id").distinct()
    return cut.join(hit.withColumn("span", F.lit(1)), "shot_id", "left").select("shot_id", *on, F.coalesce("span", F.lit(0)).alias("span"))


def scene_for_time(moments: DataFrame, scenes: DataFrame, on: list[str], moment: str) -> DataFrame:
    """The scene of each moment: the one that holds it, the first for moments before all, else the last (gaps too)."""
    first = scenes.groupBy(*on).agg(F.min(F.struct("scene_start", "scene_id")).alias("__first"), F.max(F.struct("scene_start", "scene_id")).alias("__last"))
    w = Window.partitionBy(*on).orderBy("__t", "__kind").rowsBetween(Window.unboundedPreceding, 0)
    kept = moments.columns
    marks = scenes.select(*on, F.col("scene_start").alias("__t"), F.lit(0).alias("__kind"), F.struct("scene_id", "scene_end").alias("__scene"))
    both = moments.withColumn("__t", F.col(moment)).withColumn("__kind", F.lit(1)).unionByName(marks, allowMissingColumns=True)
    both = both.withColumn("__scene", F.last("__scene", ignorenulls=True).over(w)).where("__kind = 1").join(first, on, "left")
    inside = F.when(F.col("__t") < F.col("__scene")["scene_end"], F.col("__scene")["scene_id"])
    before = F.when(F.col("__t") < F.col("__first")["scene_start"], F.col("__first")["scene_id"])
    return both.select(*kept, F.coalesce(inside, before, F.col("__last")["scene_id"]).alias("scene_id"))
