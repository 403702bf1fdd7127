"""Operators on ordered rows: sessions, islands, unions and gaps of stretches, cuts, scenes, lanes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FIRST, HERE = Window.unboundedPreceding, 0


def _run(flag: Column, window) -> Column:
    return F.sum(flag.cast("int")).over(window.rowsBetween(FIRST, HERE))


def sessionize(words: DataFrame, by: list[str], max_gap: float, speaker: str = "speaker", order: tuple[str, ...] = ("start", "pos")) -> DataFrame:
    """Words with the number of their group (from 1): a new one after a gap over max_gap or at another speaker.

    The gap runs from the end of the word before, not from the greatest end. Blank speakers don't break a group and take
    on its speaker. A speaker can only be carried forward inside a stretch without gaps, so gaps are numbered first.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    named = F.nullif(F.trim(F.col(speaker)), F.lit(""))
    gap = F.lag("end").over(w).isNull() | (F.col("start") - F.lag("end").over(w) > max_gap)
    rows = words.where("start IS NOT NULL AND `end` IS NOT NULL").withColumn("__named", named).withColumn("__stretch", _run(gap, w))
    inside = Window.partitionBy(*by, "__stretch").orderBy(*order)
    known = F.last("__named", ignorenulls=True).over(inside.rowsBetween(FIRST, -1))
    change = F.row_number().over(inside) == 1
    change = change | (F.col("__named").isNotNull() & known.isNotNull() & (F.col("__named") != known))
    rows = rows.withColumn("__change", change)
    return rows.withColumn("group_no", _run(F.col("__change"), w)).drop("__stretch", "__change", "__named")


def group_words(words: DataFrame, by: list[str], max_gap: float) -> DataFrame:
    """Groups of words as lines: bounds (the end of the last word), text, speaker, source (mixed for several), review flag."""
    rows = sessionize(words, by, max_gap)
    item = F.struct("start", "pos", "end", "text", F.nullif(F.trim(F.col("speaker")), F.lit("")).alias("speaker"), F.nullif(F.col("transcription_source"), F.lit("")).alias("source"))
    out = rows.groupBy(*by, "group_no").agg(F.array_sort(F.collect_list(item)).alias("w"), F.bool_or(F.coalesce("review_required", F.lit(False))).alias("review_required"))
    first_of = lambda field: F.get(F.filter(F.transform("w", lambda x: x[field]), lambda x: x.isNotNull()), F.lit(0))
    sources = F.size(F.array_distinct(F.array_compact(F.transform("w", lambda x: x["source"]))))
    return out.select(
        *by, "group_no", F.get("w", F.lit(0))["start"].alias("start"), F.element_at("w", -1)["end"].alias("end"), F.size("w").alias("n_words"),
        F.array_join(F.transform("w", lambda x: F.trim(x["text"])), " ").alias("text"), F.coalesce(first_of("speaker"), F.lit("")).alias("speaker"),
        F.when(sources > 1, "mixed").otherwise(F.coalesce(first_of("source"), F.lit(""))).alias("transcription_source"), "review_required",
    )


def numbered_ids(df: DataFrame, by: list[str], order: list[str], form: str = "DL_%06d", name: str = "line_id") -> DataFrame:
    return df.withColumn(name, F.format_string(form, F.row_number().over(Window.partitionBy(*by).orderBy(*order))))


def level_islands(hops: DataFrame, by: list[str], threshold: float, min_silence: int, min_island: int, index: str = "i", level: str = "level") -> DataFrame:
    """Stretches of hops above the threshold: by, first hop, end (exclusive).

    An island ends when so many silent hops have passed since its last loud one; one hop less counts than the naive gap,
    as the hop that closes an island is compared before it is added. Islands shorter than min_island hops are dropped.
    """
    w = Window.partitionBy(*by).orderBy(index)
    loud = hops.where(F.col(level) > threshold)
    before = F.lag(index).over(w)
    new = before.isNull() | ((F.col(index) - 1) - (before + 1) >= min_silence)
    out = loud.withColumn("__n", _run(new, w)).groupBy(*by, "__n").agg(F.min(index).alias("first"), (F.max(index) + 1).alias("end"))
    return out.where(F.col("end") - F.col("first") >= min_island).drop("__n")


def activity_segments(hops: DataFrame, by: list[str], threshold: float, index: str = "i", level: str = "level") -> DataFrame:
    """Unbroken stretches of hops above the threshold: by, start, end (exclusive)."""
    w = Window.partitionBy(*by).orderBy(index)
    loud = hops.where(F.col(level) > threshold).withColumn("__g", F.col(index) - F.row_number().over(w))
    return loud.groupBy(*by, "__g").agg(F.min(index).alias("start"), (F.max(index) + 1).alias("end")).drop("__g")


def merge_segments(segments: DataFrame, by: list[str], merge_gap: float = 0, min_duration: float = 0) -> DataFrame:
    """Union of stretches, joined over gaps of at most merge_gap; unions shorter than min_duration are dropped."""
    w = Window.partitionBy(*by).orderBy("start", "end")
    far = F.max("end").over(w.rowsBetween(FIRST, -1))
    rows = segments.withColumn("__far", far).withColumn("__n", _run(F.col("__far").isNull() | (F.col("start") - F.col("__far") > merge_gap), w))
    out = rows.groupBy(*by, "__n").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("__n")
    return out.where(F.col("end") - F.col("start") >= min_duration)


def gap_segments(segments: DataFrame, totals: DataFrame, by: list[str], min_gap: float = 0) -> DataFrame:
    """What the stretches leave free of [0, total] of each entity (totals: by, total), from min_gap upwards."""
    ends = totals.select(*by, F.col("total").alias("start"), F.col("total").alias("end"))
    w = Window.partitionBy(*by).orderBy("start", "end").rowsBetween(FIRST, -1)
    rows = segments.select(*by, "start", "end").unionByName(ends).withColumn("__from", F.greatest(F.lit(0), F.coalesce(F.max("end").over(w), F.lit(0))))
    rows = rows.join(totals, by)
    out = rows.select(*by, F.col("__from").alias("start"), F.least("start", "total").alias("end"))
    return out.where((F.col("end") > F.col("start")) & (F.col("end") - F.col("start") >= min_gap))


def residual_ambience(ambience: DataFrame, covered: DataFrame, totals: DataFrame, by: list[str]) -> DataFrame:
    """Stretches of ambience: those marked so and what other stretches leave free of each entity, joined where they touch."""
    return merge_segments(ambience.select(*by, "start", "end").unionByName(gap_segments(covered, totals, by).select(*by, "start", "end")), by)


def merge_short_pieces(pieces: DataFrame, by: list[str], least: float) -> DataFrame:
    """Pieces that follow one another, those shorter than `least` joined to what follows, a short last one to what stands before: by, start, end.

    The pieces of one entity (the parts of one cue) are folded in order.
    """
    piece = pieces.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("p"))
    element = "struct<start:double,end:double>"
    ends = F.transform("p", lambda x: F.struct(x["start"].cast("double").alias("start"), x["end"].cast("double").alias("end")))
    seed = F.struct(F.array().cast(f"array<{element}>").alias("done"), F.get(ends, F.lit(0)).alias("now"))

    def step(state: Column, x: Column) -> Column:
        short = state["now"]["end"] - state["now"]["start"] < least
        joined = F.struct(F.when(short, state["now"]["start"]).otherwise(x["start"]).alias("start"), x["end"].alias("end"))
        return F.struct(F.when(short, state["done"]).otherwise(F.concat(state["done"], F.array(state["now"]))).alias("done"), joined.alias("now"))

    def close(state: Column) -> Column:
        done, now = state["done"], state["now"]
        short = (now["end"] - now["start"] < least) & (F.size(done) > 0)
        last = F.struct(F.get(done, F.size(done) - 1)["start"].alias("start"), now["end"].alias("end"))
        return F.when(short, F.concat(F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))), F.array(last))).otherwise(F.concat(done, F.array(now)))

    folded = F.aggregate(F.slice(ends, F.lit(2), F.greatest(F.size(ends) - 1, F.lit(0))), seed, step, close)
    return piece.select(*by, F.explode(folded).alias("x")).select(*by, "x.start", "x.end")


def inset_gaps(gaps: DataFrame, handle: float, min_gap: float) -> DataFrame:
    """Gaps shrunk on both sides; those shorter than min_gap afterwards are dropped."""
    out = gaps.withColumn("start", F.col("start") + handle).withColumn("end", F.col("end") - handle)
    return out.where((F.col("end") > F.col("start")) & (F.col("end") - F.col("start") >= min_gap))


def infer_windows(lines: DataFrame, by: list[str], default: float, least: float) -> DataFrame:
    """Ends for lines without one: the next line's start, at most a default length on; every line gets the least length."""
    w = Window.partitionBy(*by).orderBy("start", "pos")
    following = F.coalesce(F.lead("start").over(w), F.col("start") + default)
    end = F.when(F.col("end") > F.col("start"), F.col("end")).otherwise(F.least(following, F.col("start") + default))
    return lines.withColumn("end", F.when(end - F.col("start") < least, F.col("start") + least).otherwise(end))


def refine_windows(lines: DataFrame, islands: DataFrame, by: list[str], handle: int, most: int) -> DataFrame:
    """Cut windows: padded by the handle, drawn out to the islands the line touches, by at most `most`."""
    from cutloom.operators.overlap import overlap_join

    own = islands.select(*by, F.col("start").alias("island_start"), F.col("end").alias("island_end"))
    hit = overlap_join(lines.select(*by, "line_id", "start", "end"), own, by, ("start", "end"), ("island_start", "island_end"))
    hit = hit.groupBy("line_id").agg(F.min("island_start").alias("__a"), F.max("island_end").alias("__b"))
    start, end = F.greatest(F.lit(0), F.col("start") - handle), F.greatest(F.greatest(F.lit(0), F.col("start") - handle), F.col("end") + handle)
    rows = lines.join(hit, "line_id", "left")
    a = F.greatest(F.lit(0), F.least(start, F.greatest(F.col("__a"), F.col("start") - most)))
    b = F.greatest(end, F.least(F.col("__b"), F.col("end") + most))
    return rows.withColumn("cut_start", F.coalesce(F.when(F.col("__a").isNotNull(), a), start)).withColumn("cut_end", F.coalesce(F.when(F.col("__b").isNotNull(), b), end)).drop("__a", "__b")


def kept_cuts(frames: Column, total: Column, min_gap: Column) -> Column:
    """Edges of shots from an array of cut frames: 0, the cuts at least min_gap after the last kept one, total.

    The last kept cut is dropped where it leaves too short a tail.
    """
    inside = F.array_sort(F.array_distinct(F.filter(frames, lambda f: (f > 0) & (f < total))))
    zero = F.array(F.lit(0).cast("bigint"))
    kept = F.aggregate(inside, zero, lambda acc, f: F.when(f - F.element_at(acc, -1) >= min_gap, F.concat(acc, F.array(f))).otherwise(acc))
    tail = (F.size(kept) > 1) & (total - F.element_at(kept, -1) < min_gap)
    kept = F.when(tail, F.slice(kept, F.lit(1), F.size(kept) - 1)).otherwise(kept)
    return F.concat(kept, F.array(total))


def ranges_of_edges(df: DataFrame, edges: str, by: list[str], padding: int = 3) -> DataFrame:
    """One row for each pair of neighbouring edges: shot_id, start_frame, end_frame."""
    pair = F.transform(F.sequence(F.lit(0), F.size(edges) - 2), lambda i: F.struct(F.lpad((i + 1).cast("string"), padding, "0").alias("shot_id"), F.get(edges, i).alias("start_frame"), F.get(edges, i + 1).alias("end_frame")))
    return df.select(*by, F.inline(F.when(F.size(edges) >= 2, pair)))


def ranges_of_cut_points(points: DataFrame, totals: DataFrame, by: list[str]) -> DataFrame:
    """Ranges between neighbouring cut points inside (0, total) and the ends: by, n, start_frame, end_frame."""
    inside = points.join(totals, by).where("frame > 0 AND frame < total").select(*by, "frame")
    edges = inside.union(totals.select(*by, F.lit(0).cast("bigint"))).union(totals.select(*by, "total")).distinct()
    w = Window.partitionBy(*by).orderBy("frame")
    out = edges.withColumn("end_frame", F.lead("frame").over(w)).withColumn("n", F.row_number().over(w))
    return out.where("end_frame > frame").select(*by, "n", F.col("frame").alias("start_frame"), "end_frame")


def range_problems(ranges: DataFrame, by: list[str]) -> DataFrame:
    """Diagnostics of shot ranges: by, shot_id, problem, frames.

    Duplicate ids, starts before 0, lengths that aren't positive, starts or ends beyond the total (by one frame: clamped),
    and, against the range before, overlaps and uncovered frames.
    """
    w = Window.partitionBy(*by).orderBy("start_frame", "end_frame", "shot_id")
    rows = ranges.withColumn("__before", F.lag(F.least("end_frame", "total")).over(w)).withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(*by, "shot_id")))
    over = F.col("end_frame") - F.col("total")
    found = F.array(
        F.when(F.col("__n") > 1, F.struct(F.lit("duplicate").alias("problem"), F.col("__n").cast("bigint").alias("frames"))),
        F.when(F.col("start_frame") < 0, F.struct(F.lit("before_start").alias("problem"), (-F.col("start_frame")).alias("frames"))),
        F.when(F.col("end_frame") <= F.col("start_frame"), F.struct(F.lit("not_positive").alias("problem"), (F.col("end_frame") - F.col("start_frame")).alias("frames"))),
        F.when(F.col("start_frame") >= F.col("total"), F.struct(F.lit("beyond_end").alias("problem"), (F.col("start_frame") - F.col("total")).alias("frames"))),
        F.when(over == 1, F.struct(F.lit("clamped").alias("problem"), over.alias("frames"))).when(over > 1, F.struct(F.lit("past_end").alias("problem"), over.alias("frames"))),
        F.when(F.col("start_frame") < F.col("__before"), F.struct(F.lit("overlap").alias("problem"), (F.col("__before") - F.col("start_frame")).alias("frames"))),
        F.when(F.col("start_frame") > F.col("__before"), F.struct(F.lit("uncovered").alias("problem"), (F.col("start_frame") - F.col("__before")).alias("frames"))),
    )
    return rows.select(*by, "shot_id", F.inline(F.array_compact(found)))


def assign_scenes(shots: DataFrame, by: list[str], order: list[str], score: str, threshold: float) -> DataFrame:
    """Scene number of each shot: 1 and one more after every shot whose score reaches the threshold."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(FIRST, -1)
    return shots.withColumn("scene", F.lit(1) + F.coalesce(F.sum((F.col(score) >= threshold).cast("int")).over(w), F.lit(0)))


def scene_rollup(shots: DataFrame, by: list[str], order: list[str], score: str, places: int = 4) -> DataFrame:
    """Scenes: first start, last end, shots in order, score of the last shot rounded to so many places."""
    item = F.struct(*order, F.col("shot_id").alias("__id"), F.col("start_ms").alias("__s"), F.col("end_ms").alias("__e"), F.col(score).alias("__score"))
    rows = shots.groupBy(*by, "scene").agg(F.array_sort(F.collect_list(item)).alias("x"))
    last = F.element_at("x", -1)
    return rows.select(*by, "scene", F.format_string("%03d", F.col("scene").cast("int")).alias("scene_id"), F.size("x").alias("shot_count"), F.get("x", F.lit(0))["__s"].alias("scene_start"), last["__e"].alias("scene_end"), F.array_join(F.transform("x", lambda r: r["__id"]), " ").alias("shot_ids"), F.round(last["__score"], places).alias("boundary_score"))


def rolling_mean(df: DataFrame, by: list[str], order: list[str], value: str, width: int, name: str) -> DataFrame:
    """Mean of the row and the width - 1 rows before it, of fewer at the beginning."""
    return df.withColumn(name, F.avg(value).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(-(width - 1), 0)))


def event_boundaries(frames: DataFrame, by: list[str], index: str = "i", flux: str = "flux", level: str = "level") -> DataFrame:
    """Frames whose flux or change of level stands out by four median deviations: by, index, strength.

    Of a run of neighbouring frames every second one counts, from its first. Fewer than two frames give none.
    """
    w = Window.partitionBy(*by).orderBy(index)
    rows = frames.withColumn("__d", F.abs(F.col(level) - F.coalesce(F.lag(level).over(w), F.col(level))))
    mid = rows.groupBy(*by).agg(F.expr(f"percentile({flux}, 0.5)").alias("__fm"), F.expr("percentile(__d, 0.5)").alias("__dm"), F.count(F.lit(1)).alias("__n"))
    rows = rows.join(mid, by).where("__n >= 2")
    spread = rows.groupBy(*by).agg(F.expr(f"percentile(abs({flux} - __fm), 0.5)").alias("__fs"), F.expr("percentile(abs(__d - __dm), 0.5)").alias("__ds"))
    rows = rows.join(spread, by).withColumn("__fl", F.col("__fm") + 4 * F.greatest(F.col("__fs"), F.lit(1e-4))).withColumn("__dl", F.col("__dm") + 4 * F.greatest(F.col("__ds"), F.lit(0.5)))
    hit = rows.where((F.col(flux) > F.col("__fl")) | (F.col("__d") > F.col("__dl"))).withColumn("__g", F.col(index) - F.row_number().over(w))
    hit = hit.withColumn("__o", F.col(index) - F.min(index).over(Window.partitionBy(*by, "__g"))).where("__o % 2 = 0")
    strength = F.greatest(F.col(flux) / F.greatest(F.col("__fl"), F.lit(1e-12)), F.col("__d") / F.greatest(F.col("__dl"), F.lit(1e-12)))
    return hit.select(*by, index, F.round(strength, 6).alias("strength"))


def smooth_labels(events: DataFrame, by: list[str], order: list[str], label: str) -> DataFrame:
    """A lone event takes the label its two neighbours have in common."""
    w = Window.partitionBy(*by).orderBy(*order)
    before, after = F.lag(label).over(w), F.lead(label).over(w)
    return events.withColumn(f"smooth_{label}", F.when((before == after) & (before != F.col(label)), before).otherwise(F.col(label)))


def local_maxima(df: DataFrame, by: list[str], order: list[str], value: str, least: float) -> DataFrame:
    """Rows from `least` upwards that exceed the row before and aren't below the row after."""
    w = Window.partitionBy(*by).orderBy(*order)
    peak = (F.col(value) >= least) & (F.coalesce(F.lag(value).over(w), F.lit(float("-inf"))) < F.col(value)) & (F.coalesce(F.lead(value).over(w), F.lit(float("-inf"))) <= F.col(value))
    return df.withColumn("__p", peak).where("__p").drop("__p")


def assign_lanes(placed: DataFrame, by: list[str]) -> DataFrame:
    """Lane (from 0) of each clip by first fit in the order of start and end: by, lane, clips of an entity as rows.

    A fold over the entity's clips that carries the end of every lane.
    """
    item = F.struct("start_frame", "end_frame", "clip")
    start = F.struct(F.array().cast("array<bigint>").alias("ends"), F.array().cast("array<struct<start_frame:bigint,end_frame:bigint,clip:string,lane:int>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        free = F.array_position(F.transform(acc["ends"], lambda e: x["start_frame"] >= e), True).cast("int")
        lane = F.when(free > 0, free - 1).otherwise(F.size(acc["ends"]))
        ends = F.when(free > 0, F.transform(acc["ends"], lambda e, i: F.when(i == lane, x["end_frame"]).otherwise(e))).otherwise(F.concat(acc["ends"], F.array(x["end_frame"])))
        row = F.struct(x["start_frame"].alias("start_frame"), x["end_frame"].alias("end_frame"), x["clip"].alias("clip"), lane.alias("lane"))
        return F.struct(ends.alias("ends"), F.concat(acc["out"], F.array(row)).alias("out"))

    rows = placed.select(*by, F.col("start_frame").cast("bigint").alias("start_frame"), F.col("end_frame").cast("bigint").alias("end_frame"), F.col("clip").cast("string").alias("clip"))
    packed = rows.groupBy(*by).agg(F.array_sort(F.collect_list(item)).alias("x"))
    return packed.select(*by, F.inline(F.aggregate("x", start, step, lambda acc: acc["out"])))


def interpolate_characters(words: DataFrame, by: list[str]) -> DataFrame:
    """Characters of each word at even steps over its time: by, pos, i, character, start, end."""
    n = F.length("text")
    step = (F.col("end") - F.col("start")) / n
    rows = words.where(n > 0).select(*by, "pos", "start", step.alias("__step"), F.posexplode(F.split("text", "")).alias("i", "character")).where("character != ''")
    return rows.select(*by, "pos", "i", "character", (F.col("start") + F.col("i") * F.col("__step")).alias("start"), (F.col("start") + (F.col("i") + 1) * F.col("__step")).alias("end"))
