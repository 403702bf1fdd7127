"""Timelines: clips placed in frames, markers, scene tags, tracks with gaps as nested rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cutloom.operators.overlap import scene_for_time
from cutloom.operators.sequences import assign_lanes


def placed(clips: DataFrame, fps: float, clamp: bool = True) -> DataFrame:
    """Clips with start_frame and frames: at least frame 0 and one frame, halves to even.

    The length is the window's; with a media length (media_sec) the media's, or the shorter one when clamped.
    """
    window = F.col("end_sec") - F.col("start_sec")
    media = F.col("media_sec")
    length = F.when(media.isNull(), window).otherwise(F.least(window, media) if clamp else media)
    frame = lambda x: F.rint(x * fps).cast("bigint")
    return clips.withColumn("start_frame", F.greatest(F.lit(0).cast("bigint"), frame(F.col("start_sec")))).withColumn("frames", F.greatest(F.lit(1).cast("bigint"), frame(length)))


def marker(speaker: Column, text: Column, status: Column, has_media: Column, preview: int = 64) -> Column:
    """Marker of a dialogue clip: colour and label.

    Red for a missing stem, orange for offscreen, unresolved and unmatched speakers, else green.
    """
    warned = status.isin("offscreen_speaker", "unresolved", "no_matching_stem")
    note = F.when(~has_media, "missing stem").when(warned, F.replace(status, F.lit("_"), F.lit(" ")))
    who, said = F.coalesce(F.nullif(speaker, F.lit("")), F.lit("?")), F.trim(F.coalesce(text, F.lit("")))
    label = F.when(said != "", F.concat(who, F.lit(": "), F.substring(said, 1, preview))).otherwise(who)
    return F.struct(F.when(~has_media, "RED").when(warned, "ORANGE").otherwise("GREEN").alias("color"), F.when(note.isNotNull(), F.concat(F.lit("["), note, F.lit("] "), label)).otherwise(label).alias("label"))


def on_screen_marker(speakers: Column) -> Column:
    """Label of a video clip; null without speakers."""
    return F.when(F.size(speakers) > 0, F.concat(F.lit("on-screen: "), F.array_join(speakers, ", ")))


def scene_markers(scenes: DataFrame, by: list[str], fps: float) -> DataFrame:
    """A purple marker for each scene: by, name, start_frame, frames (one at least), color, scene_id, shot_ids."""
    frame = lambda x: F.rint(x * fps).cast("bigint")
    start, end = F.col("scene_start"), F.col("scene_end")
    return scenes.select(
        *by, F.concat(F.lit("SC"), F.col("scene_id").cast("string")).alias("name"), F.greatest(F.lit(0).cast("bigint"), frame(start)).alias("start_frame"),
        F.greatest(F.lit(1).cast("bigint"), frame(end - start)).alias("frames"), F.lit("PURPLE").alias("color"), F.col("scene_id").cast("string").alias("scene_id"), F.coalesce("shot_ids", F.array().cast("array<string>")).alias("shot_ids"),
    )


def shifted(placements: DataFrame, offset: int) -> DataFrame:
    """Placements that start `offset` frames earlier, at frame 0 at least; their lengths stay."""
    return placements.withColumn("start_frame", F.greatest(F.lit(0).cast("bigint"), F.col("start_frame") - offset))


def first_float(*columns: Column) -> Column:
    """The first column that holds a number; null for none."""
    return F.coalesce(*[F.trim(c.cast("string")).try_cast("double") for c in columns])


def tag_scenes(clips: DataFrame, scenes: DataFrame, by: list[str]) -> DataFrame:
    """Clips with scene_id: of the scene that lists the shot (shot_ids array), else of the scene at the clip's start."""
    listed = scenes.select(*by, F.col("scene_id").alias("__listed"), F.explode("shot_ids").alias("shot_id")).dropDuplicates([*by, "shot_id"])
    timed = scene_for_time(clips.withColumn("__at", F.col("start_sec")), scenes.select(*by, "scene_id", "scene_start", "scene_end"), by, "__at").withColumnRenamed("scene_id", "__timed")
    return timed.join(listed, [*by, "shot_id"], "left").withColumn("scene_id", F.coalesce("__listed", "__timed")).drop("__listed", "__timed", "__at")


def tracks(placements: DataFrame, by: list[str], group: str) -> DataFrame:
    """Tracks of each group as nested rows: by, group, lane, items (gaps and clips in order).

    Overlapping clips go to further lanes, the first free one each.
    """
    keyed = placements.withColumn("end_frame", F.col("start_frame") + F.col("frames"))
    lanes = assign_lanes(keyed.select(*by, group, "start_frame", "end_frame", "clip"), [*by, group])
    before = F.coalesce(F.lag("end_frame").over(Window.partitionBy(*by, group, "lane").orderBy("start_frame")), F.lit(0))
    gap = F.struct(F.lit("gap").alias("kind"), F.lit(None).cast("string").alias("clip"), before.alias("start_frame"), (F.col("start_frame") - before).alias("frames"))
    clip = F.struct(F.lit("clip").alias("kind"), F.col("clip"), F.col("start_frame"), (F.col("end_frame") - F.col("start_frame")).alias("frames"))
    items = lanes.withColumn("__items", F.when(F.col("start_frame") > before, F.array(gap, clip)).otherwise(F.array(clip)))
    out = items.groupBy(*by, group, "lane").agg(F.array_sort(F.collect_list(F.struct("start_frame", "__items"))).alias("x"))
    return out.select(*by, group, "lane", F.flatten(F.transform("x", lambda r: r["__items"])).alias("items"))


def otio_json(track_rows: DataFrame, by: list[str], group: str, fps: float) -> DataFrame:
    """One OpenTimelineIO document for each entity: by, json."""
    time = lambda v: F.struct(F.lit("RationalTime.1").alias("OTIO_SCHEMA"), F.lit(float(fps)).alias("rate"), v.cast("double").alias("value"))
    span = lambda x: F.struct(F.lit("TimeRange.1").alias("OTIO_SCHEMA"), time(x["frames"]).alias("duration"), time(F.lit(0)).alias("start_time"))
    children = F.transform("items", lambda x: F.struct(F.when(x["kind"] == "gap", "Gap.1").otherwise("Clip.1").alias("OTIO_SCHEMA"), x["clip"].alias("name"), span(x).alias("source_range")))
    track = F.struct(F.col(group), F.col("lane"), F.lit("Track.1").alias("OTIO_SCHEMA"), F.concat_ws(" ", group, F.col("lane") + 1).alias("name"), F.lit("Audio").alias("kind"), children.alias("children"))
    rows = track_rows.groupBy(*by).agg(F.array_sort(F.collect_list(track)).alias("t"))
    stack = F.struct(F.lit("Stack.1").alias("OTIO_SCHEMA"), F.transform("t", lambda t: F.struct(t["OTIO_SCHEMA"].alias("OTIO_SCHEMA"), t["name"].alias("name"), t["kind"].alias("kind"), t["children"].alias("children"))).alias("children"))
    return rows.select(*by, F.to_json(F.struct(F.lit("Timeline.1").alias("OTIO_SCHEMA"), F.lit("timeline").alias("name"), stack.alias("tracks"))).alias("json"))


def summary(placements: DataFrame, by: list[str], group: str) -> DataFrame:
    """Clips, frames and end of each entity and group, with totals (null group)."""
    ends = F.max(F.col("start_frame") + F.col("frames"))
    return placements.groupingSets([[*map(F.col, by), F.col(group)], [*map(F.col, by)]], *map(F.col, by), F.col(group)).agg(F.count(F.lit(1)).alias("clips"), F.sum("frames").alias("frames"), ends.alias("end_frame"))
