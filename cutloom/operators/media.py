"""Streams, masters, faces, clips' units and names of media: choices over captured tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cutloom.functions.names import safe_name
from cutloom.functions.vectors import box_iou

#: Suffixes of videos and of image sequences.
VIDEO_SUFFIXES = (".mov", ".mp4", ".m4v", ".mxf", ".mkv", ".avi", ".webm", ".mts", ".m2ts", ".wmv", ".mpg")
IMAGE_SUFFIXES = (".exr", ".dpx", ".png", ".tif", ".tiff", ".jpg", ".jpeg")
#: Labels of an alignment that stand for unknown words.
UNKNOWN_WORDS = ("<unk>", "<oov>", "oov", "spn", "<spn>")
#: Other names of a recipe's roles.
ROLE_ALIASES = {"dialogue": "dx", "dialog": "dx", "music": "mx", "effects": "fx", "sfx": "fx", "room-tone": "room_tone", "roomtone": "room_tone"}


def stereo_program(streams: DataFrame, by: list[str]) -> DataFrame:
    """How each file's streams (index, channels, layout) become a stereo programme: by, choice, indices.

    In this order: eight mono streams give the first pair; a stereo stream; a stream of six channels; six mono streams; the
    first stream. A null channel count or layout counts as none.
    """
    stream = F.struct("index", F.coalesce("channels", F.lit(0)).alias("channels"), F.lower(F.coalesce("layout", F.lit(""))).alias("layout"))
    rows = streams.groupBy(*by).agg(F.array_sort(F.collect_list(stream)).alias("s"))
    mono = lambda n: (F.size("s") >= n) & F.forall(F.slice("s", 1, n), lambda x: x["channels"] == 1)
    stereo = F.get(F.filter("s", lambda x: (x["channels"] == 2) | (x["layout"] == "stereo")), F.lit(0))
    surround = F.get(F.filter("s", lambda x: (x["channels"] >= 6) | x["layout"].contains("5.1")), F.lit(0))
    numbers = lambda n: F.transform(F.slice("s", 1, n), lambda x: x["index"])
    ways = [(mono(8), "first_mono_pair_2_0_program", numbers(2)), (stereo.isNotNull(), "stereo_stream", F.array(stereo["index"])), (surround.isNotNull(), "downmix_5_1_stream", F.array(surround["index"])), (mono(6), "downmix_six_mono_5_1", numbers(6))]
    choice, indices = F.when(ways[0][0], ways[0][1]), F.when(ways[0][0], ways[0][2])
    for hit, name, own in ways[1:]:
        choice, indices = choice.when(hit, name), indices.when(hit, own)
    return rows.select(*by, choice.otherwise("first_audio_stream_to_stereo").alias("choice"), indices.otherwise(numbers(1)).alias("indices"))


def master_kind(path: Column, is_folder: Column) -> Column:
    """kind (video, sequence) and path of a master: a frame of a sequence stands for its folder; other files are an error."""
    suffix = F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))
    folder = F.regexp_replace(path, r"/[^/]*$", "")
    wrong = F.raise_error(F.concat(F.lit("unsupported master: "), path)).cast("string")
    kind = F.when(is_folder | suffix.isin(*IMAGE_SUFFIXES), "sequence").when(suffix.isin(*VIDEO_SUFFIXES), "video").otherwise(wrong)
    return F.struct(kind.alias("kind"), F.when(~is_folder & suffix.isin(*IMAGE_SUFFIXES), folder).otherwise(path).alias("path"))


def best_target_face(faces: DataFrame, targets: DataFrame, on: list[str], key: str, least: float = 0.1) -> DataFrame:
    """Of each target (on, box) the face that overlaps it most, from `least` up: on, key, iou; ties go to the smaller key."""
    pairs = faces.select(*on, key, F.col("box").alias("__a")).join(targets.select(*on, F.col("box").alias("__b")), on)
    best = pairs.groupBy(*on).agg(F.min(F.struct((-box_iou(F.col("__a"), F.col("__b"))).alias("d"), F.col(key).alias("k"))).alias("b"))
    return best.select(*on, F.col("b.k").alias(key), (-F.col("b.d")).alias("iou")).where(F.col("iou") >= least)


def clip_unit(line: Column, shot: Column, clip: Column) -> Column:
    """What a voice clip belongs to: its line, else its shot, else itself; a clip without any is an error."""
    own = F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in (line, shot, clip)])
    return F.coalesce(own, F.raise_error(F.lit("voice clip without line, shot and clip")).cast("string"))


def representatives(clips: DataFrame, unit: str, key: str, level: str) -> DataFrame:
    """The loudest clip of each unit: unit, key, level; ties go to the smaller key, a null level is the quietest."""
    rank = F.struct((-F.coalesce(F.col(level), F.lit(float("-inf")))).alias("d"), F.col(key).alias("k"), F.col(level).alias("l"))
    return clips.where(F.col(unit).isNotNull()).groupBy(unit).agg(F.min(rank).alias("b")).select(unit, F.col("b.k").alias(key), F.col("b.l").alias(level))


def clip_bounds(clip_start: Column, clip_end: Column, start: Column, end: Column) -> Column:
    """start and end of a clip where both are known, else of its line, else null."""
    whole = clip_start.isNotNull() & clip_end.isNotNull()
    own = F.struct(F.when(whole, clip_start).otherwise(start).cast("double").alias("start"), F.when(whole, clip_end).otherwise(end).cast("double").alias("end"))
    return F.when(own["start"].isNotNull() & own["end"].isNotNull(), own)


def shot_media(folder: Column, prefix: str, shot: Column, sequence: Column, suffix: str = ".mov") -> Column:
    """Names of a shot's media: shot_name, shot_dir, plate_path, video_path (a proxy where the master is a sequence)."""
    name = F.concat(safe_name(F.lit(prefix), "shot"), F.lit("_"), safe_name(shot))
    at = F.concat(folder, F.lit("/"), name)
    file = lambda end: F.concat(at, F.lit("/"), name, F.lit(end))
    return F.struct(name.alias("shot_name"), at.alias("shot_dir"), F.when(sequence, file("_plate")).otherwise(file(suffix)).alias("plate_path"), F.when(sequence, file("_proxy.mov")).otherwise(file(suffix)).alias("video_path"))


def role_key(role: Column) -> Column:
    """A recipe role under its usual name."""
    text = F.lower(F.trim(role))
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in ROLE_ALIASES.items() for x in pair]), text), text)


def segment_labels(windows: DataFrame, segments: DataFrame, by: list[str], default: str = "ambience") -> DataFrame:
    """Scores of windows averaged over their segment, and the best label: by, label, confidence, scores (map).

    windows: by, window, label, score. Segments without windows get the default with confidence 0; ties (to nine places) go to the smaller label.
    """
    counts = windows.groupBy(*by).agg(F.count_distinct("window").alias("__n"))
    means = windows.groupBy(*by, "label").agg(F.sum("score").alias("s")).join(counts, by).withColumn("s", F.col("s") / F.col("__n"))
    best = means.groupBy(*by).agg(F.min(F.struct((-F.round("s", 9)).alias("d"), "label")).alias("b"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", "s")))).alias("scores"))
    out = segments.select(*by).join(best, by, "left")
    return out.select(*by, F.coalesce("b.label", F.lit(default)).alias("label"), F.coalesce(-F.col("b.d"), F.lit(0.0)).alias("confidence"), "scores")


def out_of_vocabulary(intervals: DataFrame, by: list[str], labels: tuple[str, ...] = UNKNOWN_WORDS) -> DataFrame:
    """Labels of an alignment that stand for unknown words, once each in the order in which they come: by, labels. intervals: by, tier, i, label."""
    hits = intervals.where(F.lower(F.trim("label")).isin(*labels)).withColumn("label", F.trim("label"))
    first = hits.groupBy(*by, "label").agg(F.min(F.struct(F.when(F.col("tier") == "words", 0).otherwise(1).alias("t"), "i")).alias("at"))
    return first.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "label"))), lambda x: x["label"]).alias("labels"))
