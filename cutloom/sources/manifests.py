"""Manifests in JSON and CSV: columns under any of their names, lenient cells, strict keys; and their writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cutloom.functions.levels import optional_float, truthy
from cutloom.functions.names import infer_shot_id, infer_source_group, normalize_header, speaker_list

#: Names under which a manifest may hold a column.
SHOT = {"shot_id": ("shot_id", "id"), "video_path": ("video_path", "path", "file_path"), "existing_speaker": ("existing_speaker", "speaker"), "start_sec": ("start_sec", "start"), "end_sec": ("end_sec", "end")}
LINE = {
    "line_id": ("line_id", "id"), "start_sec": ("start_sec", "start"), "end_sec": ("end_sec", "end"), "cut_start_sec": ("cut_start_sec",), "cut_end_sec": ("cut_end_sec",), "text": ("text",),
    "diarized_speaker": ("diarized_speaker",), "source_group": ("source_group", "diarized_speaker"), "speaker": ("speaker", "char"), "transcription_source": ("transcription_source",), "review_required": ("review_required",),
}
CLIP = {
    "path": ("path", "clip", "file_path"), "clip_id": ("clip_id", "id"), "clip_type": ("clip_type",), "line_id": ("line_id",), "shot_id": ("shot_id",), "source_group": ("source_group",), "source_stem": ("source_stem",),
    "start_sec": ("start_sec",), "end_sec": ("end_sec",), "clip_start_sec": ("clip_start_sec",), "clip_end_sec": ("clip_end_sec",), "text": ("text",), "embedding": ("embedding",),
}
BOX = ("target_face_box", "face_box", "box")
BOX_PARTS = (("face_x", "face_y", "face_w", "face_h"), ("x", "y", "w", "h"))
NUMBERS = ("start_sec", "end_sec", "cut_start_sec", "cut_end_sec", "clip_start_sec", "clip_end_sec")
LINE_CSV = ("line_id", "start_sec", "end_sec", "cut_start_sec", "cut_end_sec", "text", "diarized_speaker", "source_group", "speaker", "transcription_source", "review_required")


def read_rows(spark: SparkSession, path: str, within: str | None = None) -> DataFrame:
    """Rows of a CSV (all text, normalised headers), or of a JSON list or of the list under a name in a JSON object; pos is their order."""
    if path.lower().endswith((".csv", ".tsv")):
        df = spark.read.csv(path, header=True, multiLine=True, escape='"', sep="\t" if path.lower().endswith(".tsv") else ",")
        df = df.toDF(*[c.lstrip("﻿").strip().lower() for c in df.columns])
        return df.withColumn("pos", F.monotonically_increasing_id())
    raw = spark.read.text(path, wholetext=True).select(F.parse_json("value").alias("v"))
    listed = F.coalesce(F.try_variant_get("v", f"$.{within}", "array<variant>"), F.try_variant_get("v", "$", "array<variant>")) if within else F.try_variant_get("v", "$", "array<variant>")
    rows = raw.select(F.posexplode(listed).alias("pos", "v"))
    keys = [r[0] for r in rows.select(F.explode(F.map_keys(F.from_json(F.to_json("v"), "map<string,string>")))).distinct().collect()]
    return rows.select(F.col("pos").cast("bigint").alias("pos"), *[F.try_variant_get("v", f"$['{k}']", "string").alias(k) for k in sorted(keys)])


def _pick(df: DataFrame, names: tuple[str, ...]) -> Column:
    found = [F.nullif(F.trim(F.col(n).cast("string")), F.lit("")) for n in names if n in df.columns]
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def _typed(df: DataFrame, names: dict[str, tuple[str, ...]], *more: Column) -> DataFrame:
    def cell(name: str) -> Column:
        value = _pick(df, names[name])
        if name in NUMBERS:
            return value.cast("double")
        if name == "review_required":
            return truthy(value)
        return value

    return df.select("pos", *[cell(n).alias(n) for n in names], *more)


def _box(df: DataFrame) -> Column:
    whole = F.from_json(_pick(df, BOX), "array<double>")
    parts = [F.array(*[_pick(df, (p,)).cast("double") for p in names]) for names in BOX_PARTS if all(n in df.columns for n in names)]
    box = F.coalesce(whole, *[F.when(~F.exists(p, lambda x: x.isNull()), p) for p in parts]) if parts else whole
    return F.when(F.size(box) == 4, box.cast("array<int>")).alias("target_face_box")


def shots(spark: SparkSession, path: str) -> DataFrame:
    """Shot manifest: a row without id or path is an error."""
    df = read_rows(spark, path, "shots")
    out = _typed(df, SHOT, _box(df))
    fail = F.raise_error(F.concat(F.lit("shot without id or path at row "), F.col("pos")))
    return out.withColumn("shot_id", F.when(F.col("shot_id").isNull() | F.col("video_path").isNull(), fail).otherwise(F.col("shot_id")))


def dialogue_lines(spark: SparkSession, path: str) -> DataFrame:
    return _typed(read_rows(spark, path, "lines"), LINE)


def voice_clips(spark: SparkSession, path: str) -> DataFrame:
    """Clip manifest; where it has a column kept, only kept clips. Missing shots and groups are inferred from the path."""
    df = read_rows(spark, path, "clips")
    if "kept" in df.columns:
        df = df.where(truthy(F.col("kept")))
    out = _typed(df, CLIP).withColumn("embedding", F.from_json("embedding", "array<double>"))
    return out.withColumn("shot_id", F.coalesce("shot_id", infer_shot_id(F.col("path")))).withColumn("source_group", F.coalesce("source_group", infer_source_group(F.col("path"))))


def clip_files(spark: SparkSession, glob: str) -> DataFrame:
    """Clips found by a path pattern, ids from their names."""
    paths = spark.read.format("binaryFile").load(glob).select("path")
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    return paths.select("path", stem.alias("clip_id"), infer_shot_id(F.col("path")).alias("shot_id"), infer_source_group(F.col("path")).alias("source_group"))


def image_sequence(spark: SparkSession, folder: str) -> DataFrame:
    """The numbered image sequences of a folder: prefix, suffix, padding, first, last, frames, missing (frame numbers)."""
    name = F.element_at(F.split("path", "/"), -1)
    rows = spark.read.format("binaryFile").load(f"{folder.rstrip('/')}/*").select(name.alias("n"))
    pattern = r"^(.*?)(\d+)(\.[A-Za-z0-9]+)$"
    rows = rows.where(F.col("n").rlike(pattern)).select(*[F.regexp_extract("n", pattern, i).alias(c) for i, c in ((1, "prefix"), (2, "digits"), (3, "suffix"))])
    out = rows.groupBy("prefix", "suffix").agg(F.min(F.length("digits")).alias("padding"), F.array_sort(F.collect_set(F.col("digits").cast("bigint"))).alias("all"))
    first, last = F.element_at("all", 1), F.element_at("all", -1)
    return out.select("prefix", "suffix", "padding", first.alias("first"), last.alias("last"), F.size("all").alias("frames"), F.array_except(F.sequence(first, last), F.col("all")).alias("missing"))


def write_csv(df: DataFrame, path: str, fields: tuple[str, ...]) -> None:
    """CSV with the fields in order; arrays joined with ', ', maps and structs as JSON, missing cells empty. Spark's commit makes it atomic."""
    kinds = {f.name: f.dataType for f in df.schema.fields}

    def cell(name: str) -> Column:
        if name not in kinds:
            return F.lit("").alias(name)
        if isinstance(kinds[name], T.ArrayType):
            return F.array_join(F.col(name).cast("array<string>"), ", ").alias(name)
        if isinstance(kinds[name], (T.MapType, T.StructType)):
            return F.to_json(name).alias(name)
        return F.coalesce(F.col(name).cast("string"), F.lit("")).alias(name)

    df.select(*[cell(f) for f in fields]).write.mode("overwrite").csv(path, header=True, emptyValue="")


def write_manifest(df: DataFrame, path: str, name: str, order: list[str], **header: str) -> None:
    """One JSON object a file: version, the header and the rows as a list under the name, in order."""
    fields = sorted(c for c in df.columns if c not in order)
    rows = df.groupBy().agg(F.array_sort(F.collect_list(F.struct(*order, *fields))).alias(name))
    rows.select(F.lit("1.0").alias("version"), *[F.lit(v).alias(k) for k, v in sorted(header.items())], name).write.mode("overwrite").json(path)


def spotting(shots_: DataFrame, fps: float, origin_frame: int = 0, drop_frame: bool = False) -> DataFrame:
    """Shots with frames, seconds (six places) and timecodes."""
    from cutloom.functions.timecode import frames_to_seconds, frames_to_smpte

    out = shots_
    for end in ("start", "end"):
        frame = F.col(f"{end}_frame")
        out = out.withColumn(f"{end}_sec", F.round(frames_to_seconds(frame, fps), 6)).withColumn(f"{end}_tc", frames_to_smpte(frame + origin_frame, fps, drop_frame))
    return out


__all__ = ["clip_files", "dialogue_lines", "image_sequence", "normalize_header", "read_rows", "shots", "speaker_list", "optional_float", "spotting", "voice_clips", "write_csv", "write_manifest"]
