"""Frames and SQL that several queries start from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cutloom.common import latest, table, whole_ms


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newest lines with usable times: line_id, project_id, reel_id, start_ms, end_ms, text, speaker, diarized_speaker, source_group, transcription_source, review_required."""
    columns = ["project_id", "reel_id", "start_sec", "end_sec", "text", "speaker", "diarized_speaker", "source_group", "transcription_source", "review_required"]
    rows = latest(table(spark, sf_dir, "dialogue_lines"), "line_id", "ingested_at", columns)
    return _timed(rows)


def shots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newest shots with usable times: shot_id, project_id, reel_id, existing_speaker, start_ms, end_ms."""
    return _timed(latest(table(spark, sf_dir, "shots"), "shot_id", "ingested_at", ["project_id", "reel_id", "existing_speaker", "start_sec", "end_sec"]))


def _timed(rows: DataFrame) -> DataFrame:
    rows = rows.where("reel_id IS NOT NULL AND start_sec >= 0 AND NOT isnan(start_sec) AND NOT isnan(end_sec)")
    rows = rows.withColumn("start_ms", whole_ms("start_sec")).withColumn("end_ms", whole_ms("end_sec")).drop("start_sec", "end_sec")
    return rows.where("end_ms > start_ms")


def clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newest voice clips with their numbers: clip_id, pos, line_id, shot_id, source_group, path, text, kept, start_ms, end_ms (of the clip)."""
    rows = latest(table(spark, sf_dir, "voice_inputs"), "clip_id", "ingested_at", ["line_id", "shot_id", "source_group", "path", "text", "kept", "clip_start_sec", "clip_end_sec"])
    rows = rows.withColumn("start_ms", whole_ms("clip_start_sec")).withColumn("end_ms", whole_ms("clip_end_sec")).drop("clip_start_sec", "clip_end_sec")
    return rows.withColumn("pos", F.regexp_extract("clip_id", r"(\d+)$", 1).cast("bigint"))


def _newest(table_: str, key: str, columns: str) -> str:
    names = [c.strip() for c in columns.split(",")]
    pack = ", ".join(f"{c} := {c}" for c in names)
    out = ", ".join(f"b.{c} {c}" for c in names)
    return f"SELECT {key}, {out} FROM (SELECT {key}, max_by(struct_pack({pack}), ingested_at) b FROM {table_} WHERE {key} IS NOT NULL GROUP BY 1)"


def _timed_sql(inner: str) -> str:
    return f"""SELECT * FROM (SELECT *, CASE WHEN NOT isnan(start_sec) THEN CAST(round(start_sec * 1000) AS BIGINT) END start_ms,
        CASE WHEN NOT isnan(end_sec) THEN CAST(round(end_sec * 1000) AS BIGINT) END end_ms FROM ({inner}) WHERE reel_id IS NOT NULL AND start_sec >= 0) WHERE end_ms > start_ms"""


LINES = "ln AS (" + _timed_sql(_newest("dialogue_lines", "line_id", "project_id, reel_id, start_sec, end_sec, text, speaker, diarized_speaker, source_group, transcription_source, review_required")) + ")"
SHOTS = "sh AS (" + _timed_sql(_newest("shots", "shot_id", "project_id, reel_id, existing_speaker, start_sec, end_sec")) + ")"
CLIPS = (
    "cl AS (SELECT *, CAST(regexp_extract(clip_id, '([0-9]+)$', 1) AS BIGINT) pos, CASE WHEN NOT isnan(clip_start_sec) THEN CAST(round(clip_start_sec * 1000) AS BIGINT) END start_ms,"
    " CASE WHEN NOT isnan(clip_end_sec) THEN CAST(round(clip_end_sec * 1000) AS BIGINT) END end_ms FROM ("
    + _newest("voice_inputs", "clip_id", "line_id, shot_id, source_group, path, text, kept, clip_start_sec, clip_end_sec") + "))"
)
