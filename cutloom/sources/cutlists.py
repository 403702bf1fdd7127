"""Cut lists: CSV, JSON, text and CMX3600 edit decision lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cutloom.functions.names import pad_shot_id
from cutloom.functions.timecode import frame_of_columns, relative_frame
from cutloom.sources.manifests import read_rows

EVENT = r"^\s*(\d+)\s+(\S+)\s+(\S+)\s+(\S+)(?:\s+\d+)?\s+(\d{2}[:;]\d{2}[:;]\d{2}[:;]\d{2})\s+(\d{2}[:;]\d{2}[:;]\d{2}[:;]\d{2})\s+(\d{2}[:;]\d{2}[:;]\d{2}[:;]\d{2})\s+(\d{2}[:;]\d{2}[:;]\d{2}[:;]\d{2})"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.posexplode(F.split("value", r"\r?\n")).alias("n", "line"))


def text_rows(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a text list: cut_point, or start and end, or shot_id, start and end; all lines must be of one kind."""
    rows = _lines(spark, path).select("n", F.trim(F.regexp_replace("line", "#.*", "")).alias("line")).where("line != ''")
    rows = rows.withColumn("t", F.split("line", r"[\s,]+"))
    kinds = rows.agg(F.min(F.size("t")).alias("a"), F.max(F.size("t")).alias("b")).first()
    if kinds["a"] != kinds["b"] or kinds["a"] not in (1, 2, 3):
        raise ValueError(f"lines of different kinds in {path}: {kinds['a']} to {kinds['b']} values")
    names = {1: ("cut_point",), 2: ("start", "end"), 3: ("shot_id", "start", "end")}[kinds["a"]]
    return rows.select(F.col("n").alias("pos"), *[F.get("t", F.lit(i)).alias(c) for i, c in enumerate(names)])


def edl_rows(spark: SparkSession, path: str, source_times: bool = False) -> DataFrame:
    """Video events of an edit decision list: pos, shot_id, start_tc, end_tc, label (the clip name that follows an event)."""
    rows = _lines(spark, path).where("line != ''").withColumn("event", F.when(F.col("line").rlike(EVENT), F.col("n")))
    rows = rows.withColumn("event", F.last("event", ignorenulls=True).over(Window.orderBy("n").rowsBetween(Window.unboundedPreceding, 0)))  # a list is one file
    names = rows.where(F.col("line").rlike(r"(?i)FROM CLIP NAME")).groupBy("event").agg(F.first(F.trim(F.regexp_extract("line", r"(?i)FROM CLIP NAME\s*:\s*(.*)$", 1))).alias("label"))
    events = rows.where(F.col("line").rlike(EVENT) & (F.col("event") == F.col("n")))
    part = lambda i: F.regexp_extract("line", EVENT, i)
    a, b = (5, 6) if source_times else (7, 8)
    events = events.where(F.upper(part(3)).rlike("V|^B$")).select("event", F.lit("").alias("shot_id"), part(a).alias("start_tc"), part(b).alias("end_tc"))
    return events.join(names, "event", "left").select(F.col("event").alias("pos"), "shot_id", "start_tc", "end_tc", F.coalesce("label", F.lit("")).alias("label"))


def read_cuts(spark: SparkSession, path: str, source_times: bool = False) -> DataFrame:
    """Rows of a cut list by its suffix, with normalised column names."""
    kind = path.lower().rsplit(".", 1)[-1]
    if kind == "edl":
        return edl_rows(spark, path, source_times)
    if kind == "txt":
        return text_rows(spark, path)
    df = read_rows(spark, path, "shots")
    return df.toDF(*[c.strip().lower().replace(" ", "_") for c in df.columns])


def shot_ranges(rows: DataFrame, fps: float, total: int | None = None, origin_frame: int = 0, padding: int = 3) -> DataFrame:
    """Ranges in frames in order: shot_id, start_frame, end_frame, label. Cut points need the total; missing ids are numbered.

    A row without start or end is an error. Ends one frame beyond the total are clamped.
    """
    if "cut_point" in rows.columns:
        if total is None:
            raise ValueError("cut points need the total number of frames")
        frame = relative_frame(F.col("cut_point"), fps, origin_frame)
        inside = rows.select(frame.alias("f")).where((F.col("f") > 0) & (F.col("f") < total)).distinct()
        edges = inside.union(rows.sparkSession.createDataFrame([(0,), (total,)], "f bigint"))
        w = Window.orderBy("f")  # a list is one file
        out = edges.select(F.lit("").alias("shot_id"), F.col("f").alias("start_frame"), F.lead("f").over(w).alias("end_frame"), F.lit("").alias("label")).where("end_frame > start_frame")
    else:
        start, end = (frame_of_columns(which, rows.columns, fps, origin_frame) for which in ("start", "end"))
        fail = F.raise_error(F.lit("shot without start or end"))
        text = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) if c in rows.columns else F.lit("")
        out = rows.select(text("shot_id").alias("shot_id"), F.when(start.isNull() | end.isNull(), fail.cast("bigint")).otherwise(start).alias("start_frame"), end.alias("end_frame"), text("label").alias("label"))
    w = Window.orderBy("start_frame", "end_frame")
    number = F.lpad(F.row_number().over(w).cast("string"), padding, "0")
    out = out.withColumn("shot_id", F.when(F.col("shot_id") == "", number).otherwise(pad_shot_id(F.col("shot_id"), padding)))
    if total is not None:
        out = out.withColumn("end_frame", F.when(F.col("end_frame") == total + 1, total).otherwise(F.col("end_frame")))
    return out.orderBy("start_frame", "end_frame")
