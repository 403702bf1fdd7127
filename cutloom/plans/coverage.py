"""Problem 4: covered periods and gaps of the reels' lines and shots."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cutloom.common import latest, table, whole_ms
from cutloom.operators.periods import covered_periods

#: Table, its key, least gap in milliseconds.
SOURCES = (("dialogue_lines", "line_id", 500), ("shots", "shot_id", 1))


def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every period and gap of each reel, for lines and shots: source_table, reel_id, kind, start, end, n, least_gap."""
    parts = []
    for name, key, least in SOURCES:
        rows = latest(table(spark, sf_dir, name), key, "ingested_at", ["reel_id", "start_sec", "end_sec"])
        rows = rows.where("start_sec >= 0 AND NOT isnan(start_sec) AND NOT isnan(end_sec)")
        rows = rows.select("reel_id", whole_ms("start_sec").alias("start_ms"), whole_ms("end_sec").alias("end_ms"))
        found = covered_periods(rows, "reel_id", "start_ms", "end_ms")
        parts.append(found.select(F.lit(name).alias("source_table"), "*", F.lit(least).alias("least_gap")))
    return reduce(DataFrame.unionByName, parts)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = coverage(spark, sf_dir)
    rows = rows.where("(kind = 'period' AND n >= 2) OR (kind = 'gap' AND `end` - start >= least_gap)")
    return rows.select("source_table", "reel_id", F.col("kind").alias("interval_kind"), F.col("start").alias("start_ms"), F.col("end").alias("end_ms"))


def _sql(name: str, key: str, least: int) -> str:
    return f"""
    (WITH newest AS (
        SELECT {key} k, max_by(struct_pack(r := reel_id, s := start_sec, e := end_sec), ingested_at) b
        FROM {name} WHERE {key} IS NOT NULL GROUP BY 1),
     spans AS (
        SELECT b.r reel_id, CAST(round(b.s * 1000) AS BIGINT) s, CAST(round(b.e * 1000) AS BIGINT) e FROM newest
        WHERE b.r IS NOT NULL AND b.s IS NOT NULL AND b.e IS NOT NULL AND NOT isnan(b.s) AND NOT isnan(b.e) AND b.s >= 0),
     seen AS (
        SELECT *, max(e) OVER (PARTITION BY reel_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) far FROM spans WHERE e > s),
     marked AS (
        SELECT *, sum(CASE WHEN far IS NULL OR s > far THEN 1 ELSE 0 END) OVER (PARTITION BY reel_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) g FROM seen)
     SELECT '{name}' source_table, reel_id, 'period' interval_kind, min(s) start_ms, max(e) end_ms FROM marked GROUP BY reel_id, g HAVING count(*) >= 2
     UNION ALL
     SELECT '{name}', reel_id, 'gap', far, s FROM marked WHERE s - far >= {least})"""


QUERIES = {"p4_found": p4_found}
ORACLE = {"p4_found": " UNION ALL ".join(_sql(*x) for x in SOURCES)}
