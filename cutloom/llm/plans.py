"""Queries p1, p2, p3, p5, p6, p7 and p8 over the driver's tables, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cutloom.common import latest, table, whole_ms
from cutloom.llm.clusters import describe_clusters, similarity_clusters
from cutloom.llm.leaks import leaks
from cutloom.llm.neighbours import similar_vectors
from cutloom.llm.runs import collapse_runs, label_key
from cutloom.llm.subjects import area_of_label, subject_areas
from cutloom.llm.tokens import encode_corpus
from cutloom.llm.turns import speaker_turns

#: p1, p5: table, its key, dimensions of its embeddings.
VECTORS = (("voice_inputs", "clip_id", 192), ("face_observations", "face_id", 256))
#: p1: least cosine of a pair.
LEAST_COSINE = 0.95
#: p3: an event further than this from its predecessor starts a new run; runs of fewer events are no cases.
MAX_GAP_MS, LEAST_RUN = 20_000, 3


def _lines(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The newest version of every line with a usable start."""
    rows = latest(table(spark, sf_dir, "dialogue_lines"), "line_id", "ingested_at", ["reel_id", "start_sec", *columns])
    return rows.where("reel_id IS NOT NULL AND start_sec >= 0 AND NOT isnan(start_sec)").withColumn("start_ms", whole_ms("start_sec"))


def p1_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten most similar others of every usable record."""
    parts = [similar_vectors(table(spark, sf_dir, name), key, "embedding", dim, "ingested_at").select(F.lit(name).alias("source_table"), F.col(key).alias("key"), "neighbour", "similarity", "rank") for name, key, dim in VECTORS]
    return parts[0].unionByName(parts[1])


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = []
    for name, key, dim in VECTORS:
        near = similar_vectors(table(spark, sf_dir, name), key, "embedding", dim, "ingested_at", least=LEAST_COSINE, near=True)
        parts.append(near.select(F.lit(name).alias("source_table"), F.least(key, "neighbour").alias("key_a"), F.greatest(key, "neighbour").alias("key_b")).distinct())
    return parts[0].unionByName(parts[1])


def _clusters(spark: SparkSession, sf_dir: str) -> list[tuple[str, str, DataFrame]]:
    return [(name, key, similarity_clusters(table(spark, sf_dir, name), key, "embedding", dim, "ingested_at")) for name, key, dim in VECTORS]


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [found.select(F.lit(name).alias("source_table"), F.col(key).alias("member_key"), F.col("cluster").alias("cluster_key")) for name, key, found in _clusters(spark, sf_dir)]
    return parts[0].unionByName(parts[1])


def p5_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each cluster its size and its most typical members."""
    parts = [describe_clusters(found, key).select(F.lit(name).alias("source_table"), F.col("cluster").alias("cluster_key"), "size", "typical") for name, key, found in _clusters(spark, sf_dir)]
    return parts[0].unionByName(parts[1])


def p2_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _lines(spark, sf_dir, "project_id", "text", "diarized_speaker", "speaker")
    return speaker_turns(lines, table(spark, sf_dir, "speakers"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2_turns(spark, sf_dir).select("reel_id", "first_line_id", "last_line_id", "speaker_key", "n_words")


def p3_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every run of lines with the same labels as one event with its count and duration."""
    lines = _lines(spark, sf_dir, "end_sec", "diarized_speaker", "source_group")
    end = F.when(F.col("end_sec") > F.col("start_sec"), whole_ms("end_sec"))
    lines = lines.select("reel_id", "line_id", "start_ms", F.coalesce(end, "start_ms").alias("end_ms"), label_key(F.col("diarized_speaker")).alias("diarized"), label_key(F.col("source_group")).alias("source"))
    runs = collapse_runs(lines.where("diarized IS NOT NULL AND source IS NOT NULL"), "reel_id", "start_ms", "line_id", ["diarized", "source"], MAX_GAP_MS, until="end_ms")
    return runs.select("reel_id", F.col("first_key").alias("first_line_id"), F.col("last_key").alias("last_line_id"), "diarized", "source", F.col("first_at").alias("start_ms"), (F.col("until") - F.col("first_at")).alias("duration_ms"), F.col("n").alias("n_events"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p3_runs(spark, sf_dir).where(F.col("n_events") >= LEAST_RUN).select("reel_id", "first_line_id", "last_line_id", "n_events")


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_corpus(table(spark, sf_dir, "documents"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    codes = sorted(r[0] for r in table(spark, sf_dir, "subject_areas").select("area_code").distinct().collect())
    labels = table(spark, sf_dir, "subject_labels").select("doc_id", area_of_label(F.col("area_label"), codes).alias("area"))
    return subject_areas(docs, labels).select("doc_id", "area_code")


def _label_sql(column: str) -> str:
    text = f"regexp_replace(lower({column}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')"
    text = f"regexp_replace({text}, '([0-9]+)', ' \\1 ', 'g')"
    text = f"regexp_replace({text}, '\\b0+([0-9])', '\\1', 'g')"
    text = f"regexp_replace({text}, '\\bspkr?\\b', 'speaker', 'g')"
    return f"nullif(replace({text}, ' ', ''), '')"


P3_RUNS_SQL = f"""
WITH newest AS (
    SELECT line_id, max_by(struct_pack(r := reel_id, s := start_sec, e := end_sec, d := diarized_speaker, g := source_group), ingested_at) b
    FROM dialogue_lines WHERE line_id IS NOT NULL GROUP BY 1),
 used AS (
    SELECT line_id, b.r reel_id, CAST(round(b.s * 1000) AS BIGINT) s, CASE WHEN b.e > b.s AND NOT isnan(b.e) THEN CAST(round(b.e * 1000) AS BIGINT) ELSE CAST(round(b.s * 1000) AS BIGINT) END e,
        {_label_sql("b.d")} d, {_label_sql("b.g")} g
    FROM newest WHERE b.r IS NOT NULL AND b.s >= 0 AND NOT isnan(b.s)),
 flagged AS (
    SELECT *, CASE WHEN lag(d) OVER w = d AND lag(g) OVER w = g AND s - lag(s) OVER w <= {MAX_GAP_MS} THEN 0 ELSE 1 END f
    FROM used WHERE d IS NOT NULL AND g IS NOT NULL WINDOW w AS (PARTITION BY reel_id ORDER BY s, line_id)),
 numbered AS (SELECT *, sum(f) OVER (PARTITION BY reel_id ORDER BY s, line_id ROWS UNBOUNDED PRECEDING) run FROM flagged)
SELECT reel_id, arg_min(line_id, (s, line_id)) first_line_id, arg_max(line_id, (s, line_id)) last_line_id, min(d) diarized, min(g) source,
    min(s) start_ms, max(e) - min(s) duration_ms, count(*) n_events
FROM numbered GROUP BY reel_id, run"""

QUERIES = {"p1_found": p1_found, "p1_neighbours": p1_neighbours, "p5_found": p5_found, "p5_clusters": p5_clusters, "p2_found": p2_found, "p2_turns": p2_turns, "p3_found": p3_found, "p3_runs": p3_runs, "p6_ids": p6_ids, "p7_found": p7_found, "p8_found": p8_found}
ORACLE = {
    "p3_runs": P3_RUNS_SQL,
    "p3_found": f"SELECT reel_id, first_line_id, last_line_id, n_events FROM ({P3_RUNS_SQL}) WHERE n_events >= {LEAST_RUN}",
}
