"""The speaker registry as tables: seeding, upserting clusters, linking names, label templates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cutloom.functions.names import canonical_speaker_name, speaker_key


def seed(registry: DataFrame, configured: DataFrame) -> DataFrame:
    """Speakers of both tables (speaker_key, name, aliases, voice_clusters, face_clusters); lists are united and sorted, known names kept."""
    both = registry.withColumn("__o", F.lit(0)).unionByName(configured.withColumn("__o", F.lit(1)), allowMissingColumns=True)
    united = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce(F.col(c), F.array().cast(dict(both.dtypes)[c])))))).alias(c)
    return both.groupBy("speaker_key").agg(F.min_by("name", "__o").alias("name"), *[united(c) for c in ("aliases", "voice_clusters", "face_clusters") if c in both.columns])


def upsert_clusters(known: DataFrame, new: DataFrame, names: DataFrame) -> DataFrame:
    """Clusters (cluster_id, name, centroid): the new table replaces the known one; names that no registered speaker has become blank.

    names: key, speaker_key. The clusters known before keep nothing but their id's name where the new ones have none.
    """
    old = known.select("cluster_id", F.col("name").alias("__old"))
    rows = new.join(old, "cluster_id", "left").withColumn("name", F.coalesce(F.nullif(F.trim("name"), F.lit("")), "__old", F.lit(""))).drop("__old")
    rows = rows.withColumn("key", speaker_key(F.col("name"))).join(names.dropDuplicates(["key"]), "key", "left")
    return rows.withColumn("name", F.when(F.col("speaker_key").isNotNull(), canonical_speaker_name(F.col("name"))).otherwise("")).drop("key")


def link(registry: DataFrame, clusters: DataFrame, field: str) -> DataFrame:
    """The registry with each speaker's clusters added to the sorted set `field`."""
    own = clusters.where("speaker_key IS NOT NULL").groupBy("speaker_key").agg(F.collect_set("cluster_id").alias("__ids"))
    empty = F.array().cast(dict(registry.dtypes)[field])
    return registry.join(own, "speaker_key", "left").withColumn(field, F.array_sort(F.array_union(F.coalesce(field, empty), F.coalesce("__ids", empty)))).drop("__ids")


def label_template(clusters: DataFrame, kind: str, relabel: bool = False) -> DataFrame:
    """Rows to be labelled by hand, those with most evidence first; clusters that have a name only when relabelled."""
    rows = clusters if relabel else clusters.where(F.coalesce(F.trim("name"), F.lit("")) == "")
    return rows.select(F.concat(F.lit(f"{kind}:"), F.col("cluster_id").cast("string")).alias("cluster_ref"), F.lit(kind).alias("type"), "cluster_id", F.coalesce("name", F.lit("")).alias("current_name"), F.lit("").alias("speaker"), "evidence_count").orderBy(F.desc("evidence_count"), "cluster_id")


def cluster_kind(members: DataFrame) -> DataFrame:
    """singleton, continuity or cluster for each cluster, by its members' modes."""
    mode = F.coalesce(F.col("mode"), F.lit(""))
    return members.groupBy("cluster_id").agg(F.when(F.bool_or(mode == "singleton"), "singleton").when(F.bool_or(mode != ""), "continuity").otherwise("cluster").alias("kind"))
