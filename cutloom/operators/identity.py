"""Speakers and faces: centroids, nearest matches with abstention, votes, resolution, labels, registry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cutloom.functions.names import canonical_speaker_name, speaker_key
from cutloom.functions.vectors import dot, norm, unit

#: Largest table of centroids or names, in rows, that is sent to every task; larger ones are joined by shuffling.
BROADCAST_ROWS = 50_000


def checked_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """The frame with a broadcast hint if it has no more than so many rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def centroids(vectors: DataFrame, by: list[str], vector: str, weight: str | None = None) -> DataFrame:
    """Mean of the unit vectors of each group, again of unit length: by, centroid, members. A weight counts from 1e-3 on."""
    w = F.greatest(F.lit(1e-3), F.coalesce(F.col(weight), F.lit(0.0))) if weight else F.lit(1.0)
    rows = vectors.where(F.col(vector).isNotNull()).select(*by, w.alias("__w"), F.posexplode(unit(F.col(vector))).alias("i", "x"))
    means = rows.groupBy(*by, "i").agg((F.sum(F.col("__w") * F.col("x")) / F.sum("__w")).alias("x"), F.count(F.lit(1)).alias("members"))
    out = means.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda r: r["x"]).alias("centroid"), F.max("members").alias("members"))
    return out.withColumn("centroid", unit(F.col("centroid")))


def best_two(clips: DataFrame, known: DataFrame, key: str, vector: str = "embedding", name: str = "speaker", centroid: str = "centroid", pos: str = "cluster_id") -> DataFrame:
    """The two nearest centroids of each clip: key, best, best_name, second (−1 where there is one centroid), margin.

    Centroids are compared one by one, so two centroids of one speaker compete. Ties go to the smaller pos. Centroids go
    to every task as one row, in as many blocks as their number needs (BROADCAST_ROWS each); the blocks' best are merged.
    """
    unit_known = known.where(F.col(centroid).isNotNull()).select(F.col(pos).alias("__pos"), F.col(name).alias("__name"), unit(F.col(centroid)).alias("__c"))
    blocks = max(1, -(-unit_known.count() // BROADCAST_ROWS))
    rows = clips.where(F.col(vector).isNotNull()).select(key, unit(F.col(vector)).alias("__v"))
    found = None
    for block in range(blocks):
        own = unit_known if blocks == 1 else unit_known.where(F.pmod(F.xxhash64("__pos"), F.lit(blocks)) == block)
        packed = F.broadcast(own.agg(F.collect_list(F.struct("__pos", "__name", "__c")).alias("__all")))
        sims = F.transform("__all", lambda c: F.struct((-F.round(dot(F.col("__v"), c["__c"]), 12)).alias("s"), c["__pos"].alias("p"), c["__name"].alias("n")))
        part = rows.join(packed).select(key, F.slice(F.array_sort(sims), 1, 2).alias("__two"))
        found = part if found is None else found.unionByName(part)
    if blocks > 1:
        found = found.groupBy(key).agg(F.slice(F.array_sort(F.flatten(F.collect_list("__two"))), 1, 2).alias("__two"))
    found = found.where(F.size("__two") > 0)
    best, second = -F.get("__two", F.lit(0))["s"], F.coalesce(-F.get("__two", F.lit(1))["s"], F.lit(-1.0))
    return found.select(key, best.alias("best"), F.get("__two", F.lit(0))["n"].alias("best_name"), second.alias("second"), F.get("__two", F.lit(1))["n"].alias("second_name"), (best - second).alias("margin"))


def accept(matches: DataFrame, least: float = 0.65, margin: float = 0.0) -> DataFrame:
    """The best name where it is near enough and far enough before the second; null else."""
    ok = (F.col("best") >= least) & (F.col("margin") >= margin)
    return matches.withColumn("accepted", F.when(ok, F.col("best_name")))


def votes(detections: DataFrame, entity: str, name: str, least: int = 2) -> DataFrame:
    """Names of each entity with at least `least` votes, the most frequent first, earlier detections (pos) first on ties."""
    counted = detections.where(F.col(name).isNotNull()).groupBy(entity, name).agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("__first"))
    item = F.struct((-F.col("n")).alias("k"), "__first", F.col(name).alias("name"), "n")
    out = counted.groupBy(entity).agg(F.array_sort(F.collect_list(item)).alias("__v"))
    accepted = F.transform(F.filter("__v", lambda v: v["n"] >= least), lambda v: v["name"])
    return out.select(entity, F.array_join(accepted, ", ").alias("accepted"), F.size("__v").alias("names"), F.aggregate("__v", F.lit(0).cast("bigint"), lambda s, v: s + v["n"]).alias("votes"))


def energy_gate(clips: DataFrame, unit_key: str, peak: str, has_vector: str, below: float = 30.0) -> DataFrame:
    """Clips that have a vector, or a peak of minus infinity, or one at most so many dB under the unit's loudest clip."""
    loudest = F.max(F.when(F.col(peak) != float("-inf"), F.col(peak))).over(Window.partitionBy(unit_key))
    keep = F.col(has_vector) | (F.col(peak) == float("-inf")) | (F.col(peak) >= loudest - below)
    return clips.withColumn("__k", keep).where("__k").drop("__k")


def clip_candidates(lines: DataFrame, stems: DataFrame, activity: DataFrame, least_seconds: float = 0.3, silence_db: float = -60.0, least_voiced: float = 0.05) -> DataFrame:
    """Every line with the stems of its source group (all stems for a line without one), whether the clip is kept, and why not.

    lines: line_id, source_group, start, end (seconds); stems: stem_id, source_group; activity: line_id, stem_id, peak_dbfs,
    voiced_ratio. A line whose group has no stem is an error. Reasons are joined with '; '. Stems are few and go to every task.
    """
    grouped = lines.where(F.coalesce(F.trim("source_group"), F.lit("")) != "")
    missing = grouped.join(stems, "source_group", "left_anti").limit(1).collect()
    if missing:
        raise ValueError(f"no stem of source group {missing[0]['source_group']}")
    blank = lines.where(F.coalesce(F.trim("source_group"), F.lit("")) == "").drop("source_group").join(checked_broadcast(stems), how="cross")
    rows = grouped.join(stems, "source_group").unionByName(blank).join(activity, ["line_id", "stem_id"], "left")
    reasons = F.array_compact(F.array(
        F.when(F.col("end") - F.col("start") < least_seconds, "too short"),
        F.when(F.coalesce(F.col("peak_dbfs"), F.lit(float("-inf"))) <= silence_db, "silent"),
        F.when(F.coalesce(F.col("voiced_ratio"), F.lit(0.0)) < least_voiced, "not voiced"),
    ))
    return rows.withColumn("kept", F.size(reasons) == 0).withColumn("reason", F.array_join(reasons, "; "))


def pick_stem(clips: DataFrame, by: str, similarity: str, peak: str) -> DataFrame:
    """Per unit the clip of greatest similarity times the root of its relative power; the first by pos on ties."""
    w = Window.partitionBy(by)
    finite = F.when(F.col(peak) != float("-inf"), F.col(peak))
    power = F.coalesce(F.pow(F.lit(10.0), (finite - F.max(finite).over(w)) / 20), F.lit(0.0))
    rows = clips.withColumn("fused", F.round(F.col(similarity) * F.sqrt(power), 9))
    return rows.withColumn("__n", F.row_number().over(w.orderBy(F.desc("fused"), "pos"))).where("__n = 1").drop("__n")


def clip_override(matches: DataFrame, seconds: str, least_seconds: float = 1.5, least_margin: float = 0.15) -> Column:
    """The clip's own best name where it is long and clear enough to overrule its cluster; null else."""
    return F.when((F.col(seconds) >= least_seconds) & (F.col("margin") >= least_margin), F.col("best_name"))


def top_k(query: DataFrame, records: DataFrame, key: str, vector: str, k: int) -> DataFrame:
    """The k records nearest to each query (columns qid, qvec; few rows) by cosine: qid, key, similarity, rank."""
    pairs = records.where(F.col(vector).isNotNull()).join(checked_broadcast(query), how="cross")
    size = norm(F.col(vector)) * norm(F.col("qvec"))
    pairs = pairs.select("qid", key, F.round(F.when(size == 0, 0.0).otherwise(dot(F.col(vector), F.col("qvec")) / size), 9).alias("similarity"))
    w = Window.partitionBy("qid").orderBy(F.desc("similarity"), key)
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def softmax(df: DataFrame, by: list[str], value: str, name: str = "p") -> DataFrame:
    w = Window.partitionBy(*by)
    e = F.exp(F.col(value) - F.max(value).over(w))
    return df.withColumn("__e", e).withColumn(name, F.col("__e") / F.sum("__e").over(w)).drop("__e")


def resolve_speakers(shots: DataFrame, face: DataFrame, voice: DataFrame, only_missing: bool = True) -> DataFrame:
    """Speakers of each shot with their source: existing before face-db before voice-db, else unresolved.

    face: shot_id, face_names array; voice: shot_id, voice_names array. With only_missing a shot that has speakers keeps
    them; else it takes a match where there is one. Names are canonical, distinct and in order.
    """
    own = F.filter(F.transform(F.split(F.coalesce("existing_speaker", F.lit("")), "[;,]"), canonical_speaker_name), lambda x: x != "")
    clean = lambda c: F.array_distinct(F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), canonical_speaker_name), lambda x: x != ""))
    rows = shots.join(face, "shot_id", "left").join(voice, "shot_id", "left")
    rows = rows.withColumn("__own", F.array_distinct(own)).withColumn("__face", clean(F.col("face_names"))).withColumn("__voice", clean(F.col("voice_names")))
    order = [("existing", "__own"), ("face-db", "__face"), ("voice-db", "__voice")] if only_missing else [("face-db", "__face"), ("voice-db", "__voice"), ("existing", "__own")]
    source, names = F.lit("unresolved"), F.array().cast("array<string>")
    for name, column in reversed(order):
        source = F.when(F.size(column) > 0, name).otherwise(source)
        names = F.when(F.size(column) > 0, F.col(column)).otherwise(names)
    return rows.select("shot_id", F.array_join(names, ", ").alias("speakers"), source.alias("source"))


def plan_from_voice_db(clips: DataFrame, members: DataFrame, names: DataFrame) -> DataFrame:
    """Clips with the speaker of their voice cluster and a status: matched, skipped, unlabeled, ungrouped or missing.

    members: clip_id, cluster_id (null: ungrouped); names: cluster_id, name ('skip' for a cluster to leave out).
    """
    rows = clips.join(members.withColumn("__known", F.lit(True)), "clip_id", "left").join(names, "cluster_id", "left")
    label = F.coalesce(F.trim("name"), F.lit(""))
    status = (
        F.when(F.col("__known").isNull(), "missing").when(F.col("cluster_id").isNull(), "ungrouped")
        .when(F.lower(label) == "skip", "skipped").when(label == "", "unlabeled").otherwise("matched")
    )
    rows = rows.withColumn("status", status)
    hit = F.col("status") == "matched"
    return rows.select("clip_id", "line_id", "shot_id", F.col("cluster_id"), F.when(hit, F.upper(label)).otherwise("").alias("speaker"), "status", F.when(hit, 1.0).otherwise(0.0).alias("score"))


def apply_labels(clusters: DataFrame, labels: DataFrame, on: list[str]) -> DataFrame:
    """Clusters with the name of their last label row (by pos); a blank label leaves the old name."""
    w = Window.partitionBy(*on).orderBy(F.desc("pos"))
    last = labels.where(F.coalesce(F.trim("label"), F.lit("")) != "").withColumn("__n", F.row_number().over(w)).where("__n = 1").select(*on, F.upper(F.trim("label")).alias("label"))
    return clusters.join(last, on, "left").withColumn("applied", F.col("label").isNotNull()).withColumn("name", F.coalesce("label", "name")).drop("label")


def alias_lookup(names: DataFrame, registry: DataFrame, by: list[str]) -> DataFrame:
    """The registered speaker of each written name (column text): the first, by pos, with that key as name, key or alias."""
    rows = registry.select(*by, "pos", "speaker_key", F.explode(F.array_compact(F.concat(F.array("speaker_key", "name"), F.coalesce("aliases", F.array())))).alias("__n"))
    rows = rows.withColumn("__key", speaker_key(F.col("__n"))).where("__key != ''").groupBy(*by, "__key").agg(F.min(F.struct("pos", "speaker_key")).alias("__s"))
    rows = rows.select(*by, "__key", F.col("__s")["speaker_key"].alias("registered"))
    return names.withColumn("__key", speaker_key(F.col("text"))).join(checked_broadcast(rows), [*by, "__key"], "left").drop("__key")


def ordered_distinct(rows: DataFrame, by: list[str], name: str) -> DataFrame:
    """The first row, by pos, of every key of a name."""
    keyed = rows.withColumn("__key", speaker_key(F.col(name))).where("__key != ''")
    w = Window.partitionBy(*by, "__key").orderBy("pos")
    return keyed.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n", "__key")


def dominant(rows: DataFrame, by: list[str], value: str, out: str) -> DataFrame:
    """The most frequent value that isn't blank, the first seen (pos) on ties."""
    counted = rows.where(F.coalesce(F.trim(value), F.lit("")) != "").groupBy(*by, value).agg(F.count(F.lit(1)).alias("__c"), F.min("pos").alias("__p"))
    best = counted.groupBy(*by).agg(F.min(F.struct((-F.col("__c")).alias("k"), "__p", F.col(value).alias("v"), F.col("__c").alias("c"))).alias("__b"))
    return best.select(*by, F.col("__b")["v"].alias(out), F.col("__b")["c"].alias(f"{out}_count"))


def language_vote(windows: DataFrame, by: list[str], requested: int, least: float = 0.6) -> DataFrame:
    """The language most windows speak, its share of the windows asked for, and whether it is sure enough."""
    best = dominant(windows, by, "code", "language")
    return best.withColumn("confidence", F.col("language_count") / F.lit(requested)).withColumn("sure", F.col("confidence") >= least)


def changed_inputs(recorded: DataFrame, current: DataFrame, by: list[str]) -> DataFrame:
    """Names whose fingerprint differs or is new; of an owner without any record, none. Columns: by, name, fingerprint."""
    owners = recorded.select(*by).distinct()
    both = current.withColumnRenamed("fingerprint", "__now").join(recorded.withColumnRenamed("fingerprint", "__then"), [*by, "name"], "left")
    both = both.where(~F.col("__now").eqNullSafe(F.col("__then")))
    return both.join(owners, by, "left_semi").select(*by, "name", F.col("__then").isNull().alias("is_new"))


def first_by_path(rows: DataFrame, path: str, priority: str) -> DataFrame:
    """One row a path: the least priority, then the first by pos."""
    w = Window.partitionBy(path).orderBy(priority, "pos")
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def exemplars(rows: DataFrame, by: list[str], quality: str, time: str, limit: int) -> DataFrame:
    """`limit` rows a group, evenly spaced in time among the twice as many of best quality."""
    good = rows.withColumn("__q", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(quality), "pos"))).where(F.col("__q") <= 2 * limit)
    w = Window.partitionBy(*by)
    good = good.withColumn("__i", F.row_number().over(w.orderBy(time, "pos")) - 1).withColumn("__n", F.count(F.lit(1)).over(w))
    spots = F.transform(F.sequence(F.lit(0), F.lit(limit - 1)), lambda i: F.floor(i * (F.col("__n") - 1) / max(1, limit - 1)))
    return good.where((F.col("__n") <= limit) | F.array_contains(spots, F.col("__i").cast("bigint"))).drop("__q", "__i", "__n")
