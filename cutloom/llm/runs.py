"""Repeated consecutive events: each run collapsed into one event."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Width of a time shard in milliseconds; a shard is the unit that one window group sees.
SHARD_MS = 600_000
#: Abbreviations of label words, a fixed list.
ABBREVIATIONS = {"spk": "speaker", "spkr": "speaker"}


def label_key(label: Column, abbreviations: dict[str, str] = ABBREVIATIONS) -> Column:
    """A label without case, separators, padding and abbreviation; null where no letter or digit is left."""
    text = F.regexp_replace(F.lower(label), r"[^\p{L}\p{N}]++", "")
    text = F.when(text.contains("0"), F.regexp_replace(text, r"(?<![0-9])0+(?=[0-9])", "")).otherwise(text)
    whole = text
    for short, word in abbreviations.items():
        whole = F.when(text.rlike(rf"^{short}(?:[0-9]|$)"), F.concat(F.lit(word), F.substring(text, len(short) + 1, 1_000_000))).otherwise(whole)
    return F.nullif(whole, F.lit(""))


def collapse_runs(df: DataFrame, entity: str, at: str, key: str, same: list[str], max_gap: int | None = None, weight: str | None = None, until: str | None = None, shard: int = SHARD_MS) -> DataFrame:
    """Collapse each run of consecutive events of an entity that agree in `same` (null equals null).

    Returns entity, the same columns, first_key, last_key, first_at, last_at, until (greatest), n (events), weight
    (summed). Events are ordered by `at`, ties by `key`; with max_gap an event further than that from its predecessor
    starts a new run. Events with a null entity or `at` are left out. An empty table gives an empty result.

    A lag window flags changes, the running sum of the flags numbers the runs, and the runs are aggregated. The
    windows see one entity and time shard at a time; the first and the last run of each shard are then chained over
    the shards, so an entity with a large share of all rows is spread over many tasks.
    """
    e, t, k = "__entity", "__at", "__key"
    labels = [f"__same{i}" for i in range(len(same))]
    rows = df.select(
        F.col(entity).alias(e), F.col(at).cast("bigint").alias(t), F.col(key).alias(k), *[F.col(c).alias(x) for c, x in zip(same, labels)],
        (F.col(weight) if weight else F.lit(1)).cast("bigint").alias("__w"), (F.col(until) if until else F.col(at)).cast("bigint").alias("__until"),
    ).where(F.col(e).isNotNull() & F.col(t).isNotNull())
    rows = rows.withColumn("__shard", F.floor(F.col(t) / F.lit(shard)))

    local = Window.partitionBy(e, "__shard").orderBy(t, k)
    changed = F.lag(t).over(local).isNull()
    for x in labels:
        changed = changed | ~F.lag(x).over(local).eqNullSafe(F.col(x))
    if max_gap is not None:
        changed = changed | (F.col(t) - F.lag(t).over(local) > max_gap)
    rows = rows.withColumn("__new", changed.cast("int")).withColumn("__run", F.sum("__new").over(local.rowsBetween(Window.unboundedPreceding, 0)))

    def merged(first: Column, last: Column, n: Column, w: Column, until_: Column) -> list[Column]:
        return [F.min(first).alias("__first"), F.max(last).alias("__last"), F.sum(n).alias("__n"), F.sum(w).alias("__w"), F.max(until_).alias("__until")]

    ends = F.struct(t, k)
    runs = rows.groupBy(e, "__shard", "__run", *labels).agg(*merged(ends, ends, F.lit(1), F.col("__w"), F.col("__until")))
    edge = (F.col("__run") == 1) | (F.col("__run") == F.max("__run").over(Window.partitionBy(e, "__shard")))
    runs = runs.withColumn("__edge", edge).persist(StorageLevel.MEMORY_AND_DISK)

    over = Window.partitionBy(e).orderBy("__shard", "__run")
    starts = F.lag("__shard").over(over).isNull() | (F.lag("__shard").over(over) == F.col("__shard"))
    for x in labels:
        starts = starts | ~F.lag(x).over(over).eqNullSafe(F.col(x))
    if max_gap is not None:
        starts = starts | (F.col("__first")[t] - F.lag("__last").over(over)[t] > max_gap)
    chains = runs.where("__edge").withColumn("__new", starts.cast("int"))
    chains = chains.withColumn("__chain", F.sum("__new").over(over.rowsBetween(Window.unboundedPreceding, 0)))
    chains = chains.groupBy(e, "__chain", *labels).agg(*merged(F.col("__first"), F.col("__last"), F.col("__n"), F.col("__w"), F.col("__until")))

    out = [
        F.col(e).alias(entity), *[F.col(x).alias(c) for c, x in zip(same, labels)],
        F.col("__first")[k].alias("first_key"), F.col("__last")[k].alias("last_key"), F.col("__first")[t].alias("first_at"), F.col("__last")[t].alias("last_at"),
        F.col("__until").alias("until"), F.col("__n").alias("n"), F.col("__w").alias("weight"),
    ]
    return runs.where(~F.col("__edge")).select(*out).unionByName(chains.select(*out))
