"""Overlapping and gapped time intervals: covered periods and the gaps between them."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Width of a time shard; a shard is the unit that one window group sees.
SHARD_MS = 600_000


def covered_periods(df: DataFrame, entity: str, start: str, end: str, shard_ms: int = SHARD_MS) -> DataFrame:
    """Merge the intervals of each entity that overlap or touch; list the gaps between the merged periods.

    Returns entity, kind ('period' or 'gap'), start, end, n (rows merged; null for gaps). start and end are whole
    numbers (milliseconds). Rows with a null entity, start or end, or an end not after the start, are left out;
    repeated rows count as often as they occur; an empty table gives an empty result.

    Two levels, so that an entity with a large share of all rows is spread over many tasks. Every interval belongs to
    the time shard of its start. One row per shard tells how far its intervals reach; the running maximum of that
    over the earlier shards, clipped into a shard, stands for everything that reaches into it, however long. With it
    each shard merges alone and knows its gaps. Only pieces at a shard's edges are stitched over shards afterwards.
    """
    e, s, t = "__entity", "__s", "__e"
    rows = df.select(F.col(entity).alias(e), F.col(start).cast("bigint").alias(s), F.col(end).cast("bigint").alias(t))
    rows = rows.where(F.col(e).isNotNull() & (F.col(t) > F.col(s)))
    rows = rows.withColumn("__shard", F.floor(F.col(s) / F.lit(shard_ms)))

    earlier = Window.partitionBy(e).orderBy("__shard").rowsBetween(Window.unboundedPreceding, -1)
    reach = rows.groupBy(e, "__shard").agg(F.max(t).alias("__far"))
    reach = reach.select(e, "__shard", F.max("__far").over(earlier).alias("__carry"))

    local = Window.partitionBy(e, "__shard").orderBy(s, t)
    before = F.greatest(F.col("__carry"), F.max(t).over(local.rowsBetween(Window.unboundedPreceding, -1)))
    marked = rows.join(reach, [e, "__shard"]).withColumn("__before", before)
    marked = marked.withColumn("__new", F.col("__before").isNull() | (F.col(s) > F.col("__before")))
    marked = marked.withColumn("__piece", F.sum(F.col("__new").cast("int")).over(local.rowsBetween(Window.unboundedPreceding, 0)))
    pieces = marked.groupBy(e, "__shard", "__piece").agg(
        F.min(s).alias(s), F.max(t).alias(t), F.count(F.lit(1)).alias("n"), F.min(F.when(F.col("__new"), F.col("__before"))).alias("__before")
    )
    last = F.max("__piece").over(Window.partitionBy(e, "__shard"))
    pieces = pieces.withColumn("__edge", (F.col("__piece") == 0) | (F.col("__piece") == last)).persist(StorageLevel.MEMORY_AND_DISK)

    out = [F.col(e).alias(entity), F.lit("period").alias("kind"), F.col(s).alias("start"), F.col(t).alias("end"), F.col("n").cast("bigint").alias("n")]
    inner = pieces.where(~F.col("__edge")).select(*out)
    chain = F.sum((F.col("__piece") > 0).cast("int")).over(Window.partitionBy(e).orderBy("__shard", "__piece").rowsBetween(Window.unboundedPreceding, 0))
    stitched = pieces.where("__edge").withColumn("__chain", chain).groupBy(e, "__chain").agg(F.min(s).alias(s), F.max(t).alias(t), F.sum("n").alias("n")).select(*out)
    gaps = pieces.where((F.col("__piece") > 0) & F.col("__before").isNotNull()).select(
        F.col(e).alias(entity), F.lit("gap").alias("kind"), F.col("__before").alias("start"), F.col(s).alias("end"), F.lit(None).cast("bigint").alias("n")
    )
    return inner.unionByName(stitched).unionByName(gaps)
