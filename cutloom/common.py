"""Reading tables, keeping the newest version of a key, cutting lineage."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def latest(df: DataFrame, key: str, version: str, columns: list[str]) -> DataFrame:
    """The row of each key with the greatest version, reduced to the columns.

    A maximum of structs combines on the map side, so a key that holds a large share of all rows never
    meets in one task. Rows with a null key are dropped; a null version is older than any other; rows equal in
    all the columns are one row; of different rows of the same version the greatest by value wins.
    """
    rest = [c for c in columns if c != key]
    best = F.max(F.struct(F.col(version).alias("__v"), *rest)).alias("__best")
    return (
        df.where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(best)
        .select(key, *[F.col("__best")[c].alias(c) for c in rest])
    )


def whole_ms(seconds: str | Column) -> Column:
    """Seconds as whole milliseconds; null for null and NaN."""
    x = F.col(seconds) if isinstance(seconds, str) else seconds
    return F.when(~F.isnan(x), F.round(x * 1000).cast("bigint"))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where it is unset, local sessions (tests) take a folder of their
    own; on a cluster a folder of one machine would lose rows, so there the setting is demanded."""
    sc = spark.sparkContext
    known = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if known:
        return known
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    sc.setCheckpointDir(os.path.join(tempfile.gettempdir(), "cutloom-checkpoints"))
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """The frame written to a table in the shared folder and read again, so that lost executors cost no rework.

    The table goes with `dropped`, or else when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/cutloom-{uuid.uuid4().hex}"
    _files(spark, path)[0].deleteOnExit(_files(spark, path)[1])
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cutloom_table = path
    return out


def dropped(*frames: DataFrame) -> None:
    """Delete the tables behind frames that `cut_lineage` returned, once nothing reads them any more."""
    for frame in frames:
        files, path = _files(frame.sparkSession, frame._cutloom_table)
        files.delete(path, True)


def _files(spark: SparkSession, path: str) -> tuple:
    """Hadoop's file system of a path, and the path."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at
