"""Tables that media tools, models and services hand over, read and checked against their schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cutloom import schemas


def schema_of(name: str) -> StructType:
    """The schema of a table of `schemas.TABLES`."""
    if name not in schemas.TABLES:
        raise ValueError(f"no captured table {name}; known are {', '.join(sorted(schemas.TABLES))}")
    return StructType.fromDDL(schemas.TABLES[name])


def captured(spark: SparkSession, path: str, name: str, form: str = "parquet") -> DataFrame:
    """A captured table in its schema's columns, order and types; other columns are dropped, a missing one is an error.

    JSON and CSV are read in that schema; values that don't fit a type are null (parquet: an error of the cast).
    """
    schema = schema_of(name)
    reader = spark.read.format(form)
    if form == "csv":
        reader = reader.option("header", True)
    found = reader.load(path)
    missing = [f.name for f in schema if f.name not in found.columns]
    if missing:
        raise ValueError(f"{name} at {path} lacks {', '.join(missing)}")
    if form == "json":
        found = spark.read.schema(schema).json(path)
    cast = (lambda f: F.col(f"`{f.name}`").try_cast(f.dataType)) if form == "csv" else (lambda f: F.col(f"`{f.name}`").cast(f.dataType))
    return found.select(*[cast(f).alias(f.name) for f in schema])
