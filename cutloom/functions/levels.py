"""Decibels, gains, lenient coercion and hashing as column expressions."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

FLOOR_DB, TINY = -120.0, 1e-12


def power_db(power: Column) -> Column:
    return F.greatest(F.lit(FLOOR_DB), 10 * F.log10(F.greatest(power, F.lit(TINY))))


def amplitude_db(amplitude: Column) -> Column:
    return F.greatest(F.lit(FLOOR_DB), 20 * F.log10(F.greatest(amplitude, F.lit(TINY**0.5))))


def lufs(energy: Column) -> Column:
    return F.greatest(F.lit(FLOOR_DB), -0.691 + 10 * F.log10(F.greatest(energy, F.lit(TINY))))


def db_to_gain(db: Column) -> Column:
    return F.pow(F.lit(10.0), db / 20)


def gain_to_db(gain: Column, floor: float = FLOOR_DB) -> Column:
    return F.when(gain > 0, F.greatest(F.lit(floor), 20 * F.log10(F.greatest(gain, F.lit(1e-300))))).otherwise(floor)


def coerce_float(value: Column, default: float = 0.0) -> Column:
    """A number, else the default."""
    return F.coalesce(value.try_cast("double"), F.lit(float(default)))


def optional_float(value: Column) -> Column:
    """A number, else null."""
    return F.trim(value.cast("string")).try_cast("double")


def truthy(value: Column) -> Column:
    """False for null, blank, 0, false, no and n; true for any other text."""
    return F.coalesce(~F.lower(F.trim(value.cast("string"))).isin("", "0", "false", "no", "n"), F.lit(False))


def parse_rate(value: Column) -> Column:
    """A frame rate given as a fraction or a number; 0 for anything else."""
    parts = F.split(F.trim(value), "/")
    low = F.coalesce(F.get(parts, F.lit(1)).try_cast("double"), F.when(F.size(parts) == 1, 1.0))
    return F.coalesce(F.when(low != 0, F.get(parts, F.lit(0)).try_cast("double") / low), F.lit(0.0))


def is_variable_rate(real: Column, average: Column) -> Column:
    return F.coalesce(F.abs(parse_rate(real) - parse_rate(average)) > 0.01, F.lit(False))


def masking_risk(dialogue: Column, background: Column) -> Column:
    """Share of the background in both powers, between 0 and 1."""
    d, b = F.greatest(dialogue, F.lit(0.0)), F.greatest(background, F.lit(0.0))
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), b / (d + b + TINY)))


def full_scale(width: Column) -> Column:
    """Greatest magnitude of a PCM sample of so many bytes."""
    return F.when(width == 1, 128.0).when(width == 2, 32768.0).when(width == 3, 8388608.0).when(width == 4, 2147483648.0)


def pcm_codec(width: Column) -> Column:
    """Codec name of a sample width in bytes; 24 bit for others."""
    return F.when(width == 1, "pcm_u8").when(width == 2, "pcm_s16le").when(width == 4, "pcm_s32le").otherwise("pcm_s24le")


def content_fingerprint(content: Column, part: int = 4 * 1024 * 1024) -> Column:
    """sha256 of a binary's first part, and of its last part too where it is longer than two."""
    size = F.length(content)
    ends = F.concat(F.substring(content, 1, part), F.substring(content, -part, part))
    return F.sha2(F.when(size > 2 * part, ends).otherwise(F.substring(content, 1, part)), 256)


def file_entry(content: Column, part: int = 4 * 1024 * 1024) -> Column:
    """A file's fingerprint as JSON with sorted keys."""
    return F.format_string('{"sha256": "%s", "size": %d}', content_fingerprint(content, part), F.length(content))


@F.pandas_udf(StringType())
def value_entry(values: pd.Series) -> pd.Series:
    """A text's fingerprint as JSON with sorted keys: the sha256 of its JSON writing (ASCII only) and its type; null for null and empty."""
    entry = lambda v: json.dumps({"sha256": hashlib.sha256(json.dumps(v).encode()).hexdigest(), "value_type": "str"})
    return values.map(lambda v: entry(v) if v else None)


def list_fingerprint(entries: Column) -> Column:
    """count and sha256 of labelled fingerprints (array of label and entry, as JSON): in order of the labels, each label and its entry. Null entries don't count."""
    known = F.array_sort(F.filter(entries, lambda e: e["entry"].isNotNull()))
    text = F.array_join(F.transform(known, lambda e: F.concat(e["label"], e["entry"])), "")
    return F.struct(F.size(known).alias("count"), F.sha2(text, 256).alias("sha256"))


def stable_digest(value: object) -> str:
    """sha256 of a value's JSON writing with sorted keys and no blanks."""
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":"), default=str).encode()).hexdigest()


def billed_minutes(seconds: Column, least: int = 1) -> Column:
    """Whole minutes begun, at least `least`."""
    return F.greatest(F.lit(least).cast("bigint"), F.ceil(seconds / 60))


def nfft_frames(length: Column, n_fft: int, hop: int) -> Column:
    """Frames of a padded transform over so many samples."""
    return F.ceil((length + n_fft) / hop) + 1
