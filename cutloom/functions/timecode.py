"""SMPTE timecode, frames and seconds as column expressions. fps is a number or a column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Rate = float | Column
TIMECODE = r"^\d{1,2}[:;]\d{2}[:;]\d{2}[:;]\d{1,2}$"


def _rate(fps: Rate) -> Column:
    return fps if isinstance(fps, Column) else F.lit(float(fps))


def nominal_rate(fps: Rate) -> Column:
    """Labels counted a second: 30 for 29.97."""
    return F.rint(_rate(fps)).cast("bigint")


def _drops(fps: Rate) -> Column:
    return nominal_rate(fps).isin(30, 60) & (_rate(fps) < nominal_rate(fps))


def smpte_to_frames(value: Column, fps: Rate) -> Column:
    """Absolute frame of a timecode, of bare seconds the nearest frame (half to even); null for other text and fps <= 0."""
    text = F.trim(value)
    parts = F.split(text, "[:;]")
    number = [F.get(parts, F.lit(i)).try_cast("bigint") for i in range(4)]
    nominal = nominal_rate(fps)
    frame = (number[0] * 3600 + number[1] * 60 + number[2]) * nominal + number[3]
    minutes = number[0] * 60 + number[1]
    dropped = F.lit(2) * (nominal / 30).cast("bigint") * (minutes - F.floor(minutes / 10))
    frame = F.when(text.contains(";") & _drops(fps), frame - dropped).otherwise(frame)
    seconds = F.rint(text.try_cast("double") * _rate(fps)).cast("bigint")
    coded = F.when(F.size(parts) == 4, frame)
    return F.when((_rate(fps) > 0) & (text != ""), F.when(text.rlike("[:;]"), coded).otherwise(seconds))


def smpte_to_seconds(value: Column, fps: Rate) -> Column:
    """Seconds of a timecode at the true rate; bare numbers are seconds already."""
    text = F.trim(value)
    return F.when(text.rlike("[:;]"), smpte_to_frames(value, fps) / _rate(fps)).otherwise(text.try_cast("double"))


def frames_to_smpte(frame: Column, fps: Rate, drop_frame: bool | Column = False) -> Column:
    """Timecode of a frame (negative ones as 0); with drop_frame the ';' form where the rate has one."""
    nominal = nominal_rate(fps)
    want = drop_frame if isinstance(drop_frame, Column) else F.lit(bool(drop_frame))
    drop = want & _drops(fps)
    n = F.greatest(frame.cast("bigint"), F.lit(0).cast("bigint"))
    dropped = F.lit(2) * (nominal / 30).cast("bigint")
    per_minute = nominal * 60 - dropped
    per_ten = per_minute * 10 + dropped
    tens, rest = F.floor(n / per_ten), n % per_ten
    shifted = n + dropped * 9 * tens + F.when(rest > dropped, dropped * F.floor((rest - dropped) / per_minute)).otherwise(0)
    n = F.when(drop, shifted).otherwise(n).cast("bigint")
    total = F.floor(n / nominal)
    sep = F.when(drop, ";").otherwise(":")
    two = lambda x: F.lpad(x.cast("bigint").cast("string"), 2, "0")
    hours = F.floor(total / 3600)
    hours = F.when(hours < 100, two(hours)).otherwise(hours.cast("string"))
    return F.concat(hours, F.lit(":"), two(F.floor(total / 60) % 60), F.lit(":"), two(total % 60), sep, two(n % nominal))


def seconds_to_frames(seconds: Column, fps: Rate) -> Column:
    """Nearest frame, half to even."""
    return F.rint(seconds * _rate(fps)).cast("bigint")


def frames_to_seconds(frame: Column, fps: Rate) -> Column:
    return frame / _rate(fps)


def parse_time_value(value: Column, fps: Rate) -> Column:
    """Seconds of a strict timecode; null for anything else, bare numbers included."""
    return F.when(F.trim(value).rlike(TIMECODE), smpte_to_seconds(value, fps))


def seconds_value(value: Column, fps: Rate) -> Column:
    """Seconds of a number or of a timecode."""
    return F.coalesce(F.trim(value).try_cast("double"), smpte_to_seconds(value, fps))


def relative_frame(value: Column, fps: Rate, origin_frame: Column | int = 0) -> Column:
    """Frame of a timecode less the origin; bare seconds are relative already."""
    frame = smpte_to_frames(value, fps)
    return F.when(F.trim(value).rlike("[:;]"), frame - origin_frame).otherwise(frame)


def frame_of_columns(which: str, columns: list[str], fps: Rate, origin_frame: Column | int = 0) -> Column:
    """Frame of a row's start or end: the frame column before the seconds, before the timecode columns."""
    blank = lambda c: F.nullif(F.trim(F.col(c).cast("string")), F.lit(""))
    found = []
    if f"{which}_frame" in columns:
        found.append(blank(f"{which}_frame").try_cast("double").cast("bigint"))
    if f"{which}_sec" in columns:
        found.append(seconds_to_frames(blank(f"{which}_sec").try_cast("double"), fps))
    for name in (f"{which}_tc", which, f"src_{'in' if which == 'start' else 'out'}"):
        if name in columns:
            found.append(relative_frame(blank(name), fps, origin_frame))
    return F.coalesce(*found) if found else F.lit(None).cast("bigint")


def tc_origin(explicit: Column, probed: Column, automatic: Column, fps: Rate) -> Column:
    """Origin frame: 'zero' is 0, 'auto' the smallest timecode of the list, another text its own frame; else the probed timecode, else 0."""
    text = F.lower(F.trim(F.coalesce(explicit, F.lit(""))))
    return F.coalesce(
        F.when(text == "zero", F.lit(0).cast("bigint")).when(text == "auto", automatic).when(text != "", smpte_to_frames(explicit, fps)),
        smpte_to_frames(probed, fps), F.lit(0).cast("bigint"),
    )
