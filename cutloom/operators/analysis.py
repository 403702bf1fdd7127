"""Events and series out of analysis bundles (JSON), as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Keys under which a bundle holds its events and an event its times, the first present one counts.
EVENT_KEYS, LIST_KEYS = ("events", "review_regions", "beats"), ("events", "regions", "items")
START_KEYS, END_KEYS = ("start_seconds", "start_sec", "start", "time_seconds", "time_sec", "time"), ("end_seconds", "end_sec", "end")
DURATION_KEYS, VALUE_KEYS = ("duration_seconds", "duration_sec", "duration"), ("values", "scores", "data")


def _first(json: Column, keys: tuple[str, ...]) -> Column:
    return F.coalesce(*[F.get_json_object(json, f"$.{k}") for k in keys])


def _items(json: Column) -> Column:
    """The elements of a JSON array as texts; none for anything else."""
    return F.when(F.ltrim(json).startswith("["), F.from_json(json, "array<string>"))


def _finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def extract_events(bundle: Column) -> Column:
    """Events of a bundle in order: array of start and end in seconds, from 0 up.

    A number is an event without length; an event has an end or a duration. Events without a start, with times that are no
    finite numbers or that end before they start are left out; a bundle without events gives an empty array.
    """
    raw = _first(bundle, EVENT_KEYS)
    listed = F.when(F.ltrim(raw).startswith("{"), _first(raw, LIST_KEYS)).otherwise(raw)
    number = lambda x: x.try_cast("double")

    def event(x: Column) -> Column:
        plain = number(x)
        start = F.coalesce(plain, number(_first(x, START_KEYS)))
        end = F.coalesce(plain, number(_first(x, END_KEYS)), start + F.coalesce(number(_first(x, DURATION_KEYS)), F.lit(0.0)))
        return F.struct(start.alias("start"), end.alias("end"))

    found = F.filter(F.transform(F.coalesce(_items(listed), F.array().cast("array<string>")), event), lambda e: _finite(e["start"]) & _finite(e["end"]) & (e["end"] >= e["start"]))
    return F.array_sort(F.transform(found, lambda e: F.struct(F.greatest(e["start"], F.lit(0.0)).alias("start"), F.greatest(e["end"], F.lit(0.0)).alias("end"))))


def event_row(event: Column, default_role: str = "event") -> Column:
    """An event for display: role, start_sec, end_sec, label; null where its times are no numbers."""
    said = F.coalesce(*[F.nullif(F.get_json_object(event, f"$.{k}"), F.lit("")) for k in ("role", "type", "category")], F.lit(default_role))
    role = F.lower(said)
    start = F.coalesce(_first(event, ("start_sec", "start", "time_sec")), F.lit("0"))
    end = F.coalesce(_first(event, ("end_sec", "end")), start)
    a, b = start.try_cast("double"), end.try_cast("double")
    label = F.coalesce(*[F.nullif(F.get_json_object(event, f"$.{k}"), F.lit("")) for k in ("label", "name")], role)
    return F.when(a.isNotNull() & b.isNotNull(), F.struct(role.alias("role"), a.alias("start_sec"), F.greatest(a, b).alias("end_sec"), label.alias("label")))


def numeric_series(bundle: Column, *keys: str) -> Column:
    """The finite numbers of the first of these keys (an array, or an object with one); null for none and for other content."""
    raw = _first(bundle, keys)
    listed = F.when(F.ltrim(raw).startswith("{"), _first(raw, VALUE_KEYS)).otherwise(raw)
    flat = F.from_json(F.concat(F.lit("["), F.regexp_replace(listed, r"[\[\]]", ""), F.lit("]")), "array<string>")
    values = F.transform(F.when(F.ltrim(listed).startswith("["), flat), lambda x: x.try_cast("double"))
    kept = F.filter(values, _finite)
    wrong = F.exists(F.from_json(F.concat(F.lit("["), F.regexp_replace(listed, r"[\[\]]", ""), F.lit("]")), "array<string>"), lambda x: x.isNotNull() & x.try_cast("double").isNull())
    return F.when(~wrong & (F.size(kept) > 0), kept)


def normalized_series(values: Column) -> Column:
    """A series between 0 and 1; 0.5 throughout where it doesn't vary."""
    low, span = F.array_min(values), F.array_max(values) - F.array_min(values)
    return F.transform(values, lambda x: F.when(span > 1e-12, (x - low) / span).otherwise(0.5))


def dominance_shares(values: Column) -> Column:
    """A frame's amounts of the sources as shares of their sum, negative ones as 0."""
    kept = F.transform(values, lambda x: F.greatest(F.when(_finite(x), x).otherwise(0.0), F.lit(0.0)))
    total = F.greatest(F.aggregate(kept, F.lit(0.0), lambda a, b: a + b), F.lit(1e-12))
    return F.transform(kept, lambda x: x / total)
