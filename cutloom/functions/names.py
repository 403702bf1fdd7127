"""Names, labels, keys and transcript text as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from cutloom.functions.fold import without_accents


def _strip(text: Column, characters: str) -> Column:
    return F.btrim(text, F.lit(characters))


def speaker_key(name: Column) -> Column:
    """Upper-case letters and digits without accents."""
    return F.regexp_replace(F.upper(without_accents(name)), r"[^\p{L}\p{N}]+", "")


def canonical_speaker_name(name: Column) -> Column:
    return F.upper(F.trim(name))


def safe_name(value: Column, fallback: str = "item") -> Column:
    """Runs of characters outside A-Z a-z 0-9 _ . - as one underscore, none of '._' at the ends; the fallback where nothing is left."""
    text = _strip(F.regexp_replace(F.trim(value), r"[^A-Za-z0-9_.-]+", "_"), "._")
    return F.coalesce(F.nullif(text, F.lit("")), F.lit(fallback))


def source_group_label(index: Column) -> Column:
    return F.format_string("speaker_%02d", index)


def source_group_from_text(value: Column) -> Column:
    """speaker_NN for a text that holds speaker and a number; empty for others."""
    n = F.regexp_extract(F.lower(value), r"speaker[_-]?(\d+)", 1)
    return F.when(F.coalesce(n, F.lit("")) != "", source_group_label(n.cast("int"))).otherwise("")


def infer_source_group(path: Column) -> Column:
    """Group of a file name: its speaker number, else its safe stem."""
    stem = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")
    return F.coalesce(F.nullif(source_group_from_text(stem), F.lit("")), safe_name(stem))


def infer_shot_id(path: Column) -> Column:
    """Shot of a clip's file name: what stands before its speaker mark, else the folder if the name starts with it, else the first number."""
    parts = F.split(path, "/")
    stem = F.regexp_replace(F.element_at(parts, -1), r"\.[^.]*$", "")
    before = _strip(F.regexp_extract(F.lower(stem), r"^(.+?)[_-]*speaker[_-]?\d+", 1), "_-")
    folder = F.when(F.size(parts) > 1, F.element_at(parts, -2))
    number = F.regexp_extract(stem, r"(?:^|[_\-.])(\d+)(?=$|[_\-.])", 1)
    return F.coalesce(F.nullif(F.substring(stem, F.lit(1), F.length(before)), F.lit("")), F.when(F.startswith(stem, folder), folder), F.nullif(number, F.lit("")))


def pad_shot_id(shot_id: Column, padding: int = 3) -> Column:
    """Numbers filled up with zeros, other ids trimmed."""
    text = F.trim(shot_id)
    n = text.try_cast("bigint").cast("string")
    return F.when(text.rlike(r"^\d+$"), F.when(F.length(n) >= padding, n).otherwise(F.lpad(n, padding, "0"))).otherwise(text)


def normalize_header(value: Column) -> Column:
    return _strip(F.regexp_replace(F.lower(F.trim(value)), "[^a-z0-9]+", "_"), "_")


def normalize_key(value: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(value)), r"\s+", "_")


def strip_stem_suffix(value: Column) -> Column:
    return F.regexp_replace(value, r"(?i)[_-]?stem$", "")


def normalized_word_text(word: Column) -> Column:
    """Lower-case words with single blanks, underscores and signs as blanks."""
    return F.trim(F.regexp_replace(F.lower(F.replace(word, F.lit("_"), F.lit(" "))), r"[^\p{L}\p{M}\p{N}]+", " "))


def word_capacity(word: Column) -> Column:
    """Words that a transcript word may stand for, at least one."""
    text = normalized_word_text(word)
    return F.greatest(F.lit(1), F.when(text == "", 0).otherwise(F.size(F.split(text, " "))))


def clean_text(value: Column) -> Column:
    """A transcript cell without markup, bracketed remarks and change notes, single-spaced, without ' ,.\"' at the ends."""
    text = F.replace(value, F.lit("\n"), F.lit(" "))
    for pattern in (r"<[^>]+>", r"\([^)]*\)", r"(?i)Change Note:.*"):
        text = F.regexp_replace(text, pattern, "")
    return _strip(F.regexp_replace(text, r"\s{2,}", " "), ' ,."')


#: What recognisers make up over music and silence; least seconds and words of speech; characters a second.
STOCK_PHRASES = ("you", "thank you", "thank you so much", "thanks for watching", "bye", "yeah", "the end", "so", "oh", "mm", "hmm")
LEAST_SPEECH_SEC, LEAST_SPEECH_WORDS, SPEECH_RATE = 0.3, 2, (2.0, 30.0)


def plausible_speech(text: Column, seconds: Column) -> Column:
    """Whether a recognised text, without punctuation at its ends, can be speech of that length; false for null."""
    plain = F.lower(_strip(F.trim(text), ".!?,"))
    words = F.size(F.filter(F.split(plain, r"\s+"), lambda w: w != ""))
    return F.coalesce(~plain.isin(*STOCK_PHRASES) & (seconds >= LEAST_SPEECH_SEC) & (words >= LEAST_SPEECH_WORDS) & (F.length(plain) / seconds).between(*SPEECH_RATE), F.lit(False))


def speaker_list(value: Column, upper: bool = False, distinct: bool = True) -> Column:
    """Names of a list written with ';' or ','."""
    names = F.filter(F.transform(F.split(value, "[;,]"), lambda x: F.upper(F.trim(x)) if upper else F.trim(x)), lambda x: x != "")
    return F.array_distinct(names) if distinct else names


def matches_on_screen(speaker: Column, on_screen: Column) -> Column:
    """Whether a speaker is among those on screen; with none given, yes."""
    key = speaker_key(speaker)
    return F.when(F.coalesce(F.size(on_screen), F.lit(0)) <= 0, True).otherwise(F.coalesce((key != "") & F.array_contains(F.transform(on_screen, speaker_key), key), F.lit(False)))


def first_value(*columns: Column) -> Column:
    """First cell that isn't blank."""
    return F.coalesce(*[F.nullif(F.trim(c.cast("string")), F.lit("")) for c in columns])


#: Names and beginnings of the roles of each group.
ROLE_GROUPS = {
    "D": (("d", "dx", "dialogue"), ("speaker:", "dialogue_")),
    "M": (("m", "mx", "music"), ("music:", "music_cue:", "music_instrument:")),
    "E": (("e", "fx", "sfx", "effects"), ("effects:",)),
    "ME": (("me", "m&e", "music_effects"), ()),
}
#: Parts of a stem's name, and marks that stand alone in it, of each role.
STEM_ROLES = {"dialogue": (("dialogue", "dialog", "vocal"), "dx"), "music_fx": (("music",), "mx"), "effects": (("effect",), "fx")}


def role_group(role: Column) -> Column:
    """D, M, E or ME of a source's role; null for others. A group's names and beginnings are tried before the next group's."""
    r, found = F.lower(role), None
    for group, (names, heads) in ROLE_GROUPS.items():
        hit = reduce(lambda a, b: a | b, [r.startswith(h) for h in heads], r.isin(*names))
        found = F.when(hit, group) if found is None else found.when(hit, group)
    return found


def stem_role(name: Column) -> Column:
    """dialogue, music_fx or effects by what a stem's file name (without the user's prefix) holds; null for others."""
    text, found = F.lower(name), None
    for role, (parts, mark) in STEM_ROLES.items():
        hit = reduce(lambda a, b: a | b, [text.contains(p) for p in parts], text.rlike(rf"(^|[_-]){mark}($|[_-])"))
        found = F.when(hit, role) if found is None else found.when(hit, role)
    return found


def quoted_identifier(path: Column, role: Column) -> Column:
    """Artifact id: role and the first 12 digits of the path's sha256."""
    return F.concat_ws("-", safe_name(role), F.substring(F.sha2(path, 256), 1, 12))
