"""Languages by name, code or alias."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Name and code of each language.
LANGUAGES = (
    ("Chinese", "zh"), ("Cantonese", "yue"), ("English", "en"), ("Arabic", "ar"), ("Czech", "cs"), ("Danish", "da"), ("Dutch", "nl"), ("Finnish", "fi"),
    ("French", "fr"), ("German", "de"), ("Greek", "el"), ("Hebrew", "he"), ("Hindi", "hi"), ("Hungarian", "hu"), ("Italian", "it"), ("Japanese", "ja"),
    ("Korean", "ko"), ("Macedonian", "mk"), ("Malay", "ms"), ("Persian", "fa"), ("Polish", "pl"), ("Portuguese", "pt"), ("Romanian", "ro"), ("Russian", "ru"),
    ("Spanish", "es"), ("Swahili", "sw"), ("Swedish", "sv"), ("Tagalog", "tl"), ("Thai", "th"), ("Turkish", "tr"), ("Vietnamese", "vi"),
)
#: Other names of languages, with their codes.
ALIASES = {
    "deutsch": "de", "farsi": "fa", "persian (farsi)": "fa", "mandarin": "zh", "mandarin chinese": "zh", "putonghua": "zh", "brazilian portuguese": "pt",
    "castilian": "es", "castellano": "es", "filipino": "tl", "bahasa melayu": "ms", "bahasa malaysia": "ms", "kiswahili": "sw",
}
#: Codes of languages written without blanks.
SPACELESS = ("zh", "yue", "ja", "th")


def _lookup(names: bool) -> Column:
    """Code, or name, by every writing in lower case."""
    by_code = {code: name for name, code in LANGUAGES}
    codes = {name.lower(): code for name, code in LANGUAGES} | {code: code for code in by_code} | ALIASES
    return F.create_map(*[F.lit(x) for key, code in codes.items() for x in (key, by_code[code] if names else code)])


def language_code(value: Column) -> Column:
    """Code of a language given by name, code or alias; null for others."""
    return F.try_element_at(_lookup(False), F.lower(F.trim(value)))


def language_name(value: Column) -> Column:
    return F.try_element_at(_lookup(True), F.lower(F.trim(value)))


def recogniser_code(value: Column) -> Column:
    """Code, or for unknown languages what was given in lower case; null for blank."""
    text = F.nullif(F.lower(F.trim(value)), F.lit(""))
    return F.coalesce(language_code(value), text)


def is_spaceless(value: Column) -> Column:
    return F.coalesce(language_code(value).isin(*SPACELESS), F.lit(False))


def supported() -> tuple[list[str], list[str]]:
    """Sorted names and sorted codes."""
    return sorted(x[0] for x in LANGUAGES), sorted(x[1] for x in LANGUAGES)


def validated(value: Column) -> Column:
    """Code of a language; an unsupported one is an error that names the supported ones."""
    said = F.concat(F.lit("Unsupported language "), F.coalesce(value, F.lit("null")), F.lit(". Supported speech languages: " + ", ".join(supported()[0])))
    return F.coalesce(language_code(value), F.raise_error(said).cast("string"))
