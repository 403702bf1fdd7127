"""Folding of text without leaving the JVM: accents, invisible characters, keys of labels."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _accent_table() -> tuple[str, str]:
    """Every letter below U+2000 whose decomposition is one ASCII letter and marks, and that letter."""
    source, target = [], []
    for code in range(0xC0, 0x2000):
        plain = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c))
        if plain != chr(code) and len(plain) == 1 and plain.isascii() and plain.isalpha():
            source.append(chr(code))
            target.append(plain)
    return "".join(source), "".join(target)


ACCENTED, PLAIN = _accent_table()
#: Characters that print nothing: soft hyphen, zero-width and direction marks, byte order mark.
INVISIBLE = "­​‌‍‎‏⁠﻿"


def without_accents(text: Column) -> Column:
    """Accented Latin letters as plain ones; combining marks dropped; German sharp s as ss."""
    plain = F.translate(text, ACCENTED, PLAIN)
    return F.when(text.rlike(r"[^\x00-\x7F]"), F.replace(F.regexp_replace(plain, r"\p{M}+", ""), F.lit("ß"), F.lit("ss"))).otherwise(text)


def folded_tokens(label: Column) -> Column:
    """Lower-case words and numbers of a label without accents, additions in brackets and repeated blanks."""
    bare = F.when(label.rlike(r"[\[(]"), F.regexp_replace(label, r"[\[(][^\])]*[\])]", " ")).otherwise(label)
    return F.regexp_extract_all(F.lower(without_accents(bare)), F.lit(r"([a-z]+|[0-9]+)"), F.lit(1))


def compact(label: Column) -> Column:
    """The folded words in their order, written together; null where nothing is left."""
    return F.nullif(F.array_join(folded_tokens(label), ""), F.lit(""))
