"""Plain words and sentences of raw texts, for use inside Arrow functions."""

from __future__ import annotations

import html
import re
import unicodedata

CLOCK = r"\d{1,3}:\d{2}:\d{2}(?:[:;.,]\d{1,3})?"
CUE = re.compile(rf"(?:(?<!\S)\d+[ \t]*\r?\n[ \t]*)?{CLOCK}\s*-->\s*{CLOCK}")
TIME = re.compile(CLOCK)
TAG = re.compile(r"<!--.*?-->|</?[A-Za-z][^<>]*>|\{\\[^{}]*\}", re.S)
WORD = re.compile(r"[^\W_]+")
ESCAPED = re.compile(r"\\u([0-9a-fA-F]{4})")
JSON_LINE = re.compile(r"^\s*\{.*\}\s*,?\s*$")
JSON_TEXT = re.compile(r'"text"\s*:\s*"((?:[^"\\]|\\.)*)"')
BREAK = re.compile(r"[.!?…][\"'”’»)\]]*\s+|[\r\n]+")


class _Fold(dict):
    """Translation table that grows with the characters met: no marks, no invisible characters, no accents."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        kind = unicodedata.category(c)
        if kind in ("Cf", "Mn", "Me") or (kind == "Cc" and not c.isspace()):
            out = ""
        else:
            out = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        self[code] = out
        return out


FOLD = _Fold()
#: Distinct odd characters of a text up to which they are replaced one by one.
FEW_ODD = 48
ASCII = bytes(range(128))
CLOCK_TAIL = re.compile(r":\d\d:\d\d")
#: ASCII characters by what they do: word characters stay, others part words; before that, sentence ends become full stops, closing marks quotes.
APART = "".join(c if c.isalnum() else " " for c in map(chr, range(128)))
ENDING = "".join(c if c.isalnum() else "\n" if c in "\r\n" else " " if c.isspace() else "." if c in ".!?" else '"' if c in "\"')]" else "\t" for c in map(chr, range(128)))


def folded(text: str) -> str:
    """Without marks, invisible characters and accents."""
    odd = set(text.encode("utf-8", "surrogatepass").translate(None, ASCII).decode("utf-8", "surrogatepass"))
    if len(odd) > FEW_ODD or not all(FOLD[ord(c)].isascii() or FOLD[ord(c)] == c for c in odd):
        return text.translate(FOLD)
    for c in odd:
        text = text.replace(c, FOLD[ord(c)])
    return text


def cleaned(text: str) -> str:
    """Entities decoded, markup, subtitle cues and times taken out, invisible characters and accents dropped, case folded."""
    if "&" in text:
        text = html.unescape(text)
    if "-->" in text:
        text = CUE.sub(" ", text)
    if "<" in text or "{" in text:
        text = TAG.sub(" ", text)
    if not text.isascii():
        text = folded(text)
    return TIME.sub(" ", text).casefold() if CLOCK_TAIL.search(text) else text.casefold()


def words(text: str | None) -> list[str]:
    """The words (letters and digits) of a text, folded; none for null."""
    if not text:
        return []
    text = cleaned(text)
    return text.translate(APART).split() if text.isascii() else WORD.findall(text)


def sentences(text: str | None, least: int = 3) -> list[list[str]]:
    """The words of each sentence of at least `least` words; line ends close a sentence, of JSON lines the texts count."""
    if not text:
        return []
    if '"text"' in text:
        text = "\n".join("\n".join(JSON_TEXT.findall(line)).replace('\\"', '"') if '"text"' in line and JSON_LINE.match(line) else line for line in text.split("\n"))
    text = cleaned(text)
    if not text.isascii():
        return [x for x in map(WORD.findall, BREAK.split(text)) if len(x) >= least]
    text = text.translate(ENDING)
    while '."' in text:
        text = text.replace('."', ".")
    return [x for x in (y.translate(APART).split() for y in text.replace(". ", "\n").replace(".\n", "\n").split("\n")) if len(x) >= least]
