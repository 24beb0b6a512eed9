"""Canonical forms of text, shared by the operators that compare texts.

All work on whole strings; null stays null.
"""

from __future__ import annotations

import re
import unicodedata

class Translation(dict):
    """A table for ``str.translate`` that asks a rule for each character once, when it first meets it.

    It holds only characters that occur, so a worker needs no table of all code points.
    """

    def __init__(self, rule):
        super().__init__()
        self.rule = rule

    def __missing__(self, c: int):
        found = self[c] = self.rule(chr(c))
        return found


_TABLES: dict[str, Translation] = {}


def _table(kinds: str) -> Translation:
    """Translation that deletes every character whose category starts with one of ``kinds``."""
    found = _TABLES.get(kinds)
    if found is None:
        starts = tuple(kinds.split())
        found = _TABLES[kinds] = Translation(lambda ch: None if unicodedata.category(ch).startswith(starts) else ch)
    return found


def fold(text: str) -> str:
    """NFC of the case-folded text; one fixed form for composed and decomposed spelling."""
    if text.isascii():
        return text.lower()
    return unicodedata.normalize("NFC", unicodedata.normalize("NFC", text).casefold())


#: White space, controls, format characters (zero width and the like) and punctuation.
_DROP = "Z C P"


def letters_and_digits(text: str | None) -> str | None:
    """The text without white space, invisible characters, case and punctuation."""
    return None if text is None else fold(text).translate(_table(_DROP))


def letters_only(text: str | None) -> str | None:
    """As :func:`letters_and_digits`, without digits and other numbers."""
    return None if text is None else fold(text).translate(_table(_DROP + " N"))


_LETTER = re.compile(r"[^\W\d_]")


def has_letter(text: str | None) -> bool:
    return bool(text) and _LETTER.search(text) is not None


#: A word: letters with their combining marks, joined by single hyphens or apostrophes.
WORD = re.compile("[^\\W\\d_][\\u0300-\\u036f]*(?:['\\u2019-]?[^\\W\\d_][\\u0300-\\u036f]*)*")
_INVISIBLE = re.compile("[\\u00ad\\u200b-\\u200f\\u2060\\ufeff]")


def invisible_free(text: str) -> str:
    """The text without zero-width characters and soft hyphens."""
    return _INVISIBLE.sub("", text)


def words(text: str | None) -> list[str]:
    """The words of a text in reading order: folded, without invisible characters."""
    if not text:
        return []
    return WORD.findall(fold(invisible_free(text)))
