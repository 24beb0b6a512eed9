"""Column functions over text. All are native expressions except those marked *exact*,
which need Unicode case-folding or normalisation and run as Arrow-batched pandas UDFs."""

from __future__ import annotations

import html
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Everything that separates words: Unicode white space and the four information separators.
SPACE = r"(?U)[\s\x1C-\x1F]"
#: Every line boundary, not only the line feed.
LINE_END = "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def bound(col: Column, f) -> Column:
    """``f(col)`` with the column computed once, however often a lambda inside ``f`` uses it."""
    return F.element_at(F.transform(F.array(col), f), 1)


def strip(col: Column | str) -> Column:
    """Without white space (any, not only U+0020) at both ends."""
    return F.regexp_replace(_c(col), r"(?U)^[\s\x1C-\x1F]+|[\s\x1C-\x1F]+$", "")


def split_words(col: Column | str) -> Column:
    """Words between white space; an empty array for blank text."""
    return F.filter(F.split(_c(col), SPACE + "+"), lambda x: x != "")


def split_lines(col: Column | str) -> Column:
    """Lines at every boundary; the empty piece after a final boundary is no line."""
    parts = F.split(_c(col), LINE_END)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def canonical(col: Column | str) -> Column:
    """Match key: lower case and single spaces. Native; differs from the exact key for letters
    whose case-folding isn't their lower case and for decomposed spelling."""
    return F.array_join(split_words(F.lower(_c(col))), " ")


@F.pandas_udf(StringType())
def _canonical_exact(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else " ".join(unicodedata.normalize("NFC", x).casefold().split()), na_action="ignore")


def canonical_exact(col: Column | str) -> Column:
    """*Exact* match key: NFC, case-folded, single spaces."""
    return _canonical_exact(_c(col))


@F.pandas_udf(StringType())
def _unescape(s: pd.Series) -> pd.Series:
    return s.map(html.unescape, na_action="ignore")


def html_unescape(col: Column | str) -> Column:
    """*Exact* replacement of HTML entities. Only texts with an ampersand cross to Python's side."""
    return F.when(_c(col).contains("&"), _unescape(_c(col))).otherwise(_c(col))


def ngrams(words: Column, width: int) -> Column:
    """Distinct word n-grams joined by spaces; empty where there are fewer than ``width`` words."""

    def cut(w: Column) -> Column:
        grams = F.transform(F.sequence(F.lit(1), F.size(w) - width + 1), lambda i: F.array_join(F.slice(w, i, width), " "))
        return F.when(F.size(w) >= width, F.array_distinct(grams)).otherwise(F.array().cast("array<string>"))

    return bound(words, cut)


def letter_words(col: Column | str) -> Column:
    """Maximal runs of letters (and of numerals that are no decimal digits)."""
    return F.regexp_extract_all(_c(col), F.lit(r"([\p{L}\p{Nl}\p{No}]+)"), 1)


def has_letter(col: Column | str) -> Column:
    return _c(col).rlike(r"\p{L}")


def lexical(col: Column | str) -> Column:
    """Whether a form has a letter or a digit (decimal or superscript; vulgar fractions and Roman numerals are none)."""
    return _c(col).rlike(r"[\p{L}\p{Nd}²³¹⁰⁴-⁹₀-₉]")


def base_relation(col: Column | str) -> Column:
    return F.substring_index(_c(col), ":", 1)


def usable_forms(forms: Column) -> Column:
    """No form with a pipe or an ASCII letter, at least three with a letter of the Cyrillic
    blocks, and those at least three quarters of all."""
    cyrillic = F.size(F.filter(forms, lambda x: x.rlike("[Ѐ-ԯ]")))
    return ~F.exists(forms, lambda x: x.rlike("[A-Za-z|]")) & (cyrillic >= 3) & (4 * cyrillic >= 3 * F.size(forms))


def valid_name(col: Column | str) -> Column:
    """Whether a name of a round is made of ASCII letters, digits, hyphens and underscores only; null is none."""
    return F.coalesce(_c(col), F.lit("")).rlike("^[A-Za-z0-9_-]+$")
