"""Canonical JSON and its SHA-256, equal to those of Python's ``json.dumps`` with sorted keys,
compact separators and unescaped Unicode."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _lower_escapes(c: Column) -> Column:
    """Control characters as ``\\u001f`` rather than ``\\u001F``."""
    out = c
    for n in [*range(0x0A, 0x10), *range(0x1A, 0x20)]:
        if n not in (0x0A, 0x0C, 0x0D):
            out = F.replace(out, F.lit(f"\\u{n:04X}"), F.lit(f"\\u{n:04x}"))
    return out


def json_text(value: Column | str | int | float | bool | None) -> Column:
    """Canonical JSON of a string or array column, or of a Python literal."""
    if not isinstance(value, Column):
        return F.lit(json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":")))
    whole = F.to_json(F.array(value))
    return _lower_escapes(F.substring(whole, F.lit(2), F.length(whole) - 2))


def fingerprint(value: Column | str | int) -> Column:
    """SHA-256 of the canonical JSON of one value (a string title is hashed with its quotes)."""
    return F.sha2(json_text(value), 256)


def fingerprint_list(*parts: Column | str | int | None) -> Column:
    """SHA-256 of the canonical JSON of a list of mixed parts."""
    inner: list[Column] = []
    for i, p in enumerate(parts):
        inner += [F.lit(",")] * (i > 0) + [json_text(p)]
    return F.sha2(F.concat(F.lit("["), *inner, F.lit("]")), 256)


def fingerprint_value(value) -> str:
    """The same on the driver, for any JSON value; NaN and infinities are refused."""
    text = json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"), allow_nan=False)
    return hashlib.sha256(text.encode("utf-8")).hexdigest()


def file_hash(path: str, block: int = 1 << 20) -> str:
    """SHA-256 of a file, read in blocks."""
    h = hashlib.sha256()
    with open(path, "rb") as f:
        while part := f.read(block):
            h.update(part)
    return h.hexdigest()


def file_hashes(files: DataFrame, keep: list[str]) -> DataFrame:
    """``(keep, digest)``: SHA-256 of the bytes in ``content``, as the binary file reader gives them."""
    return files.select(*keep, F.sha2("content", 256).alias("digest"))


def article_id(language: Column | str, title: Column) -> Column:
    """``<language>:wiki:`` and the first 20 hex digits of the title's fingerprint."""
    lang = F.lit(language) if isinstance(language, str) else language
    return F.concat(lang, F.lit(":wiki:"), F.substring(fingerprint(title), 1, 20))


def record_id(language: str, title: Column, record: Column, text: Column) -> Column:
    """As :func:`article_id`; a row without a title is known by its number and text instead."""
    untitled = F.sha2(F.concat(F.lit("["), record.cast("string"), F.lit(","), json_text(text), F.lit("]")), 256)
    whole = F.when(F.coalesce(title, F.lit("")) == "", untitled).otherwise(fingerprint(title))
    return F.concat(F.lit(f"{language}:wiki:"), F.substring(whole, 1, 20))
