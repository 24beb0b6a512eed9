"""Duplicates hidden by formatting (problem 5), on dictionary-encoded records.

The columns' values (the text, and each field of the key-value column) are dictionary-encoded:
every distinct value of the table is canonicalised once, the distinct canonical values get
integers, and the dictionary is stored in the shared folder. A record becomes the sorted tuple
of its values' integers, field name and value being one entry, and equal tuples are grouped.

Values travel as hashes after they were canonicalised: 96 bits for a value as written, 128 bits
for its canonical form. Both are checked when the dictionary is built: canonical forms of one
hash must agree in a second, independent hash of 64 bits, and a hash of a written value must lead
to one integer only. A collision stops the job, it never merges records.

Defined results: null and blank key-value fields are the same as no field; a field with an
empty value is a field, and so is one without an equals sign, and these two differ. A field named
twice counts twice. A record whose text is null or holds no letter is left out. Repeated rows,
also those of one id, are copies. Very long texts are canonicalised whole. Other columns of the
input are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .canon import has_letter, letters_and_digits

#: First letter of a value: what it belongs to.
TEXT, FIELD = "t", "f"


def canonical_value(value: str) -> str | None:
    """The canonical form of a text or field with its first letter; null for those that count for nothing."""
    kind, raw = value[0], value[1:]
    if kind == TEXT:
        return TEXT + letters_and_digits(raw) if has_letter(raw) else None
    if not raw.strip():
        return None
    key, eq, rest = raw.partition("=")
    return FIELD + letters_and_digits(key) + eq + letters_and_digits(rest)


def _occurrences(df: DataFrame, id_col: str, text_col: str, meta_col: str) -> DataFrame:
    """``(n, id, value)``: each value of each row; ``n`` tells rows apart."""
    fields = F.transform(F.split(F.coalesce(F.col(meta_col), F.lit("")), r"\|"), lambda x: F.concat(F.lit(FIELD), x))
    fields = F.filter(fields, lambda x: F.length(x) > 1)
    rows = df.select(F.monotonically_increasing_id().alias("n"), F.col(id_col).alias("id"), F.col(text_col).alias("text"), fields.alias("fields")).where("text is not null")
    return rows.select("n", "id", F.explode(F.concat(F.array(F.concat(F.lit(TEXT), "text")), "fields")).alias("value"))


def _written(value: str = "value") -> list:
    return [F.xxhash64(value).alias("a"), F.hash(value).alias("b")]


def value_dictionary(df: DataFrame, text_col: str = "text", meta_col: str = "meta") -> DataFrame:
    """``(a, b, integer)``, stored: of every distinct value as written (by its hash) the integer of its canonical form.

    Distinct values are combined before they move; each is canonicalised once in the whole job.
    Values that count for nothing have no entry.
    """

    def run(batches):
        for b in batches:
            at, digest, check = [], [], []
            for i, v in enumerate(b.column(2).to_pylist()):
                c = canonical_value(v)
                if c is not None:
                    raw = c.encode("utf-8")
                    at.append(i)
                    digest.append(xxhash.xxh3_128_digest(raw))
                    check.append(xxhash.xxh64_intdigest(raw))
            rows = pa.array(at, pa.int64())
            halves = np.frombuffer(b"".join(digest), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(rows), b.column(1).take(rows), pa.array(halves[:, 0]), pa.array(halves[:, 1]), pa.array(np.array(check, np.uint64).view(np.int64))],
                names=["a", "b", "c", "d", "check"],
            )

    values = _occurrences(df, text_col, text_col, meta_col).select("value").distinct().select(*_written(), "value")
    forms = stored(values.mapInArrow(run, "a bigint, b int, c bigint, d bigint, check bigint"), "forms")
    number = F.when(F.min("check") == F.max("check"), F.lit(0)).otherwise(F.raise_error(F.lit("two canonical values share a 128-bit hash")))
    integers = stored(forms.groupBy("c", "d").agg(number.alias("ok")).select("c", "d", (F.monotonically_increasing_id() + F.col("ok")).alias("integer")), "integers")
    one = F.when(F.min("integer") == F.max("integer"), F.min("integer")).otherwise(F.raise_error(F.lit("two values share a 96-bit hash")))
    return stored(forms.join(integers, ["c", "d"]).groupBy("a", "b").agg(one.alias("integer")), "dictionary")


def encoded_records(df: DataFrame, id_col: str = "row_id", text_col: str = "text", meta_col: str = "meta") -> DataFrame:
    """``(id, key)``, stored: the sorted integer tuple of each record; texts without a letter are left out.

    The dictionary meets the values' occurrences in a join between two stored or scanned tables,
    which adaptive execution splits at frequent values, or turns into a broadcast where it has
    measured the dictionary to be small.
    """
    dictionary = value_dictionary(df, text_col, meta_col)
    each = _occurrences(df, id_col, text_col, meta_col).select("n", "id", *_written(), F.col("value").startswith(TEXT).alias("is_text"))
    records = (
        each.join(dictionary, ["a", "b"])
        .groupBy("n", "id")
        .agg(F.array_sort(F.collect_list("integer")).alias("key"), F.max("is_text").alias("has_text"))  # a record's own values
        .where("has_text")
    )
    return stored(records.select(F.col("id").alias(id_col), "key"), "records")


def _groups(records: DataFrame, id_col: str) -> DataFrame:
    return records.groupBy("key").agg(F.min(id_col).alias("row_a"), F.count("*").alias("n_copies"))


def collapse(df: DataFrame, id_col: str = "row_id", text_col: str = "text", meta_col: str = "meta") -> DataFrame:
    """``(id, n_copies)``: one row for each record, its smallest id and the number of its copies.

    Tuples are combined before they move: a record with very many copies is one row for each task.
    """
    return _groups(encoded_records(df, id_col, text_col, meta_col), id_col).select(F.col("row_a").alias(id_col), "n_copies")


def copies(df: DataFrame, id_col: str = "row_id", text_col: str = "text", meta_col: str = "meta") -> DataFrame:
    """``(row_a, row_b)``: of every group of copies the smallest id with each other one.

    Groups of two and more are stored, then each record meets the one row of its group in a join
    of two plain tables, which adaptive execution can split where a group is hot.
    """
    records = encoded_records(df, id_col, text_col, meta_col)
    groups = stored(_groups(records, id_col).where("n_copies > 1").select("key", "row_a"), "groups")
    return records.join(groups, "key").where(F.col(id_col) != F.col("row_a")).select("row_a", F.col(id_col).alias("row_b"))
