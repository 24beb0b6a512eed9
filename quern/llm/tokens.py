"""Token budgets (problem 1) and encoding of a corpus (problem 7).

Both run over whole texts under one vocabulary that the driver reads once and broadcasts
(its size is fixed by the file, about 2 MB). No text is shuffled.

Defined results: null and empty texts have no tokens (0, or an empty list) and still count as
documents; a text of white space has the tokens of its white space. Repeated rows count each.
Empty tables give empty results. Labels that are null, blank or placeholders count under
``und`` (language) or ``none`` (source, domain). Other columns of the input are ignored, so
their names don't matter.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .bpe import UNIT, Decoder, Encoder, load_vocabulary

_ENCODERS: dict[int, Encoder] = {}
#: Labels that stand for no label.
NO_LABEL = ["", "-", "?", "unk", "und", "unknown", "none", "n/a", "null"]


def _encoder(shared) -> Encoder:
    """One encoder for each worker process and vocabulary; it keeps its memories between tasks."""
    found = _ENCODERS.get(shared.id if hasattr(shared, "id") else id(shared))
    if found is None:
        _ENCODERS.clear()
        found = _ENCODERS[shared.id if hasattr(shared, "id") else id(shared)] = Encoder(shared.value)
    return found


class _Shared:
    """A broadcast with a stable key for the workers' registry."""

    def __init__(self, spark, value):
        self._broadcast = spark.sparkContext.broadcast(value)
        self.id = self._broadcast._jbroadcast.id()

    def __getstate__(self):
        return {"_broadcast": self._broadcast, "id": self.id}

    @property
    def value(self):
        return self._broadcast.value


def label(column: str, missing: str) -> Column:
    """A label without regard to case and blanks, ``missing`` where it names nothing."""
    c = F.lower(F.trim(F.regexp_replace(F.col(column), r"(?U)\s+", " ")))
    return F.when(c.isNull() | c.isin(NO_LABEL), F.lit(missing)).otherwise(c)


def encode_corpus(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, ids)``: the token ids of every text, without special tokens.

    Map-only. Each distinct unit (a word with the white space before it) is encoded once for
    each worker by the backtracking encoder and remembered within a fixed bound.
    """
    shared = _Shared(df.sparkSession, load_vocabulary(vocabulary))

    def run(batches):
        e = _encoder(shared)
        for b in batches:
            parts = [e.encode_bytes(t) for t in b.column(1).to_pylist()]
            offsets = np.zeros(len(parts) + 1, np.int64)
            np.cumsum([len(p) // 4 for p in parts], out=offsets[1:])
            values = pa.Array.from_buffers(pa.int32(), int(offsets[-1]), [None, pa.py_buffer(b"".join(parts))])
            lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), values)
            yield pa.RecordBatch.from_arrays([b.column(0), lists], names=[id_col, "ids"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def decode_corpus(df: DataFrame, vocabulary: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``(id, text)``: the inverse of :func:`encode_corpus`; null and empty lists give an empty text."""
    shared = _Shared(df.sparkSession, load_vocabulary(vocabulary))

    def run(batches):
        d = Decoder(shared.value)
        for b in batches:
            texts = pa.array([d.decode(x) for x in b.column(1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), texts], names=[id_col, "text"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {kind}, text string")


def document_tokens(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_tokens)`` of every document, without making the lists of ids."""
    shared = _Shared(df.sparkSession, load_vocabulary(vocabulary))

    def run(batches):
        e = _encoder(shared)
        for b in batches:
            n = pa.array([len(e.encode_bytes(t)) // 4 for t in b.column(1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), n], names=[id_col, "n_tokens"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_tokens bigint")


#: Distinct (slice, unit) pairs that a task counts before it hands them on.
COUNTED = 400_000
SLICE = ["source", "lang", "doc_domain"]


def piece_counts(docs: DataFrame, shared: _Shared) -> DataFrame:
    """``(slice, piece, n)`` of a table ``(slice, text)``, stored: how often a slice has each piece.

    A task counts over all its texts, within a bound, and its counts are combined again before
    they move, by slice and piece, so no piece or slice is one task.
    """

    def run(batches):
        e = _encoder(shared)
        slices: dict[int, Counter] = {}
        held = 0

        def out():
            for key, units in slices.items():
                pieces: Counter = Counter()
                for u, n in units.items():
                    for p in e.split(u):
                        pieces[p] += n
                k = len(pieces)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(k, key, np.int64)), pa.array(list(pieces), pa.string()), pa.array(list(pieces.values()), pa.int64())], names=["slice", "piece", "n"]
                )

        for b in batches:
            for key, text in zip(b.column(0).to_pylist(), b.column(1)):
                text = text.as_py()
                seen = slices.get(key)
                if seen is None:
                    seen = slices[key] = Counter()
                before = len(seen)
                seen.update(UNIT.findall(text))
                held += len(seen) - before
                if held > COUNTED:
                    yield from out()
                    slices.clear()
                    held = 0
        yield from out()

    counted = docs.where("text <> ''").mapInArrow(run, "slice bigint, piece string, n bigint")
    return stored(counted.groupBy("slice", "piece").agg(F.sum("n").alias("n")), "pieces")


def piece_lengths(counts: DataFrame, shared: _Shared) -> DataFrame:
    """``(piece, size)``: the tokens of each distinct piece; each is tokenized once in the whole job."""

    def run(batches):
        e = _encoder(shared)
        for b in batches:
            size = [len(e.piece(p.encode("utf-8"))) for p in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size, pa.int64())], names=["piece", "size"])

    return counts.select("piece").distinct().mapInArrow(run, "piece string, size bigint")


def token_budget(
    df: DataFrame,
    vocabulary: str,
    text_col: str = "text",
    source_col: str = "source",
    lang_col: str = "lang",
    domain_col: str = "doc_domain",
) -> DataFrame:
    """``(source, lang, doc_domain, n_docs, n_empty, n_chars, n_pieces, n_tokens)`` by slice.

    Pieces are counted by slice, each distinct piece is tokenized once, and its length is joined
    to its counts. A piece has at most one row for each slice there, so a frequent one is a
    partition that adaptive execution splits. A slice travels as the hash of its labels; two
    slices of one hash stop the job.
    """
    shared = _Shared(df.sparkSession, load_vocabulary(vocabulary))
    labels = [label(source_col, "none").alias("source"), label(lang_col, "und").alias("lang"), label(domain_col, "none").alias("doc_domain")]
    docs = df.select(*labels, F.col(text_col).alias("text")).withColumn("slice", F.xxhash64(*SLICE))
    counts = piece_counts(docs.select("slice", "text"), shared)
    totals = counts.join(piece_lengths(counts, shared), "piece").groupBy("slice").agg(F.sum("n").alias("n_pieces"), F.sum(F.col("n") * F.col("size")).alias("n_tokens"))
    key = F.struct(*SLICE)
    one = F.when(F.min(key) == F.max(key), F.min(key)).otherwise(F.raise_error(F.lit("two slices share a hash")))
    plain = docs.groupBy("slice").agg(
        one.alias("key"),
        F.count("*").alias("n_docs"),
        F.count_if(F.coalesce(F.col("text"), F.lit("")) == "").alias("n_empty"),
        F.coalesce(F.sum(F.length("text")), F.lit(0)).cast("bigint").alias("n_chars"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return plain.join(totals, "slice", "left").select("key.*", "n_docs", "n_empty", "n_chars", zero("n_pieces"), zero("n_tokens"))
