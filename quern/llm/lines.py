"""Lines that come back in many articles of one source (problem 6), by PrefixSpan.

The lines of a row get the integer of their letters (case, spacing, punctuation and digits
don't count). Over each source's articles, as sequences of line integers in reading order,
frequent sequences are mined by growing prefixes: the frequent single lines first; then, in the
articles reduced to their frequent lines, a frequent sequence grows by the line that follows one of
its occurrences, as long as enough distinct articles support it. Lines of a sequence thus follow
each other with no other frequent line between them (own lines of the article may be), so an
article of n frequent lines has at most n sequences of each length, never all its 2^n
combinations. The support of a sequence is its number of distinct articles. Reported are the *closed*
sequences: those that no longer one of equal support contains. Removal deletes the occurrences of
the lines of all closed sequences; every frequent line is in one, alone or among others.

Defined results: rows with a null source take no part and stay as they are. Neither do rows with a
null article, unless ``unnamed`` is set: then they support nothing, but the frequent lines of
their source are found in them like in any other row. Null,
blank and letterless lines are never removed; a null text stays null, and a text of which all
lines go becomes empty. A line that repeats within an article supports once. Equal order keys
are read by row id. Other columns of the input are ignored.
"""

from __future__ import annotations

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut, stored
from .canon import letters_only

#: Distinct articles in which a sequence must occur.
MIN_ARTICLES = 8


def line_table(
    df: DataFrame, id_col: str = "row_id", text_col: str = "text", source_col: str = "source", article_col: str = "source_id",
    unnamed: bool = False,
) -> DataFrame:
    """``(source, article, row_id, line_no, line)``: the integer of every line with a letter.

    ``unnamed`` keeps the rows without an article, with a null one.
    """
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            row, number, line = [], [], []
            for i, text in enumerate(b.column(3).to_pylist()):
                for j, x in enumerate(text.split("\n"), 1):
                    letters = letters_only(x)
                    if letters and any(c.isalpha() for c in letters):
                        row.append(i)
                        number.append(j)
                        line.append(xxhash.xxh3_128_digest(letters.encode("utf-8")))
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*(b.column(i).take(at) for i in range(3)), pa.array(number, pa.int32()), pa.array(line, pa.binary())],
                names=["source", "article", "row_id", "line_no", "line"],
            )

    rows = df.select(
        F.col(source_col).cast("string").alias("source"), F.col(article_col).cast("string").alias("article"), F.col(id_col).alias("row_id"), F.col(text_col).alias("text")
    ).where(F.col(source_col).isNotNull() & (F.col(article_col).isNotNull() | F.lit(unnamed)) & F.col(text_col).isNotNull())
    return rows.mapInArrow(run, f"source string, article string, row_id {kind}, line_no int, line binary")


def _support(occurrences: DataFrame, keys: list[str], least: int) -> DataFrame:
    """Distinct articles of each key, counted in two combining steps so that no key is one task."""
    each = occurrences.where("article is not null").select("source", "article", *keys).distinct()
    return each.groupBy("source", *keys).agg(F.count("*").alias("n_articles")).where(F.col("n_articles") >= least)


def frequent_lines(lines: DataFrame, min_articles: int = MIN_ARTICLES) -> DataFrame:
    """``(source, line, n_articles)``: the frequent sequences of length one."""
    return _support(lines, ["line"], min_articles)


def _numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """Adds ``at``: the place of each row in the order of all rows.

    Ranges of the order are sorted each by one task, a range of one article or of a part of one;
    only the number of rows of each range reaches the driver.
    """
    laid = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order)).withColumn("m", F.monotonically_increasing_id())
    part, local = F.shiftright("m", 33), F.col("m").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = {r["p"]: r["n"] for r in laid.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}
    before, begins = 0, []
    for p in sorted(sizes):
        begins.append((p, before))
        before += sizes[p]
    begins = F.broadcast(rows.sparkSession.createDataFrame(begins, "part bigint, begin bigint"))  # one row a task
    return laid.withColumn("part", part).join(begins, "part").withColumn("at", F.col("begin") + local).drop("part", "begin", "m")


def closed_sequences(lines: DataFrame, min_articles: int = MIN_ARTICLES) -> DataFrame:
    """``(source, sequence, n_articles)``: the closed frequent sequences, single lines among them.

    The state of a level is one row for each occurrence of a frequent sequence: the place where
    it begins, and its number. Two occurrences that begin at neighbouring places of an article
    make one that is longer by a line; only such pairs move, by place, so neither a hot source
    nor a hot article is one task. Growth ends when no sequence is frequent. ``lines`` is read
    twice, so it should be a stored table.
    """
    level = stored(
        frequent_lines(lines, min_articles).select("source", "line", "n_articles", F.monotonically_increasing_id().alias("number"), F.array("line").alias("sequence")), "sequences"
    )
    kept = lines.where("article is not null").join(level.select("source", "line", "number").hint("merge"), ["source", "line"])
    kept = kept.select("source", "article", "row_id", "line_no", "number")
    state = cut(_numbered(kept, ["source", "article", "row_id", "line_no"]).select("source", "article", "at", "number"))
    found = []
    while True:
        following = state.select("source", "article", (F.col("at") - 1).alias("at"), F.col("number").alias("next"))
        pairs = cut(state.join(following, ["source", "article", "at"]))
        frequent = _support(pairs, ["number", "next"], min_articles)
        grown = stored(frequent.withColumn("grown", F.monotonically_increasing_id()), "sequences")
        # a sequence is closed unless one that is longer by a line at either end has as many articles
        longer = grown.select(F.explode(F.array("number", "next")).alias("number"), "n_articles").groupBy("number").agg(F.max("n_articles").alias("most"))
        closed = level.join(longer, "number", "left").where(F.col("most").isNull() | (F.col("most") < F.col("n_articles")))
        found.append(closed.select("source", "sequence", "n_articles"))
        if grown.isEmpty():
            break
        state = cut(pairs.join(grown.select("number", "next", "grown"), ["number", "next"]).select("source", "article", "at", F.col("grown").alias("number")))
        heads = level.select("number", "sequence")
        last = level.select(F.col("number").alias("next"), F.array(F.element_at("sequence", -1)).alias("last"))
        level = stored(
            grown.join(heads, "number").join(last, "next").select("source", "n_articles", F.col("grown").alias("number"), F.concat("sequence", "last").alias("sequence")), "sequences"
        )
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out


def occurrences(lines: DataFrame, sequences: DataFrame) -> DataFrame:
    """The rows of :func:`line_table` that hold a line of one of the sequences of their source."""
    wanted = cut(sequences.select("source", F.explode("sequence").alias("line")).distinct())
    return lines.join(wanted, ["source", "line"])


def repeated_lines(df: DataFrame, min_articles: int = MIN_ARTICLES, **columns: str | bool) -> DataFrame:
    """``(row_id, line_no)`` of every occurrence of a line of a frequent sequence."""
    lines = stored(line_table(df, **columns), "lines")
    return occurrences(lines, closed_sequences(lines, min_articles)).select("row_id", "line_no")


def remove_repeated_lines(df: DataFrame, min_articles: int = MIN_ARTICLES, id_col: str = "row_id", text_col: str = "text", **columns: str | bool) -> DataFrame:
    """``(id, text, n_removed)`` of every row, without the lines of frequent sequences of its source."""
    gone = (
        repeated_lines(df, min_articles, id_col=id_col, text_col=text_col, **columns)
        .groupBy("row_id")
        .agg(F.collect_set("line_no").alias("gone"))  # a row's own lines
        .select(F.col("row_id").alias(id_col), "gone")
    )
    rows = df.select(F.col(id_col), F.col(text_col).alias("text")).join(gone, id_col, "left")
    lines = F.split("text", "\n")
    kept = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains("gone", (i + 1).cast("int"))), "\n")
    return rows.select(id_col, F.when(F.col("gone").isNull(), F.col("text")).otherwise(kept).alias("text"), F.coalesce(F.size("gone"), F.lit(0)).cast(T.IntegerType()).alias("n_removed"))


def named(sequences: DataFrame) -> DataFrame:
    """Sequences with their lines' integers as hexadecimal text."""
    return sequences.select("source", F.transform("sequence", lambda x: F.lower(F.hex(x))).alias("sequence"), "n_articles")
