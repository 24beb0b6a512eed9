"""Corpus preparation: wiki cleaning, grouping, splits and overlap removal.

Every filter returns what it kept and an audit of what it changed or dropped.
"""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from ..functions import text as T
from ..functions.hashing import fingerprint_list
from ..session import cut
from .components import group_by_shared_keys, rank_by_hash
from .running import running

# What makes a line of a wiki page metadata, and titles of main pages.
WIKI_METADATA = (
    r"(?iU)^(?:\{\||\|[}\-]|\||!|__(?:NOTOC|NOEDITSECTION)__|"
    r"(?:Категорий|Категория|Category|Файл|File|Image):|\d+\s*px\|)"
)


MAIN_PAGES = ["Кумшо лаштык", "Кутскон бам", "Тӱҥ лаштык", "Main Page"]


@F.pandas_udf(ArrayType(StringType()))
def _unescape_lines(lines: pd.Series) -> pd.Series:
    return lines.map(lambda x: None if x is None else [html.unescape(v) for v in x])


def clean_wiki(df: DataFrame, text_col: str = "text", unescape: bool = True) -> DataFrame:
    """Adds ``clean`` (text of the kept lines) and ``audit`` (array of line_no, reason, text, result).

    Works on each document's array of lines, so nothing is shuffled. Drops metadata lines and
    lines without a letter (the latter without audit unless an edit emptied them), removes
    comments, innermost templates, link targets and tags, decodes entities, collapses spaces.
    A null text gives an empty text.
    """
    lines = T.split_lines(F.coalesce(F.col(text_col), F.lit("")))
    meta = lambda x: T.strip(x).rlike(WIKI_METADATA)

    def edit(x: Column) -> Column:
        x = T.strip(x)
        x = F.regexp_replace(x, r"<!--.*?-->", "")
        x = F.regexp_replace(x, r"\{\{[^{}]*\}\}", "")
        x = F.regexp_replace(x, r"\[\[(?:[^|\]]*\|)?([^\]]+)\]\]", "$1")
        return F.regexp_replace(x, r"<[^>]+>", "")

    with_lines = df.withColumn("__lines", lines).withColumn("__edited", F.transform("__lines", edit))
    if unescape:
        with_lines = with_lines.withColumn(
            "__edited", F.when(F.col(text_col).contains("&"), _unescape_lines("__edited")).otherwise(F.col("__edited"))
        )
    tidy = lambda x: T.strip(F.regexp_replace(x, "[ \\t\u00a0]+", " "))
    rows = F.transform(
        F.arrays_zip("__lines", "__edited"),
        lambda z, i: F.struct(
            (i + 1).cast("int").alias("line_no"),
            F.when(meta(z["__lines"]), "wiki_metadata_line").when(tidy(z["__edited"]) != z["__lines"], "wiki_inline_cleanup").alias("reason"),
            z["__lines"].alias("text"),
            F.when(~meta(z["__lines"]), tidy(z["__edited"])).alias("result"),
        ),
    )
    rows = F.filter(rows, lambda r: T.strip(r["text"]) != "")
    kept = F.filter(F.transform("__rows", lambda r: r["result"]), lambda x: x.isNotNull() & (x != "") & T.has_letter(x))
    return (
        with_lines.withColumn("__rows", rows)
        .withColumn("clean", F.array_join(kept, "\n"))
        .withColumn("audit", F.filter("__rows", lambda r: r["reason"].isNotNull()))
        .drop("__lines", "__edited", "__rows")
    )


def drop_titles(df: DataFrame, titles: list[str] = MAIN_PAGES, title_col: str = "title") -> tuple[DataFrame, DataFrame]:
    """Rows without the given titles (main pages), and the audit of those dropped."""
    hit = F.coalesce(T.strip(title_col).isin(titles), F.lit(False))
    return df.where(~hit), df.where(hit).withColumn("reason", F.lit("wiki_main_page"))


def stamp_representation(df: DataFrame, name: str = "identity", version: str = "1") -> DataFrame:
    """Adds the representation; only the identity of version 1 is known."""
    if (name, version) != ("identity", "1"):
        raise ValueError(f"unknown representation {name} {version}")
    return df.withColumn("representation", F.struct(F.lit(name).alias("name"), F.lit(version).alias("version"), F.lit(None).cast("string").alias("mapping_sha256")))


def counts(df: DataFrame, by: list[str], text_col: str = "text") -> DataFrame:
    """Documents and characters (code points) by the given columns."""
    return df.groupBy(*by).agg(F.count("*").alias("documents"), F.coalesce(F.sum(F.length(text_col)), F.lit(0)).alias("characters"))


# ---- duplicate groups, merge and ranked splits -----------------------------------------


def duplicate_groups(
    records: DataFrame, id_col: str = "id", ids_col: str = "source_ids", text_col: str = "text", lang_col: str = "language", key: Column | None = None
) -> DataFrame:
    """``(rec, root)``: components over a shared canonical text or source id within a language."""
    key = key if key is not None else T.canonical_exact(text_col)
    texts = records.select(F.col(id_col).alias("rec"), F.concat_ws("\u0001", F.lit("t"), F.col(lang_col), key).alias("key")).where(F.col(text_col).isNotNull())
    ids = records.select(F.col(id_col).alias("rec"), F.col(lang_col).alias("l"), F.explode(ids_col).alias("s")).where("s is not null")
    ids = ids.select("rec", F.concat_ws("\u0001", F.lit("s"), "l", "s").alias("key"))
    return group_by_shared_keys(texts.unionByName(ids))


def group_ends(records: DataFrame, roots: DataFrame, id_col: str = "id") -> DataFrame:
    """``(root, first, last)``: of each group its first and last member by (id, text), as structs of both."""
    order = F.struct(F.col(id_col).alias("id"), F.col("text"))
    rows = records.join(roots, records[id_col] == roots["rec"])
    return rows.groupBy("root").agg(F.min(order).alias("first"), F.max(order).alias("last"))


def merge_groups(records: DataFrame, roots: DataFrame, id_col: str = "id", key: Column | None = None) -> DataFrame:
    """One row for each group: ``root, id, language, source_ids, text, n_records``.

    The representative is the smallest by id and text. Source ids are the sorted union. Texts
    that are canonically equal count once, in the spelling of the last by (id, text), in the
    order of their canonical forms.
    """
    key = key if key is not None else T.canonical_exact("text")
    rows = records.join(roots, records[id_col] == roots["rec"]).withColumn("__k", key)
    order = F.struct(F.col(id_col), F.col("text"))
    texts = (
        rows.where("text is not null").groupBy("root", "__k").agg(F.max_by("text", order).alias("t"))
        .groupBy("root").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("__k", "t"))), lambda x: x["t"]), "\n").alias("text"))
    )
    ids = rows.select("root", F.explode("source_ids").alias("s")).where("s is not null").groupBy("root").agg(F.sort_array(F.collect_set("s")).alias("source_ids"))
    heads = rows.groupBy("root").agg(F.min_by(F.col(id_col), order).alias("id"), F.min_by("language", order).alias("language"), F.count("*").alias("n_records"))
    return (
        heads.join(ids, "root", "left").join(texts, "root", "left")
        .select("root", "id", "language", F.coalesce("source_ids", F.array().cast("array<string>")).alias("source_ids"), "text", "n_records")
    )


def ranked_splits(
    groups: DataFrame, seed: int = 42, validation: float = 0.05, test: float = 0.05, targets: list[str] | None = None, tie: str = "root"
) -> DataFrame:
    """Adds ``split``: by rank of fingerprint([seed, source_ids]) the first are test, then validation.

    Sizes are ``max(1, round half even(n * fraction))`` of each target language; other languages
    are all train. Ranks come from hash ranges, not from one sort.
    """
    sizes = groups.groupBy("language").agg(F.count("*").alias("__n"))
    size = lambda f: F.greatest(F.lit(1), F.bround(F.col("__n") * F.lit(f)).cast("int"))
    ranked = rank_by_hash(groups, ["language"], fingerprint_list(seed, F.col("source_ids")), [tie], "__rank")
    sizes = sizes.select(F.col("language").alias("__l"), size(test).alias("__t"), size(validation).alias("__v"))
    split = F.when(F.col("__rank") <= F.col("__t"), "test").when(F.col("__rank") <= F.col("__t") + F.col("__v"), "validation").otherwise("train")
    if targets is not None:
        split = F.when(F.col("language").isin(targets), split).otherwise("train")
    return ranked.join(sizes, F.col("language").eqNullSafe(F.col("__l"))).withColumn("split", split).drop("__l", "__rank", "__t", "__v")


def split_violations(groups: DataFrame, targets: list[str]) -> DataFrame:
    """Target languages with fewer than three groups, or without a group left for training."""
    per = groups.groupBy("language").agg(F.count("*").alias("n"), F.sum((F.col("split") == "train").cast("int")).alias("n_train"))
    return per.where(F.col("language").isin(targets) & ((F.col("n") < 3) | (F.col("n_train") == 0)))


# ---- overlap removal --------------------------------------------------------------------


def _grams(words: Column, width: int) -> Column:
    return T.ngrams(words, width)


def overlapping_lines(lines: DataFrame, protected: DataFrame, width: int = 12) -> DataFrame:
    """``(id, line_no)`` of the lines whose key or any n-gram is protected.

    ``lines`` is ``(id, line_no, key)`` with canonical keys, ``protected`` is ``(key)``. N-grams
    meet as 64-bit hashes of eight bytes; lines that hit are then checked on the n-grams themselves.
    """
    whole = lines.join(protected.distinct(), "key", "left_semi").select("id", "line_no")
    grams = lines.select("id", "line_no", F.explode(_grams(F.split("key", " "), width)).alias("gram"))
    guard = cut(protected.select(F.explode(_grams(F.split("key", " "), width)).alias("gram")).distinct())
    hashed = grams.select("id", "line_no", F.xxhash64("gram").alias("h")).join(guard.select(F.xxhash64("gram").alias("h")).distinct(), "h", "left_semi")
    suspects = lines.join(hashed.select("id", "line_no").distinct(), ["id", "line_no"], "left_semi")
    exact = suspects.select("id", "line_no", F.explode(_grams(F.split("key", " "), width)).alias("gram")).join(guard, "gram", "left_semi")
    return whole.unionByName(exact.select("id", "line_no")).distinct()


def keyed_lines(df: DataFrame, id_col: str = "id", text_col: str = "text", exact: bool = True) -> DataFrame:
    """``(id, line_no, line, key)`` of every line with a non-empty canonical key."""
    rows = df.select(F.col(id_col).alias("id"), F.posexplode(T.split_lines(text_col)).alias("p", "line"))
    key = T.canonical_exact("line") if exact else T.canonical("line")
    return rows.select("id", (F.col("p") + 1).cast("int").alias("line_no"), "line", key.alias("key")).where("key <> ''")


def remove_overlap(
    records: DataFrame, exclusions: DataFrame | None = None, width: int = 12, id_col: str = "id", exact: bool = True
) -> tuple[DataFrame, DataFrame]:
    """Records without lines that stand in protected text, and the audit of the lines removed.

    Exclusions protect against everything; then test, validation and train follow, and the lines
    a split keeps protect against the later ones, never against their own. Protection holds
    across languages. Keys are computed once and cut; each stage is a pair of semi-joins.
    """
    lines = cut(keyed_lines(records, id_col, exact=exact).join(records.select(F.col(id_col).alias("id"), "split"), "id"))
    guard = None
    if exclusions is not None:
        key = T.canonical_exact("text") if exact else T.canonical("text")
        guard = exclusions.select(key.alias("key")).where("key <> ''")
    kept, gone = None, None
    for split in ("test", "validation", "train"):
        own = lines.where(F.col("split") == split)
        if guard is None:
            stay, bad = own, own.limit(0)
        else:
            hits = cut(overlapping_lines(own.select("id", "line_no", "key"), guard, width))
            stay, bad = own.join(hits, ["id", "line_no"], "left_anti"), own.join(hits, ["id", "line_no"], "left_semi")
        stay = cut(stay)
        kept = stay if kept is None else kept.unionByName(stay)
        gone = bad if gone is None else gone.unionByName(bad)
        if split != "train":
            guard = stay.select("key") if guard is None else guard.unionByName(stay.select("key"))
    texts = kept.groupBy("id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("__text"))
    out = records.join(texts.withColumnRenamed("id", "__id"), F.col(id_col) == F.col("__id")).drop("__id", "text").withColumnRenamed("__text", "text")
    return out, gone.select("id", "split", "line_no", F.lit("protected_passage").alias("reason"), F.col("line").alias("text"))


# ---- recovery of recordings -------------------------------------------------------------


def text_candidates(lines: DataFrame, utterances: DataFrame, doc_col: str = "doc") -> DataFrame:
    """``(doc, line, text, n, only)``: how many recordings hold each line's stripped text, and which if it is one.

    Candidates are counted by text before the join, never gathered.
    """
    pairs = utterances.select(T.strip("text").alias("t"), "recording").where("t is not null and recording is not null").distinct()
    stats = pairs.groupBy("t").agg(F.count("*").alias("n"), F.min("recording").alias("only"))
    rows = lines.select(F.col(doc_col).alias("doc"), "line", T.strip("text").alias("text"))
    found = rows.join(stats, rows["text"] == stats["t"], "left")
    return found.select("doc", "line", "text", F.coalesce("n", F.lit(0)).alias("n"), F.when(F.col("n") == 1, F.col("only")).alias("only"))


def recover_recordings(lines: DataFrame, utterances: DataFrame, doc_col: str = "doc") -> DataFrame:
    """``(doc, line, text, n_candidates, recording, method)`` for every local line.

    Lines meet archive utterances on equal stripped text. A line with one candidate is an
    anchor; an ambiguous line takes a recording if the nearest anchors strictly before and after
    name the same one and it is a candidate. A text's candidates are counted, never gathered;
    whether an anchor is one of them is an equi-join. Both anchors are carried over pieces of the
    document, so a long one is many tasks.
    """
    pairs = utterances.select(T.strip("text").alias("t"), "recording").where("t is not null and recording is not null").distinct()
    rows = text_candidates(lines, utterances, doc_col).withColumnRenamed("only", "own")
    rows = running(rows, ["doc"], ["line"], {"before": ("last", F.col("own")), "after": ("next", F.col("own"))}, others=True)
    asked = F.when((F.col("n") > 1) & (F.col("before") == F.col("after")), F.col("before"))
    known = pairs.select(F.col("t").alias("kt"), F.col("recording").alias("kr"))
    rows = rows.withColumn("asked", asked).join(known, (F.col("text") == F.col("kt")) & (F.col("asked") == F.col("kr")), "left")
    method = (
        F.when(F.col("n") == 0, "unmatched").when(F.col("own").isNotNull(), "unique_exact_recording")
        .when(F.col("kr").isNotNull(), "exact_with_matching_neighbor_anchors").otherwise("ambiguous_recording")
    )
    return rows.select("doc", "line", "text", F.col("n").alias("n_candidates"), F.coalesce("own", "kr").alias("recording"), method.alias("method"))


# ---- small steps ------------------------------------------------------------------------


def union_records(*frames: DataFrame) -> DataFrame:
    """The records of several languages or sources; columns that one lacks are null there."""
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def drop_blank(df: DataFrame, text_col: str = "text") -> DataFrame:
    """The records whose text is more than white space."""
    return df.where(T.strip(text_col) != "")


def distinct_counts(df: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """Of each group the number of distinct values of each column, nulls left out.

    Each column is made distinct by itself before it is counted, so no group is one task.
    """
    out = df.select(*by).distinct()
    for c in columns:
        n = df.where(F.col(c).isNotNull()).select(*by, c).distinct().groupBy(*by).agg(F.count("*").alias(c)).select(*[F.col(b).alias(f"__{b}") for b in by], F.col(c).alias(f"__n_{c}"))
        on = [F.col(b).eqNullSafe(F.col(f"__{b}")) for b in by]
        out = out.join(n, on, "left").drop(*[f"__{b}" for b in by]).withColumn(c, F.coalesce(f"__n_{c}", F.lit(0)).cast("bigint")).drop(f"__n_{c}")
    return out
