"""Selection and sampling: eligibility, best sentence of an article, top lists, quotas, weights."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as TX
from ..functions import treebank as TB
from ..functions.hashing import article_id, fingerprint_list, fingerprint_value


def top_by_hash(df: DataFrame, digest: Column, k: int, tie: list[str]) -> DataFrame:
    """The ``k`` rows of least digest in a total order. Spark keeps only k rows of each task."""
    return df.withColumn("__h", digest).orderBy("__h", *tie).limit(k).drop("__h")


def best_of_group(df: DataFrame, by: list[str], rank: Column, keep: list[str]) -> DataFrame:
    """Of each group the row of least rank, by a combining aggregation (no sort)."""
    best = F.min(F.struct(rank.alias("rank"), *keep)).alias("b")
    return df.groupBy(*by).agg(best).select(*by, "b.*")


def excerpts(df: DataFrame, k: int, seed: int, low: int = 8, high: int = 40, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """``k`` texts of ``low`` to ``high`` words, by fingerprint([seed, id])."""
    n = F.size(TX.split_words(text_col))
    return top_by_hash(df.where(n.between(low, high)), fingerprint_list(seed, F.col(id_col)), k, [id_col])


def source_splits(splits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(source_id, split)`` from rows of ``source_ids`` and ``split``, and the ids with two splits."""
    each = splits.select(F.explode("source_ids").alias("source_id"), "split").where("source_id is not null").distinct()
    bad = each.groupBy("source_id").agg(F.count("*").alias("n")).where("n > 1")
    return each.join(bad, "source_id", "left_anti"), bad.select("source_id")


def eligible(
    sentences: DataFrame, language: str, splits: DataFrame, used: DataFrame, dev_articles: DataFrame, low: int, high: int
) -> DataFrame:
    """Sentences that a new batch may draw: ``(source_id, sent_id, forms, text, adjacent)``.

    ``sentences`` is ``(article, sent_id, ids, forms, text)``. The article must be in the train
    split and no development article, the pair (source_id, sent_id) unused, ids consecutive, forms
    usable, and the forms must align with the text.
    """
    rows = sentences.where("article <> '' and sent_id <> ''").withColumn("source_id", article_id(language, F.col("article")))
    n = F.size("forms")
    shaped = (
        n.between(low, high)
        & (F.col("ids") == F.sequence(F.lit(1), F.greatest(n, F.lit(1))))
        & ~F.exists("forms", lambda f: f.isNull() | (f == "") | (f == "_"))
        & TX.usable_forms(F.col("forms"))
    )
    rows = rows.where(shaped).withColumn("adjacent", TB.spaces_after(F.col("forms"), F.col("text"))).where("adjacent is not null")
    rows = rows.join(splits.where("split = 'train'").select("source_id"), "source_id", "left_semi")
    rows = rows.join(dev_articles.select("source_id"), "source_id", "left_anti")
    rows = rows.join(used.select("source_id", F.col("source_sent_id").alias("sent_id")), ["source_id", "sent_id"], "left_anti")
    return rows.select("source_id", "sent_id", "forms", "text", "adjacent")


def numbered_ids(rows: DataFrame, digest: Column, tie: list[str], count: int, prefix: str, name: str = "number") -> DataFrame:
    """The ``count`` rows first by digest, with ids that number them from 1."""
    top = top_by_hash(rows, digest, count, tie)
    w = Window.orderBy(digest, *tie)  # at most ``count`` rows
    return top.withColumn(name, F.format_string(f"{prefix}-%04d", F.row_number().over(w)))


def select_batch(rows: DataFrame, language: str, round_id: str, count: int, seed: int) -> DataFrame:
    """One sentence of each article, the ``count`` articles first by hash, numbered from 1."""
    rank = fingerprint_list(seed, F.col("source_id"), F.col("sent_id"), F.col("forms"))
    best = best_of_group(rows, ["source_id"], rank, ["sent_id", "forms", "text", "adjacent"])
    chosen = numbered_ids(best, fingerprint_list(seed, F.col("source_id")), ["source_id"], count, f"{language}-fewshot-{round_id}")
    return chosen.select(F.col("number").alias("sent_id"), "source_id", F.col("sent_id").alias("source_sent_id"), "forms", "text", "adjacent")


def held_out_drafts(sentences: DataFrame, splits: DataFrame, per_language: int, seed: int, language: str) -> DataFrame:
    """One sentence of at least three words of each test article, the first ``per_language`` by hash.

    Sentences without an id take no part.
    """
    rows = sentences.where((F.size("forms") >= 3) & (F.col("article") != "") & F.col("sent_id").isNotNull()).withColumn("source_id", article_id(language, F.col("article")))
    rows = rows.join(splits.where("split = 'test'").select("source_id"), "source_id", "left_semi")
    best = best_of_group(rows, ["source_id"], fingerprint_list(seed, F.col("source_id"), F.col("sent_id")), ["sent_id", "forms"])
    return top_by_hash(best, fingerprint_list(seed, F.col("source_id")), per_language, ["source_id"]).withColumn("annotation_status", F.lit("DRAFT_AUTOMATIC"))


def assign_dev_batches(batches: list[DataFrame], language: str, seed: int = 42, dev_cap: int = 500, fraction: float = 0.1) -> DataFrame:
    """``(batch, source_id, source_sent_id, split)`` over batches in order.

    Each batch may add ``min(round half even(rows * fraction), dev_cap - dev rows)`` new articles to
    the development set, the first by fingerprint([seed, language, source_id]); an article keeps
    its split for good. Articles of several rows may take the set past its cap: later batches then
    add none, and :func:`over_cap` reports it. The batches are the human rounds, so the loop is short.
    """
    spark = batches[0].sparkSession
    known = spark.createDataFrame([], "source_id string, split string")
    out, dev_rows = None, 0
    for i, batch in enumerate(batches):
        rows = batch.select("source_id", "source_sent_id")
        quota = max(0, min(round(rows.count() * fraction), dev_cap - dev_rows))
        fresh = rows.select("source_id").distinct().join(known, "source_id", "left_anti")
        dev = top_by_hash(fresh, fingerprint_list(seed, language, F.col("source_id")), quota, ["source_id"])
        split = fresh.join(dev.withColumn("d", F.lit(1)), "source_id", "left").select("source_id", F.when(F.col("d") == 1, "dev").otherwise("train").alias("split"))
        known = known.unionByName(split)
        done = rows.join(known, "source_id").select(F.lit(i).alias("batch"), "source_id", "source_sent_id", "split")
        dev_rows += done.where("split = 'dev'").count()
        out = done if out is None else out.unionByName(done)
    return out


def over_cap(rows: DataFrame, dev_cap: int = 500) -> DataFrame:
    """``(dev_rows)``: the number of development rows, if repeated articles took it past the cap."""
    return rows.where("split = 'dev'").agg(F.count("*").alias("dev_rows")).where(F.col("dev_rows") > dev_cap)


def tempered_weights(df: DataFrame, by: str, alpha: float) -> DataFrame:
    """``(by, n, weight)``: n^alpha over its sum."""
    w = Window.partitionBy(F.lit(1))  # one row for each language
    return df.groupBy(by).agg(F.count("*").alias("n")).withColumn("weight", F.pow(F.col("n"), F.lit(alpha)) / F.sum(F.pow(F.col("n"), F.lit(alpha))).over(w))


def normalized_weights(df: DataFrame, by: str, weight: str = "weight", name: str = "share") -> DataFrame:
    """Each weight as a share of its group's sum; null where that is 0."""
    total = df.groupBy(by).agg(F.sum(weight).alias("__w")).withColumnRenamed(by, "__by")
    return df.join(total, F.col(by).eqNullSafe(F.col("__by"))).withColumn(name, F.when(F.col("__w") != 0, F.col(weight) / F.col("__w"))).drop("__by", "__w")


def few_shot_mix(weights: DataFrame, targets: list[str], fraction: float) -> DataFrame:
    """Source weights times ``1 - fraction``, and the fraction in equal parts for the targets."""
    spark = weights.sparkSession
    lang = weights.columns[0]
    source = weights.select(lang, (F.col("weight") * (1 - fraction)).alias("weight"))
    return source.unionByName(spark.createDataFrame([(t, fraction / len(targets)) for t in targets], f"`{lang}` string, weight double"))


#: Groups that a weighted draw tells apart by their stretch of the weights' line.
MOST_LANGUAGES = 1_000


def hash_draw(df: DataFrame, weights: DataFrame, draws: int, seed: int, by: str = "language", id_col: str = "id") -> DataFrame:
    """``(draw, by, id)``: weighted draws with replacement, language first, then a uniform row.

    Draw numbers are hashed to a point of the weights' line and to a row number; rows are
    numbered by hash ranges, so neither rows nor draws gather in one task.
    """
    from .components import rank_by_hash

    spark = df.sparkSession
    n = df.groupBy(by).agg(F.count("*").alias("__n"))
    w = Window.orderBy(by).rowsBetween(Window.unboundedPreceding, 0)
    line = weights.join(n, by).withColumn("__hi", F.sum("weight").over(w)).withColumn("__lo", F.col("__hi") - F.col("weight"))
    total = line.agg(F.sum("weight")).first()[0]
    u = lambda k: F.pmod(F.xxhash64(F.lit(seed), F.lit(k), F.col("draw")), F.lit(1 << 40)) / float(1 << 40)
    points = spark.range(draws).withColumnRenamed("id", "draw").withColumn("__u", u(1) * total)
    ends = [(r[by], float(r["__lo"]), int(r["__n"])) for r in line.orderBy("__lo").collect()]  # one row for each language
    if len(ends) > MOST_LANGUAGES:
        raise ValueError(f"{len(ends)} groups to draw from; at most {MOST_LANGUAGES} are laid on one line")
    names = spark.createDataFrame([(i, x, n) for i, (x, _, n) in enumerate(ends)], T.StructType([T.StructField("__i", T.IntegerType()), T.StructField(by, df.schema[by].dataType), T.StructField("__n", T.LongType())]))
    place = F.lit(0)
    for i, (_, low, _) in enumerate(ends[1:], 1):
        place = F.when(F.col("__u") >= low, i).otherwise(place)
    picked = points.withColumn("__i", place).join(names, "__i")
    picked = picked.withColumn("__rank", (F.floor(u(2) * F.col("__n")) + 1).cast("bigint")).select("draw", by, "__rank")
    ranked = rank_by_hash(df.select(by, id_col), [by], F.sha2(F.concat_ws(":", F.lit(seed), F.col(id_col).cast("string")), 256), [id_col], "__rank")
    return picked.join(ranked, [by, "__rank"]).select("draw", by, id_col)


def seeded_schedule(sizes: dict[str, int], weights: dict[str, float], draws: int, seed: int) -> list[tuple[str, int]]:
    """Draws of (language, row number) from Python's generator, where its sequence must be matched."""
    rng = random.Random(seed)
    names = list(weights)
    p = [weights[k] for k in names]
    out = []
    for _ in range(draws):
        lang = rng.choices(names, weights=p, k=1)[0]
        out.append((lang, rng.choice(range(sizes[lang]))))
    return out


def epoch_draws(sizes: dict[str, int], weights: dict[str, float], seed: int, epoch: int) -> list[tuple[str, int]]:
    """The draws of one epoch, as many as there are rows: first all languages, in alphabetical order of
    their names, then a row number for each. The generator is seeded with fingerprint([seed, epoch, "sampling"])."""
    names = sorted(weights)
    if missing := [n for n in names if not sizes.get(n)]:
        raise ValueError(f"no rows for {missing}")
    rng = random.Random(int(fingerprint_value([seed, epoch, "sampling"]), 16))
    languages = rng.choices(names, [weights[n] for n in names], k=sum(sizes.values()))
    return [(n, rng.randrange(sizes[n])) for n in languages]


def longest_of_group(df: DataFrame, by: str, size: Column, id_col: str) -> DataFrame:
    """Of each group the row of greatest size (ties: smallest id), for smoke runs."""
    return df.groupBy(by).agg(F.min_by(F.col(id_col), F.struct((-size).alias("s"), F.col(id_col))).alias(id_col), F.max(size).alias("size"))


def eval_subset(df: DataFrame, limit: int, seed: int, id_col: str = "sent_id", text_col: str = "text", order: str = "pos") -> DataFrame:
    """All rows if they are no more than the limit, else the first by fingerprint([seed, id, text])."""
    if df.count() <= limit:
        return df
    return top_by_hash(df, fingerprint_list(seed, F.col(id_col), F.col(text_col)), limit, [order])


def run_signature(*parts) -> str:
    """Identity of a run from its config, data, model and code hashes."""
    return fingerprint_value(list(parts))
