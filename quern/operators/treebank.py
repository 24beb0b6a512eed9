"""Treebanks as tables: sentences from lines, words, metadata, validation, vocabularies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import treebank as TB
from ..functions.hashing import fingerprint_list
from ..functions.text import bound
from .running import running

FIELDS = ["id", "form", "lemma", "upos", "xpos", "feats", "head", "deprel", "deps", "misc"]


def sentences_from_lines(lines: DataFrame, file_col: str = "file", pos_col: str = "pos", line_col: str = "line", only_empty: bool = False) -> DataFrame:
    """``(file, sent_no, lines)``: runs of lines between blank ones; the last needs no blank line.

    A line of white space ends a sentence too, unless ``only_empty``. The running count of blank
    lines goes over pieces of each file, so a long file is many tasks; sentences keep the order
    of their lines.
    """
    text = F.regexp_replace(F.col(line_col), "[\r\n]+$", "")
    blank = (text == "") if only_empty else ~text.rlike(r"(?U)[^\s\x1C-\x1F]")
    marked = lines.select(F.col(file_col).alias("file"), F.col(pos_col).alias("pos"), text.alias("line"), blank.cast("int").alias("blank"))
    marked = running(marked, ["file"], ["pos"], {"g": ("sum", F.col("blank"))})
    rows = marked.where("blank = 0").groupBy("file", "g").agg(F.sort_array(F.collect_list(F.struct("pos", "line"))).alias("r"))
    return rows.select("file", F.col("g").alias("sent_no"), F.transform("r", lambda x: x["line"]).alias("lines"))


def metadata(lines: Column) -> Column:
    """Map of the ``# key = value`` comments; of a repeated key the last counts."""
    heads = F.filter(lines, lambda x: x.startswith("#") & x.contains(" = "))
    key = lambda x: F.regexp_replace(F.substring_index(F.substring(x, 2, 1_000_000), " = ", 1), "^ +| +$", "")
    pairs = F.transform(heads, lambda x: F.named_struct(F.lit("k"), key(x), F.lit("v"), F.substring(x, F.locate(" = ", x) + 3, F.length(x))))
    last = lambda ps: F.filter(ps, lambda p, i: ~F.exists(F.slice(ps, i + 2, F.size(ps)), lambda q: q["k"] == p["k"]))
    return F.map_from_entries(bound(pairs, last))


def words(lines: Column) -> Column:
    """Array of word structs: the rows whose id is all digits (no ranges, no empty nodes).

    Words in the range of a multi-word token carry its first id and its form, others nulls.
    """
    rows = F.filter(lines, lambda x: ~x.startswith("#"))
    cols = F.filter(F.transform(rows, lambda x: F.split(x, "\t")), lambda c: F.size(c) == 10)

    def build(cols: Column) -> Column:
        ranges = F.transform(
            F.filter(cols, lambda c: c[0].rlike("^[0-9]+-[0-9]+$")),
            lambda c: F.struct(F.substring_index(c[0], "-", 1).cast("int").alias("first"), F.substring_index(c[0], "-", -1).cast("int").alias("last"), c[1].alias("form")),
        )

        def one(c: Column) -> Column:
            number = c[0].cast("int")
            span = F.get(F.filter(ranges, lambda r: number.between(r["first"], r["last"])), F.lit(0))
            return F.struct(
                number.alias("id"), c[1].alias("form"), c[2].alias("lemma"), c[3].alias("upos"), c[4].alias("xpos"), c[5].alias("feats"),
                F.when(c[6] != "_", c[6].try_cast("int")).alias("head"), c[7].alias("deprel"), c[9].alias("misc"), span["first"].alias("span_first"), span["form"].alias("span_form"),
            )

        return F.transform(F.filter(cols, lambda c: c[0].rlike("^[0-9]+$")), one)

    return bound(cols, build)


def bad_columns(lines: Column) -> Column:
    """Number of token lines that don't have ten columns (an error to the strict reader)."""
    return F.size(F.filter(lines, lambda x: ~x.startswith("#") & (F.size(F.split(x, "\t")) != 10)))


def render(lines: Column) -> Column:
    """The sentence as text, with the blank line that ends it."""
    return F.concat(F.array_join(lines, "\n"), F.lit("\n\n"))


def word_table(sentences: DataFrame, keys: list[str], lines: str = "lines") -> DataFrame:
    """One row for each word, with the sentence's keys."""
    return sentences.select(*keys, F.explode(words(F.col(lines))).alias("w")).select(*keys, "w.*")


def tree_violations(words_: Column, require_gold: bool = True) -> Column:
    """Array of what is wrong with a sentence: ids, root count, head range, self loop, root relation, cycle."""
    heads = F.transform(words_, lambda w: w["head"])
    n = F.size(words_)
    ids = F.transform(words_, lambda w: w["id"])
    checks = [(n == 0, "empty"), (ids != F.sequence(F.lit(1), F.greatest(n, F.lit(1))), "ids")]
    if require_gold:
        checks += [
            (F.exists(heads, lambda h: h.isNull()), "no_head"),
            (F.size(F.filter(heads, lambda h: h == 0)) != 1, "root_count"),
            (F.exists(heads, lambda h: (h < 0) | (h > n)), "head_range"),
            (F.exists(words_, lambda w: w["head"] == w["id"]), "self_loop"),
            (F.exists(words_, lambda w: (w["head"] == 0) != (TB.F.substring_index(w["deprel"], ":", 1) == "root")), "root_relation"),
            (TB.has_cycle(heads), "cycle"),
        ]
    return F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for c, name in checks]), lambda x: x.isNotNull())


# ---- vocabularies -------------------------------------------------------------------------


def label_vocabulary(tokens: DataFrame) -> DataFrame:
    """``(kind, labels)``: sorted labels of parts of speech (without ``_``), base relations, and
    for each feature its values with ``_`` first."""
    upos = tokens.where("upos <> '_'").select(F.lit("upos").alias("kind"), F.col("upos").alias("v"))
    rel = tokens.select(F.lit("deprel").alias("kind"), F.substring_index("deprel", ":", 1).alias("v")).where("v <> '_'")
    feats = tokens.where("feats <> '_'").select(F.explode(F.split("feats", r"\|")).alias("p")).select(F.concat(F.lit("feats:"), F.substring_index("p", "=", 1)).alias("kind"), F.substring(F.col("p"), F.locate("=", F.col("p")) + 1, F.length("p")).alias("v"))
    sets = upos.unionByName(rel).unionByName(feats).distinct().groupBy("kind").agg(F.sort_array(F.collect_list("v")).alias("labels"))
    return sets.select("kind", F.when(F.col("kind").startswith("feats:"), F.concat(F.array(F.lit("_")), F.array_remove("labels", "_"))).otherwise(F.col("labels")).alias("labels"))


def lemma_rules(tokens: DataFrame) -> DataFrame:
    """``(rule, n, idx)``: lemma rules by falling count, then text; the copying rule is number 0.

    Each distinct pair of form and lemma gets its rule once.
    """
    pairs = tokens.where("lemma <> '_'").groupBy("form", "lemma").agg(F.count("*").alias("n"))
    rules = pairs.select(TB.lemma_rule("form", "lemma").alias("rule"), "n").groupBy("rule").agg(F.sum("n").alias("n"))
    copy = F.col("rule") == '[0,0,"",""]'
    return rules.withColumn("idx", (F.row_number().over(Window.orderBy(copy.desc(), F.col("n").desc(), "rule")) - 1).cast("int"))


def extend_vocabulary(parent: Column, observed: Column) -> Column:
    """Parent labels in their order, then the new ones in the order observed."""
    return F.concat(parent, F.array_except(observed, parent))


def index_labels(tokens: DataFrame, vocabulary: DataFrame, column: str, name: str) -> DataFrame:
    """Adds the index of a label in the vocabulary ``(label, idx)``, -100 where it is unseen."""
    v = vocabulary.select(F.col("label").alias("__label"), F.col("idx").alias("__idx"))
    return tokens.join(v, F.col(column) == F.col("__label"), "left").withColumn(name, F.coalesce("__idx", F.lit(-100))).drop("__label", "__idx")


def first_seen_forms(tokens: DataFrame, order: list[str], form: str = "form") -> DataFrame:
    """``(form, first)``: each distinct form with the place where it is first met, by a combining aggregation."""
    return tokens.groupBy(form).agg(F.min(F.struct(*order)).alias("first"))


# ---- groups --------------------------------------------------------------------------------


def recording_key(sent_id: Column, language: Column, doc_title: Column, sound_url: Column) -> Column:
    """What a sentence's recording or text is: title or sound file for ``yrk``; for others the id
    up to its last colon, else up to its last underscore, with one fixed batch as a whole."""
    by_id = (
        F.when(sent_id.startswith("brat_2018:"), F.lit("brat_2018"))
        .when(sent_id.contains(":"), F.regexp_replace(sent_id, "(?s):[^:]*$", ""))
        .otherwise(F.regexp_replace(sent_id, "(?s)_[^_]*$", ""))
    )
    return F.when(language == "yrk", F.coalesce(F.when(doc_title != "", doc_title), sound_url)).otherwise(by_id)


def greedy_groups(sizes: DataFrame, by: list[str], goal: Column, seed: int, key: str = "key", n: str = "n") -> DataFrame:
    """``(by, goal, key)``: groups taken in the order of fingerprint([seed, key]) up to a goal.

    Stops once the goal is met; skips a group that would pass max(1.2 goal, goal + 2) unless
    nothing is selected yet; if nothing is, takes the smallest group.

    While the goal isn't met, a group no larger than max(0.2 goal, 2) never passes the limit. So
    only the larger ones, of which a total has few (50 where the goal is a tenth of it), are decided one
    after the other; sums of the small ones before each, and then of all taken, are running sums.
    """
    order = ["__h", "__k"]
    rows = sizes.select(*by, F.col(key).alias("__k"), F.col(n).cast("bigint").alias("__n"), fingerprint_list(seed, F.col(key)).alias("__h"), goal.cast("bigint").alias("goal"))
    limit = F.greatest(F.col("goal") * 1.2, (F.col("goal") + 2).cast("double"))
    rows = rows.withColumn("__big", F.col("__n") > limit - F.col("goal"))
    small = running(rows, by, order, {"__small": ("sum", F.when(F.col("__big"), 0).otherwise(F.col("__n")))}, others=True)
    bigs = small.where("__big").groupBy(*by).agg(F.max("goal").alias("goal"), F.sort_array(F.collect_list(F.struct("__h", "__k", "__n", "__small"))).alias("bigs"))
    start = F.struct(F.lit(0).cast("bigint").alias("sum"), F.array().cast("array<string>").alias("keys"))

    def step(acc, x):
        so_far = acc["sum"] + x["__small"]
        take = (so_far < F.col("goal")) & ((so_far == 0) | ((so_far + x["__n"]).cast("double") <= limit))
        return F.when(take, F.struct((acc["sum"] + x["__n"]).alias("sum"), F.concat(acc["keys"], F.array(x["__k"])).alias("keys"))).otherwise(acc)

    taken = bigs.select(*[F.col(c).alias(f"__t{i}") for i, c in enumerate(by)], F.explode(F.aggregate("bigs", start, step)["keys"]).alias("__tk"))
    on = [F.col("__k") == F.col("__tk"), *[F.col(c).eqNullSafe(F.col(f"__t{i}")) for i, c in enumerate(by)]]
    marked = rows.join(taken, on, "left").withColumn("__in", ~F.col("__big") | F.col("__tk").isNotNull()).drop("__tk", *[f"__t{i}" for i in range(len(by))])
    summed = running(marked, by, order, {"__before": ("sum", F.when(F.col("__in"), F.col("__n")).otherwise(0))}, others=True)
    chosen = summed.where(F.col("__in") & (F.col("__before") < F.col("goal"))).select(*by, "goal", F.col("__k").alias("key"))
    least = rows.where("goal <= 0").groupBy(*by).agg(F.max("goal").alias("goal"), F.min(F.struct("__n", "__h", "__k"))["__k"].alias("key"))
    return chosen.unionByName(least)


def internal_split(sentences: DataFrame, language: str, seed: int, key: str = "key", fraction: float = 0.10, forbidden: tuple[str, ...] = ("brat_2018",)) -> DataFrame:
    """Adds ``split`` to the sentences of one treebank by whole groups.

    ``myv``: a dev set, never from the forbidden groups. ``yrk``: a test set, then a dev set
    (next seed) from the rest. Another language is an error.
    """
    sizes = sentences.groupBy(key).agg(F.count("*").alias("n")).withColumnRenamed(key, "key")
    total = sentences.count()
    goal = F.bround(F.lit(total * fraction))

    def pick(of: DataFrame, s: int) -> DataFrame:
        return greedy_groups(of.withColumn("one", F.lit(1)), ["one"], goal, s).select("key")

    if language == "myv":
        dev = pick(sizes.where(~F.col("key").isin(list(forbidden))), seed).withColumn("split", F.lit("dev"))
        chosen = dev
    elif language == "yrk":
        test = pick(sizes, seed)
        dev = pick(sizes.join(test, "key", "left_anti"), seed + 1)
        chosen = test.withColumn("split", F.lit("test")).unionByName(dev.withColumn("split", F.lit("dev")))
    else:
        raise ValueError(f"no internal split for {language}")
    renamed = chosen.withColumnRenamed("key", "__k")
    return sentences.join(renamed, F.col(key) == F.col("__k"), "left").withColumn("split", F.coalesce("split", F.lit("train"))).drop("__k")


def split_leaks(rows: DataFrame, key: str, split: str = "split") -> DataFrame:
    """Keys that stand in more than one split."""
    return rows.groupBy(key).agg(F.countDistinct(split).alias("n_splits")).where("n_splits > 1")
