"""The annotation cycle: checks between drafts and corrections, consensus of analyzers,
translations, spacing and predictions. Checks return the rows that violate them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import treebank as TB
from . import treebank as S
from .running import numbered


def key_differences(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, n_left, n_right)`` of the keys whose numbers of rows differ between two tables."""
    a = left.groupBy(*keys).agg(F.count("*").alias("n_left"))
    b = right.groupBy(*keys).agg(F.count("*").alias("n_right"))
    return a.join(b, keys, "full").select(*keys, F.coalesce("n_left", F.lit(0)).alias("n_left"), F.coalesce("n_right", F.lit(0)).alias("n_right")).where("n_left <> n_right")


def pair_violations(original: DataFrame, draft: DataFrame, key: str = "sent_id") -> DataFrame:
    """``(key, problem)`` for a one-to-one pairing with equal article and forms."""
    repeated = original.groupBy(key).count().where("count > 1").select(key, F.lit("repeated_original").alias("problem"))
    repeated = repeated.unionByName(draft.groupBy(key).count().where("count > 1").select(key, F.lit("repeated_draft").alias("problem")))
    j = original.select(key, F.col("article").alias("a1"), F.col("forms").alias("f1"), F.lit(1).alias("x")).join(
        draft.select(key, F.col("article").alias("a2"), F.col("forms").alias("f2"), F.lit(1).alias("y")), key, "full"
    )
    problem = (
        F.when(F.col("x").isNull(), "missing_original").when(F.col("y").isNull(), "missing_draft")
        .when(~F.col("a1").eqNullSafe(F.col("a2")), "article").when(~F.col("f1").eqNullSafe(F.col("f2")), "forms")
    )
    return repeated.unionByName(j.select(key, problem.alias("problem")).where("problem is not null"))


def gold_violations(sentences: DataFrame, splits: DataFrame, language: str, expected: int) -> DataFrame:
    """``(sent_id, problem)`` for a gold file: count, status, source, test split, one sentence an article, trees."""
    m = sentences.select(S.metadata(F.col("lines")).alias("m"), S.words(F.col("lines")).alias("w"))
    rows = m.select(F.col("m")["sent_id"].alias("sent_id"), F.col("m")["source_id"].alias("source_id"), F.col("m")["annotation_status"].alias("status"), "w")
    tests = splits.where("split = 'test'").select("source_id", F.lit(True).alias("t")).distinct()
    rows = rows.join(tests, "source_id", "left")
    problems = F.filter(
        F.concat(
            F.array(
                F.when(~F.col("status").eqNullSafe(F.lit("GOLD_ADJUDICATED")), F.lit("status")),
                F.when(~F.coalesce(F.col("source_id").startswith(language + ":"), F.lit(False)), F.lit("source")),
                F.when(F.col("t").isNull(), F.lit("split")),
            ),
            F.transform(S.tree_violations(F.col("w")), lambda x: F.concat(F.lit("tree:"), x)),
        ),
        lambda x: x.isNotNull(),
    )
    out = rows.select("sent_id", F.explode(problems).alias("problem"))
    twice = rows.groupBy("source_id").agg(F.count("*").alias("n"), F.min("sent_id").alias("sent_id")).where("n > 1").select("sent_id", F.lit("article_twice").alias("problem"))
    number = rows.agg(F.count("*").alias("n")).where(F.col("n") != expected).select(F.lit(None).cast("string").alias("sent_id"), F.lit("count").alias("problem"))
    return out.unionByName(twice).unionByName(number)


def correction_violations(draft: DataFrame, corrected: DataFrame, splits: DataFrame) -> DataFrame:
    """``(sent_id, problem)`` of a corrected batch against its draft.

    Both are ``(sent_id, source_id, source_sent_id, text, status, words)``. Ids and number of rows
    must agree, source identity and text be unchanged, the status be adjudicated, the article in
    the train split, every lexical form have a settled lemma, every word a part of speech and
    valid features.
    """
    keys = key_differences(draft, corrected, ["sent_id"]).select("sent_id", F.when(F.col("n_left") == 0, "unknown").when(F.col("n_right") == 0, "missing").otherwise("repeated").alias("problem"))
    d = draft.select("sent_id", F.col("source_id").alias("s0"), F.col("source_sent_id").alias("ss0"), F.col("text").alias("t0"))
    open_lemma = F.exists("words", lambda w: (w["upos"] == "_") | (((w["lemma"] == "_") | w["lemma"].contains("?")) & T.lexical(w["form"])))
    bad_feats = F.exists("words", lambda w: ~TB.feats_valid(w["feats"]))
    # words are looked at before the join, so that they stay where they are
    c = corrected.select("sent_id", "source_id", "source_sent_id", "text", "status", open_lemma.alias("open_lemma"), bad_feats.alias("bad_feats"))
    j = c.join(d, "sent_id").join(splits.where("split = 'train'").select("source_id", F.lit(True).alias("train")).distinct(), "source_id", "left")
    checks = [
        (~F.col("source_id").eqNullSafe(F.col("s0")) | ~F.col("source_sent_id").eqNullSafe(F.col("ss0")), "source_identity"),
        (~F.col("text").eqNullSafe(F.col("t0")), "text_changed"), (F.coalesce(F.col("text"), F.lit("")) == "", "text_missing"),
        (~F.col("status").eqNullSafe(F.lit("GOLD_ADJUDICATED")), "status"), (F.col("train").isNull(), "split"), (F.col("open_lemma"), "unresolved"), (F.col("bad_feats"), "features"),
    ]
    found = F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for c, n in checks]), lambda x: x.isNotNull())
    return keys.unionByName(j.select("sent_id", F.explode(found).alias("problem")))


def repeated_sources(batches: DataFrame) -> DataFrame:
    """Pairs of source and source sentence that more than one corrected row has."""
    return batches.groupBy("source_id", "source_sent_id").agg(F.count("*").alias("n")).where("n > 1")


def retained_rows(rows: DataFrame, reviewed: DataFrame, key: str = "sent_id", id_col: str = "row_id") -> DataFrame:
    """``(id, kept)``: of each row the id of the first reviewed row with its key, if that has its text unchanged."""
    first = reviewed.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(id_col, "text")).alias("r"))
    return rows.join(first, key, "left").select(id_col, F.when(F.col("r.text") == F.col("text"), F.col(f"r.{id_col}")).alias("kept"))


def consensus(first: Column, second: Column) -> Column:
    """Struct ``lemma, status`` from two analyzers' lemmas (nulls and empty ones don't count)."""
    clean = lambda x: F.array_distinct(F.filter(x, lambda v: v.isNotNull() & (v != "")))
    a, b = clean(first), clean(second)
    common = F.array_intersect(a, b)
    status = (
        F.when(F.size(common) == 1, "consensus").when((F.size(a) == 0) | (F.size(b) == 0), "unanalyzed")
        .when(F.size(common) > 1, "ambiguous_common").otherwise("disjoint")
    )
    return F.struct(F.when(F.size(common) == 1, F.element_at(common, 1)).alias("lemma"), status.alias("status"))


def review_tokens(tokens: DataFrame) -> DataFrame:
    """Review of ``(…, form, lemma, misc, first, second)``: adds ``consensus_lemma``, ``status``,
    ``review_lemma`` (marked where open or different), ``copy_lemma`` and ``copy_misc`` of the
    analyzers' copy."""
    c = F.when(T.lexical("form"), consensus(F.col("first"), F.col("second"))).otherwise(F.struct(F.lit(None).cast("string").alias("lemma"), F.lit("nonlexical_exempt").alias("status")))
    t = tokens.withColumn("__c", c)
    lemma = F.col("__c")["lemma"]
    review = (
        F.when(~T.lexical("form"), F.col("lemma")).when(lemma.isNull(), F.concat("lemma", F.lit("?")))
        .when(lemma != F.col("lemma"), F.concat("lemma", F.lit("?"), lemma)).otherwise(F.col("lemma"))
    )
    parts = F.filter(F.split("misc", r"\|"), lambda x: x != "_")
    parts = F.when(lemma.isNotNull(), F.concat(parts, F.array(F.lit("LemmaSource=FST")))).otherwise(parts)
    return (
        t.withColumn("consensus_lemma", lemma).withColumn("status", F.col("__c")["status"]).withColumn("review_lemma", review)
        .withColumn("copy_lemma", F.coalesce(lemma, F.lit("_"))).withColumn("copy_misc", F.when(F.size(parts) == 0, "_").otherwise(F.array_join(parts, "|"))).drop("__c")
    )


def alignment_violations(tokens: DataFrame, analyses: DataFrame) -> DataFrame:
    """Words that a sentence and its analysis don't share: ``(sent_id, id, problem)``."""
    j = tokens.select("sent_id", "id", F.col("form").alias("f1")).join(analyses.select("sent_id", "id", F.col("form").alias("f2")), ["sent_id", "id"], "full")
    problem = F.when(F.col("f1").isNull(), "extra_analysis").when(F.col("f2").isNull(), "no_analysis").when(F.col("f1") != F.col("f2"), "form")
    return j.select("sent_id", "id", problem.alias("problem")).where("problem is not null")


def coverage(analyses: DataFrame) -> DataFrame:
    """Tokens, analyzed tokens and candidates; ``analyses`` is an array column."""
    return analyses.agg(F.count("*").alias("tokens"), F.count_if(F.size("analyses") > 0).alias("analyzed"), F.coalesce(F.sum(F.greatest(F.size("analyses"), F.lit(0))), F.lit(0)).alias("candidates"))


def lookup_analyses(rows: DataFrame) -> DataFrame:
    """``(form, analyses)`` from lookup output ``(form, analysis)``: unknowns (ending in ``?``) and blanks
    dropped, distinct, sorted; each analysis with its lemma, the text before the first plus sign."""
    ok = F.col("analysis").isNotNull() & (F.trim("analysis") != "") & ~F.col("analysis").endswith("?")
    got = rows.groupBy("form").agg(F.sort_array(F.collect_set(F.when(ok, F.col("analysis")))).alias("a"))
    return got.select("form", F.transform("a", lambda x: F.struct(F.substring_index(x, "+", 1).alias("lemma"), x.alias("analysis"))).alias("analyses"))


def publication_violations(model: DataFrame, analyzers: DataFrame) -> DataFrame:
    """``(file, sent_id, problem)`` of the two files of one language that are to be published.

    Both are ``(pos, lines)``. Ids must be there, distinct, and the same in the same order; every
    sentence needs a translation and a sound tree (the analyzers' copy only sound ids), and both
    files the same forms, texts and sources.
    """
    keys = ["text", "text_en", "source_id", "source_sent_id"]

    def read(df: DataFrame) -> DataFrame:
        m, w = S.metadata(F.col("lines")), S.words(F.col("lines"))
        facts = [F.try_element_at("m", F.lit(k)).alias(k) for k in ("sent_id", *keys)]
        return df.select("pos", m.alias("m"), w.alias("w")).select("pos", *facts, "w", F.transform("w", lambda x: F.struct(x["id"].alias("id"), x["form"].alias("form"))).alias("forms"))

    def alone(t: DataFrame, name: str, gold: bool) -> DataFrame:
        row = lambda d, problem: d.select(F.lit(name).alias("file"), "sent_id", problem.alias("problem"))
        checks = F.array(F.when(F.col("sent_id").isNull(), "no_id"), F.when(F.coalesce("text_en", F.lit("")) == "", "no_translation"))
        trees = F.transform(S.tree_violations(F.col("w"), gold), lambda x: F.concat(F.lit("tree:"), x))
        found = row(t.withColumn("p", F.explode(F.filter(F.concat(checks, trees), lambda x: x.isNotNull()))), F.col("p"))
        twice = t.groupBy("sent_id").agg(F.count("*").alias("n")).where("n > 1 and sent_id is not null")
        empty = t.agg(F.count("*").alias("n")).where("n = 0").select(F.lit(None).cast("string").alias("sent_id"))
        return found.unionByName(row(twice, F.lit("repeated_id"))).unionByName(row(empty, F.lit("empty_file")))

    a, b = read(model), read(analyzers)
    rank = lambda t: numbered(t, ["pos"], "at").select("at", F.struct("sent_id", "forms", *keys).alias("f"))
    both = rank(a).withColumnRenamed("f", "x").join(rank(b).withColumnRenamed("f", "y"), "at", "full").where(~F.col("x").eqNullSafe(F.col("y")))
    differ = both.select(F.lit("both").alias("file"), F.coalesce("x.sent_id", "y.sent_id").alias("sent_id"), F.lit("files_differ").alias("problem"))
    return alone(a, "model", True).unionByName(alone(b, "analyzers", False)).unionByName(differ)


# ---- rewriting sentences ----------------------------------------------------------------


def _rewrite(lines: Column, spaced: Column) -> Column:
    """Token lines with ``SpaceAfter=No`` set exactly where the next word follows without space."""
    heads = F.filter(lines, lambda x: x.startswith("#"))
    body = F.filter(lines, lambda x: ~x.startswith("#"))

    def one(x, i):
        c = F.split(x, "\t")
        misc = F.filter(F.split(c[9], r"\|"), lambda v: (v != "_") & (v != "SpaceAfter=No") & (v != ""))
        misc = F.when(F.get(spaced, i), F.concat(misc, F.array(F.lit("SpaceAfter=No")))).otherwise(misc)
        return F.array_join(F.concat(F.slice(c, 1, 9), F.array(F.when(F.size(misc) == 0, "_").otherwise(F.array_join(misc, "|")))), "\t")

    return F.concat(heads, F.transform(body, one))


def enrich(sentences: DataFrame) -> DataFrame:
    """Adds ``enriched`` and ``problem`` to ``(lines, text, text_en)``: text comments after the
    sentence id, and spacing. Only one problem is named; then ``enriched`` is null."""
    meta, w = S.metadata(F.col("lines")), S.words(F.col("lines"))
    s = sentences.withColumn("__m", meta).withColumn("__w", w).withColumn("__s", TB.spaces_after(F.transform("__w", lambda x: x["form"]), F.col("text")))
    problem = (
        F.when(F.coalesce(F.col("text_en"), F.lit("")).rlike(r"[\r\n]") | (F.coalesce(F.col("text_en"), F.lit("")) == ""), "translation")
        .when(F.array_contains(F.map_keys("__m"), "text") | F.array_contains(F.map_keys("__m"), "text_en"), "has_text")
        .when(F.col("__s").isNull(), "spacing")
        .when(F.size("__w") != F.size(F.filter("lines", lambda x: ~x.startswith("#"))), "rows")
    )
    done = F.flatten(
        F.transform(
            _rewrite(F.col("lines"), F.col("__s")),
            lambda x: F.when(x.startswith("# sent_id = "), F.array(x, F.concat(F.lit("# text = "), F.col("text")), F.concat(F.lit("# text_en = "), F.col("text_en")))).otherwise(F.array(x)),
        )
    )
    return s.withColumn("problem", problem).withColumn("enriched", F.when(problem.isNull(), done)).drop("__m", "__w", "__s")


def add_translation(sentences: DataFrame) -> DataFrame:
    """Adds ``translated`` and ``problem`` to ``(lines, text_en)``: the translation after ``# text``."""
    has = F.exists("lines", lambda x: x.startswith("# text_en = "))
    english = F.coalesce(F.col("text_en"), F.lit(""))
    problem = F.when((F.trim(english) == "") | english.rlike(r"[\r\n]"), "translation").when(has, "has_translation").when(~F.exists("lines", lambda x: x.startswith("# text = ")), "no_text")
    out = F.flatten(F.transform("lines", lambda x: F.when(x.startswith("# text = "), F.array(x, F.concat(F.lit("# text_en = "), F.col("text_en")))).otherwise(F.array(x))))
    return sentences.withColumn("problem", problem).withColumn("translated", F.when(problem.isNull(), out))


def form_only(lines: Column) -> Column:
    """The sentence without annotation: columns 3 to 9 blank, spacing kept, status comments gone."""
    kept = F.filter(lines, lambda x: ~x.startswith("# annotation_status = ") & ~x.startswith("# lemma_source = "))

    def one(x):
        c = F.split(x, "\t")
        spacing = F.when(F.array_contains(F.split(c[9], r"\|"), "SpaceAfter=No"), "SpaceAfter=No").otherwise("_")
        blank = F.concat(F.slice(c, 1, 2), F.array_repeat(F.lit("_"), 7), F.array(spacing))
        return F.when(x.startswith("#"), x).otherwise(F.array_join(blank, "\t"))

    return F.transform(kept, one)


def write_predictions(lines: Column, predictions: Column) -> Column:
    """The sentence with predicted lemma, part of speech, features, head and relation.

    ``predictions`` is an array of structs in word order. Other columns are blanked, of the last
    only ``SpaceAfter=No`` stays; rows that are no words lose columns 3 to 9. Null where the
    number of predictions isn't that of the words.
    """
    heads = F.filter(lines, lambda x: x.startswith("#"))
    rows = F.filter(lines, lambda x: ~x.startswith("#"))
    is_word = lambda x: F.substring_index(x, "\t", 1).rlike("^[0-9]+$")

    def rewrite(body: Column) -> Column:
        def one(x, i):
            c = F.split(x, "\t")
            p = F.get(predictions, F.size(F.filter(F.slice(body, 1, i), is_word)))  # words before this row
            spacing = F.when(F.array_contains(F.split(c[9], r"\|"), "SpaceAfter=No"), "SpaceAfter=No").otherwise("_")
            word = F.array(c[0], c[1], p["lemma"], p["upos"], F.lit("_"), p["feats"], p["head"].cast("string"), p["deprel"], F.lit("_"), spacing)
            other = F.concat(F.slice(c, 1, 2), F.array_repeat(F.lit("_"), 7), F.array(spacing))
            return F.array_join(F.when(is_word(x), word).otherwise(other), "\t")

        return F.transform(body, one)

    return F.when(F.size(F.filter(rows, is_word)) == F.size(predictions), F.concat(heads, T.bound(rows, rewrite)))


#: Stands for a character that a match covers; no character of any text.
_GONE = "\uffff"


def strip_boilerplate(lines: Column, pattern: str) -> Column:
    """Struct ``lines, changed, problem``: matches of the pattern cut from the text and from the tokens.

    In a copy of the text every covered character is blotted out; each token, found in the text
    behind the one before, keeps what isn't blotted out at its place and goes if nothing is left.
    The rest is numbered anew, columns 3 to 9 are blanked (not the last), the translation is dropped.

    Defined results: a sentence without a match, or without text, stays as it is. ``lines`` is null where
    no letter or digit remains, and where ``problem`` says why the sentence can't be cut: a row
    that is no word (a range, an empty node), a form that isn't in the text, or no token left.
    The pattern must not match the empty text.
    """
    prefix = "# text = "
    text = F.substring(F.get(F.filter(lines, lambda x: x.startswith(prefix)), F.lit(0)), len(prefix) + 1, 1 << 30)
    parts = F.split(text, pattern, -1)
    blots = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.repeat(F.lit(_GONE), F.length(m)))
    blotted = F.array_join(F.zip_with(parts, F.concat(blots, F.array(F.lit(""))), lambda p, b: F.concat(p, b)), "")
    rest = T.strip(F.regexp_replace(text, pattern, ""))
    rows = F.transform(F.filter(lines, lambda x: ~x.startswith("#")), lambda x: F.split(x, "\t"))
    heads = F.filter(lines, lambda x: x.startswith("#") & ~x.startswith("# text_en = "))
    none = F.array().cast("array<string>")
    blank = "\t".join(["_"] * 7)

    def cut(v: Column) -> Column:
        start = F.struct(F.lit(1).alias("at"), F.lit(True).alias("found"), none.alias("kept"))

        def step(acc, c):
            at = F.call_function("locate", c[1], v["text"], acc["at"])
            left = F.replace(F.call_function("substring", v["blotted"], at, F.length(c[1])), F.lit(_GONE), F.lit(""))
            row = F.concat_ws("\t", (F.size(acc["kept"]) + 1).cast("string"), left, F.lit(blank), c[9])
            return F.struct((at + F.length(c[1])).alias("at"), (acc["found"] & (at > 0)).alias("found"), F.when(left == "", acc["kept"]).otherwise(F.concat(acc["kept"], F.array(row))).alias("kept"))

        def judged(done: Column) -> Column:
            problem = (
                F.when(F.exists(v["rows"], lambda c: ~c[0].rlike("^[0-9]+$")), "no_simple_words")
                .when(~done["found"], "absent_form").when(F.size(done["kept"]) == 0, "no_token_left")
            )
            new = F.concat(F.transform(v["heads"], lambda x: F.when(x.startswith(prefix), F.concat(F.lit(prefix), v["rest"])).otherwise(x)), done["kept"])
            empty = ~v["rest"].rlike(r"[\p{L}\p{N}]")
            return (
                F.when(~v["matched"], F.struct(v["lines"].alias("lines"), F.lit(False).alias("changed"), F.lit(None).cast("string").alias("problem")))
                .when(empty, F.struct(F.lit(None).cast("array<string>").alias("lines"), F.lit(True).alias("changed"), F.lit(None).cast("string").alias("problem")))
                .otherwise(F.struct(F.when(problem.isNull(), new).alias("lines"), F.lit(True).alias("changed"), problem.alias("problem")))
            )

        return T.bound(F.aggregate(F.when(v["matched"], v["rows"]).otherwise(F.array().cast("array<array<string>>")), start, step), judged)

    known = F.struct(
        lines.alias("lines"), text.alias("text"), blotted.alias("blotted"), rest.alias("rest"), rows.alias("rows"), heads.alias("heads"), F.coalesce(text.rlike(pattern), F.lit(False)).alias("matched")
    )
    return T.bound(known, cut)
