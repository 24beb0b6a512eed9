"""Composite operators: whole steps of corpus and treebank preparation and of the review cycle.

Each returns tables and, beside them, the violations that make the step invalid; nothing is
written. ``require_clean`` turns violations into an error at the edge of a pipeline.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.hashing import article_id, fingerprint_list
from ..session import cut
from . import annotation as A
from . import blocks as B
from . import corpus, scoring, selection
from . import treebank as S


def require_clean(violations: DataFrame, what: str, show: int = 5) -> None:
    """Raise with the first few rows if a violation table holds any."""
    rows = violations.limit(show).collect()
    if rows:
        raise ValueError(f"{what}: " + "; ".join(str(r.asDict()) for r in rows))


def prepare_corpus(
    records: DataFrame, exclusions: DataFrame | None, targets: list[str], seed: int = 42, validation: float = 0.05, test: float = 0.05, width: int = 12
) -> dict[str, DataFrame]:
    """Grouping, merge, ranked splits, overlap removal, representation.

    Keys: ``documents``, ``splits`` (source ids with their split, taken before overlap removal),
    ``audit``, ``counts``, ``violations`` (languages without enough groups, splits left empty).
    """
    roots = corpus.duplicate_groups(records)
    groups = corpus.ranked_splits(corpus.merge_groups(records, roots).where(T.strip("text") != ""), seed, validation, test, targets)
    kept, audit = corpus.remove_overlap(groups, exclusions, width)
    kept = corpus.stamp_representation(kept)
    counts = corpus.counts(kept, ["language", "split"])
    want = groups.where(F.col("language").isin(targets)).select("language", "split").distinct()
    empty = want.join(counts.where("documents > 0").select("language", "split"), ["language", "split"], "left_anti").select("language", F.concat(F.lit("empty split "), "split").alias("problem"))
    few = corpus.split_violations(groups, targets).select("language", F.lit("too few groups").alias("problem"))
    return {"documents": kept, "splits": groups.select("source_ids", "language", "split"), "audit": audit, "counts": counts, "violations": empty.unionByName(few)}


def prepare_treebank(sentences: DataFrame, language: str, seed: int = 42, parallel_key: Column | None = None) -> dict[str, DataFrame]:
    """Internal split of a treebank without one: ``sentences`` with ``split`` and rendered text,
    and the violations (sentences without a group, trees, parallel texts across splits)."""
    m = S.metadata(F.col("lines"))
    get = lambda k: F.try_element_at(m, F.lit(k))
    keyed = sentences.withColumn("key", S.recording_key(get("sent_id"), F.lit(language), get("doc_title"), get("sound_url")))
    split = S.internal_split(keyed.where("key <> ''"), language, seed)
    name = get("sent_id").alias("sent_id")
    bad = keyed.where("key is null or key = ''").select(name, F.lit("no group").alias("problem"))
    trees = sentences.select(name, F.explode(S.tree_violations(S.words(F.col("lines")))).alias("problem"))
    out = bad.unionByName(trees)
    if parallel_key is not None:
        leaks = S.split_leaks(split.withColumn("p", parallel_key).where("p is not null"), "p")
        out = out.unionByName(leaks.select(F.col("p").alias("sent_id"), F.lit("parallel text in several splits").alias("problem")))
    return {"sentences": split.withColumn("rendered", S.render(F.col("lines"))), "violations": out}


def prepare_targets(batches: list[tuple[DataFrame, DataFrame]], splits: DataFrame, language: str, seed: int = 42, dev_cap: int = 500) -> dict[str, DataFrame]:
    """Cumulative corrected data over (draft, corrected) rounds: rows with their split, and violations.

    Articles of several rows may take the development set past its cap, which is reported apart (``over_cap``).
    """
    bad = None
    for draft, corrected in batches:
        v = A.correction_violations(draft, corrected, splits)
        bad = v if bad is None else bad.unionByName(v)
    every = None
    for _, corrected in batches:
        every = corrected.select("source_id", "source_sent_id") if every is None else every.unionByName(corrected.select("source_id", "source_sent_id"))
    twice = A.repeated_sources(every).select(F.concat_ws(" ", "source_id", "source_sent_id").alias("sent_id"), F.lit("repeated_source").alias("problem"))
    rows = selection.assign_dev_batches([c for _, c in batches], language, seed, dev_cap)
    return {"rows": rows, "violations": bad.unionByName(twice), "over_cap": selection.over_cap(rows, dev_cap)}


def select_form_only(sentences: DataFrame, language: str, splits: DataFrame, count: int, seed: int, low: int, high: int) -> DataFrame:
    """The historical selection: one usable sentence of each training article, without text and spacing."""
    n = F.size("forms")
    shaped = n.between(low, high) & (F.col("ids") == F.sequence(F.lit(1), F.greatest(n, F.lit(1)))) & ~F.exists("forms", lambda f: f.isNull() | (f == "") | (f == "_")) & T.usable_forms(F.col("forms"))
    rows = sentences.where((F.col("article") != "") & (F.col("sent_id") != "") & shaped).withColumn("source_id", article_id(language, F.col("article")))
    rows = rows.join(splits.where("split = 'train'").select("source_id").distinct(), "source_id", "left_semi")
    best = selection.best_of_group(rows, ["source_id"], fingerprint_list(seed, F.col("source_id"), F.col("sent_id"), F.col("forms")), ["sent_id", "forms"])
    return selection.top_by_hash(best, fingerprint_list(seed, F.col("source_id")), count, ["source_id"]).select("source_id", F.col("sent_id").alias("source_sent_id"), "forms", F.lit("FORM_ONLY").alias("annotation_status"))


def predicted_batch(selected: DataFrame, predictions: DataFrame, used_ids: DataFrame) -> dict[str, DataFrame]:
    """Selected sentences with their predictions as tree lines, the texts to translate, and violations.

    ``predictions`` is ``(sent_id, p)`` with one struct a word; reused sentence ids, sentences
    without predictions and differing word counts are reported.
    """
    j = selected.join(predictions, "sent_id", "left")
    row = lambda f, i: F.concat_ws("\t", (i + 1).cast("string"), f, *[F.lit("_")] * 7, F.when(F.get("adjacent", i), "SpaceAfter=No").otherwise("_"))
    comment = lambda k, c: F.concat(F.lit(f"# {k} = "), c)
    head = F.array(comment("sent_id", F.col("sent_id")), comment("text", F.col("text")), comment("source_id", F.col("source_id")), comment("source_sent_id", F.col("source_sent_id")), F.lit("# annotation_status = PARSER_DRAFT"))
    lines = F.concat(head, F.transform("forms", row))
    out = j.withColumn("lines", A.write_predictions(lines, F.col("p")))
    reused = selected.join(used_ids.select("sent_id").distinct(), "sent_id", "left_semi").select("sent_id", F.lit("reused id").alias("problem"))
    missing = out.where("lines is null").select("sent_id", F.lit("predictions").alias("problem"))
    return {"sentences": out.where("lines is not null").select("sent_id", "source_id", "lines"), "requests": out.select("sent_id", "text"), "violations": reused.unionByName(missing)}


def refill_batch(retained: DataFrame, original: DataFrame, candidates: DataFrame, history: DataFrame, language: str, count: int, seed: int) -> dict[str, DataFrame]:
    """A cleaned batch filled up again to ``count``.

    Additions come from articles that the batch doesn't hold and pairs that history doesn't; ids
    of retained rows whose text is unchanged are ``preserved``.
    """
    free = candidates.join(history, [candidates["source_id"] == history["source_id"], candidates["sent_id"] == history["source_sent_id"]], "left_anti")
    free = free.join(retained.select("source_id").distinct(), "source_id", "left_anti")
    need = count - retained.count()
    if need < 0:
        raise ValueError("the retained batch exceeds the wanted count")
    added = selection.select_batch(free, language, "refresh", need, seed)
    preserved = retained.join(original.select("sent_id", F.col("text").alias("was")), "sent_id", "left").where(F.col("text").eqNullSafe(F.col("was"))).select("sent_id")
    texts = retained.select("text").unionByName(added.select("text")).groupBy("text").count().where("count > 1").select(F.col("text").alias("sent_id"), F.lit("duplicate text").alias("problem"))
    return {"additions": added, "preserved": preserved, "violations": texts}


def assembled_batch(model: DataFrame, analyzers: DataFrame, originals: DataFrame, preserved: DataFrame, translations: DataFrame, requests: DataFrame, count: int) -> dict[str, DataFrame]:
    """Review rows with preserved originals and translations merged in, and what is wrong with them.

    All sentence tables are ``(sent_id, lines)``. Trees of preserved rows are tolerated and
    reported apart (``tree_issues``); any other problem is a violation.
    """
    keep = originals.join(preserved.select("sent_id"), "sent_id", "left_semi").select("sent_id", F.col("lines").alias("old"))
    rows = model.join(keep, "sent_id", "left").join(translations, "sent_id", "left")
    merged = A.add_translation(rows.withColumn("text_en", F.coalesce("text_en", F.lit(""))))
    lines = F.when(F.col("old").isNotNull(), F.col("old")).otherwise(F.coalesce("translated", "lines"))
    read = lambda df: cut(df.withColumn("m", S.metadata(F.col("lines"))).withColumn("w", S.words(F.col("lines"))))  # noqa: E731  # every check below reads them
    out, copy = read(merged.select("sent_id", lines.alias("lines"), F.col("old").isNotNull().alias("preserved"))), read(analyzers.select("sent_id", "lines"))
    issues = out.select("sent_id", "preserved", F.explode(S.tree_violations(F.col("w"))).alias("problem"))
    facts = lambda df: df.select("sent_id", *[F.try_element_at("m", F.lit(k)).alias(k) for k in ("text", "source_id", "source_sent_id")], F.transform("w", lambda w: w["form"]).alias("forms"))
    a, b = facts(out), facts(copy)
    differ = a.join(b.select("sent_id", *[F.col(c).alias(f"b_{c}") for c in b.columns[1:]]), "sent_id", "full").where(
        " or ".join(f"not ({c} <=> b_{c})" for c in ("text", "source_id", "source_sent_id", "forms"))
    )
    v = [
        A.key_differences(translations, requests, ["sent_id"]).select("sent_id", F.lit("translation ids").alias("problem")),
        issues.where("not preserved").select("sent_id", "problem"),
        differ.select("sent_id", F.lit("differs from the analyzers' copy").alias("problem")),
        out.where(F.try_element_at("m", F.lit("text_en")).isNull()).select("sent_id", F.lit("no translation").alias("problem")),
        a.groupBy("text").agg(F.count("*").alias("n"), F.min("sent_id").alias("sent_id")).where("n > 1").select("sent_id", F.lit("duplicate text").alias("problem")),
        out.agg(F.count("*").alias("n")).where(F.col("n") != count).select(F.lit(None).cast("string").alias("sent_id"), F.lit("count").alias("problem")),
    ]
    bad = v[0]
    for x in v[1:]:
        bad = bad.unionByName(x)
    return {"sentences": out.select("sent_id", "lines"), "tree_issues": issues.where("preserved").select("sent_id", "problem"), "violations": bad}


def merge_translations(sentences: DataFrame, translations: DataFrame) -> dict[str, DataFrame]:
    """Drafts with their translations; ids must be the same on both sides."""
    ids = A.key_differences(sentences, translations, ["sent_id"]).select("sent_id", F.when(F.col("n_right") == 0, "missing").otherwise("extra").alias("problem"))
    done = A.add_translation(sentences.join(translations, "sent_id"))
    return {"sentences": done.where("problem is null").select("sent_id", F.col("translated").alias("lines")), "violations": ids.unionByName(done.where("problem is not null").select("sent_id", "problem"))}


def enriched_drafts(originals: DataFrame, drafts: DataFrame, translations: DataFrame) -> dict[str, DataFrame]:
    """Drafts with the original text, spacing and translation; pairing problems are violations."""
    bad = A.pair_violations(originals.select("sent_id", "article", "forms"), drafts.select("sent_id", "article", "forms"))
    j = drafts.select("sent_id", "lines").join(originals.select("sent_id", "text"), "sent_id").join(translations, "sent_id", "left")
    e = A.enrich(j)
    ids = A.key_differences(drafts, translations, ["sent_id"]).select("sent_id", F.lit("translation ids").alias("problem"))
    return {"sentences": e.where("problem is null").select("sent_id", F.col("enriched").alias("lines")), "violations": bad.unionByName(ids).unionByName(e.where("problem is not null").select("sent_id", "problem"))}


def review_drafts(tokens: DataFrame, analyses: DataFrame) -> dict[str, DataFrame]:
    """Drafts reviewed against two analyzers.

    ``tokens`` is ``(sent_id, id, form, lemma, misc)``, ``analyses`` ``(sent_id, id, form, first,
    second)`` with the lemmas that each analyzer offers. Words that don't pair are violations.
    """
    bad = A.alignment_violations(tokens, analyses)
    rows = A.review_tokens(tokens.join(analyses.drop("form"), ["sent_id", "id"]))
    summary = rows.groupBy("status").agg(F.count("*").alias("n"))
    return {"tokens": rows, "summary": summary, "violations": bad}


def analyzed_sentences(sentences: DataFrame, lookup: DataFrame) -> dict[str, DataFrame]:
    """Sentences with an analyzer's analyses of every word, by its output for the distinct forms.

    ``sentences`` is ``(sent_id, source_id, source_sent_id, words)``, ``lookup`` ``(form, analysis)``.
    Returns the sentences with ``tokens``, an array of ``id, form, analyses``; the ``forms`` that the
    analyzer is to be asked for; the ``coverage``; and as violations the forms it wasn't asked.
    """
    each = sentences.select("sent_id", F.explode("words").alias("w")).select("sent_id", "w.id", "w.form")
    found = A.lookup_analyses(lookup)
    rows = each.join(found.withColumn("asked", F.lit(True)), "form", "left")
    known = rows.withColumn("analyses", F.coalesce("analyses", F.array().cast(found.schema["analyses"].dataType)))
    tokens = known.groupBy("sent_id").agg(F.sort_array(F.collect_list(F.struct("id", "form", "analyses"))).alias("tokens"))  # a sentence's words
    empty = F.array().cast(tokens.schema["tokens"].dataType)
    out = sentences.select("sent_id", "source_id", "source_sent_id").join(tokens, "sent_id", "left").withColumn("tokens", F.coalesce("tokens", empty))
    missing = rows.where("asked is null").select("form").distinct().select("form", F.lit("no lookup").alias("problem"))
    return {"sentences": out, "forms": each.select("form").distinct(), "coverage": A.coverage(known), "violations": missing}


def word_analyses(tokens: DataFrame, candidates: DataFrame) -> dict[str, DataFrame]:
    """Words with a second analyzer's candidates in canonical order.

    ``tokens`` is ``(sent_id, id, form)``, ``candidates`` ``(sent_id, id, wf, lemma, gramm)``, a row for
    each candidate. A single candidate with neither lemma nor grammar is none; one of another form
    is a violation.
    """
    real = candidates.where((F.coalesce("lemma", F.lit("")) != "") | (F.coalesce("gramm", F.lit("")) != ""))
    listed = real.groupBy("sent_id", "id").agg(F.sort_array(F.collect_list(F.to_json(F.struct("gramm", "lemma", "wf")))).alias("analyses"))  # a word's candidates
    rows = tokens.join(listed, ["sent_id", "id"], "left").withColumn("analyses", F.coalesce("analyses", F.array().cast("array<string>")))
    other = tokens.join(real.select("sent_id", "id", "wf"), ["sent_id", "id"]).where(~F.col("wf").eqNullSafe(F.col("form"))).select("sent_id", "id", F.lit("form").alias("problem"))
    return {"tokens": rows, "coverage": A.coverage(rows), "violations": other}


def evaluate_parser(gold: DataFrame, system: DataFrame, repeats: int = 1000, seed: int = 1729) -> dict[str, DataFrame]:
    """Metrics, article counts and intervals of one language's predictions over gold tokenization."""
    pairs = gold.select("doc", "sent", "id", "source_id", F.col("head").alias("g_head"), F.col("deprel").alias("g_deprel")).join(
        system.select("doc", "sent", "id", F.col("head").alias("s_head"), F.col("deprel").alias("s_deprel")), ["doc", "sent", "id"]
    )
    articles = scoring.article_counts(pairs)
    different = scoring.text_differences(gold, system).select("doc", F.lit("text").alias("problem"))
    return {"metrics": scoring.metrics(gold, system), "articles": articles, "intervals": scoring.bootstrap(articles, repeats, seed), "violations": different}


def compare_runs(first: DataFrame, second: DataFrame, repeats: int = 1000, seed: int = 1729) -> dict[str, DataFrame]:
    """Paired differences of two runs' article counts, and the articles that don't pair."""
    return {"differences": scoring.paired_difference(first, second, repeats, seed), "violations": scoring.paired_violations(first, second)}


def evaluate_language_model(scored: DataFrame, blocks: DataFrame, limit: int, seed: int) -> dict[str, DataFrame]:
    """Masked metrics by language, split and checkpoint over a fixed selection of blocks.

    ``scored`` is ``(id, checkpoint, loss_sum, n, top1, top5)``. The selection takes the blocks
    first by fingerprint([seed, id]) of each language and split.
    """
    from .components import rank_by_hash

    chosen = rank_by_hash(blocks.select("id", "language", "split"), ["language", "split"], fingerprint_list(seed, F.col("id")), ["id"], "rank").where(F.col("rank") <= limit)
    metrics = B.masked_metrics(scored.join(chosen, "id"), ["language", "split", "checkpoint"])
    return {"selection": chosen.select("id", "language", "split"), "metrics": metrics}


def compare_predictions(rows: DataFrame, keys: list[str], base: str, adapted: str) -> DataFrame:
    """Predictions of two checkpoints side by side."""
    side = lambda c, p: rows.where(F.col("checkpoint") == c).drop("checkpoint").select(*keys, *[F.col(x).alias(f"{p}_{x}") for x in rows.columns if x not in (*keys, "checkpoint")])
    return side(base, "base").join(side(adapted, "adapted"), keys, "full")


def with_summaries(runs: DataFrame, summaries: DataFrame, key: str) -> DataFrame:
    """All runs, with the summary that exists for some of them."""
    return runs.join(summaries, key, "left")


def side_by_side(reports: dict[str, DataFrame], key: str, value: str) -> DataFrame:
    """One value of several reports over the same gold, by key; a key that one lacks is left out."""
    out = None
    for name, df in reports.items():
        one = df.select(key, F.col(value).alias(name))
        out = one if out is None else out.join(one, key)
    return out


# ---- smaller pieces -----------------------------------------------------------------------


def pick_relation(scores: Column, labels: list[str], head: Column) -> Column:
    """``root`` where the head is 0, else the label of greatest score other than ``root``."""
    root = labels.index("root")
    masked = F.transform(scores, lambda x, i: F.struct(F.when(i == root, F.lit(float("-inf"))).otherwise(x).alias("s"), (-i).alias("i")))
    best = -F.array_max(masked)["i"]
    return F.when(head == 0, "root").otherwise(F.element_at(F.array(*map(F.lit, labels)), (best + 1).cast("int")))


def ordered_candidates(candidates: Column) -> Column:
    """Distinct analyses as JSON texts in ascending order."""
    return F.sort_array(F.array_distinct(F.transform(candidates, lambda x: F.to_json(x))))


def encoder_windows(sizes: list[int], capacity: int, overlap: int) -> list[tuple[int, int]]:
    """Piece ranges of overlapping windows that end between words wherever a word fits.

    ``sizes`` are the pieces of each word. A word longer than a window is cut. The next window
    starts at the last word border that repeats at least ``overlap`` pieces, and always later.
    Where a window that starts at a piece ends, and where the one behind it starts, is worked out
    for all pieces at once; the windows are the way from piece 0 along these.
    """
    border = np.concatenate([[0], np.cumsum(np.asarray(sizes, np.int64))])
    total = int(border[-1])
    piece = np.arange(total)
    border_before = lambda x: border[np.searchsorted(border, x, "right") - 1]
    full = np.minimum(piece + capacity, total)
    end = np.where(border_before(full) > piece, border_before(full), full)
    repeat = np.maximum(piece + 1, end - overlap)
    behind = border[np.searchsorted(border, piece, "right")]
    start = np.select([border_before(repeat) > piece, behind < end], [border_before(repeat), behind], repeat)
    way, at = [], 0
    while at < total:
        way.append((at, int(end[at])))
        at = int(start[at]) if end[at] < total else total
    return way


def window_table(words: DataFrame, capacity: int, overlap: int, keys: list[str]) -> DataFrame:
    """``(keys, window, start, end)`` for rows with an array ``sizes`` of pieces a word."""
    import pandas as pd

    def run(batches):
        for b in batches:
            rows = [(*[r[k] for k in keys], i, s, e) for _, r in b.iterrows() for i, (s, e) in enumerate(encoder_windows(list(r["sizes"]), capacity, overlap))]
            yield pd.DataFrame(rows, columns=[*keys, "window", "start", "end"])

    schema = ", ".join(f"`{k}` {words.schema[k].dataType.simpleString()}" for k in keys)
    return words.select(*keys, "sizes").mapInPandas(run, f"{schema}, window int, start int, end int")
