"""Queries over the corpus tables: preparation, splits, overlap, cleaning, selection, blocks."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.hashing import article_id, fingerprint, fingerprint_list
from ..operators import blocks as B
from ..operators import cleaning, corpus, selection
from ..session import shared_dir, table
from ..sources import readers, sinks
from . import sqltext as Q
from .registry import query

WIDTH = 12
_SPLIT_SQL = "CASE lower(split) WHEN 'test' THEN 'test' WHEN 'validation' THEN 'validation' WHEN 'dev' THEN 'validation' ELSE 'train' END"


def _split():
    s = F.lower("split")
    return F.when(s == "test", "test").when(s.isin("validation", "dev"), "validation").otherwise("train")


# ---- counts, unions, simple filters -----------------------------------------------------------


@query("SELECT lang, count(*) AS documents, coalesce(sum(length(text)), 0)::BIGINT AS characters FROM documents GROUP BY lang")
def a1_counts_by_lang(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.counts(table(spark, sf, "documents"), ["lang"])


@query(f"SELECT language, {_SPLIT_SQL} AS split, count(*) AS documents, coalesce(sum(length(text)), 0)::BIGINT AS characters FROM corpus_records GROUP BY 1, 2")
def a1_counts_by_split(spark, sf):
    return corpus.counts(table(spark, sf, "corpus_records").withColumn("split", _split()), ["language", "split"])


@query("""SELECT language, count(*) AS n FROM (SELECT lang AS language FROM documents UNION ALL SELECT language FROM sentences
    UNION ALL SELECT language FROM corpus_records) GROUP BY language""")
def u1_union_records(spark, sf):
    d = table(spark, sf, "documents").select(F.col("lang").alias("language"), "text")
    s = table(spark, sf, "sentences").select("language", "text", "article")
    r = table(spark, sf, "corpus_records").select("language", "text", "recording_id")
    return corpus.union_records(d, s, r).groupBy("language").agg(F.count("*").alias("n"))


@query(f"SELECT doc_id, title FROM documents WHERE title IS NULL OR {Q.strip('title')} NOT IN ('Кумшо лаштык', 'Кутскон бам', 'Тӱҥ лаштык', 'Main Page')")
def pr2_main_pages(spark, sf):
    return corpus.drop_titles(table(spark, sf, "documents"))[0].select("doc_id", "title")


@query(f"SELECT lang, count(*) AS n FROM documents WHERE text IS NOT NULL AND {Q.strip('text')} <> '' GROUP BY lang")
def pr3_nonempty(spark, sf):
    return corpus.drop_blank(table(spark, sf, "documents")).groupBy("lang").agg(F.count("*").alias("n"))


@query("SELECT rec_no, 'identity' AS name, '1' AS version FROM corpus_records")
def pr4_representation(spark, sf):
    return corpus.stamp_representation(table(spark, sf, "corpus_records").drop("representation")).select("rec_no", "representation.name", "representation.version")


_META = (
    r"(?i)^(?:\{\||\|[}\-]|\||!|__(?:NOTOC|NOEDITSECTION)__|(?:Категорий|Категория|Category|Файл|File|Image):|\d+\s*px\|)"
)
_STRIP_X = Q.strip("x")
_EDIT = rf"""regexp_replace(regexp_replace(regexp_replace(regexp_replace({_STRIP_X}, '<!--.*?-->', '', 'g'),
    '\{{\{{[^{{}}]*\}}\}}', '', 'g'), '\[\[(?:[^|\]]*\|)?([^\]]+)\]\]', '\1', 'g'), '<[^>]+>', '', 'g')"""
_TIDY = Q.strip(f"regexp_replace({_EDIT}, '[ \\t\\x{{a0}}]+', ' ', 'g')")


@query(rf"""WITH l AS (SELECT doc_id, unnest({Q.lines("coalesce(text, '')")}) AS x, generate_subscripts({Q.lines("coalesce(text, '')")}, 1) AS i FROM documents),
    e AS (SELECT doc_id, i, x, regexp_matches({_STRIP_X}, '{_META}') AS meta, {_TIDY} AS y FROM l WHERE {_STRIP_X} <> ''),
    g AS (SELECT doc_id, string_agg(y, chr(10) ORDER BY i) FILTER (WHERE NOT meta AND regexp_matches(y, '\p{{L}}')) AS clean,
        count(*) FILTER (WHERE meta) AS n_metadata, count(*) FILTER (WHERE NOT meta AND y <> x) AS n_cleaned FROM e GROUP BY doc_id)
    SELECT doc_id, coalesce(clean, '') AS clean, coalesce(n_metadata, 0)::INT AS n_metadata, coalesce(n_cleaned, 0)::INT AS n_cleaned FROM documents LEFT JOIN g USING (doc_id)""")
def pr1_line_clean(spark, sf):
    got = corpus.clean_wiki(table(spark, sf, "documents").select("doc_id", "text"), unescape=False)
    n = lambda why: F.size(F.filter("audit", lambda a: a["reason"] == why))
    return got.select("doc_id", "clean", n("wiki_metadata_line").alias("n_metadata"), n("wiki_inline_cleanup").alias("n_cleaned"))


@query(None)
def pr1_line_clean_exact(spark, sf):
    """With entities decoded (exact, Arrow-batched)."""
    return corpus.clean_wiki(table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", "clean")


# ---- functions ---------------------------------------------------------------------------------


@query("""SELECT rec_no, sha256('[42,' || to_json(list_transform(coalesce(source_ids, []), lambda x: x))::VARCHAR || ']') AS fp, sha256(to_json(language)::VARCHAR) AS fl
    FROM corpus_records WHERE source_ids IS NOT NULL""")
def f1_fingerprint(spark, sf):
    r = table(spark, sf, "corpus_records").where("source_ids is not null")
    return r.select("rec_no", fingerprint_list(42, F.col("source_ids")).alias("fp"), fingerprint(F.col("language")).alias("fl"))


@query("""SELECT row_id, language || ':wiki:' || substr(sha256(to_json(article)::VARCHAR), 1, 20) AS article_key FROM sentences WHERE article IS NOT NULL AND language IS NOT NULL""")
def f1_article_ids(spark, sf):
    s = table(spark, sf, "sentences").where("article is not null and language is not null")
    return s.select("row_id", article_id(F.col("language"), F.col("article")).alias("article_key"))


@query(f"SELECT row_id, {Q.canonical('text')} AS key FROM sentences WHERE text IS NOT NULL")
def f3_canonical(spark, sf):
    return table(spark, sf, "sentences").where("text is not null").select("row_id", T.canonical("text").alias("key"))


@query(f"SELECT row_id, {Q.canonical('nfc_normalize(text)')} AS key FROM sentences WHERE text IS NOT NULL")
def f3_canonical_exact(spark, sf):
    return table(spark, sf, "sentences").where("text is not null").select("row_id", T.canonical_exact("text").alias("key"))


@query(f"""WITH k AS (SELECT doc_id, {Q.words('lower(text)')} AS w FROM documents WHERE text IS NOT NULL)
    SELECT doc_id, len({Q.grams('w', WIDTH)})::INT AS n_grams FROM k""")
def f4_ngrams(spark, sf):
    d = table(spark, sf, "documents").where("text is not null").select("doc_id", T.split_words(F.lower("text")).alias("w"))
    return d.select("doc_id", F.size(T.ngrams(F.col("w"), WIDTH)).alias("n_grams"))


@query(f"SELECT doc_id, len({Q.words('text')})::INT AS n_words, len({Q.lines('text')})::INT AS n_lines FROM documents WHERE text IS NOT NULL")
def f5_f6_words_and_lines(spark, sf):
    d = table(spark, sf, "documents").where("text is not null")
    return d.select("doc_id", F.size(T.split_words("text")).alias("n_words"), F.size(T.split_lines("text")).alias("n_lines"))


@query(r"SELECT row_id, regexp_extract_all(text, '[\p{L}\p{Nl}\p{No}]+') AS letter_words FROM sentences WHERE text IS NOT NULL")
def f17_letter_words(spark, sf):
    s = table(spark, sf, "sentences").where("text is not null")
    return s.select("row_id", T.letter_words("text").alias("letter_words"))


@query(r"SELECT word, regexp_matches(word, '[\p{L}\p{Nd}²³¹⁰⁴-⁹₀-₉]') AS lexical, split_part(word || ':x', ':', 1) AS base FROM dictionary")
def f16_f11_lexical_and_base(spark, sf):
    return table(spark, sf, "dictionary").select("word", T.lexical("word").alias("lexical"), T.base_relation(F.concat("word", F.lit(":x"))).alias("base"))


@query("SELECT row_id, regexp_matches(coalesce(annotation_status, ''), '^[A-Za-z0-9_-]+$') AS valid FROM sentences")
def f26_round_id(spark, sf):
    return table(spark, sf, "sentences").select("row_id", T.valid_name("annotation_status").alias("valid"))


# ---- duplicate groups and splits -----------------------------------------------------------------

_GROUPS = f"""keys AS (SELECT rec_no AS rec, 't' || chr(1) || language || chr(1) || {Q.canonical('text')} AS key FROM corpus_records WHERE text IS NOT NULL
    UNION SELECT rec_no, 's' || chr(1) || language || chr(1) || s FROM (SELECT rec_no, language, unnest(source_ids) AS s FROM corpus_records) WHERE s IS NOT NULL),
  hub AS (SELECT key, min(rec) AS v FROM keys GROUP BY key),
  e AS (SELECT DISTINCT rec AS a, v AS b FROM keys JOIN hub USING (key)), e2 AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
  reach AS (SELECT a, b FROM e2 UNION SELECT r.a, e2.b FROM reach r JOIN e2 ON r.b = e2.a),
  roots AS (SELECT a AS rec, min(b) AS root FROM reach GROUP BY a)"""
_MERGED = f"""{_GROUPS},
  rows_ AS (SELECT r.rec_no, r.language, r.source_ids, r.text, roots.root, {Q.canonical('r.text')} AS k FROM corpus_records r JOIN roots ON r.rec_no = roots.rec),
  t AS (SELECT root, string_agg(x, chr(10) ORDER BY k) AS text FROM (SELECT root, k, arg_max(text, (rec_no, text)) AS x FROM rows_ WHERE text IS NOT NULL GROUP BY root, k) GROUP BY root),
  s AS (SELECT root, list_sort(list(DISTINCT x)) AS source_ids FROM (SELECT root, unnest(source_ids) AS x FROM rows_) WHERE x IS NOT NULL GROUP BY root),
  merged AS (SELECT root, min(rec_no) AS id, arg_min(language, rec_no) AS language, count(*) AS n_records FROM rows_ GROUP BY root),
  groups AS (SELECT m.root, m.id, m.language, coalesce(s.source_ids, []) AS source_ids, t.text, m.n_records FROM merged m LEFT JOIN s USING (root) LEFT JOIN t USING (root))"""
_TARGETS = ["mhr", "udm", "nio"]


def _records(spark, sf):
    return table(spark, sf, "corpus_records").select("rec_no", "source_ids", "text", "language")


def _merged(spark, sf):
    r = _records(spark, sf)
    roots = corpus.duplicate_groups(r, "rec_no", key=T.canonical("text"))
    return corpus.merge_groups(r, roots, "rec_no", key=T.canonical("text"))


@query(f"WITH RECURSIVE {_GROUPS} SELECT rec, root FROM roots")
def a3_duplicate_groups(spark, sf):
    return corpus.duplicate_groups(_records(spark, sf), "rec_no", key=T.canonical("text"))


@query(f"""WITH RECURSIVE {_GROUPS}, m AS (SELECT root, min(rec) AS a, max(rec) AS b FROM roots GROUP BY root)
    SELECT root, a AS first_id, x.text AS first_text, b AS last_id, y.text AS last_text FROM m JOIN corpus_records x ON x.rec_no = a JOIN corpus_records y ON y.rec_no = b""")
def o2_group_ends(spark, sf):
    """The members of each group in the order of id and text: the first and the last."""
    r = _records(spark, sf)
    ends = corpus.group_ends(r, corpus.duplicate_groups(r, "rec_no", key=T.canonical("text")), "rec_no")
    return ends.select("root", F.col("first.id").alias("first_id"), F.col("first.text").alias("first_text"), F.col("last.id").alias("last_id"), F.col("last.text").alias("last_text"))


@query(f"WITH RECURSIVE {_MERGED} SELECT root, id, language, source_ids, text, n_records FROM groups")
def a4_merged_groups(spark, sf):
    return _merged(spark, sf)


@query(f"""WITH RECURSIVE {_MERGED}, sizes AS (SELECT language, greatest(1, round_even(count(*) * 0.05, 0))::INT AS k FROM groups GROUP BY language),
    r AS (SELECT root, language, row_number() OVER (PARTITION BY language ORDER BY sha256('[42,' || to_json(source_ids)::VARCHAR || ']'), root) AS n FROM groups)
    SELECT root, language, CASE WHEN language NOT IN ('mhr', 'udm', 'nio') THEN 'train' WHEN n <= k THEN 'test' WHEN n <= 2 * k THEN 'validation' ELSE 'train' END AS split
    FROM r JOIN sizes USING (language)""")
def w3_ranked_split(spark, sf):
    return corpus.ranked_splits(_merged(spark, sf), targets=_TARGETS).select("root", "language", "split")


@query("""SELECT lang AS language, count(DISTINCT source) AS n, greatest(0, count(DISTINCT source) - 2 * greatest(1, round_even(count(DISTINCT source) * 0.05, 0)))::BIGINT AS n_train
    FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL GROUP BY lang HAVING count(DISTINCT source) < 3""")
def c1_split_violations(spark, sf):
    """Languages whose sources, as groups, are too few for three splits."""
    g = table(spark, sf, "documents").where("source is not null and lang is not null").select(F.col("lang").alias("language"), F.col("source").alias("root"), F.array("source").alias("source_ids")).distinct()
    targets = [r[0] for r in g.select("language").distinct().collect()]  # a few languages
    return corpus.split_violations(corpus.ranked_splits(g, targets=targets), targets)


@query("""SELECT source_id FROM (SELECT DISTINCT s AS source_id, lower(split) AS split FROM (SELECT unnest(source_ids) AS s, split FROM corpus_records) WHERE s IS NOT NULL AND split IS NOT NULL)
    GROUP BY source_id HAVING count(*) > 1""")
def c5_split_conflicts(spark, sf):
    r = table(spark, sf, "corpus_records").where("split is not null").withColumn("split", F.lower("split"))
    return selection.source_splits(r)[1]


@query("""SELECT source, count(DISTINCT lower(split)) AS n_splits FROM corpus_records WHERE source IS NOT NULL GROUP BY source HAVING count(DISTINCT lower(split)) > 1""")
def a18_split_leaks(spark, sf):
    from ..operators.treebank import split_leaks

    r = table(spark, sf, "corpus_records").where("source is not null").withColumn("split", F.lower("split"))
    return split_leaks(r, "source")


# ---- overlap --------------------------------------------------------------------------------------


@query(f"""WITH l AS (SELECT doc_id AS id, unnest({Q.lines('text')}) AS line, generate_subscripts({Q.lines('text')}, 1)::INT AS line_no FROM documents WHERE text IS NOT NULL),
    k0 AS (SELECT id, line_no, {Q.words('lower(line)')} AS w FROM l), k AS (SELECT *, array_to_string(w, ' ') AS key FROM k0),
    b0 AS (SELECT {Q.words('lower(text)')} AS w FROM eval_items WHERE text IS NOT NULL), b AS (SELECT *, array_to_string(w, ' ') AS key FROM b0),
    g AS (SELECT DISTINCT unnest({Q.grams('w', WIDTH)}) AS gram FROM b WHERE key <> '')
    SELECT id, line_no FROM k WHERE key IN (SELECT key FROM b WHERE key <> '')
    UNION SELECT id, line_no FROM (SELECT id, line_no, unnest({Q.grams('w', WIDTH)}) AS gram FROM k) WHERE gram IN (SELECT gram FROM g)""")
def j2_overlap_lines(spark, sf):
    lines = corpus.keyed_lines(table(spark, sf, "documents").where("text is not null"), "doc_id", exact=False)
    guard = table(spark, sf, "eval_items").select(T.canonical("text").alias("key")).where("key <> ''")
    return corpus.overlapping_lines(lines.select("id", "line_no", "key"), guard, WIDTH)


_STAGE = """{s}h AS (SELECT rec_no, line_no FROM k WHERE split = '{split}' AND key IN (SELECT key FROM {guard})
    UNION SELECT rec_no, line_no FROM (SELECT rec_no, line_no, unnest(grams) AS gram FROM k WHERE split = '{split}') WHERE gram IN (SELECT unnest(grams) FROM {guard})),
  {s}s AS (SELECT k.* FROM k ANTI JOIN {s}h USING (rec_no, line_no) WHERE split = '{split}')"""


@query(f"""WITH l AS (SELECT rec_no, {_SPLIT_SQL} AS split, unnest({Q.lines('text')}) AS line, generate_subscripts({Q.lines('text')}, 1)::INT AS line_no FROM corpus_records WHERE text IS NOT NULL),
  k0 AS (SELECT rec_no, split, line_no, line, {Q.words('lower(line)')} AS w FROM l), k AS (SELECT *, array_to_string(w, ' ') AS key, {Q.grams('w', WIDTH)} AS grams FROM k0 WHERE len(w) > 0),
  b0 AS (SELECT {Q.words("lower(split_part(text, chr(10), 1))")} AS w FROM corpus_records WHERE contains(text, chr(10))), g1 AS (SELECT array_to_string(w, ' ') AS key, {Q.grams('w', WIDTH)} AS grams FROM b0 WHERE len(w) > 0),
  {_STAGE.format(s='t', split='test', guard='g1')}, g2 AS (SELECT key, grams FROM g1 UNION ALL SELECT key, grams FROM ts),
  {_STAGE.format(s='v', split='validation', guard='g2')}, g3 AS (SELECT key, grams FROM g2 UNION ALL SELECT key, grams FROM vs),
  {_STAGE.format(s='r', split='train', guard='g3')}
  SELECT k.rec_no AS id, k.split, k.line_no FROM k JOIN (SELECT * FROM th UNION ALL SELECT * FROM vh UNION ALL SELECT * FROM rh) USING (rec_no, line_no)""")
def j2_three_stage(spark, sf):
    """The first line of every record of several lines is protected."""
    r = table(spark, sf, "corpus_records").where("text is not null").select("rec_no", "text", _split().alias("split"))
    guard = r.where(F.col("text").contains("\n")).select(F.substring_index("text", "\n", 1).alias("text"))
    return corpus.remove_overlap(r, guard, WIDTH, "rec_no", exact=False)[1].select("id", "split", "line_no")


# ---- recovery -----------------------------------------------------------------------------------------

_RECOVER = f"""c AS (SELECT {Q.strip('text')} AS t, list_sort(list(DISTINCT source_id)) AS candidates FROM sentences WHERE text IS NOT NULL AND source_id IS NOT NULL GROUP BY 1),
  l AS (SELECT source AS doc, row_id AS line, {Q.strip('text')} AS text FROM sentences WHERE text IS NOT NULL AND source IS NOT NULL),
  j AS (SELECT doc, line, text, coalesce(candidates, []) AS candidates, CASE WHEN len(candidates) = 1 THEN candidates[1] END AS own FROM l LEFT JOIN c ON l.text = c.t),
  a AS (SELECT *, last_value(own IGNORE NULLS) OVER (PARTITION BY doc ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before,
    first_value(own IGNORE NULLS) OVER (PARTITION BY doc ORDER BY line ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS after FROM j),
  m AS (SELECT doc, line, CASE WHEN len(candidates) = 0 THEN 'unmatched' WHEN own IS NOT NULL THEN 'unique_exact_recording'
    WHEN before = after AND list_contains(candidates, before) THEN 'exact_with_matching_neighbor_anchors' ELSE 'ambiguous_recording' END AS method,
    coalesce(own, CASE WHEN len(candidates) > 1 AND before = after AND list_contains(candidates, before) THEN before END) AS recording FROM a)"""


def _recovered(spark, sf):
    s = table(spark, sf, "sentences").where("text is not null")
    lines = s.where("source is not null").select(F.col("source").alias("doc"), F.col("row_id").alias("line"), "text")
    return corpus.recover_recordings(lines, s.where("source_id is not null").select("text", F.col("source_id").alias("recording")))


@query(f"WITH {_RECOVER} SELECT doc, line, method, recording FROM m")
def w2_recording_anchors(spark, sf):
    return _recovered(spark, sf).select("doc", "line", "method", "recording")


@query(f"WITH {_RECOVER} SELECT method, count(*) AS n FROM m GROUP BY method")
def a2_recovery_methods(spark, sf):
    return _recovered(spark, sf).groupBy("method").agg(F.count("*").alias("n"))


@query(f"""WITH c AS (SELECT {Q.strip('text')} AS t, count(DISTINCT source_id) AS n, min(source_id) AS r FROM sentences WHERE text IS NOT NULL AND source_id IS NOT NULL GROUP BY 1),
    l AS (SELECT source AS doc, row_id AS line, {Q.strip('text')} AS t FROM sentences WHERE text IS NOT NULL AND source IS NOT NULL)
    SELECT doc, line, coalesce(n, 0) AS n, CASE WHEN n = 1 THEN r END AS recording FROM l LEFT JOIN c USING (t)""")
def j1_exact_text_join(spark, sf):
    s = table(spark, sf, "sentences").where("text is not null")
    lines = s.where("source is not null").select(F.col("source").alias("doc"), F.col("row_id").alias("line"), "text")
    return corpus.text_candidates(lines, s.where("source_id is not null").select("text", F.col("source_id").alias("recording"))).select("doc", "line", "n", F.col("only").alias("recording"))


# ---- language filter and deduplication ---------------------------------------------------------------------

_LISTED = " OR ".join(f"(language = '{k}' AND list_has_any(lows, {v}))" for k, v in cleaning.TARGET_WORDS.items())
_LID = """lid AS (SELECT row_id AS sent_id, text, lower(trim(language)) AS language,
    CASE WHEN regexp_matches(coalesce(text, ''), '[іїєґ]') THEN ['uk', 'ru', 'mhr'] ELSE ['ru', 'uk', 'mhr'] END AS labels,
    CASE WHEN row_id % 3 = 0 THEN [0.85, 0.1, 0.05] WHEN row_id % 3 = 1 THEN [0.6, 0.3, 0.1] ELSE [0.4, 0.35, 0.25] END AS probs FROM sentences)"""
_RULES = rf"""w AS (SELECT sent_id, language, labels, probs, lower(coalesce(text, '')) AS low, regexp_extract_all(coalesce(text, ''), '[\p{{L}}\p{{Nl}}\p{{No}}]+') AS words FROM lid),
  w2 AS (SELECT *, list_transform(words, lambda x: lower(x)) AS lows FROM w),
  j AS (SELECT *, coalesce(regexp_matches(low, '[{cleaning.TARGET_LETTERS}]') OR {_LISTED}
      OR (language = 'udm' AND len(list_filter(lows, lambda x: regexp_matches(x, '{cleaning.UDMURT_ENDINGS}'))) > 0), false) AS keep FROM w2),
  u AS (SELECT *, coalesce(NOT keep AND language = 'mhr' AND coalesce(probs[list_position(labels, 'uk')], 0) >= 0.8 AND regexp_matches(low, '[іїєґ]'), false) AS uk FROM j),
  o AS (SELECT sent_id, probs[1] AS p, unnest(words) AS w FROM u WHERE NOT keep AND NOT uk AND labels[1] = 'ru' AND probs[1] >= 0.5),
  d AS (SELECT DISTINCT lower(word) AS l FROM dictionary UNION SELECT unnest({cleaning.RUSSIAN_EXTRA})),
  k AS (SELECT sent_id, p, w, lower(w) AS l, regexp_matches(lower(w), '{cleaning.RUSSIAN_SPELLING}') AS sp, lower(w) IN (SELECT l FROM d) AS hit FROM o),
  f AS (SELECT sent_id, p, count(*) FILTER (WHERE sp AND hit) AS known, count(*) FILTER (WHERE NOT (sp AND hit)) AS unknown,
      count(*) FILTER (WHERE NOT (sp AND hit) AND NOT (sp AND regexp_matches(w, '^\p{{Lu}}'))) AS nn FROM k GROUP BY sent_id, p),
  dec AS (SELECT u.sent_id AS id, CASE WHEN uk THEN 'ukrainian' WHEN (known > 0 AND unknown = 0) OR (known >= 4 AND nn = 0 AND f.p >= 0.8) THEN 'russian_only' END AS reason
      FROM u LEFT JOIN f ON u.sent_id = f.sent_id)"""
_DECIDE = f"{_LID}, {_RULES}"


def _identified(spark, sf):
    uk = F.coalesce("text", F.lit("")).rlike("[іїєґ]")
    arr = lambda *x: F.array(*map(F.lit, x))
    third = F.col("row_id") % 3
    return table(spark, sf, "sentences").select(
        F.col("row_id").alias("sent_id"), "text", F.lower(F.trim("language")).alias("language"),
        F.when(uk, arr("uk", "ru", "mhr")).otherwise(arr("ru", "uk", "mhr")).alias("labels"),
        F.when(third == 0, arr(0.85, 0.1, 0.05)).when(third == 1, arr(0.6, 0.3, 0.1)).otherwise(arr(0.4, 0.35, 0.25)).alias("probs"),
    )


@query(f"WITH {_DECIDE} SELECT id, reason FROM dec")
def pr8_language_filter(spark, sf):
    return cleaning.language_decision(_identified(spark, sf), table(spark, sf, "dictionary"))


_DEDUP = """s AS (SELECT row_id AS sent_id, text, annotation_status IS NOT DISTINCT FROM 'PARSER_FST_REVIEW' AS pref FROM sentences),
  fk AS (SELECT *, first_value(sent_id) OVER (PARTITION BY text ORDER BY pref DESC, sent_id) AS kept FROM s),
  dd AS (SELECT sent_id, text, CASE WHEN text IS NULL THEN sent_id ELSE kept END AS kept_sent_id, text IS NULL OR kept = sent_id AS is_kept FROM fk)"""


@query(f"WITH {_DEDUP} SELECT sent_id, kept_sent_id, is_kept FROM dd")
def w1_dedup_preferred(spark, sf):
    s = table(spark, sf, "sentences").select(F.col("row_id").alias("sent_id"), "text", F.col("annotation_status").eqNullSafe("PARSER_FST_REVIEW").alias("pref"))
    return cleaning.deduplicate(s, F.col("text"), ["sent_id"], preferred=F.col("pref")).select("sent_id", "kept_sent_id", "is_kept")


_NOTICE = r"Школа для рок\.?"
_CLEAN = rf"""base AS (SELECT row_id AS sent_id, text, lower(trim(language)) AS language, annotation_status,
    coalesce(lower(trim(language)) = 'mhr' AND TRY_CAST(string_split(sent_id, '-')[3] AS INT) <= 36, false) AS protected,
    CASE WHEN regexp_matches(coalesce(text, ''), '[іїєґ]') THEN ['uk', 'ru', 'mhr'] ELSE ['ru', 'uk', 'mhr'] END AS labels,
    CASE WHEN row_id % 3 = 0 THEN [0.85, 0.1, 0.05] WHEN row_id % 3 = 1 THEN [0.6, 0.3, 0.1] ELSE [0.4, 0.35, 0.25] END AS probs FROM sentences),
  fin AS (SELECT *, CASE WHEN NOT protected AND language = 'mhr' AND regexp_matches(text, '{_NOTICE}') THEN {Q.strip(f"regexp_replace(text, '{_NOTICE}', '', 'g')")} ELSE text END AS final FROM base),
  chg AS (SELECT *, coalesce(final <> text, false) AS changed, coalesce(final <> text AND NOT regexp_matches(final, '[\p{{L}}\p{{N}}]'), false) AS bare FROM fin),
  lid AS (SELECT sent_id, final AS text, language, labels, probs FROM chg WHERE NOT protected AND NOT bare), {_RULES},
  jud AS (SELECT c.*, CASE WHEN bare THEN 'boilerplate_only' ELSE dec.reason END AS reason FROM chg c LEFT JOIN dec ON c.sent_id = dec.id),
  pref AS (SELECT text, max(row_id) AS sent_id FROM sentences WHERE annotation_status = 'PARSER_FST_REVIEW' GROUP BY text),
  lft AS (SELECT j.*, p.sent_id IS NOT NULL AS p FROM jud j LEFT JOIN pref p ON j.final = p.text AND j.sent_id = p.sent_id WHERE reason IS NULL),
  won AS (SELECT *, CASE WHEN final IS NULL THEN sent_id ELSE first_value(sent_id) OVER (PARTITION BY final ORDER BY p DESC, sent_id) END AS kept FROM lft),
  aud AS (SELECT sent_id, text, 'remove' AS action, reason, NULL::VARCHAR AS cleaned_text, NULL::BIGINT AS kept_sent_id FROM jud WHERE reason IS NOT NULL
    UNION ALL SELECT sent_id, text, 'strip_boilerplate', NULL, final, NULL FROM jud WHERE reason IS NULL AND changed
    UNION ALL SELECT sent_id, final, 'remove', 'duplicate_text', NULL, kept FROM won WHERE kept <> sent_id)"""


def _cleaned(spark, sf):
    s = table(spark, sf, "sentences")
    protected = cleaning.protected_ids(s.select("row_id", "sent_id", "language")).select(F.col("row_id").alias("sent_id"), "protected")
    rows = _identified(spark, sf).join(protected, "sent_id").withColumn("pos", F.col("sent_id"))
    preferred = s.where("annotation_status = 'PARSER_FST_REVIEW'").groupBy("text").agg(F.max("row_id").alias("sent_id"))
    return cleaning.clean_rows(rows, table(spark, sf, "dictionary"), _NOTICE, preferred=preferred)


@query(f"WITH {_CLEAN} SELECT sent_id, language, final AS text FROM won WHERE kept = sent_id")
def pr9_clean_rows(spark, sf):
    """What the cleaning steps keep: boilerplate, language filter, then duplicates among the rest."""
    return _cleaned(spark, sf)[0].select("sent_id", "language", "text")


@query(f"WITH {_CLEAN} SELECT * FROM aud")
def pr9_audit(spark, sf):
    return _cleaned(spark, sf)[1]


@query(f"WITH {_CLEAN} SELECT coalesce(reason, action) AS reason, count(*) AS n FROM aud GROUP BY 1")
def a17_reason_histogram(spark, sf):
    """The cleaning pipeline's audit by reason."""
    return cleaning.reason_histogram(_cleaned(spark, sf)[1])


@query("SELECT row_id, coalesce(lower(trim(language)) = 'mhr' AND TRY_CAST(string_split(sent_id, '-')[3] AS INT) <= 36, false) AS protected FROM sentences")
def pr10_protected_ids(spark, sf):
    return cleaning.protected_ids(table(spark, sf, "sentences")).select("row_id", "protected")


# ---- selection --------------------------------------------------------------------------------------------


@query("SELECT doc_id FROM documents ORDER BY sha256('[42,\"' || doc_id || '\"]'), doc_id LIMIT 100")
def o1_top_k_hash(spark, sf):
    d = table(spark, sf, "documents").select("doc_id")
    return selection.top_by_hash(d, fingerprint_list(42, F.col("doc_id").cast("string")), 100, ["doc_id"])


@query("""SELECT source_id, arg_min(row_id, (sha256('[42,"' || row_id || '"]'), row_id)) AS row_id FROM sentences WHERE source_id IS NOT NULL GROUP BY source_id""")
def w4_best_per_article(spark, sf):
    s = table(spark, sf, "sentences").where("source_id is not null")
    return selection.best_of_group(s, ["source_id"], fingerprint_list(42, F.col("row_id").cast("string")), ["row_id"]).select("source_id", "row_id")


@query(f"""SELECT row_id FROM sentences WHERE text IS NOT NULL AND len({Q.words('text')}) BETWEEN 8 AND 40 ORDER BY sha256('[7,"' || row_id || '"]'), row_id LIMIT 50""")
def pr7_excerpts(spark, sf):
    s = table(spark, sf, "sentences").where("text is not null").select(F.col("row_id").cast("string").alias("id"), "text")
    return selection.excerpts(s, 50, 7).select(F.col("id").cast("bigint").alias("row_id"))


_FORMS = r"[\p{L}\p{M}\p{N}]+"
_USABLE = r"""len(list_filter(forms, lambda f: regexp_matches(f, '[A-Za-z|]'))) = 0 AND len(list_filter(forms, lambda f: regexp_matches(f, '[\x{400}-\x{52f}]'))) >= 3
    AND 4 * len(list_filter(forms, lambda f: regexp_matches(f, '[\x{400}-\x{52f}]'))) >= 3 * len(forms)"""


@query(f"SELECT row_id, {_USABLE} AS usable FROM (SELECT row_id, regexp_extract_all(coalesce(text, ''), '{_FORMS}') AS forms FROM sentences)")
def pr5_usable_forms(spark, sf):
    forms = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(f"({_FORMS})"), 1)
    return table(spark, sf, "sentences").select("row_id", T.usable_forms(forms).alias("usable"))


def _drafted(spark, sf):
    return table(spark, sf, "sentences").where("annotation_status is not null").select("source_id", F.col("source_sent_id"))


@query("""SELECT DISTINCT s.row_id FROM sentences s ANTI JOIN (SELECT source_id, source_sent_id FROM sentences WHERE annotation_status IS NOT NULL) d
    ON s.source_id = d.source_id AND s.source_sent_id = d.source_sent_id""")
def j7_not_drafted(spark, sf):
    return table(spark, sf, "sentences").join(_drafted(spark, sf), ["source_id", "source_sent_id"], "left_anti").select("row_id").distinct()


@query("""WITH m AS (SELECT DISTINCT source_id, CASE WHEN lower(trim(language)) = 'mhr' THEN 'train' ELSE 'test' END AS split FROM sentences WHERE source_id IS NOT NULL),
    o AS (SELECT source_id FROM m GROUP BY source_id HAVING count(*) = 1 AND min(split) = 'train') SELECT row_id FROM sentences WHERE source_id IN (SELECT source_id FROM o)""")
def j3_train_articles(spark, sf):
    """Rows of articles that a split map holds in one split only, the training one."""
    s = table(spark, sf, "sentences")
    split = F.when(F.lower(F.trim("language")) == "mhr", "train").otherwise("test")
    known, _ = selection.source_splits(s.select(F.array("source_id").alias("source_ids"), split.alias("split")))
    return s.join(known.where("split = 'train'"), "source_id", "left_semi").select("row_id")


def _eligible(spark, sf, language="mhr"):
    s = table(spark, sf, "sentences").where((F.lower(F.trim("language")) == language) & F.col("text").isNotNull())
    forms = F.regexp_extract_all("text", F.lit(r"(?U)([\p{L}\p{M}\p{N}]+|[^\s\p{L}\p{M}\p{N}])"), 1)
    s = s.select("article", F.col("source_sent_id").alias("sent_id"), forms.alias("forms"), "text").withColumn("ids", F.transform("forms", lambda f, i: i + 1))
    splits = table(spark, sf, "sentences").where("article is not null").select(article_id(language, F.col("article")).alias("source_id")).distinct().withColumn("split", F.lit("train"))
    none = spark.createDataFrame([], "source_id string, source_sent_id string")
    return selection.eligible(s, language, splits, none, none, 5, 35)


_TOKEN = r"[\p{L}\p{M}\p{N}]+|[^\t-\r\x20\x85\p{Z}\p{L}\p{M}\p{N}]"
_ELIGIBLE = rf"""el0 AS (SELECT 'mhr:wiki:' || substr(sha256(to_json(article)::VARCHAR), 1, 20) AS source_id, source_sent_id AS sent_id, text, regexp_extract_all(text, '{_TOKEN}') AS forms
      FROM sentences WHERE lower(trim(language)) = 'mhr' AND text IS NOT NULL AND article <> '' AND source_sent_id <> ''),
    el AS (SELECT source_id, sent_id, text, forms FROM el0 WHERE len(forms) BETWEEN 5 AND 35 AND NOT list_contains(forms, '_') AND {_USABLE}
)"""


@query(f"WITH {_ELIGIBLE} SELECT source_id, sent_id, len(forms)::INT AS n_forms FROM el")
def pr6_eligible(spark, sf):
    return _eligible(spark, sf).select("source_id", "sent_id", F.size("forms").alias("n_forms"))


@query(f"WITH {_ELIGIBLE} SELECT count(*) AS eligible_sentences, count(DISTINCT source_id) AS eligible_articles FROM el")
def a23_selection_sizes(spark, sf):
    return _eligible(spark, sf).agg(F.count("*").alias("eligible_sentences"), F.countDistinct("source_id").alias("eligible_articles"))


@query(f"""WITH {_ELIGIBLE}, r AS (SELECT *, sha256('[42,' || to_json(source_id)::VARCHAR || ',' || to_json(sent_id)::VARCHAR || ',' || to_json(forms)::VARCHAR || ']') AS h FROM el),
    b AS (SELECT source_id, arg_min(sent_id, (h, sent_id)) AS source_sent_id, arg_min(text, (h, sent_id)) AS text FROM r GROUP BY source_id)
    SELECT 'mhr-fewshot-r1-' || lpad(row_number() OVER (ORDER BY sha256('[42,' || to_json(source_id)::VARCHAR || ']'), source_id)::VARCHAR, 4, '0') AS sent_id, source_id, source_sent_id, text FROM b
    ORDER BY sha256('[42,' || to_json(source_id)::VARCHAR || ']'), source_id LIMIT 20""")
def c9_new_batch(spark, sf):
    return selection.select_batch(_eligible(spark, sf), "mhr", "r1", 20, 42).select("sent_id", "source_id", "source_sent_id", "text")


@query("""SELECT lang, n, round(pow(n, 0.5) / sum(pow(n, 0.5)) OVER (), 6) AS weight FROM (SELECT lang, count(*) AS n FROM documents GROUP BY lang)""")
def a20_weights(spark, sf):
    return selection.tempered_weights(table(spark, sf, "documents"), "lang", 0.5).withColumn("weight", F.round("weight", 6))


@query("""SELECT mix, language, round(weight / sum(weight) OVER (PARTITION BY mix), 6) AS share FROM mix_targets""")
def a21_normalized_weights(spark, sf):
    t = table(spark, sf, "mix_targets").select("mix", "language", "weight")
    return selection.normalized_weights(t, "mix").select("mix", "language", F.round("share", 6).alias("share"))


@query("SELECT count(*) AS n_draws, 0::BIGINT AS n_far FROM blocks WHERE language IS NOT NULL")
def o5_weighted_draws(spark, sf):
    """As many draws as rows; languages drawn more than five standard deviations off their weight are counted."""
    rows = table(spark, sf, "blocks").where("language is not null")
    d = rows.groupBy("id").agg(F.min(F.lower(F.trim("language"))).alias("language"))
    w = selection.tempered_weights(d, "language", 0.5).select("language", "weight")
    n = rows.count()
    drawn = selection.hash_draw(d, w, n, 42).groupBy("language").agg(F.count("*").alias("n"))
    far = F.abs(F.coalesce("n", F.lit(0)) - F.col("weight") * n) > 5 * F.sqrt(F.col("weight") * (1 - F.col("weight")) * n)
    return w.join(drawn, "language", "left").agg(F.sum(F.coalesce("n", F.lit(0))).alias("n_draws"), F.count_if(far).alias("n_far"))


@query("""SELECT lang, arg_min(doc_id, (-n_chars, doc_id)) AS doc_id, max(n_chars) AS size FROM documents WHERE n_chars IS NOT NULL GROUP BY lang""")
def o6_longest(spark, sf):
    return selection.longest_of_group(table(spark, sf, "documents").where("n_chars is not null"), "lang", F.col("n_chars"), "doc_id")


@query("""SELECT source_id, 'mhr-fewshot-' || lpad(row_number() OVER (ORDER BY sha256('[42,"' || source_id || '"]'), source_id)::VARCHAR, 4, '0') AS number
    FROM (SELECT DISTINCT source_id FROM sentences WHERE source_id IS NOT NULL) ORDER BY sha256('[42,"' || source_id || '"]'), source_id LIMIT 200""")
def w11_numbering(spark, sf):
    d = table(spark, sf, "sentences").where("source_id is not null").select("source_id").distinct()
    digest = fingerprint_list(42, F.col("source_id"))
    return selection.numbered_ids(d, digest, ["source_id"], 200, "mhr-fewshot")


def _dev_sql(statuses: list[str], cap: int) -> str:
    """Batches one after the other: new articles, the first of them to the development set."""
    parts, known, devs = [], "SELECT NULL::VARCHAR AS source_id, NULL::VARCHAR AS split WHERE false", "0"
    for i, status in enumerate(statuses):
        parts.append(f"r{i} AS (SELECT source_id, source_sent_id FROM sentences WHERE source_id IS NOT NULL AND annotation_status = '{status}')")
        parts.append(f"f{i} AS (SELECT source_id, row_number() OVER (ORDER BY sha256('[42,\"mhr\",' || to_json(source_id)::VARCHAR || ']'), source_id) AS n FROM (SELECT DISTINCT source_id FROM r{i} WHERE source_id NOT IN (SELECT source_id FROM ({known})))) ")
        parts.append(f"s{i} AS (SELECT source_id, CASE WHEN n <= greatest(0, least((SELECT round_even(count(*) * 0.1, 0) FROM r{i}), {cap} - ({devs}))) THEN 'dev' ELSE 'train' END AS split FROM f{i})")
        known = " UNION ALL ".join(f"SELECT * FROM s{j}" for j in range(i + 1))
        parts.append(f"d{i} AS (SELECT {i} AS batch, r{i}.*, split FROM r{i} JOIN ({known}) USING (source_id))")
        devs = " + ".join(f"(SELECT count(*) FROM d{j} WHERE split = 'dev')" for j in range(i + 1))
    return f"WITH {', '.join(parts)} " + " UNION ALL ".join(f"SELECT * FROM d{i}" for i in range(len(statuses)))


_ROUNDS = ["ZERO_SHOT_DRAFT", "PARSER_DRAFT", "PARSER_FST_REVIEW"]


@query(_dev_sql(_ROUNDS, 1_000_000))
def w10_dev_batches(spark, sf):
    s = table(spark, sf, "sentences").where("source_id is not null and annotation_status is not null").select("source_id", "source_sent_id", "annotation_status")
    return selection.assign_dev_batches([s.where(F.col("annotation_status") == x) for x in _ROUNDS], "mhr", dev_cap=1_000_000)


@query("""WITH a AS (SELECT id, count(*) AS n FROM blocks WHERE id IS NOT NULL GROUP BY id), b AS (SELECT id, count(*) AS n FROM blocks WHERE id IS NOT NULL AND split = 'train' GROUP BY id)
    SELECT id, a.n AS n_left, coalesce(b.n, 0) AS n_right FROM a LEFT JOIN b USING (id) WHERE a.n <> coalesce(b.n, 0)""")
def u4_set_difference(spark, sf):
    """Block ids that the training blocks hold otherwise than all blocks."""
    from ..operators.annotation import key_differences

    b = table(spark, sf, "blocks").where("id is not null").select("id", "split")
    return key_differences(b, b.where("split = 'train'"), ["id"])


@query("SELECT source, count(DISTINCT text) AS texts, count(DISTINCT article) AS articles FROM sentences GROUP BY source")
def u6_distinct_sets(spark, sf):
    got = corpus.distinct_counts(table(spark, sf, "sentences").select("source", "text", "article"), ["source"], ["text", "article"])
    return got.select("source", F.col("text").alias("texts"), F.col("article").alias("articles"))


@query(f"""WITH e AS (SELECT {Q.words('lower(text)')} AS w FROM eval_items WHERE text IS NOT NULL), b AS (SELECT DISTINCT unnest({Q.grams('w', 5)}) AS g FROM e),
    d AS (SELECT doc_id, {Q.words('lower(text)')} AS w FROM documents WHERE text IS NOT NULL)
    SELECT DISTINCT doc_id FROM (SELECT doc_id, unnest({Q.grams('w', 5)}) AS g FROM d) WHERE g IN (SELECT g FROM b)""")
def u2_gram_intersection(spark, sf):
    gram = lambda df: F.explode(T.ngrams(T.split_words(F.lower("text")), 5)).alias("g")
    b = table(spark, sf, "eval_items").where("text is not null").select(gram(None)).distinct()
    d = table(spark, sf, "documents").where("text is not null").select("doc_id", gram(None))
    return d.join(b, "g", "left_semi").select("doc_id").distinct()


# ---- blocks and metrics ----------------------------------------------------------------------------------------


@query(f"""WITH d AS (SELECT doc_id, list_transform({Q.words('text')}, lambda w: length(w)::INT) AS ids FROM documents WHERE text IS NOT NULL),
    c AS (SELECT doc_id, ids, unnest(range(0, len(ids), 126)) AS block_offset FROM d)
    SELECT doc_id, block_offset::INT AS block_offset, list_concat([0], ids[block_offset + 1:block_offset + 126], [2])::INT[] AS input_ids FROM c""")
def w7_chunks(spark, sf):
    d = table(spark, sf, "documents").where("text is not null").select("doc_id", F.transform(T.split_words("text"), lambda w: F.length(w)).alias("ids"))
    return B.chunks(d, 126, keep=("doc_id",)).select("doc_id", "block_offset", "input_ids")


@query(f"""WITH d AS (SELECT lang AS language, text, list_transform({Q.words('text')}, lambda w: length(w)::INT) AS ids FROM documents WHERE text IS NOT NULL)
    SELECT language, count(*) AS documents, sum(length(text))::BIGINT AS characters, sum(len({Q.words('text')}))::BIGINT AS whitespace_words, sum(len(ids))::BIGINT AS subtokens,
    sum(len(list_filter(ids, lambda x: x = 3)))::BIGINT AS unknown_tokens, count(*) FILTER (WHERE len(ids) > 126) AS over_capacity, max(len(ids))::INT AS max_subtokens,
    round(sum(len(ids)) / greatest(1, sum(len({Q.words('text')}))), 6) AS subtokens_per_word, round(sum(len(list_filter(ids, lambda x: x = 3))) / greatest(1, sum(len(ids))), 6) AS unknown_rate
    FROM d GROUP BY language""")
def a5_tokenization_audit(spark, sf):
    d = table(spark, sf, "documents").where("text is not null")
    d = d.select(F.col("lang").alias("language"), "text", F.transform(T.split_words("text"), lambda w: F.length(w)).alias("ids"))
    return B.tokenization_audit(d, 126, 3)


@query("SELECT source, doc_id, n::INT AS n FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents) WHERE n <= 3")
def a5_first_examples(spark, sf):
    return B.first_examples(table(spark, sf, "documents").select("source", "doc_id"), "source", 3, "doc_id")


_BLOCKS = "SELECT id, min(lower(trim(language))) AS language, max(input_ids) AS input_ids, max(special_tokens_mask) AS mask FROM blocks GROUP BY id"


def _blocks(spark, sf):
    b = table(spark, sf, "blocks").groupBy("id").agg(F.min(F.lower(F.trim("language"))).alias("language"), F.max("input_ids").alias("input_ids"), F.max("special_tokens_mask").alias("special_tokens_mask"))
    return b.where("input_ids is not null and special_tokens_mask is not null and exists(special_tokens_mask, x -> x = 0)")


@query(None)
def o8_masked_blocks(spark, sf):
    return B.mask_blocks(_blocks(spark, sf), 0.15, 42, 4, 400_000, [0, 1, 2, 3, 4])


@query(f"""WITH b AS ({_BLOCKS}), t AS (SELECT id, language, unnest(input_ids) AS tok, unnest(mask) AS m FROM b),
    m AS (SELECT coalesce(language, '') AS language, count(*) AS n, sum(tok % 97) / 16.0 AS l, count(*) FILTER (WHERE tok % 5 = 0) AS t1, count(*) FILTER (WHERE tok % 2 = 0) AS t5 FROM t WHERE m = 0 GROUP BY 1)
    SELECT language, n, round(l / n, 6) AS loss, round(t1 / n, 6) AS accuracy, round(t5 / n, 6) AS top5_accuracy FROM m""")
def a11_masked_metrics(spark, sf):
    t = _blocks(spark, sf).select(F.coalesce("language", F.lit("")).alias("language"), F.explode(F.arrays_zip("input_ids", "special_tokens_mask")).alias("z"))
    t = t.where("z.special_tokens_mask = 0").select("language", (F.col("z.input_ids") % 97 / 16.0).alias("loss_sum"), F.lit(1).alias("n"), (F.col("z.input_ids") % 5 == 0).cast("int").alias("top1"), (F.col("z.input_ids") % 2 == 0).cast("int").alias("top5"))
    return B.masked_metrics(t, ["language"]).drop("perplexity")


@query(f"""WITH b AS ({_BLOCKS}), n AS (SELECT *, sum(len(list_filter(mask, lambda x: x = 0))) OVER (PARTITION BY language ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
      FROM b WHERE len(list_filter(mask, lambda x: x = 0)) > 0),
    e AS (SELECT language, id, coalesce(before, 0) AS before, unnest(mask) AS m, generate_subscripts(mask, 1) AS i FROM n),
    r AS (SELECT *, before + row_number() OVER (PARTITION BY language, id ORDER BY i) AS k FROM e WHERE m = 0) SELECT language, id, (i - 1)::INT AS position FROM r WHERE k <= 2000""")
def a12_leave_one_out(spark, sf):
    return B.leave_one_out(_blocks(spark, sf), 2000)


@query("""SELECT vec_id, list_transform(list_sort(list_transform(embedding, lambda x, i: {'s': -x, 'i': i})), lambda r: (r.i - 1)::INT)[1:5] AS top_index FROM embeddings""")
def o7_top_predictions(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", F.transform(B.top_predictions(F.col("embedding"), 5), lambda r: r["index"]).alias("top_index"))


@query("SELECT vec_id, (len(list_filter(embedding, lambda x: x > embedding[label % len(embedding) + 1])) + 1)::INT AS gold_rank FROM embeddings")
def o7_gold_rank(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", B.gold_rank(F.col("embedding"), (F.col("label") % F.size("embedding")).cast("int")).alias("gold_rank"))


@query(f"""WITH b AS ({_BLOCKS}), t AS (SELECT language, id, unnest(input_ids) AS tok FROM b)
    SELECT id, round(sum(-(tok % 89) / 8.0), 6) AS sum_log_prob, round(avg(-(tok % 89) / 8.0), 6) AS mean_log_prob, count(*) AS subtokens FROM t
    WHERE id IN (SELECT id FROM b WHERE len(list_filter(mask, lambda x: x = 0)) > 0) GROUP BY id""")
def f25_candidate_scores(spark, sf):
    t = _blocks(spark, sf).select("id", F.explode("input_ids").alias("tok")).select("id", (-(F.col("tok") % 89) / 8.0).alias("log_prob"))
    return B.candidate_scores(t, ["id"])


@query(f"""WITH b AS ({_BLOCKS}), k AS (SELECT * FROM b WHERE len(list_filter(mask, lambda x: x = 0)) > 0), w AS (SELECT coalesce(language, '') AS batch, max(len(input_ids)) AS w FROM k GROUP BY 1)
    SELECT id, list_resize(input_ids, w, 1)::INT[] AS input_ids, list_resize(list_transform(input_ids, lambda x: 1), w, 0)::INT[] AS attention_mask FROM k JOIN w ON coalesce(k.language, '') = w.batch""")
def c21_padded_batches(spark, sf):
    b = _blocks(spark, sf).withColumn("batch", F.coalesce("language", F.lit(""))).withColumn("labels", F.col("input_ids"))
    return B.pad_batches(b).select("id", "input_ids", "attention_mask")


@query("""SELECT event_type, event_id, round(sum(value) OVER (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 3) AS exposure FROM events""")
def a19_exposure(spark, sf):
    return B.exposure(table(spark, sf, "events"), "event_type", "event_id", F.col("value")).select("event_type", "event_id", F.round("exposure", 3).alias("exposure"))


@query("SELECT event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY event_type")
def stream_event_totals(spark, sf):
    """The event log as a file stream, drained once (extension)."""
    from ..streaming.exposure import event_totals_stream, run_once

    schema = table(spark, sf, "events").schema
    folder = os.path.join(shared_dir(spark), f"stream-{os.getpid()}-{os.urandom(4).hex()}")
    df = event_totals_stream(spark, os.path.join(sf, "events.parquet"), schema, "ts", "event_type", "value")
    out = run_once(df, f"quern_events_{os.urandom(4).hex()}", "complete", folder)
    return out.select("event_type", "n", F.round("total", 2).alias("total"))


# ---- sources and sinks ------------------------------------------------------------------------------------------


def _scratch(spark, name):
    return os.path.join(shared_dir(spark), f"{name}-{os.urandom(6).hex()}")


def _wiki_round_trip(spark, sf):
    path = _scratch(spark, "csv")
    d = table(spark, sf, "documents").where("title is not null and text is not null and text <> '' and title <> ''")
    d.select(F.col("title").alias("article"), "text").write.csv(path, header=True, escape='"', quoteAll=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return readers.read_wiki_csv(spark, path)


@query("SELECT title AS article, text FROM documents WHERE title IS NOT NULL AND text IS NOT NULL AND text <> '' AND title <> ''")
def s1_wiki_csv(spark, sf):
    """All documents with title and text written as CSV and read again by the wiki reader."""
    return _wiki_round_trip(spark, sf)


@query("SELECT rec_no, id, source_ids, language, text FROM corpus_records")
def s9_s11_jsonl(spark, sf):
    """Records written as JSON lines and read again."""
    path = _scratch(spark, "jsonl")
    sinks.write_jsonl(table(spark, sf, "corpus_records").select("rec_no", "id", "source_ids", "language", "text"), path)
    return readers.read_jsonl(spark, path, "rec_no bigint, id string, source_ids array<string>, language string, text string")
