"""Queries over the composite steps."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.hashing import article_id
from ..operators import blocks as B
from ..operators import composites as C
from ..session import table
from . import sqltext as Q
from .corpus_queries import _ELIGIBLE, _MERGED, _USABLE, _eligible
from .registry import query
from .treebank_queries import _internal_sql, _lines, gold_tokens, system_tokens

_LABELS = ["nsubj", "root", "obj", "obl", "det"]


@query("""WITH e AS (SELECT vec_id, label % 3 AS head, embedding[1:5] AS s FROM embeddings), m AS (SELECT vec_id, head, list_transform([s[1], s[3], s[4], s[5]], lambda x: x) AS t FROM e)
    SELECT vec_id, CASE WHEN head = 0 THEN 'root' ELSE (['nsubj', 'obj', 'obl', 'det'])[list_position(t, list_max(t))] END AS relation FROM m""")
def f23_relation_pick(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", (F.col("label") % 3).alias("head"), F.slice("embedding", 1, 5).cast("array<double>").alias("s"))
    return e.select("vec_id", C.pick_relation(F.col("s"), _LABELS, F.col("head")).alias("relation"))


_LAST = "list_filter(border, lambda y: y <= {x})[-1]"


def _end(s: str) -> str:
    full = f"least({s} + 510, total)"
    return f"CASE WHEN {_LAST.format(x=full)} > {s} THEN {_LAST.format(x=full)} ELSE {full} END"


_WORD = _LAST.format(x="greatest(f.s + 1, f.e - 64)")
_BEHIND = "list_filter(border, lambda y: y > f.s)[1]"
_NEXT = f"(CASE WHEN {_WORD} > f.s THEN {_WORD} WHEN {_BEHIND} < f.e THEN {_BEHIND} ELSE greatest(f.s + 1, f.e - 64) END)"


@query(rf"""WITH RECURSIVE d AS (SELECT doc_id, unnest(regexp_extract_all(text, '[\p{{L}}\p{{M}}\p{{N}}]+')) AS w, generate_subscripts(regexp_extract_all(text, '[\p{{L}}\p{{M}}\p{{N}}]+'), 1) AS i FROM documents WHERE text IS NOT NULL),
    e AS (SELECT doc_id, i, sum(length(w)) OVER (PARTITION BY doc_id ORDER BY i)::BIGINT AS e FROM d), b AS (SELECT doc_id, list_concat([0::BIGINT], list(e ORDER BY i)) AS border, max(e) AS total FROM e GROUP BY doc_id),
    f AS (SELECT doc_id, 0 AS win, 0::BIGINT AS s, ({_end('0')})::BIGINT AS e FROM b
      UNION ALL SELECT doc_id, win + 1, s, ({_end('s')})::BIGINT FROM (SELECT f.doc_id, f.win, {_NEXT}::BIGINT AS s, border, total FROM f JOIN b USING (doc_id) WHERE f.e < total))
    SELECT doc_id, win::INT AS "window", s::INT AS start, e::INT AS "end" FROM f""")
def w8_encoder_windows(spark, sf):
    d = table(spark, sf, "documents").where("text is not null").select("doc_id", F.transform(F.regexp_extract_all("text", F.lit(r"([\p{L}\p{M}\p{N}]+)"), 1), lambda w: F.length(w)).alias("sizes"))
    return C.window_table(d, 510, 64, ["doc_id"])


@query(f"""WITH {Q.TOKENS} SELECT sent, id, to_json({{'lemma': lemma, 'upos': upos}})::VARCHAR AS first FROM gold""")
def o4_candidate_order(spark, sf):
    """The first candidate of every token, of three of which two are alike."""
    g = gold_tokens(spark, sf)
    s = lambda c: F.struct(F.col("lemma"), F.when(F.lit(c), F.col("upos")).otherwise(F.lit("~")).alias("upos"))
    return g.select("sent", "id", F.element_at(C.ordered_candidates(F.array(s(False), s(True), s(True))), 1).alias("first"))


@query(f"""WITH RECURSIVE {Q.TOKENS}, {_internal_sql("SELECT coalesce(min(source_id), '') AS key FROM gold WHERE lower(trim(language)) = 'nenets' GROUP BY doc, sent HAVING coalesce(min(source_id), '') <> ''")}
    SELECT split, count(*) AS n, count(DISTINCT key) AS groups FROM split GROUP BY split""")
def c4_treebank(spark, sf):
    """Sentences of one language split by whole articles, with their violations."""
    s = _lines(gold_tokens(spark, sf).where(F.lower(F.trim("language")) == "nenets"))
    s = s.withColumn("lines", F.concat(F.array(F.concat(F.lit("# doc_title = "), F.regexp_replace(F.filter("lines", lambda x: x.startswith("# source_id"))[0], "^# source_id = ", ""))), "lines"))
    out = C.prepare_treebank(s, "yrk")
    return out["sentences"].groupBy("split").agg(F.count("*").alias("n"), F.countDistinct("key").alias("groups"))


def _forms(spark, sf):
    s = table(spark, sf, "sentences").where((F.lower(F.trim("language")) == "mhr") & F.col("text").isNotNull())
    forms = F.regexp_extract_all("text", F.lit(r"([\p{L}\p{M}\p{N}]+)"), 1)
    return s.select("article", F.col("source_sent_id").alias("sent_id"), forms.alias("forms"), "text").withColumn("ids", F.transform("forms", lambda f, i: i + 1))


_MHR = r"""m0 AS (SELECT 'mhr:wiki:' || substr(sha256(to_json(article)::VARCHAR), 1, 20) AS source_id, source_sent_id AS sent_id, regexp_extract_all(text, '[\p{L}\p{M}\p{N}]+') AS forms
    FROM sentences WHERE lower(trim(language)) = 'mhr' AND text IS NOT NULL AND article <> '')"""


@query(f"""WITH {_MHR}, u AS (SELECT * FROM m0 WHERE sent_id <> '' AND len(forms) BETWEEN 5 AND 50 AND {_USABLE}),
    r AS (SELECT *, sha256('[42,' || to_json(source_id)::VARCHAR || ',' || to_json(sent_id)::VARCHAR || ',' || to_json(forms)::VARCHAR || ']') AS h FROM u),
    b AS (SELECT source_id, arg_min(sent_id, (h, sent_id)) AS source_sent_id, arg_min(len(forms), (h, sent_id))::INT AS n_forms FROM r GROUP BY source_id)
    SELECT * FROM b ORDER BY sha256('[42,' || to_json(source_id)::VARCHAR || ']'), source_id LIMIT 50""")
def c8_form_only_selection(spark, sf):
    s = _forms(spark, sf)
    splits = s.where("article is not null").select(article_id("mhr", F.col("article")).alias("source_id")).distinct().withColumn("split", F.lit("train"))
    return C.select_form_only(s, "mhr", splits, 50, 42, 5, 50).select("source_id", "source_sent_id", F.size("forms").alias("n_forms"))


@query(f"""WITH {_MHR}, r AS (SELECT *, sha256('[42,' || to_json(source_id)::VARCHAR || ',' || to_json(sent_id)::VARCHAR || ']') AS h FROM m0 WHERE len(forms) >= 3 AND sent_id IS NOT NULL),
    b AS (SELECT source_id, arg_min(sent_id, (h, sent_id)) AS sent_id FROM r GROUP BY source_id)
    SELECT source_id, sent_id, 'DRAFT_AUTOMATIC' AS annotation_status FROM b ORDER BY sha256('[42,' || to_json(source_id)::VARCHAR || ']'), source_id LIMIT 200""")
def c7_held_out_drafts(spark, sf):
    from ..operators.selection import held_out_drafts

    s = _forms(spark, sf)
    splits = s.where("article is not null").select(article_id("mhr", F.col("article")).alias("source_id")).distinct().withColumn("split", F.lit("test"))
    return held_out_drafts(s, splits, 200, 42, "mhr").select("source_id", "sent_id", "annotation_status")


@query(f"""WITH {Q.TOKENS} SELECT count(DISTINCT (doc, sent)) AS sentences FROM gold""")
def c15_merged_translations(spark, sf):
    s = _lines(gold_tokens(spark, sf)).select(F.col("sent").cast("string").alias("sent_id"), F.concat("lines", F.array(F.lit("# text = x"))).alias("lines"))
    t = s.select("sent_id", F.lit("a sentence").alias("text_en"))
    return C.merge_translations(s, t)["sentences"].agg(F.count("*").alias("sentences"))


@query(None)
def c18_parser_evaluation(spark, sf):
    g = gold_tokens(spark, sf).withColumn("source_id", F.coalesce("source_id", F.lit("")))
    return C.evaluate_parser(g, system_tokens(g))["intervals"]


@query("""WITH b AS (SELECT id, min(lower(trim(language))) AS language, min(split) AS split, max(len(input_ids)) AS n FROM blocks WHERE language IS NOT NULL AND input_ids IS NOT NULL GROUP BY id),
    c AS (SELECT *, row_number() OVER (PARTITION BY language, split ORDER BY sha256('[1729,' || coalesce(to_json(id)::VARCHAR, 'null') || ']'), id) AS k FROM b),
    s AS (SELECT language, split, unnest(['base', 'best']) AS checkpoint, n FROM c WHERE k <= 64 AND n > 0),
    g AS (SELECT language, split, checkpoint, sum(n)::BIGINT AS n, sum(n * CASE WHEN checkpoint = 'base' THEN 4.0 ELSE 2.5 END) AS l, sum(n // 3) AS t1, sum(n // 2) AS t5 FROM s GROUP BY ALL)
    SELECT language, split, checkpoint, n, round((l / n)::DOUBLE, 6) AS loss, round(t1 / n, 6) AS accuracy, round(t5 / n, 6) AS top5_accuracy, round(exp((l / n)::DOUBLE), 6) AS perplexity FROM g""")
def c19_model_evaluation(spark, sf):
    """Masked metrics of two checkpoints over the same selected blocks (losses by arithmetic)."""
    b = table(spark, sf, "blocks").where("language is not null and input_ids is not null").groupBy("id").agg(F.min(F.lower(F.trim("language"))).alias("language"), F.min("split").alias("split"), F.max(F.size("input_ids")).alias("n"))
    scored = b.select("id", F.explode(F.array(F.lit("base"), F.lit("best"))).alias("checkpoint"), "n").where("n > 0")
    scored = scored.select("id", "checkpoint", (F.col("n") * F.when(F.col("checkpoint") == "base", 4.0).otherwise(2.5)).alias("loss_sum"), "n", F.floor(F.col("n") / 3).alias("top1"), F.floor(F.col("n") / 2).alias("top5"))
    return C.evaluate_language_model(scored, b, 64, 1729)["metrics"]


@query("SELECT vec_id, label AS base_label, label + 1 AS adapted_label FROM embeddings")
def c23_compared_predictions(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", "label")
    rows = e.withColumn("checkpoint", F.lit("base")).unionByName(e.withColumn("label", F.col("label") + 1).withColumn("checkpoint", F.lit("adapted")))
    return C.compare_predictions(rows, ["vec_id"], "base", "adapted").select("vec_id", "base_label", "adapted_label")


@query(r"""WITH s AS (SELECT row_id, regexp_extract_all(text, '[\p{L}\p{M}\p{N}]+') AS w FROM sentences WHERE text IS NOT NULL),
    t AS (SELECT row_id, unnest(w) AS surface, (generate_subscripts(w, 1) - 1)::INT AS idx FROM s) SELECT row_id, idx, surface, length(surface)::INT AS token_id FROM t""")
def c22_token_view(spark, sf):
    """Words as tokens over the joined words: index, id, span and surface."""
    w = F.regexp_extract_all("text", F.lit(r"([\p{L}\p{M}\p{N}]+)"), 1)
    s = table(spark, sf, "sentences").where("text is not null").select("row_id", w.alias("pieces"))
    start = lambda i: F.aggregate(F.slice("pieces", 1, i), F.lit(0), lambda a, x: a + F.length(x) + 1)
    s = s.withColumn("text", F.array_join("pieces", " ")).withColumn("ids", F.transform("pieces", lambda p: F.length(p)))
    s = s.withColumn("spans", F.transform("pieces", lambda p, i: F.named_struct(F.lit("start"), start(i), F.lit("end"), start(i) + F.length(p))))
    return B.token_view(s, keep=("row_id",)).select("row_id", "idx", "surface", "token_id")


# ---- whole steps -------------------------------------------------------------------------------


@query(f"""WITH RECURSIVE {_MERGED}, sizes AS (SELECT language, greatest(1, round_even(count(*) * 0.05, 0))::INT AS k FROM groups WHERE text <> '' GROUP BY language),
    r AS (SELECT root, language, text, row_number() OVER (PARTITION BY language ORDER BY sha256('[42,' || to_json(source_ids)::VARCHAR || ']'), root) AS n FROM groups WHERE text <> ''),
    parts AS (SELECT language, CASE WHEN language NOT IN ('mhr', 'udm', 'nio') THEN 'train' WHEN n <= k THEN 'test' WHEN n <= 2 * k THEN 'validation' ELSE 'train' END AS split, text FROM r JOIN sizes USING (language))
    SELECT language, split, count(*) AS documents, sum(length(text))::BIGINT AS characters FROM parts GROUP BY 1, 2""")
def c2_prepared_corpus(spark, sf):
    """The whole preparation: grouping, merge, ranked splits, overlap, representation; counts by language and split."""
    r = table(spark, sf, "corpus_records").where("language is not null and language <> ''")
    r = r.select(F.format_string("%012d", "rec_no").alias("id"), "source_ids", "text", "language")
    return C.prepare_corpus(r, table(spark, sf, "eval_items").where("text is not null"), ["mhr", "udm", "nio"])["counts"]


@query(f"""WITH {Q.TOKENS}, t AS (SELECT sent, max((lemma = '?')::INT) AS open FROM sys GROUP BY sent), r AS (SELECT source_id, source_sent_id, count(*) AS n FROM sentences WHERE row_id IN (SELECT sent FROM t) GROUP BY 1, 2)
    SELECT 'unresolved' AS name, count(*) AS n FROM t WHERE open = 1 UNION ALL SELECT 'status', count(*) FROM t UNION ALL SELECT 'split', count(*) FROM t
    UNION ALL SELECT 'repeated_source', count(*) FROM r WHERE n > 1 UNION ALL SELECT 'rows', sum(n)::BIGINT FROM r""")
def c6_prepared_targets(spark, sf):
    """One corrected round: what is wrong with it, and the rows it adds."""
    from .treebank_queries import _corrected

    none = spark.createDataFrame([], "source_id string, split string")
    out = C.prepare_targets([_corrected(spark, sf)], none, "mhr", dev_cap=1_000_000)
    bad = out["violations"].groupBy(F.col("problem").alias("name")).agg(F.count("*").alias("n"))
    return bad.unionByName(out["rows"].agg(F.count("*").alias("n")).select(F.lit("rows").alias("name"), "n"))


_RANKED = f"""{_ELIGIBLE}, hs AS (SELECT *, sha256('[42,' || to_json(source_id)::VARCHAR || ',' || to_json(sent_id)::VARCHAR || ',' || to_json(forms)::VARCHAR || ']') AS h FROM el),
    best AS (SELECT source_id, arg_min(sent_id, (h, sent_id)) AS source_sent_id, arg_min(forms, (h, sent_id)) AS forms FROM hs GROUP BY source_id),
    nth AS (SELECT *, row_number() OVER (ORDER BY sha256('[42,' || to_json(source_id)::VARCHAR || ']'), source_id) AS k FROM best)"""


@query(f"""WITH {_RANKED} SELECT 'mhr-fewshot-r1-' || lpad(k::VARCHAR, 4, '0') AS sent_id, source_id, (5 + len(forms))::INT AS n_lines, 'dep' AS last_relation FROM nth WHERE k <= 30 AND k <> 3
    UNION ALL SELECT 'violation', 'predictions', 1, NULL UNION ALL SELECT 'violation', 'reused id', 1, NULL""")
def c10_predicted_batch(spark, sf):
    """A new batch with predictions, which one sentence lacks; another's id is used already."""
    from ..operators import selection

    chosen = selection.select_batch(_eligible(spark, sf), "mhr", "r1", 30, 42)
    word = lambda f, i: F.struct(f.alias("lemma"), F.lit("NOUN").alias("upos"), F.lit("_").alias("feats"), i.alias("head"), F.lit("dep").alias("deprel"))
    made = chosen.where(~F.col("sent_id").endswith("-0003")).select("sent_id", F.transform("forms", word).alias("p"))
    out = C.predicted_batch(chosen, made, chosen.where(F.col("sent_id").endswith("-0007")).select("sent_id"))
    relation = F.element_at(F.split(F.element_at("lines", -1), "\t"), 8)
    rows = out["sentences"].select("sent_id", "source_id", F.size("lines").alias("n_lines"), relation.alias("last_relation"))
    bad = out["violations"].groupBy("problem").agg(F.count("*").cast("int").alias("n_lines"))
    return rows.unionByName(bad.select(F.lit("violation").alias("sent_id"), F.col("problem").alias("source_id"), "n_lines", F.lit(None).cast("string").alias("last_relation")))


@query(f"""WITH {_RANKED} SELECT 'mhr-fewshot-refresh-' || lpad((k - 20)::VARCHAR, 4, '0') AS sent_id, source_id FROM nth WHERE k BETWEEN 21 AND 50""")
def c11_refilled_batch(spark, sf):
    """A batch of 20 refilled to 50 from articles that it doesn't hold."""
    from ..operators import selection

    rows = _eligible(spark, sf)
    kept = selection.select_batch(rows, "mhr", "r1", 20, 42)
    history = spark.createDataFrame([], "source_id string, source_sent_id string")
    return C.refill_batch(kept, kept, rows, history, "mhr", 50, 42)["additions"].select("sent_id", "source_id")


def _reviewed(spark, sf):
    from .io_queries import _reviewed_files

    model, other = _reviewed_files(spark, sf)
    text = lambda d: d.select(F.col("pos").cast("string").alias("sent_id"), F.concat(F.array(F.concat(F.lit("# text = "), F.col("pos").cast("string"))), F.filter("lines", lambda x: ~x.startswith("# text_en"))).alias("lines"))
    return text(model), text(other)


@query(f"""WITH {Q.TOKENS}, s AS (SELECT DISTINCT sent FROM gold) SELECT 'rows' AS name, count(*) AS n FROM s UNION ALL SELECT 'differs from the analyzers'' copy', count(*) FROM s WHERE sent % 7 = 0
    UNION ALL SELECT 'no translation', count(*) FROM s WHERE sent % 11 = 0 UNION ALL SELECT 'translation ids', count(*) FROM s WHERE sent % 11 = 0""")
def c13_assembled_batch(spark, sf):
    """A batch put together from model, analyzers and translations, of which some are missing."""
    model, other = _reviewed(spark, sf)
    asked = model.select("sent_id")
    english = asked.where(F.col("sent_id").cast("bigint") % 11 != 0).withColumn("text_en", F.lit("a sentence"))
    out = C.assembled_batch(model, other, model.limit(0), asked.limit(0), english, asked, asked.count())
    bad = out["violations"].groupBy(F.col("problem").alias("name")).agg(F.count("*").alias("n"))
    return bad.unionByName(out["sentences"].agg(F.count("*").alias("n")).select(F.lit("rows").alias("name"), "n"))


@query(r"""WITH s AS (SELECT row_id, text, regexp_extract_all(text, '[\p{L}\p{M}\p{N}]+|[^\t-\r\x1c-\x20\x85\p{Z}\p{L}\p{M}\p{N}]') AS f FROM sentences WHERE text IS NOT NULL),
    k AS (SELECT * FROM s WHERE len(f) > 0) SELECT 'rows' AS name, count(*) AS n FROM k WHERE row_id % 9 <> 0 UNION ALL SELECT 'translation', count(*) FROM k WHERE row_id % 9 = 0 UNION ALL SELECT 'translation ids', count(*) FROM k WHERE row_id % 9 = 0
    UNION ALL SELECT 'article', count(*) FROM k WHERE row_id % 8 = 0""")
def c16_enriched_drafts(spark, sf):
    """Drafts with text, spacing and translation; some lack one, of some the article differs."""
    forms = F.regexp_extract_all("text", F.lit(r"(?U)([\p{L}\p{M}\p{N}]+|[^\s\x1C-\x1F\p{L}\p{M}\p{N}])"), 1)
    s = table(spark, sf, "sentences").where("text is not null").select(F.col("row_id").cast("string").alias("sent_id"), F.coalesce("article", F.lit("")).alias("article"), "text", forms.alias("forms")).where(F.size("forms") > 0)
    row = lambda f, i: F.concat_ws("\t", (i + 1).cast("string"), f, *[F.lit("_")] * 8)
    drafts = s.select("sent_id", F.when(F.col("sent_id").cast("bigint") % 8 == 0, F.concat("article", F.lit("x"))).otherwise(F.col("article")).alias("article"), "forms",
                      F.concat(F.array(F.concat(F.lit("# sent_id = "), "sent_id")), F.transform("forms", row)).alias("lines"))
    english = s.where(F.col("sent_id").cast("bigint") % 9 != 0).select("sent_id", F.lit("a sentence").alias("text_en"))
    out = C.enriched_drafts(s, drafts, english)
    bad = out["violations"].groupBy(F.col("problem").alias("name")).agg(F.count("*").alias("n"))
    return bad.unionByName(out["sentences"].agg(F.count("*").alias("n")).select(F.lit("rows").alias("name"), "n"))


@query(f"""WITH {Q.TOKENS}, r AS (SELECT form, count(DISTINCT CASE WHEN length(form) % 4 <> 0 THEN lemma || '+' || upos END) AS k FROM gold GROUP BY form),
    t AS (SELECT gold.sent, gold.form, CASE WHEN length(form) = 5 THEN 0 ELSE k END AS k FROM gold JOIN r USING (form))
    SELECT 'tokens' AS name, count(*) AS n FROM t UNION ALL SELECT 'analyzed', count(*) FROM t WHERE k > 0 UNION ALL SELECT 'candidates', sum(k)::BIGINT FROM t
    UNION ALL SELECT 'sentences', count(DISTINCT sent) FROM t UNION ALL SELECT 'forms', count(DISTINCT form) FROM t UNION ALL SELECT 'no lookup', count(DISTINCT form) FROM t WHERE length(form) = 5""")
def c17_analyzed_sentences(spark, sf):
    """Sentences with an analyzer's answers; forms of five letters were not asked."""
    g = gold_tokens(spark, sf)
    s = g.groupBy("doc", "sent").agg(F.first("source_id").alias("source_id"), F.sort_array(F.collect_list(F.struct("id", "form"))).alias("words"))
    s = s.select(F.col("sent").alias("sent_id"), "source_id", F.lit(None).cast("string").alias("source_sent_id"), "words")
    answer = F.when(F.length("form") % 4 == 0, F.concat("form", F.lit("+?"))).otherwise(F.concat("lemma", F.lit("+"), "upos"))
    out = C.analyzed_sentences(s, g.where(F.length("form") != 5).select("form", answer.alias("analysis")))
    cover = out["coverage"].select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("bigint").alias("n")) for c in ("tokens", "analyzed", "candidates")])).alias("x")).select("x.*")
    count = lambda d, name: d.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
    return cover.unionByName(count(out["sentences"], "sentences")).unionByName(count(out["forms"], "forms")).unionByName(count(out["violations"], "no lookup"))


@query(f"""WITH {Q.TOKENS} SELECT 'tokens' AS name, count(*) AS n FROM gold UNION ALL SELECT 'analyzed', count(*) FROM gold WHERE id % 4 <> 0
    UNION ALL SELECT 'candidates', sum(CASE WHEN id % 4 = 0 THEN 0 WHEN id % 2 = 0 THEN 2 ELSE 1 END)::BIGINT FROM gold UNION ALL SELECT 'form', count(*) FROM gold WHERE id % 9 = 1 AND id % 4 <> 0""")
def c17_word_analyses(spark, sf):
    """A second analyzer's candidates by word: none, one or two; of some the form differs."""
    g = gold_tokens(spark, sf).select(F.col("sent").alias("sent_id"), "id", "form", "lemma", "upos")
    wf = F.when(F.col("id") % 9 == 1, F.concat("form", F.lit("x"))).otherwise(F.col("form"))
    real = F.struct(wf.alias("wf"), F.col("lemma").alias("lemma"), F.col("upos").alias("gramm"))
    second = F.struct(F.col("form").alias("wf"), F.col("form").alias("lemma"), F.lit("X").alias("gramm"))
    nothing = F.struct(F.col("form").alias("wf"), F.lit("").alias("lemma"), F.lit("").alias("gramm"))
    c = g.select("sent_id", "id", F.explode(F.when(F.col("id") % 4 == 0, F.array(nothing)).when(F.col("id") % 2 == 0, F.array(real, second)).otherwise(F.array(real))).alias("c")).select("sent_id", "id", "c.*")
    out = C.word_analyses(g.select("sent_id", "id", "form"), c)
    cover = out["coverage"].select(F.explode(F.array(*[F.struct(F.lit(x).alias("name"), F.col(x).cast("bigint").alias("n")) for x in ("tokens", "analyzed", "candidates")])).alias("x")).select("x.*")
    return cover.unionByName(out["violations"].groupBy(F.col("problem").alias("name")).agg(F.count("*").alias("n")))
