"""Command line: ``python -m quern.cli COMMAND …``. Inputs and outputs are paths that Spark reads."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import functions as F

from . import config
from .operators import annotation, cleaning, composites, corpus, scoring, selection
from .operators import treebank as S
from .session import get_spark
from .sources import readers, sinks


def _prepare(a, spark):
    config.validate({"seed": a.seed, "validation_fraction": a.validation, "test_fraction": a.test, "overlap_words": a.overlap_words, "targets": a.targets})
    records = spark.read.parquet(a.records)
    exclusions = readers.read_exclusions(spark, a.exclude) if a.exclude else None
    out = composites.prepare_corpus(records, exclusions, a.targets, a.seed, a.validation, a.test, a.overlap_words)
    composites.require_clean(out["violations"], "preparation")
    for name in ("documents", "splits", "audit", "counts"):
        sinks.write_jsonl(out[name], f"{a.output}/{name}")


def _clean(a, spark):
    rows = corpus.clean_wiki(readers.read_wiki_csv(spark, a.csv))
    sinks.write_jsonl(rows.where("clean <> ''").select("article", F.col("clean").alias("text")), f"{a.output}/documents")
    sinks.write_jsonl(rows.select("article", F.explode("audit").alias("a")).select("article", "a.*"), f"{a.output}/audit")


def _validate(a, spark):
    s = readers.read_conllu(spark, a.path)
    bad = s.select("file", "sent_no", F.explode(S.tree_violations(S.words(F.col("lines")), not a.form_only)).alias("problem"))
    bad.show(a.show, False)
    composites.require_clean(bad, a.path)


def _tokens(spark, path):
    """Words of treebank files, a document for each file; a single file is one whatever its name."""
    read = readers.read_conllu(spark, path)
    single = len(read.select("file").distinct().limit(2).collect()) < 2
    doc = F.lit("d") if single else F.regexp_extract("file", "[^/]+$", 0)
    s = read.withColumn("m", S.metadata(F.col("lines"))).withColumn("w", S.words(F.col("lines")))
    s = s.select(doc.alias("doc"), F.col("sent_no").alias("sent"), "m", F.explode("w").alias("w"))
    return s.select("doc", "sent", F.try_element_at("m", F.lit("source_id")).alias("source_id"), "w.*")


def _print(df) -> None:
    print(json.dumps([r.asDict() for r in df.collect()], ensure_ascii=False))


def _score(a, spark):
    _print(scoring.metrics(_tokens(spark, a.gold), _tokens(spark, a.system)).orderBy("metric"))  # 13 rows


def _evaluate(a, spark):
    config.validate({"repeats": a.repeats, "seed": a.seed})
    out = composites.evaluate_parser(_tokens(spark, a.gold), _tokens(spark, a.system), a.repeats, a.seed)
    composites.require_clean(out["violations"], "gold and system hold other characters")
    for name in ("metrics", "articles", "intervals"):
        sinks.write_jsonl(out[name], f"{a.output}/{name}")
    _print(out["intervals"])


def _compare(a, spark):
    config.validate({"repeats": a.repeats, "seed": a.seed})
    read = lambda p: readers.read_jsonl(spark, p, "source_id string, tokens bigint, head_ok bigint, both_ok bigint")
    out = composites.compare_runs(read(a.first), read(a.second), a.repeats, a.seed)
    composites.require_clean(out["violations"], "articles that don't pair")
    _print(out["differences"])


def _splits(spark, path):
    known, bad = selection.source_splits(readers.read_jsonl(spark, path, "source_ids array<string>, split string"))
    composites.require_clean(bad, "sources in several splits")
    return known


def _drafts(a, spark):
    config.validate({"per_language": a.per_language, "seed": a.seed})
    out = selection.held_out_drafts(spark.read.parquet(a.sentences), _splits(spark, a.splits), a.per_language, a.seed, a.language)
    sinks.write_jsonl(out, a.output)


def _select(a, spark):
    config.validate({"count": a.count, "seed": a.seed, "min_words": a.min_words, "max_words": a.max_words})
    none = "source_id string, source_sent_id string"
    used = readers.read_jsonl(spark, a.used, none) if a.used else spark.createDataFrame([], none)
    dev = readers.read_jsonl(spark, a.dev_articles, "source_id string") if a.dev_articles else spark.createDataFrame([], "source_id string")
    rows = selection.eligible(spark.read.parquet(a.sentences), a.language, _splits(spark, a.splits), used, dev, a.min_words, a.max_words)
    sinks.write_jsonl(selection.select_batch(rows, a.language, a.round, a.count, a.seed), a.output)


def _clean_rows(a, spark):
    preferred = readers.read_jsonl(spark, a.preferred, "text string, sent_id string") if a.preferred else None
    rows, audit = cleaning.clean_rows(spark.read.parquet(a.rows), spark.read.parquet(a.dictionary), preferred=preferred)
    sinks.write_jsonl(rows, f"{a.output}/rows")
    sinks.write_jsonl(audit, f"{a.output}/audit")


def _treebank(a, spark):
    config.validate({"seed": a.seed})
    out = composites.prepare_treebank(readers.read_conllu(spark, a.path), a.language, a.seed)
    composites.require_clean(out["violations"], a.path)
    for split in ("train", "dev", "test"):
        part = out["sentences"].where(F.col("split") == split)
        if not part.isEmpty():
            sinks.write_conllu(part, f"{a.output}/{split}.conllu", ["file", "sent_no"])


def _gold(a, spark):
    bad = annotation.gold_violations(readers.read_conllu(spark, a.path), _splits(spark, a.splits), a.language, a.count)
    composites.require_clean(bad, a.path)


def _publish(a, spark):
    """Each language's two files are compared, then all are copied; nothing is copied if any differ."""
    with open(f"{a.review}/manifest.json", encoding="utf-8") as f:
        recorded = json.load(f)["files"]
    kinds = [f"{g}-{k}.conllu" for g in a.languages for k in ("model-review", "fst")]
    pos = lambda n: readers.read_conllu(spark, f"{a.review}/{n}").select(F.col("sent_no").alias("pos"), "lines")
    for model, other in zip(kinds[::2], kinds[1::2]):
        composites.require_clean(annotation.publication_violations(pos(model), pos(other)), model)
    _ = sinks.publish({n: f"{a.review}/{n}" for n in kinds}, a.output, recorded)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quern")
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("prepare", help="groups, splits, overlap removal")
    c.add_argument("records"), c.add_argument("output")
    c.add_argument("--targets", nargs="+", default=["mhr", "udm", "nio"])
    c.add_argument("--seed", type=int, default=42), c.add_argument("--validation", type=float, default=0.05), c.add_argument("--test", type=float, default=0.05)
    c.add_argument("--overlap-words", type=int, default=12), c.add_argument("--exclude")
    c.set_defaults(run=_prepare)
    c = sub.add_parser("clean-wiki", help="clean a wiki CSV")
    c.add_argument("csv"), c.add_argument("output"), c.set_defaults(run=_clean)
    c = sub.add_parser("validate", help="check the trees of treebank files")
    c.add_argument("path"), c.add_argument("--form-only", action="store_true"), c.add_argument("--show", type=int, default=20), c.set_defaults(run=_validate)
    c = sub.add_parser("score", help="score system against gold treebank files")
    c.add_argument("gold"), c.add_argument("system"), c.set_defaults(run=_score)

    def resampling(c):
        c.add_argument("--repeats", type=int, default=1000), c.add_argument("--seed", type=int, default=1729)

    def selecting(c):
        c.add_argument("sentences"), c.add_argument("splits"), c.add_argument("output")
        c.add_argument("--language", required=True), c.add_argument("--seed", type=int, default=42)

    c = sub.add_parser("evaluate", help="scores, counts by article and intervals of a system's treebank files")
    c.add_argument("gold"), c.add_argument("system"), c.add_argument("output"), resampling(c), c.set_defaults(run=_evaluate)
    c = sub.add_parser("compare", help="paired differences of two runs' counts by article")
    c.add_argument("first"), c.add_argument("second"), resampling(c), c.set_defaults(run=_compare)
    c = sub.add_parser("drafts", help="one sentence of each test article, to be annotated")
    selecting(c), c.add_argument("--per-language", type=int, default=200), c.set_defaults(run=_drafts)
    c = sub.add_parser("select", help="a new batch of sentences of training articles")
    selecting(c), c.add_argument("--round", required=True), c.add_argument("--count", type=int, default=200), c.add_argument("--min-words", type=int, default=5), c.add_argument("--max-words", type=int, default=50)
    c.add_argument("--used"), c.add_argument("--dev-articles"), c.set_defaults(run=_select)
    c = sub.add_parser("clean-rows", help="boilerplate, language filter and duplicates of target rows")
    c.add_argument("rows"), c.add_argument("dictionary"), c.add_argument("output"), c.add_argument("--preferred"), c.set_defaults(run=_clean_rows)
    c = sub.add_parser("treebank", help="internal split of a treebank without one")
    c.add_argument("path"), c.add_argument("output"), c.add_argument("--language", required=True), c.add_argument("--seed", type=int, default=42), c.set_defaults(run=_treebank)
    c = sub.add_parser("gold", help="check a gold treebank file")
    c.add_argument("path"), c.add_argument("splits"), c.add_argument("--language", required=True), c.add_argument("--count", type=int, default=200), c.set_defaults(run=_gold)
    c = sub.add_parser("publish", help="compare and copy the reviewed files")
    c.add_argument("review"), c.add_argument("output"), c.add_argument("--languages", nargs="+", default=["mhr", "udm"]), c.set_defaults(run=_publish)
    return p


def main(args: list[str] | None = None, spark=None) -> None:
    a = parser().parse_args(args)
    a.run(a, spark or get_spark())


if __name__ == "__main__":
    main()
