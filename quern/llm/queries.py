"""Queries of the operators for training data, by problem number."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stored, table
from . import dedup, groups, langid, leaks, lines, mixing, reading, tokens

#: Folder of the public tokenizers' files; nothing of it is copied here.
TOKENIZERS = os.environ.get("QUERN_TOKENIZERS", "/opt/tokenizers")


#: End of the first delivery of :func:`p3_deliveries`.
EARLY = "2024-11-01"


def _vocabulary(name: str = "byte_bpe_50k.json") -> str:
    return os.path.join(TOKENIZERS, name)


def p1_token_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_budget(table(spark, sf_dir, "documents"), _vocabulary())


def p1_doc_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.document_tokens(table(spark, sf_dir, "documents"), _vocabulary())


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode_corpus(table(spark, sf_dir, "documents"), _vocabulary())


def p7_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose decoded ids differ from their text; none are expected."""
    docs = table(spark, sf_dir, "documents")
    back = tokens.decode_corpus(tokens.encode_corpus(docs, _vocabulary()), _vocabulary())
    return (
        docs.select("doc_id", F.coalesce("text", F.lit("")).alias("was"))
        .join(back, "doc_id")
        .agg(F.count("*").alias("n_docs"), F.sum((F.col("was") != F.col("text")).cast("bigint")).alias("n_changed"))
    )


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.wrong_labels(table(spark, sf_dir, "sentences"), langid.read_samples(table(spark, sf_dir, "lang_samples")))


def p2_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.label_passages(table(spark, sf_dir, "sentences"), langid.read_samples(table(spark, sf_dir, "lang_samples")))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.copies(table(spark, sf_dir, "sentences"))


def p5_collapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.collapse(table(spark, sf_dir, "sentences"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.repeated_lines(table(spark, sf_dir, "sentences"), unnamed=True)


def p6_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.remove_repeated_lines(table(spark, sf_dir, "sentences"), unnamed=True)


def p6_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The closed frequent sequences of lines of each source."""
    return lines.named(lines.closed_sequences(stored(lines.line_table(table(spark, sf_dir, "sentences")), "lines")))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups.related_pairs(table(spark, sf_dir, "corpus_records"))


def p3_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups.assign_splits(table(spark, sf_dir, "corpus_records"))[0]


def p3_deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Splits after two deliveries: what was updated before ``EARLY``, then the rest."""
    records = table(spark, sf_dir, "corpus_records")
    early = F.coalesce(F.col("updated_at") < F.lit(EARLY).cast("timestamp"), F.lit(True))
    _, state = groups.assign_splits(records.where(early))
    _, state = groups.assign_splits(records.where(~early), stored(state, "splits"))
    return state.where("node like 'r%'").select(F.substring("node", 2, 20).cast("bigint").alias("rec"), "component", "split", "status")


def p3_same_again(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table after the same delivery twice, against that after the first: nothing differs."""
    records = table(spark, sf_dir, "corpus_records")
    _, once = groups.assign_splits(records)
    once = stored(once, "splits")
    _, twice = groups.assign_splits(records, once)
    state = lambda t, k: t.select("node", F.struct("component", "split", "n_records", (F.col("status") == groups.QUARANTINED).alias("apart")).alias(k))
    both = state(once, "a").join(state(twice, "b"), "node", "full")
    return both.agg(
        F.count_if(F.col("node").startswith("r")).alias("n_records"), F.count_if(F.col("a").isNull() | F.col("b").isNull()).alias("n_other"), F.count_if(F.col("a") != F.col("b")).alias("n_changed")
    )


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.unreachable(table(spark, sf_dir, "blocks"), table(spark, sf_dir, "mix_targets"))


def p4_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(table(spark, sf_dir, "blocks"), table(spark, sf_dir, "mix_targets"))


def p4_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_copies(table(spark, sf_dir, "blocks"), table(spark, sf_dir, "mix_targets"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.leaked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p8_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.without_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")).select("doc_id")


def p9_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading.reading_bands(table(spark, sf_dir, "documents"), table(spark, sf_dir, "reading_labels"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p9_grades(spark, sf_dir).select("doc_id", "band")


QUERIES = {f.__name__: f for f in (p1_token_budget, p1_doc_tokens, p2_found, p2_passages, p3_found, p3_splits, p3_deliveries, p3_same_again, p4_found, p4_report, p4_copies, p5_found, p5_collapsed, p6_found, p6_removed, p6_sequences, p7_ids, p7_round_trip, p8_found, p8_kept, p9_found, p9_grades)}

_P4_TARGETS = """
t AS (SELECT mix, language, max_repeats, weight / sum(weight) OVER (PARTITION BY mix) * budget_tokens AS wanted FROM mix_targets),
b AS (SELECT id, min(nullif(lower(trim(language)), '')) AS language, max(len(list_filter(special_tokens_mask, lambda x: x = 0))) AS n
      FROM blocks WHERE split = 'train' GROUP BY id),
s AS (SELECT language, sum(coalesce(n, 0)) AS stock FROM b GROUP BY language)"""

ORACLE: dict[str, str] = {
    "p3_same_again": "SELECT count(DISTINCT rec_no) AS n_records, 0::BIGINT AS n_other, 0::BIGINT AS n_changed FROM corpus_records",
    "p4_found": f"""WITH {_P4_TARGETS}
        SELECT mix, language FROM t LEFT JOIN s USING (language) WHERE wanted > coalesce(stock, 0) * max_repeats""",
}
