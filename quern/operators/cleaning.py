"""Language filter, boilerplate and exact deduplication of target-language rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import cut

# Fixed values of the language filter: letters that only target languages have, words that
# never count as Russian, and Russian words that the dictionary lacks.
TARGET_LETTERS = "ӱӧҥӝӟӥӵӹӓӫöä"
TARGET_WORDS = {
    "mhr": ["дене", "деч", "але", "уло", "огыл", "тудо", "тиде", "влак", "россий", "ий", "кече", "ял", "сола", "шке", "лийын", "шоген", "марте"],
    "udm": ["пыре", "гурт", "гуртын", "сярысь", "вал", "вань", "луэ", "быдэ", "со", "татын", "шур", "шуре", "арын", "но", "кун",
            "выль", "вуон", "сылон", "кошкон", "кыл", "уж", "крезьгур"],
}
RUSSIAN_EXTRA = """финно угроведов угроведение угроведения угроведению финноугроведения финноугроведению
финноугроведение священномученик бесермян конф науч научн практ посвящ посвящён посвящен отв междунар
всерос филол докл тр авт респ пед межвуз техн студ практич межд кл волжско марийско русско историко
северо карело гражданско романо лугово угристика ревитализации билингвальной контактологии
деятельностного удмуртоведение фольклорно лит литературоведческий сост ред изд""".split()
# Fixed value: the notice that one site puts behind its pages.
BOILERPLATE = (
    r"Торалык Яндекс\.Карт(?:е-влак(?:ын)?|ын) "
    r"ӱзгар(?:ын|ыштын|тын) полышышт дене висалтын\."
)
UDMURT_ENDINGS = r"(?:ысь|лэн|лэсь|ъёс)$"
RUSSIAN_SPELLING = "^[а-яё]+$"


def language_decision(
    rows: DataFrame, dictionary: DataFrame, id_col: str = "sent_id", text_col: str = "text", lang_col: str = "language"
) -> DataFrame:
    """``(id, reason)``: ``ukrainian``, ``russian_only`` or null (keep) for every row.

    ``rows`` carries ``labels`` and ``probs``, the identifier's three best guesses. Rules apply in
    order; only rows that no earlier rule decides are exploded into words and meet the dictionary.
    """
    low = F.lower(F.coalesce(F.col(text_col), F.lit("")))
    words = T.letter_words(F.coalesce(F.col(text_col), F.lit("")))
    lows = F.transform(words, F.lower)
    lang = F.col(lang_col)
    prob = lambda code: F.coalesce(F.try_element_at(F.col("probs"), F.array_position("labels", code).cast("int") + F.when(F.array_position("labels", code) == 0, 99).otherwise(0)), F.lit(0.0))
    protected = F.lit(False)
    for code, listed in TARGET_WORDS.items():
        protected = protected | ((lang == code) & F.arrays_overlap(lows, F.array(*map(F.lit, listed))))
    keep = low.rlike(f"[{TARGET_LETTERS}]") | protected | ((lang == "udm") & F.exists(lows, lambda w: w.rlike(UDMURT_ENDINGS)))
    keep = F.coalesce(keep, F.lit(False))
    ukrainian = F.coalesce(~keep & (lang == "mhr") & (prob("uk") >= 0.8) & low.rlike("[іїєґ]"), F.lit(False))
    judged = rows.select(
        F.col(id_col).alias("id"), keep.alias("keep"), ukrainian.alias("uk"), words.alias("words"),
        F.try_element_at("labels", F.lit(1)).alias("top"), F.coalesce(F.try_element_at("probs", F.lit(1)), F.lit(0.0)).alias("p"),
    )
    open_ = judged.where(~F.col("keep") & ~F.col("uk") & (F.col("top") == "ru") & (F.col("p") >= 0.5))
    each = open_.select("id", "p", F.explode("words").alias("w")).withColumn("l", F.lower("w"))
    spelled = F.col("l").rlike(RUSSIAN_SPELLING)
    listed = dictionary.select(F.lower("word").alias("l")).unionByName(
        dictionary.sparkSession.createDataFrame([(w,) for w in RUSSIAN_EXTRA], "l string")
    ).distinct().withColumn("hit", F.lit(1))
    found = (
        each.join(listed, "l", "left")
        .groupBy("id", "p")
        .agg(
            F.countDistinct(F.when(spelled & (F.col("hit") == 1), F.col("l"))).alias("known_kinds"),
            F.count_if(spelled & (F.col("hit") == 1)).alias("known"),
            F.count_if(~spelled | F.col("hit").isNull()).alias("unknown"),
            F.count_if((~spelled | F.col("hit").isNull()) & ~(spelled & F.col("w").rlike(r"^\p{Lu}"))).alias("not_names"),
        )
    )
    russian = found.where(
        ((F.col("known") > 0) & (F.col("unknown") == 0)) | ((F.col("known") >= 4) & (F.col("not_names") == 0) & (F.col("p") >= 0.8))
    ).select("id", F.lit(True).alias("ru"))
    return judged.join(russian, "id", "left").select("id", F.when(F.col("uk"), "ukrainian").when(F.coalesce("ru", F.lit(False)), "russian_only").alias("reason"))


def deduplicate(rows: DataFrame, text: Column, order: list[str], id_col: str = "sent_id", preferred: Column | None = None) -> DataFrame:
    """Adds ``kept_sent_id`` and ``is_kept``: of each text the first row, or the preferred one.

    Winners come from a combining aggregation over the text's digest, so a text with very many
    rows is one row for each task; the join back is one that adaptive execution can split.
    Rows with a null text are all kept. ``order`` with the id must tell the rows apart.
    """
    behind = F.when(F.coalesce(preferred, F.lit(False)), 0).otherwise(1) if preferred is not None else F.lit(1)
    keyed = rows.withColumn("__t", F.sha2(text, 256)).withColumn("__o", F.struct(behind.alias("b"), *[F.col(c) for c in order], F.col(id_col).alias("__id")))
    winners = keyed.where("__t is not null").groupBy("__t").agg(F.min("__o").alias("__w")).withColumnRenamed("__t", "__k")
    joined = keyed.join(winners, F.col("__t") == F.col("__k"), "left")
    return (
        joined.withColumn("kept_sent_id", F.when(F.col("__t").isNull(), F.col(id_col)).otherwise(F.col("__w")["__id"]))
        .withColumn("is_kept", F.col("__t").isNull() | F.col("__o").eqNullSafe(F.col("__w")))
        .drop("__t", "__o", "__k", "__w")
    )


def reason_histogram(audit: DataFrame) -> DataFrame:
    """``(reason, n)``: audit entries by reason, or by action where they have none."""
    return audit.groupBy(F.coalesce("reason", "action").alias("reason")).agg(F.count("*").alias("n"))


def protected_ids(rows: DataFrame, language: str = "mhr", last: int = 36, id_col: str = "sent_id", lang_col: str = "language") -> DataFrame:
    """Adds ``protected``: rows of the language whose id's third part, between hyphens, is at most ``last``."""
    number = F.try_element_at(F.split(id_col, "-"), F.lit(3)).try_cast("int")
    return rows.withColumn("protected", F.coalesce((F.lower(F.trim(lang_col)) == language) & (number <= last), F.lit(False)))


def clean_rows(
    rows: DataFrame, dictionary: DataFrame, pattern: str = BOILERPLATE, stripped: tuple[str, ...] = ("mhr",), preferred: DataFrame | None = None, id_col: str = "sent_id", order: str = "pos"
) -> tuple[DataFrame, DataFrame]:
    """The cleaning steps in their order: boilerplate, language filter, then duplicates among what is left.

    ``rows`` is ``(sent_id, pos, language, text, labels, probs)`` with optional ``protected``; a
    protected row passes by the first two steps. Boilerplate is cut from rows of the ``stripped``
    languages. Of rows with one final text the first in order is kept, or the one that
    ``preferred``, ``(text, sent_id)``, names for it. A row that the filter removes never wins.

    Returns the kept rows ``(sent_id, pos, language, text)``, and the audit ``(sent_id, text, action,
    reason, cleaned_text, kept_sent_id)``: one entry for every row removed and every text changed.
    A null text is kept and is no duplicate.
    """
    protected = F.coalesce(F.col("protected"), F.lit(False)) if "protected" in rows.columns else F.lit(False)
    strips = ~protected & F.col("language").isin(*stripped) & F.col("text").rlike(pattern)
    final = F.when(F.coalesce(strips, F.lit(False)), T.strip(F.regexp_replace("text", pattern, ""))).otherwise(F.col("text"))
    read = rows.select(F.col(id_col).alias("id"), F.col(order).alias("pos"), "language", "text", "labels", "probs", protected.alias("protected"), final.alias("final"))
    read = cut(read.withColumn("changed", F.coalesce(F.col("final") != F.col("text"), F.lit(False)))).withColumn("key", F.monotonically_increasing_id())
    bare = F.coalesce(F.col("changed") & ~F.col("final").rlike(r"[\p{L}\p{N}]"), F.lit(False))
    decided = language_decision(read.where(~F.col("protected") & ~bare), dictionary, "key", "final", "language").where("reason is not null").select(F.col("id").alias("key"), "reason")
    judged = cut(read.join(decided, "key", "left").select("id", "pos", "language", "text", "final", "changed", F.when(bare, "boilerplate_only").otherwise(F.col("reason")).alias("reason")))
    left = judged.where("reason is null").select("id", "pos", "language", "text", "final", "changed")
    choice = None
    if preferred is not None:
        wanted = preferred.select(F.col("text").alias("__pt"), F.col("sent_id").alias("__pi"), F.lit(True).alias("__p")).distinct()
        left = left.join(wanted, (F.col("final") == F.col("__pt")) & (F.col("id") == F.col("__pi")), "left").drop("__pt", "__pi")
        choice = F.col("__p")
    settled = deduplicate(left, F.col("final"), ["pos"], "id", choice)
    none = F.lit(None).cast("string")
    entry = lambda t, action, reason, cleaned, kept: t.select(F.col("id").alias(id_col), "text", F.lit(action).alias("action"), reason.alias("reason"), cleaned.alias("cleaned_text"), kept.alias("kept_sent_id"))
    nobody = F.lit(None).cast(rows.schema[id_col].dataType)
    audit = (
        entry(judged.where("reason is not null"), "remove", F.col("reason"), none, nobody)
        .unionByName(entry(judged.where("reason is null and changed"), "strip_boilerplate", none, F.col("final"), nobody))
        .unionByName(entry(settled.where(~F.col("is_kept")).withColumn("text", F.col("final")), "remove", F.lit("duplicate_text"), none, F.col("kept_sent_id")))
    )
    return settled.where("is_kept").select(F.col("id").alias(id_col), "pos", "language", F.col("final").alias("text")), audit
