"""The cleaning steps on their edge cases."""

from pyspark.sql import functions as F

from quern.operators import annotation as A
from quern.operators import cleaning as C

ROW = "sent_id string, pos int, language string, text string, labels array<string>, probs array<double>, protected boolean"
NOTICE = "Торалык Яндекс.Картын ӱзгарын полышышт дене висалтын."


def _row(i, text, lang="mhr", top="mhr", p=0.9, protected=False, sid=None):
    return (sid or f"s{i}", i, lang, text, [top, "uk", "xx"], [p, 0.05, 0.05], protected)


def test_clean_rows(spark):
    ru = "дом стоит здесь"
    rows = [
        _row(1, ru, top="ru"),  # removed by the filter, must not win its text
        _row(2, ru, top="ru", protected=True),  # protected rows pass by the filter
        _row(3, ru, lang="udm", top="udm", p=0.4),
        _row(4, f"Ола {NOTICE}"), _row(5, "Ола"), _row(6, "Ола"),
        _row(7, NOTICE), _row(8, NOTICE, lang="udm", top="udm"), _row(9, NOTICE, protected=True),
        _row(10, None), _row(11, None), _row(12, ""), _row(13, "Ӱдыр", top="ru"), _row(14, "один", top="ru"), _row(14, "Ола кугу", sid="s14"),
    ]
    df = spark.createDataFrame(rows, ROW).withColumn("key", F.lit("clash")).withColumn("reason", F.lit("clash"))
    words = spark.createDataFrame([("дом",), ("Стоит",), ("здесь",), ("один",), (None,)], "word string")
    preferred = spark.createDataFrame([("Ола", "s6"), ("Ола", "zz"), (None, "s1")], "text string, sent_id string")
    kept, audit = C.clean_rows(df, words, preferred=preferred)
    assert {(r.sent_id, r.pos, r.text) for r in kept.collect()} == {("s2", 2, ru), ("s6", 6, "Ола"), ("s8", 8, NOTICE), ("s10", 10, None), ("s11", 11, None), ("s12", 12, ""), ("s13", 13, "Ӱдыр"), ("s14", 14, "Ола кугу")}
    got = {(r.sent_id, r.action, r.reason, r.cleaned_text, r.kept_sent_id) for r in audit.collect()}
    assert got == {
        ("s1", "remove", "russian_only", None, None), ("s14", "remove", "russian_only", None, None), ("s7", "remove", "boilerplate_only", None, None), ("s4", "strip_boilerplate", None, "Ола", None),
        ("s3", "remove", "duplicate_text", None, "s2"), ("s4", "remove", "duplicate_text", None, "s6"), ("s5", "remove", "duplicate_text", None, "s6"), ("s9", "remove", "duplicate_text", None, "s8"),
    }
    assert {r.reason: r.n for r in C.reason_histogram(audit).collect()} == {"russian_only": 2, "boilerplate_only": 1, "strip_boilerplate": 1, "duplicate_text": 4}
    k, a = C.clean_rows(df.limit(0), words)
    assert k.count() == 0 == a.count()


def test_protected_ids(spark):
    df = spark.createDataFrame([("mhr-f-36", " MHR "), ("mhr-f-37", "mhr"), ("mhr-f-1", "udm"), ("mhr-f", "mhr"), (None, "mhr"), ("mhr-f-2", None), ("a-b-x", "mhr")], "sent_id string, language string")
    assert [r.protected for r in C.protected_ids(df).collect()] == [True] + [False] * 6


def _tokens(*forms, misc=()):
    return [f"{i}\t{f}\tl\tN\tx\ty\t1\tr\td\t{dict(misc).get(i, '_')}" for i, f in enumerate(forms, 1)]


def test_strip_boilerplate(spark):
    blank = "\t_" * 7
    sentences = [
        ["# text = Ола Яш. кугу", "# text_en = x", *_tokens("Ола", "Яш", ".", "кугу", misc={1: "A=b|SpaceAfter=No", 4: "Z=1"}.items())],
        ["# text = Ола", *_tokens("Ола")],
        [*_tokens("Яш", ".")],
        ["# text = Яш. Яш.", *_tokens("Яш", ".", "Яш", ".")],
        ["# text = ОлаЯш.ош", *_tokens("ОлаЯш.ош")],
        ["# text = Яш. ола", "1-2\tЯш.\t_\t_\t_\t_\t_\t_\t_\t_", *_tokens("Яш", ".", "ола")],
        ["# text = Яш. ола", *_tokens("Яш", ".", "олак")],
        ["# text = Яш. ола", *_tokens("Яш", ".")],
        [],
        None,
    ]
    df = spark.createDataFrame([(x,) for x in sentences], "lines array<string>")
    got = [r.b for r in df.select(A.strip_boilerplate(F.col("lines"), r"Яш\.").alias("b")).collect()]
    assert got[0].lines == ["# text = Ола  кугу", f"1\tОла{blank}\tA=b|SpaceAfter=No", f"2\tкугу{blank}\tZ=1"] and got[0].changed
    assert [(x.lines, x.changed) for x in got[1:3]] == [(s, False) for s in sentences[1:3]]
    assert (got[3].lines, got[3].changed, got[3].problem) == (None, True, None)
    assert got[4].lines == ["# text = Олаош", f"1\tОлаош{blank}\t_"]
    assert [(x.lines, x.problem) for x in got[5:8]] == [(None, "no_simple_words"), (None, "absent_form"), (None, "no_token_left")]
    assert got[8].lines == [] and not got[8].changed and got[9].lines is None
