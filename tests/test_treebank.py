import csv
import json
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from quern.operators import annotation as A
from quern.operators import scoring
from quern.operators import treebank as S
from quern.sources import readers, sinks

ONE = "# sent_id = s1\n# text = Мый толам.\n1\tМый\tмый\tPRON\t_\tCase=Nom\t2\tnsubj\t_\t_\n2\tтолам\tтолаш\tVERB\t_\t_\t0\troot\t_\tSpaceAfter=No\n3\t.\t.\tPUNCT\t_\t_\t2\tpunct\t_\t_\n"
TWO = "# sent_id = s0\n# sent_id = s2\n1-2\tдома\t_\t_\t_\t_\t_\t_\t_\tSpaceAfter=No\n1\tв\tв\tADP\t_\t_\t2\tcase\t_\t_\n2\tдоме\tдом\tNOUN\t_\tNumber=Sing|Case=Loc\t0\troot\t_\t_\n2.1\tx\t_\t_\t_\t_\t_\t_\t_\t_\n"


def _bank(spark, tmp_path, text):
    p = tmp_path / "a.conllu"
    p.write_text(text, encoding="utf-8", newline="\n")
    return str(p)


def test_reader_keeps_lines_and_order(spark, tmp_path):
    path = _bank(spark, tmp_path, ONE + "\t \n\n" + TWO)
    got = readers.read_conllu(spark, path).orderBy("sent_no").collect()
    assert ["\n".join(r.lines) + "\n" for r in got] == [ONE, TWO]
    readers.register(spark)
    streamed = spark.read.format("treebank").load(str(tmp_path)).orderBy("sent_no").collect()
    assert [r.lines for r in streamed] == [r.lines for r in got]
    m = [r.m for r in readers.read_conllu(spark, path).orderBy("sent_no").select(S.metadata(F.col("lines")).alias("m")).collect()]
    assert m == [{"sent_id": "s1", "text": "Мый толам."}, {"sent_id": "s2"}]
    w = S.word_table(readers.read_conllu(spark, path), ["sent_no"]).orderBy("sent_no", "id").collect()
    assert [(r.id, r.form, r["head"]) for r in w] == [(1, "Мый", 2), (2, "толам", 0), (3, ".", 2), (1, "в", 2), (2, "доме", 0)]


def test_sink_round_trip(spark, tmp_path):
    path = _bank(spark, tmp_path, ONE + "\n" + TWO + "\n")
    sinks.write_conllu(readers.read_conllu(spark, path).coalesce(1), str(tmp_path / "out"), ["sent_no"])
    part = "".join(p.read_text(encoding="utf-8") for p in sorted((tmp_path / "out").glob("part-*")))
    assert part == ONE + "\n" + TWO + "\n"


def test_exclusions(spark, tmp_path):
    (tmp_path / "a.conllu").write_text(ONE + "\n" + TWO, encoding="utf-8")
    (tmp_path / "b.txt").write_text("строка\n\nещё\n", encoding="utf-8")
    assert sorted(r.text for r in readers.read_exclusions(spark, str(tmp_path)).collect()) == sorted(["Мый толам.", "в доме", "строка", "ещё"])


def test_wiki_csv_and_document(spark, tmp_path):
    p = tmp_path / "w.csv"
    p.write_text('﻿article,text\nA,"x ""q""\ny"\n,z\n', encoding="utf-8")
    got = readers.number_records(readers.read_wiki_csv(spark, str(p))).collect()
    assert [(r.article, r.text, r.record) for r in got] == [("A", 'x "q"\ny', 2), (None, "z", 3)]
    bad = tmp_path / "b.csv"
    bad.write_text("a,b\n1,2\n")
    with pytest.raises(ValueError):
        readers.read_wiki_csv(spark, str(bad))
    d = tmp_path / "d.txt"
    d.write_text(" one \n\n two\n")
    assert readers.read_document(spark, str(d)).first().text == "one\ntwo"


def test_tei_archive(spark, tmp_path):
    xml = """<TEI xmlns="http://www.tei-c.org/ns/1.0"><text><body><annotationBlock who="S1"><u><seg type="utterance" xml:id="u1"><w>мый</w> <w> то<i>лам</i></w><w> </w></seg><seg type="other"><w>x</w></seg></u>
    <spanGrp><span><w>noise</w></span></spanGrp></annotationBlock></body></text></TEI>"""
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("b/rec2_tei.xml", xml)
        z.writestr("rec1_tei.xml", xml)
        z.writestr("other.xml", "<x/>")
    got = readers.read_tei_archives(spark, str(tmp_path / "z.zip")).collect()
    assert [(r.text, r.recording, r.utterance_id, r.speaker, r.member) for r in got] == [("мый толам", "rec2", "u1", "S1", "b/rec2_tei.xml"), ("мый толам", "rec1", "u1", "S1", "rec1_tei.xml")]


def test_sinks(spark, tmp_path):
    sinks.write_json(str(tmp_path / "a.json"), {"ӱ": 1})
    assert json.loads((tmp_path / "a.json").read_text(encoding="utf-8")) == {"ӱ": 1}
    with pytest.raises(ValueError):
        sinks.write_json(str(tmp_path / "b.json"), float("inf"))
    assert not (tmp_path / "b.json").exists()
    with pytest.raises(FileExistsError):
        sinks.fresh(str(tmp_path))
    log = sinks.EventLog(str(tmp_path / "log.jsonl"))
    log.event("train", step=1)
    log.event("stop")
    assert readers.read_jsonl(spark, str(tmp_path / "log.jsonl"), "time string, event string, step int").count() == 2
    folder = tmp_path / "m"
    folder.mkdir()
    (folder / "d.jsonl").write_text('{"x":1}\n')
    sinks.write_manifest(str(folder), ["d.jsonl"], seed=42)
    assert sinks.load_verified(spark, str(folder), "d.jsonl", "x int").first().x == 1
    (folder / "d.jsonl").write_text('{"x":2}\n')
    with pytest.raises(ValueError):
        sinks.load_verified(spark, str(folder), "d.jsonl", "x int")
    done = sinks.publish({"a.json": str(tmp_path / "a.json")}, str(tmp_path / "pub"))
    assert set(done) == {"a.json"}
    f = tmp_path / "t.txt"
    f.write_text("old")
    from quern.functions.hashing import file_hash

    with pytest.raises(ValueError):
        sinks.staged_apply({str(f): ("0", b"new")}, str(tmp_path / "bk0"))
    assert f.read_text() == "old"
    sinks.staged_apply({str(f): (file_hash(str(f)), b"new")}, str(tmp_path / "bk"))
    assert f.read_text() == "new" and next((tmp_path / "bk").iterdir()).read_text() == "old"


def _words(spark, rows):
    return spark.createDataFrame([(r,) for r in rows], "w array<struct<id:int,head:int,deprel:string>>")


def test_tree_violations(spark):
    rows = [[(1, 0, "root"), (2, 1, "obj")], [(1, 2, "obj"), (2, 1, "obj")], [(1, 0, "obj")], [(1, 5, "obj"), (2, 0, "root")], [(2, 0, "root")], [(1, 1, "obj"), (2, 0, "root")], []]
    got = [r.v for r in _words(spark, rows).select(S.tree_violations(F.col("w")).alias("v")).collect()]
    assert got == [[], ["root_count", "cycle"], ["root_relation"], ["head_range"], ["ids"], ["self_loop", "cycle"], ["empty", "ids", "root_count"]]


def test_vocabulary(spark):
    t = spark.createDataFrame([("a", "a", "NOUN", "Case=Nom", "obl:x"), ("ab", "a", "_", "_", "root"), ("b", "b", "ADJ", "Case=Acc|N=1", "_")], "form string, lemma string, upos string, feats string, deprel string")
    v = {r.kind: r.labels for r in S.label_vocabulary(t).collect()}
    assert v == {"upos": ["ADJ", "NOUN"], "deprel": ["obl", "root"], "feats:Case": ["_", "Acc", "Nom"], "feats:N": ["_", "1"]}
    assert [(r.rule, r.n, r.idx) for r in S.lemma_rules(t).orderBy("idx").collect()] == [('[0,0,"",""]', 2, 0), ('[0,1,"",""]', 1, 1)]
    e = spark.createDataFrame([(["b", "a"], ["a", "c"])], "p array<string>, o array<string>")
    assert e.select(S.extend_vocabulary(F.col("p"), F.col("o"))).first()[0] == ["b", "a", "c"]


def test_groups_stay_whole(spark):
    s = spark.createDataFrame([(f"g{i // 3}", i) for i in range(30)], "key string, i int")
    got = S.internal_split(s, "yrk", 42).collect()
    by = {}
    for r in got:
        by.setdefault(r.key, set()).add(r.split)
    assert all(len(v) == 1 for v in by.values()) and sum(v == {"test"} for v in by.values()) == 1 and sum(v == {"dev"} for v in by.values()) == 1
    with pytest.raises(ValueError):
        S.internal_split(s, "fi", 42)


def test_recording_key(spark):
    df = spark.createDataFrame([("a:b:1", "myv", None, None), ("x_2", "myv", None, None), ("brat_2018:7", "myv", None, None), ("q", "yrk", "T", "U"), ("q", "yrk", None, "U")], "s string, l string, t string, u string")
    assert [r.k for r in df.select(S.recording_key(F.col("s"), F.col("l"), F.col("t"), F.col("u")).alias("k")).collect()] == ["a:b", "x", "brat_2018", "T", "U"]


def test_consensus_and_review(spark):
    df = spark.createDataFrame(
        [("ӱдыр", "ӱдыр", "_", ["ӱдыр"], ["ӱдыр"]), ("йоча", "йоча", "_", ["йочаш"], ["йочаш", None]), ("пӧрт", "пӧрт", "X=1", [], ["пӧрт"]), (".", ".", "_", [], []), ("a", "a", "_", ["x", "y"], ["y", "x"]), ("b", "b", "_", ["x"], ["y"])],
        "form string, lemma string, misc string, first array<string>, second array<string>",
    )
    r = A.review_tokens(df).collect()
    assert [x.review_lemma for x in r] == ["ӱдыр", "йоча?йочаш", "пӧрт?", ".", "a?", "b?"]
    assert [x.status for x in r] == ["consensus", "consensus", "unanalyzed", "nonlexical_exempt", "ambiguous_common", "disjoint"]
    assert [x.copy_misc for x in r][:3] == ["LemmaSource=FST", "LemmaSource=FST", "X=1"]


def test_predictions_and_form_only(spark, tmp_path):
    s = readers.read_conllu(spark, _bank(spark, tmp_path, TWO)).withColumn("p", F.expr("array(named_struct('lemma','L','upos','U','feats','F','head',2,'deprel','d'), named_struct('lemma','M','upos','V','feats','_','head',0,'deprel','root'))"))
    out = s.select(A.write_predictions(F.col("lines"), F.col("p")).alias("x"), A.write_predictions(F.col("lines"), F.slice("p", 1, 1)).alias("bad"), A.form_only(F.col("lines")).alias("f")).first()
    assert out.x[2:] == ["1-2\tдома\t_\t_\t_\t_\t_\t_\t_\tSpaceAfter=No", "1\tв\tL\tU\t_\tF\t2\td\t_\t_", "2\tдоме\tM\tV\t_\t_\t0\troot\t_\t_", "2.1\tx\t_\t_\t_\t_\t_\t_\t_\t_"]
    assert out.bad is None and out.f[3] == "1\tв\t_\t_\t_\t_\t_\t_\t_\t_"


def test_enrich_translate_boilerplate(spark):
    lines = ["# sent_id = s", "1\tМый\t_\t_\t_\t_\t_\t_\t_\t_", "2\tтолам\t_\t_\t_\t_\t_\t_\t_\tX=1", "3\t.\t_\t_\t_\t_\t_\t_\t_\t_"]
    df = spark.createDataFrame([(lines, "Мый толам.", "I come."), (lines, "Мый x толам.", "I come."), (lines, "Мый толам.", "")], "lines array<string>, text string, text_en string")
    r = A.enrich(df).collect()
    assert r[0].enriched[1:3] == ["# text = Мый толам.", "# text_en = I come."] and r[0].enriched[4].endswith("X=1|SpaceAfter=No")
    assert [x.problem for x in r] == [None, "spacing", "translation"]
    t = A.add_translation(spark.createDataFrame([(["# text = a", "x"], "b"), (["# text = a", "# text_en = c"], "b"), (["# text = a"], "b\nc"), (["# text = a"], None)], "lines array<string>, text_en string")).collect()
    assert t[0].translated == ["# text = a", "# text_en = b", "x"] and [x.problem for x in t] == [None, "has_translation", "translation", "translation"]
    b = spark.createDataFrame([(["# text = Кутсо тест. Мый", "# text_en = x", "1\tКутсо\ta\tb\t_\t_\t_\t_\t_\t_", "2\tтест.\ta\tb\t_\t_\t_\t_\t_\t_", "3\tМый\ta\tb\t_\t_\t_\t_\t_\t_"],), (["# text = Кутсо тест.", "1\tКутсо\t_\t_\t_\t_\t_\t_\t_\t_", "2\tтест.\t_\t_\t_\t_\t_\t_\t_\t_"],)], "lines array<string>")
    got = [x.b for x in b.select(A.strip_boilerplate(F.col("lines"), r"Кутсо тест\.").alias("b")).collect()]
    assert got[0].lines == ["# text = Мый", "1\tМый\t_\t_\t_\t_\t_\t_\t_\t_"] and got[1].lines is None and got[1].changed


def test_violation_reports(spark):
    a = spark.createDataFrame([("1", "x", ["a"]), ("2", "x", ["b"]), ("3", "x", ["c"]), ("3", "x", ["c"])], "sent_id string, article string, forms array<string>")
    d = spark.createDataFrame([("1", "y", ["a"]), ("2", "x", ["q"]), ("4", "x", ["d"])], "sent_id string, article string, forms array<string>")
    got = {(r.sent_id, r.problem) for r in A.pair_violations(a, d).collect()}
    assert {("1", "article"), ("2", "forms"), ("3", "missing_draft"), ("4", "missing_original"), ("3", "repeated_original")} == got
    look = spark.createDataFrame([("a", "a+N"), ("a", "b+V"), ("a", "a+N"), ("q", "q+?"), ("z", None)], "form string, analysis string")
    assert {r.form: [x.lemma for x in r.analyses] for r in A.lookup_analyses(look).collect()} == {"a": ["a", "b"], "q": [], "z": []}


TOK = "doc string, sent int, id int, form string, lemma string, upos string, xpos string, feats string, head int, deprel string"


def test_gold_against_gold_is_one(spark):
    rows = [("d", s, i, f"w{s}{i}", "l", "NOUN", "_", "Case=Nom", i - 1, "root" if i == 1 else "case:x") for s in range(3) for i in range(1, 5)]
    m = scoring.metrics(*[spark.createDataFrame(rows, TOK)] * 2).collect()
    assert len(m) == 13 and all(r.f1 == 1.0 or r.gold_total == 0 for r in m)


def test_retokenized_system(spark):
    gold = [("d", 0, 1, "ab", "x", "N", "_", "_", 0, "root"), ("d", 0, 2, "c", "y", "V", "_", "_", 1, "case"), ("d", 0, 3, "d", "z", "V", "_", "_", 1, "obj")]
    sys_ = [("d", 0, 1, "a", "x", "N", "_", "_", 0, "root"), ("d", 0, 2, "b", "x", "N", "_", "_", 1, "obj"), ("d", 0, 3, "c", "y", "V", "_", "_", 1, "case"), ("d", 0, 4, "d", "q", "V", "_", "_", 3, "obj")]
    m = {r.metric: r for r in scoring.metrics(spark.createDataFrame(gold, TOK), spark.createDataFrame(sys_, TOK)).collect()}
    assert (m["Words"].correct, m["Words"].gold_total, m["Words"].system_total, m["Words"].aligned_total) == (2, 3, 4, None)
    assert m["UPOS"].correct == 2 and m["Lemmas"].correct == 1 and m["UAS"].correct == 0 and m["Sentences"].correct == 1 and m["UPOS"].aligned_accuracy == 1.0


def _multiword(spark, words):
    """``abc a b c`` is the token abc of the words a, b, c."""
    rows = []
    for w in words:
        form, *parts = w.split(" ")
        first = len(rows) + 1
        for x in parts or [form]:
            rows.append(("d", 0, len(rows) + 1, x, "_", "_", "_", "_", int(len(rows) > 0), "_", first if parts else None, form if parts else None))
    return spark.createDataFrame(rows, TOK + ", span_first int, span_form string")


@pytest.mark.parametrize("gold, system, correct", [
    (["a"], ["a"], 1), (["a", "b", "c"], ["a", "b", "c"], 3), (["abc a b c"], ["a", "b", "c"], 3), (["a", "bc b c", "d"], ["a", "b", "c", "d"], 4), (["abcd a b c d"], ["ab a b", "cd c d"], 4),
    (["abc a b c", "de d e"], ["a", "bcd b c d", "e"], 5), (["abcd"], ["a", "b", "c", "d"], 0), (["abc", "d"], ["a", "b", "c", "d"], 1), (["a", "bc", "d"], ["a", "b", "c", "d"], 2),
    (["a", "bc b c", "d"], ["a", "b", "cd"], 2), (["abc a BX c", "def d EX f"], ["ab a b", "cd c d", "ef e f"], 4), (["ab a b", "cd bc d"], ["a", "bc", "d"], 2), (["a", "bc b c", "d"], ["ab AX BX", "cd CX a"], 1),
])
def test_multiword_alignment(spark, gold, system, correct):
    g, s = _multiword(spark, gold), _multiword(spark, system)
    a, b = scoring.char_spans(g), scoring.char_spans(s)
    assert scoring.align(a, b).count() == correct
    if (gold, system) in ((["abc a b c"], ["a", "b", "c"]), (["a", "bc b c", "d"], ["ab AX BX", "cd CX a"])):
        m = {r.metric: r for r in scoring.metrics(g, s).collect()}
        size = lambda words: sum(max(1, len(w.split(" ")) - 1) for w in words)
        assert (m["Words"].correct, m["Words"].gold_total, m["Words"].system_total) == (correct, size(gold), size(system))
        assert (m["Tokens"].gold_total, m["Tokens"].system_total) == (len(gold), len(system)) and m["Sentences"].correct == 1


def test_text_differences(spark):
    same = [["abc a b c", "d"], ["ab", "cd"]], [["a", "b"], ["ab q r"]]
    for g, s in same:
        assert scoring.text_differences(_multiword(spark, g), _multiword(spark, s)).count() == 0
    for g, s in ([["a"], ["b"]], [["ab"], ["ba"]], [["ab"], ["abc"]], [["aab"], ["abb"]]):
        assert [r.doc for r in scoring.text_differences(_multiword(spark, g), _multiword(spark, s)).collect()] == ["d"]


def test_reader_keeps_multiword_tokens(spark, tmp_path):
    w = S.word_table(readers.read_conllu(spark, _bank(spark, tmp_path, TWO)), ["sent_no"]).orderBy("id").collect()
    assert [(r.form, r.span_first, r.span_form) for r in w] == [("в", 1, "дома"), ("доме", 1, "дома")]


def test_interval_of_many_rows(spark):
    df = spark.createDataFrame([(float((i * 7919) % 1000),) for i in range(1000)], "x double").repartition(5)
    assert tuple(scoring.interval_of(df, "x").first()) == (24.0, 974.0) and tuple(scoring.interval_of(df.limit(0), "x").first()) == (None, None)


def test_hashed_resamples(spark, monkeypatch):
    a = spark.createDataFrame([(f"a{i}", 10 + i % 5, 8 + i % 3, 6 + i % 3) for i in range(60)], "source_id string, tokens bigint, head_ok bigint, both_ok bigint")
    exact = scoring.bootstrap(a, 300).first()
    monkeypatch.setattr(scoring, "GATHERED", 10)
    hashed = scoring.bootstrap(a, 300).first()
    assert all(abs(x - y) < 0.01 for x, y in zip(exact, hashed)) and exact.articles == hashed.articles == 60


def test_lcs_islands(spark):
    mk = lambda w: spark.createDataFrame([("d", i, x) for i, x in enumerate(w)], "doc string, pos int, form string")
    assert [(r.g_pos, r.s_pos) for r in scoring.lcs_alignment(mk(["a", "b", "c"]), mk(["A", "C"]), ["doc"]).orderBy("g_pos").collect()] == [(0, 0), (2, 1)]


def test_bootstrap(spark):
    a = spark.createDataFrame([(f"a{i}", 10 + i % 5, 8 + i % 3, 6 + i % 3) for i in range(60)], "source_id string, tokens bigint, head_ok bigint, both_ok bigint")
    r = scoring.bootstrap(a, 300).first()
    total = a.agg(F.sum("head_ok") / F.sum("tokens")).first()[0]
    assert r.uas_low < total < r.uas_high and r.las_high < r.uas_low
    e = scoring.bootstrap_exact([tuple(x)[1:] for x in a.collect()], 300)
    assert abs(e["uas_95"][0] - r.uas_low) < 0.01 and abs(e["uas_95"][1] - r.uas_high) < 0.01
    d = {x.metric: x for x in scoring.paired_difference(a, a.withColumn("head_ok", F.col("head_ok") - 1), 200).collect()}
    assert d["uas"].low <= d["uas"].difference <= d["uas"].high and d["las"].difference == 0
    assert scoring.paired_violations(a, a.where("source_id <> 'a1'")).first().source_id == "a1"
    with pytest.raises(ValueError):
        scoring.bootstrap_exact([(1, 1, 1)])


def test_wiki_csv_keeps_line_ends(spark, tmp_path):
    rows = [("A", "a\rb\nc\r\nd"), ("B", '\r"x"\r\n'), ("C", "\n\r ,\r")]
    for k, end in enumerate(["\n", "\r\n", "\r"]):
        p = tmp_path / f"{k}.csv"
        with open(p, "w", encoding="utf-8", newline="") as f:
            w = csv.writer(f, lineterminator=end, quoting=csv.QUOTE_MINIMAL if k else csv.QUOTE_ALL)
            w.writerows([("article", "text"), *rows])
        assert [tuple(r) for r in readers.read_wiki_csv(spark, str(p)).collect()] == rows, end


def test_wiki_csv_of_all_documents(spark, sf):
    from quern.plans.registry import QUERIES

    if not os.path.isdir(sf):
        pytest.skip("no tables")
    d = spark.read.parquet(f"{sf}/documents.parquet").where("title <> '' and text <> ''").select("title", "text")
    got = sorted(map(tuple, QUERIES["s1_wiki_csv"](spark, sf).select("article", "text").collect()))
    assert got == sorted(map(tuple, d.collect())) and any("\r" in t for _, t in got)


@pytest.mark.parametrize("name", ["f7_f8_feats", "f10_apply_rule"])
def test_whole_functions_equal_sql(spark, sf, name):
    duckdb = pytest.importorskip("duckdb")
    from quern.plans.registry import ORACLE, QUERIES

    if not os.path.isdir(sf):
        pytest.skip("no tables")
    c = duckdb.connect()
    c.execute(f"create view sentences as select * from '{sf}/sentences.parquet'")
    got = QUERIES[name](spark, sf)
    rows = sorted(map(tuple, got.collect()))
    assert rows == sorted(c.execute(f"select {', '.join(got.columns)} from ({ORACLE[name]})").fetchall())
    assert any(r[2] == "_" for r in rows) if name == "f7_f8_feats" else {1, 2} <= {len(r[0]) for r in rows}
