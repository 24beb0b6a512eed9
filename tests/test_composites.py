import json
import os

import pytest
from pyspark.sql import functions as F

from quern import cli, config
from quern.operators import composites as C

LINES = ["# sent_id = {0}", "# text = Мый толам {0}", "# source_id = a{0}", "# source_sent_id = q{0}", "1\tМый\t_\tPRON\t_\t_\t2\tnsubj\t_\t_", "2\tтолам\t_\tVERB\t_\t_\t0\troot\t_\t_", "3\t{0}\t_\tNUM\t_\t_\t2\tobl\t_\t_"]


def _sentence(i, drop=()):
    return [x.format(i) for k, x in enumerate(LINES) if k not in drop]


def test_windows():
    assert C.encoder_windows([1, 1, 1, 1, 1], 3, 1) == [(0, 3), (2, 5)]
    assert C.encoder_windows([7], 3, 1) == [(0, 3), (2, 5), (4, 7)]
    assert C.encoder_windows([2, 2, 2], 5, 3) == [(0, 4), (2, 6)]
    assert C.encoder_windows([], 3, 1) == []


def test_window_table_covers_every_piece(spark):
    df = spark.createDataFrame([("a", [1, 4, 2, 9, 1]), ("b", [])], "k string, sizes array<int>")
    got = C.window_table(df, 6, 2, ["k"]).collect()
    assert {p for r in got for p in range(r.start, r.end)} == set(range(17)) and all(r.end - r.start <= 6 and r.k == "a" for r in got)


def test_small_pieces(spark):
    df = spark.createDataFrame([([0.1, 9.0, 0.5], 2), ([0.1, 9.0, 0.5], 0), ([0.5, 1.0, 0.5], 1)], "s array<double>, h int")
    assert [r.r for r in df.select(C.pick_relation(F.col("s"), ["a", "root", "b"], F.col("h")).alias("r")).collect()] == ["b", "root", "a"]
    c = spark.createDataFrame([([("b", "x"), ("a", "y"), ("b", "x")],)], "c array<struct<l:string,g:string>>")
    assert c.select(C.ordered_candidates(F.col("c"))).first()[0] == ['{"l":"a","g":"y"}', '{"l":"b","g":"x"}']


def test_prepare_corpus_and_cli(spark, tmp_path):
    rows = [(f"r{i:02d}", [f"s{i}"], f"текст номер {i} " + " ".join(f"w{i}x{k}" for k in range(14)), "mhr") for i in range(20)]
    df = spark.createDataFrame(rows, "id string, source_ids array<string>, text string, language string")
    out = C.prepare_corpus(df, None, ["mhr"])
    C.require_clean(out["violations"], "x")
    assert {(r.split, r.documents) for r in out["counts"].collect()} == {("train", 18), ("validation", 1), ("test", 1)}
    with pytest.raises(ValueError):
        C.require_clean(C.prepare_corpus(df.limit(2), None, ["mhr"])["violations"], "x")
    df.write.parquet(str(tmp_path / "in"))
    cli.main(["prepare", str(tmp_path / "in"), str(tmp_path / "out"), "--targets", "mhr"], spark)
    assert spark.read.json(str(tmp_path / "out/documents")).count() == 20


def test_translations_and_assembly(spark):
    s = spark.createDataFrame([(str(i), _sentence(i)) for i in range(3)], "sent_id string, lines array<string>")
    t = spark.createDataFrame([(str(i), f"I come {i}") for i in range(3)], "sent_id string, text_en string")
    m = C.merge_translations(s, t)
    assert m["violations"].count() == 0 and m["sentences"].where(F.array_contains("lines", "# text_en = I come 1")).count() == 1
    assert {(r.sent_id, r.problem) for r in C.merge_translations(s, t.where("sent_id <> '1'"))["violations"].collect()} == {("1", "missing")}
    old = spark.createDataFrame([("0", [*_sentence(0)[:2], "# text_en = kept", *_sentence(0)[2:]])], "sent_id string, lines array<string>")
    req = t.where("sent_id <> '0'").select("sent_id")
    a = C.assembled_batch(s, s, old, old.select("sent_id"), t.where("sent_id <> '0'"), req, 3)
    assert a["violations"].count() == 0 and a["sentences"].where(F.array_contains("lines", "# text_en = kept")).count() == 1
    assert {r.problem for r in C.assembled_batch(s, s.limit(2), old, old.select("sent_id"), t, req, 4)["violations"].collect()} >= {"count", "translation ids", "differs from the analyzers' copy"}


def test_rounds(spark):
    word = [(1, "мый", "мый", "PRON", "_")]
    schema = "sent_id string, source_id string, source_sent_id string, text string, status string, words array<struct<id:int,form:string,lemma:string,upos:string,feats:string>>"
    mk = lambda ids, st, lemma="мый": spark.createDataFrame([(f"x{i}", f"a{i}", f"q{i}", "t", st, [(1, "мый", lemma, "PRON", "_")]) for i in ids], schema)
    splits = spark.createDataFrame([(f"a{i}", "train") for i in range(40)], "source_id string, split string")
    out = C.prepare_targets([(mk(range(10), "D"), mk(range(10), "GOLD_ADJUDICATED")), (mk(range(10, 30), "D"), mk(range(10, 30), "GOLD_ADJUDICATED"))], splits, "mhr")
    assert out["violations"].count() == 0 and {(r.split, r["count"]) for r in out["rows"].groupBy("split").count().collect()} == {("train", 27), ("dev", 3)}
    bad = C.prepare_targets([(mk(range(3), "D"), mk([0, 1, 5], "D", "мый?"))], splits, "mhr", dev_cap=5)["violations"]
    assert {r.problem for r in bad.collect()} == {"missing", "unknown", "status", "unresolved"}
    del word


def test_targets_past_the_cap(spark):
    schema = "sent_id string, source_id string, source_sent_id string, text string, status string, words array<struct<id:int,form:string,lemma:string,upos:string,feats:string>>"
    mk = lambda st: spark.createDataFrame([(f"x{i}", f"a{i // 5}", f"q{i}", "t", st, [(1, "мый", "мый", "PRON", "_")]) for i in range(40)], schema)
    splits = spark.createDataFrame([(f"a{i}", "train") for i in range(8)], "source_id string, split string")
    prepare = lambda cap: C.prepare_targets([(mk("D"), mk("GOLD_ADJUDICATED"))], splits, "mhr", dev_cap=cap)
    out, roomy = prepare(3), prepare(500)  # three of four articles of five rows, and all four
    assert out["violations"].isEmpty() and out["rows"].where("split = 'dev'").count() == 15 and out["rows"].count() == 40
    assert [r.dev_rows for r in out["over_cap"].collect()] == [15] and roomy["over_cap"].isEmpty() and roomy["rows"].where("split = 'dev'").count() == 20


def test_selection_and_refill(spark):
    cand = spark.createDataFrame([(f"a{i}", f"q{i}", ["мый", "толам", str(i)], f"мый толам {i}", [False] * 3) for i in range(12)], "source_id string, sent_id string, forms array<string>, text string, adjacent array<boolean>")
    kept = spark.createDataFrame([("k1", "a0", "x"), ("k2", "a1", "y")], "sent_id string, source_id string, text string")
    orig = spark.createDataFrame([("k1", "x"), ("k2", "z")], "sent_id string, text string")
    hist = spark.createDataFrame([("a2", "q2")], "source_id string, source_sent_id string")
    r = C.refill_batch(kept, orig, cand, hist, "mhr", 6, 42)
    added = r["additions"].collect()
    assert len(added) == 4 and not {x.source_id for x in added} & {"a0", "a1", "a2"} and [x.sent_id for x in r["preserved"].collect()] == ["k1"]
    preds = r["additions"].select("sent_id", F.transform("forms", lambda f, i: F.struct(f.alias("lemma"), F.lit("X").alias("upos"), F.lit("_").alias("feats"), i.alias("head"), F.when(i == 0, "root").otherwise("dep").alias("deprel"))).alias("p"))
    b = C.predicted_batch(r["additions"], preds, spark.createDataFrame([("zz",)], "sent_id string"))
    assert b["violations"].count() == 0 and b["sentences"].count() == 4
    assert C.predicted_batch(r["additions"], preds.limit(0), r["additions"].select("sent_id"))["violations"].count() == 8


def test_language_model_evaluation(spark):
    blocks = spark.range(40).select(F.concat(F.lit("b"), "id").alias("id"), F.lit("mhr").alias("language"), F.lit("test").alias("split"))
    scored = blocks.select("id", F.explode(F.array(F.lit("base"), F.lit("best"))).alias("checkpoint")).withColumn("loss_sum", F.when(F.col("checkpoint") == "base", 4.0).otherwise(2.0)).selectExpr("*", "2 n", "1 top1", "2 top5")
    out = C.evaluate_language_model(scored, blocks, 10, 42)
    assert out["selection"].count() == 10 and {(r.checkpoint, r.loss, r.n) for r in out["metrics"].collect()} == {("base", 2.0, 20), ("best", 1.0, 20)}
    side = C.compare_predictions(scored.select("id", "checkpoint", "loss_sum"), ["id"], "base", "best").first()
    assert (side.base_loss_sum, side.adapted_loss_sum) == (4.0, 2.0)


def test_config():
    config.validate({"seed": 1, "mask_probability": 0.15, "targets": ["a"], "language_weights": {"a": 1.0}, "device": "cpu", "precision": "fp32", "max_length": 64, "window_overlap": 8})
    for bad in ({"sed": 1}, {"seed": -1}, {"mask_probability": float("nan")}, {"targets": ["a", "a"]}, {"device": "cpu", "precision": "bf16"}, {"min_words": 9, "max_words": 2}, {"language_weights": {}}, {"max_length": 10, "window_overlap": 9}):
        with pytest.raises(ValueError):
            config.validate(bad)
    assert "pyspark" in config.environment()


def test_score_command(spark, tmp_path, capsys):
    p = tmp_path / "g.conllu"
    p.write_text("\n".join(_sentence(1)) + "\n\n", encoding="utf-8")
    cli.main(["validate", str(p)], spark)
    capsys.readouterr()
    cli.main(["score", str(p), str(p)], spark)
    assert all(r["f1"] in (1.0, 0.0) for r in json.loads(capsys.readouterr().out))


def test_candidates_equal_sql(spark, sf):
    duckdb = pytest.importorskip("duckdb")
    import __spark_entry__ as e

    if not os.path.isdir(sf):
        pytest.skip("no tables")
    c = duckdb.connect()
    c.execute(f"create view sentences as select * from '{sf}/sentences.parquet'")
    want = sorted(c.execute(f"select sent, id, first from ({e.oracle_sql()['o4_candidate_order']})").fetchall())
    got = sorted(map(tuple, e.queries()["o4_candidate_order"](spark, sf).select("sent", "id", "first").collect()))
    assert got == want and {i % 2 for _, i, _ in got} == {0, 1}


def test_commands(spark, tmp_path, capsys):
    def bank(name, lines):
        p = tmp_path / name
        p.write_text("".join("\n".join(x) + "\n\n" for x in lines), encoding="utf-8")
        return str(p)

    def out(name):
        return str(tmp_path / name)

    gold = bank("gold.conllu", [_sentence(i) for i in range(4)])
    other = bank("other.conllu", [[x.replace("2\tobl", "1\tobl") for x in _sentence(i)] for i in range(4)])
    cli.main(["evaluate", gold, gold, out("one"), "--repeats", "20"], spark)
    cli.main(["evaluate", gold, other, out("two"), "--repeats", "20"], spark)
    cli.main(["compare", f"{out('one')}/articles", f"{out('two')}/articles", "--repeats", "20"], spark)
    rows = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert {r["metric"]: round(r["difference"], 6) for r in rows} == {"uas": round(1 / 3, 6), "las": round(1 / 3, 6)}
    with pytest.raises(ValueError):
        cli.main(["evaluate", gold, bank("bad.conllu", [[x.replace("Мый\t", "Мы\t") for x in _sentence(i)] for i in range(4)]), out("three")], spark)
    # the same in folders, paired by file name
    for d in ("g", "s"):
        (tmp_path / d).mkdir()
        for k in range(2):
            bank(f"{d}/f{k}.conllu", [_sentence(i) for i in range(k, k + 2)])
    cli.main(["score", out("g"), out("s")], spark)
    assert all(r["f1"] in (1.0, 0.0) for r in json.loads(capsys.readouterr().out.strip().splitlines()[-1]))

    forms = [f"сӧз{k}" for k in range(6)]
    s = spark.createDataFrame([(f"a{i}", f"s{i}", forms, list(range(1, 7)), " ".join(forms)) for i in range(9)], "article string, sent_id string, forms array<string>, ids array<int>, text string")
    s.write.parquet(out("sentences"))
    from quern.functions.hashing import article_id

    ids = s.select(F.array(article_id("mhr", F.col("article"))).alias("source_ids"), F.when(F.col("article") < "a4", "test").otherwise("train").alias("split"))
    ids.write.json(out("splits"))
    cli.main(["drafts", out("sentences"), out("splits"), out("drafts"), "--language", "mhr", "--per-language", "3"], spark)
    assert spark.read.json(out("drafts")).count() == 3
    cli.main(["select", out("sentences"), out("splits"), out("batch"), "--language", "mhr", "--round", "r1", "--count", "4", "--min-words", "3", "--max-words", "9"], spark)
    assert {r.sent_id for r in spark.read.json(out("batch")).collect()} == {f"mhr-fewshot-r1-000{k}" for k in range(1, 5)}

    rows = spark.createDataFrame([("s1", 1, "mhr", "Ола", ["mhr"], [0.9]), ("s2", 2, "mhr", "Ола", ["mhr"], [0.9])], "sent_id string, pos int, language string, text string, labels array<string>, probs array<double>")
    rows.write.parquet(out("rows"))
    spark.createDataFrame([("дом",)], "word string").write.parquet(out("words"))
    cli.main(["clean-rows", out("rows"), out("words"), out("cleaned")], spark)
    assert spark.read.json(f"{out('cleaned')}/rows").count() == 1 == spark.read.json(f"{out('cleaned')}/audit").count()

    review = tmp_path / "review"
    review.mkdir()
    english = lambda i: ["# text_en = x", *_sentence(i)]
    names = [f"{g}-{k}.conllu" for g in ("mhr", "udm") for k in ("model-review", "fst")]
    for n in names:
        bank(f"review/{n}", [english(i) for i in range(3)])
    from quern.sources import sinks

    sinks.write_manifest(str(review), names)
    cli.main(["publish", str(review), out("published")], spark)
    assert sorted(os.listdir(out("published"))) == sorted(names)
    bank("review/udm-fst.conllu", [english(i) for i in range(2)])
    sinks.write_manifest(str(review), names)
    with pytest.raises(ValueError):
        cli.main(["publish", str(review), out("published2")], spark)
    assert not os.path.exists(out("published2"))
    titled = bank("t.conllu", [[f"# doc_title = t{i // 3}", *_sentence(i)] for i in range(30)])
    cli.main(["treebank", titled, out("bank"), "--language", "yrk"], spark)
    assert {x for x in os.listdir(out("bank"))} == {"train.conllu", "dev.conllu", "test.conllu"}
    with pytest.raises(ValueError):
        cli.main(["gold", gold, out("splits"), "--language", "mhr", "--count", "4"], spark)
