"""Each operator against brute force or an exact round trip, and on its edge cases."""

import collections
import math
import os
import random
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import bpe, canon, dedup, groups, langid, leaks, lines, mixing, queries, reading, tokens

TOK = os.environ.get("QUERN_TOKENIZERS", "/opt/tokenizers")
needs_vocabulary = pytest.mark.skipif(not os.path.isdir(TOK), reason="no tokenizer files")
LONG = "сӱрет " * 40_000
ODD = ["", None, " ", "\n\n", "a  b", "it's x'll  <|endoftext|>", "ҥ" * 300, "a\x1cb\x85c", "　x y", "é é", "𝒳👍🏽", "1234 5,6", "tab\tx\r\n"]


# ---- tokens ----------------------------------------------------------------------------------------


@needs_vocabulary
@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"])
def test_encoder_equals_library(name):
    import base64

    import public_tokenizers as P
    import tiktoken

    rank_file = name.replace(".json", ".tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in open(os.path.join(TOK, rank_file), "rb"))}
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    vocabulary = bpe.load_vocabulary(os.path.join(TOK, name))
    e, d = bpe.Encoder(vocabulary, memory=50), bpe.Decoder(vocabulary)
    rng = random.Random(5)
    texts = [x for x in ODD if x] + ["".join(rng.choice("abcdeғұѣ ӱҥ\n.,'1 эй") for _ in range(rng.randrange(1, 60))) for _ in range(400)] + [LONG[:3000]]
    for t in texts:
        ids = e.encode(t)
        assert ids == lib.encode_ordinary(t)
        assert d.decode(ids) == t


@needs_vocabulary
def test_word_ends_equal_library():
    from tokenizers import Tokenizer

    path = os.path.join(TOK, "word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    lib.encode_special_tokens = True
    vocabulary = bpe.load_vocabulary(path)
    e, d = bpe.Encoder(vocabulary, memory=50), bpe.Decoder(vocabulary)
    rng = random.Random(6)
    texts = [x for x in ODD if x] + ["ΣΑΣ Σ İi", "it's  Don't 'S", "e\u0301 \u0308a\u2000b", "Hello, World! 12"]
    texts += ["".join(rng.choice("abcdeғұѣ ӱҥ\n.,'1 эйABÉΣ") for _ in range(rng.randrange(1, 60))) for _ in range(400)]
    for t in texts:
        assert e.encode(t) == lib.encode(t, add_special_tokens=False).ids, t
    assert d.decode(e.encode("Hello, World")) == "hello , world "


@needs_vocabulary
def test_unknown_vocabularies_are_refused(tmp_path):
    import json

    with pytest.raises(ValueError):
        bpe.load_vocabulary(os.path.join(TOK, "piece_bpe_32k.model"))
    good = json.load(open(os.path.join(TOK, "byte_bpe_50k.json"), encoding="utf-8"))
    changes = [{"normalizer": {"type": "NFKC"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"model": good["model"] | {"unk_token": "?"}}, {"model": good["model"] | {"merges": good["model"]["merges"][::-1]}}]
    for i, change in enumerate(changes):
        path = tmp_path / f"{i}.json"
        path.write_text(json.dumps(good | change), encoding="utf-8")
        with pytest.raises(ValueError):
            bpe.load_vocabulary(str(path))


@needs_vocabulary
def test_encode_corpus_edges(spark):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate([*ODD, LONG, ODD[4]])], "doc_id bigint, text string, ids string")
    v = os.path.join(TOK, "byte_bpe_50k.json")
    got = {r.doc_id: r.ids for r in tokens.encode_corpus(df, v).collect()}
    assert got[0] == [] == got[1] and len(got) == len(ODD) + 2 and got[4] == got[len(ODD) + 1]
    back = {r.doc_id: r.text for r in tokens.decode_corpus(tokens.encode_corpus(df, v), v).collect()}
    assert all(back[r.doc_id] == (r.text or "") for r in df.collect())
    n = {r.doc_id: r.n_tokens for r in tokens.document_tokens(df, v).collect()}
    assert n == {k: len(x) for k, x in got.items()}
    assert tokens.encode_corpus(df.limit(0), v).count() == 0
    with pytest.raises(ValueError):
        bpe.Decoder(bpe.load_vocabulary(v)).decode([10**9])


@needs_vocabulary
def test_token_budget_adds_up(spark, monkeypatch):
    rows = [(t, s, g, d) for t in [*ODD, "мый толам мый"] for s, g, d in (("a", "MHR ", None), (None, "?", "news"), ("a", "mhr", " "))]
    df = spark.createDataFrame(rows, "text string, source string, lang string, doc_domain string").withColumn("n_docs", F.lit("clash"))
    v = os.path.join(TOK, "byte_bpe_50k.json")
    e = bpe.Encoder(bpe.load_vocabulary(v))
    got = {(r.source, r.lang, r.doc_domain): r for r in tokens.token_budget(df, v).collect()}
    assert set(got) == {("a", "mhr", "none"), ("none", "und", "news")}
    want = sum(len(e.encode(t)) for t, *_ in rows if _[0] == "a")
    r = got["a", "mhr", "none"]
    assert (r.n_tokens, r.n_docs, r.n_empty) == (want, 2 * (len(ODD) + 1), 4)
    assert r.n_chars == sum(len(t or "") for t, *_ in rows if _[0] == "a")
    assert tokens.token_budget(df.limit(0), v).count() == 0
    assert [tuple(x) for x in tokens.token_budget(df.where("text is null"), v).select("source", "n_docs", "n_empty", "n_chars", "n_tokens").orderBy("source").collect()] == [("a", 2, 2, 0, 0), ("none", 1, 1, 0, 0)]
    monkeypatch.setattr(tokens, "COUNTED", 3)  # counts handed on many times add up alike
    assert {(r.source, r.lang, r.doc_domain): r for r in tokens.token_budget(df, v).collect()} == got
    w = os.path.join(TOK, "word_bpe_49k.json")
    e = bpe.Encoder(bpe.load_vocabulary(w))
    assert {r.source: r.n_tokens for r in tokens.token_budget(df, w).collect()}["a"] == sum(len(e.encode(t)) for t, *_ in rows if _[0] == "a")


# ---- languages ----------------------------------------------------------------------------------------


def _samples(spark, sf):
    return langid.read_samples(spark.read.parquet(f"{sf}/lang_samples.parquet"))


def _slow_bits(train: list[list[str]], word: str) -> list[float]:
    """The code length of a word, straight from the definition."""
    out = []
    for texts in train:
        seen = collections.defaultdict(collections.Counter)
        for w in texts:
            b = b" " + w.encode() + b" "
            for i in range(1, len(b)):
                for k in range(min(i, langid.ORDER - 1) + 1):
                    seen[b[i - k : i]][b[i]] += 1
        b, bits = b" " + word.encode() + b" ", 0.0
        for i in range(1, len(b)):
            for k in range(min(i, langid.ORDER - 1), -1, -1):
                c = seen.get(b[i - k : i])
                if not c:
                    continue
                total, kinds = sum(c.values()), len(c)
                if c[b[i]]:
                    bits += np.log2((total + kinds) / c[b[i]])
                    break
                bits += np.log2((total + kinds) / kinds)
            else:
                bits += 8.0
        out.append(bits)
    return out


def test_code_lengths_equal_definition():
    train = [["мый", "толам", "мыйын", "тол"], ["the", "then", "he"], ["тон", "мон", "то"]]
    m = langid.PartialMatching(langid.Samples(["a", "b", "c"], train))
    words = ["мый", "толын", "hen", "zzz", "т", "мыйынмон"]
    assert np.allclose(m.bits(words), [_slow_bits(train, w) for w in words], atol=1e-4)


def test_held_out_languages(spark, sf):
    if not os.path.isdir(sf):
        pytest.skip("no tables")
    rows = [(r.language, r.text) for r in spark.read.parquet(f"{sf}/lang_samples.parquet").collect()]
    random.Random(1).shuffle(rows)
    train, test = rows[:1000], rows[1000:]
    m = langid.Labeller(langid.PartialMatching(langid.Samples(langid.CODES, [[w for g, t in train if g == c for w in canon.words(t)] for c in langid.CODES])))
    lang, offsets, _ = m.label([langid.tokens_of(t) for _, t in test])
    right = np.mean([(lang[a:b] == langid.CODES.index(g)).all() for (g, _), a, b in zip(test, offsets, offsets[1:])])
    assert right > 0.97
    mixed = [(f"{a[1]} «{b[1]}»", {a[0], b[0]}) for a, b in zip(test[::2], test[1::2]) if a[0] != b[0] and min(len(canon.words(a[1])), len(canon.words(b[1]))) >= 5]
    lang, offsets, _ = m.label([langid.tokens_of(t) for t, _ in mixed])
    good = [{langid.CODES[k] for k, n in collections.Counter(lang[a:b]).items() if n >= 4} == want for (_, want), a, b in zip(mixed, offsets, offsets[1:])]
    assert np.mean(good) > 0.93


def test_wrong_labels_edges(spark, sf):
    if not os.path.isdir(sf):
        pytest.skip("no tables")
    ru, en = "это большой дом который здесь стоять", "people of the forest and the river"
    rows = [(1, ru, "ru"), (2, ru, " RU"), (3, ru, None), (4, ru, "en"), (5, f"{ru}. {en}", "ru"), (6, "дом был", None), (7, None, None), (8, "", "xx"), (9, "12 34 56 78 90", "ru"), (10, f"{en} дом был", "en"), (11, ru * 3000, "?"), (3, ru, None)]
    df = spark.createDataFrame(rows, "row_id bigint, text string, language string").withColumn("lang", F.lit("clash"))
    s = _samples(spark, sf)
    got = collections.Counter((r.row_id, r.lang) for r in langid.wrong_labels(df, s).collect())
    assert got == {(3, "ru"): 2, (4, "ru"): 1, (5, "ru"): 1, (5, "en"): 1, (11, "ru"): 1}
    p = langid.label_passages(df, s).where("row_id = 5").orderBy("passage").collect()
    assert [x.lang for x in p] == ["ru", "en"] and all(x.confidence > 0.99 for x in p) and p[1].first_word == p[0].n_words
    assert langid.wrong_labels(df.limit(0), s).count() == 0 and langid.label_passages(df.where("text is null"), s).count() == 0


def test_labeller_memory_does_not_matter():
    train = langid.Samples(["a", "b"], [["мый", "толам"], ["the", "then"]])
    texts = [["мый", "then", "«", "the", "толам"], ["x"], [], ["the"] * 9]
    big, small = (langid.Labeller(langid.PartialMatching(train), memory=n) for n in (1000, 2))
    for a, b in zip(big.label(texts), small.label(texts)):
        assert np.array_equal(a, b)


# ---- groups -------------------------------------------------------------------------------------------


def _related(rows):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for rec, ids, lang in rows:
        find(("r", rec))
        for i in ids or []:
            if i is None or i.strip().lower() in tokens.NO_LABEL or not (lang or "").strip():
                continue
            a, b = find(("r", rec)), find((lang.strip().lower(), i.strip().lower()))
            parent[a] = b
    g = collections.defaultdict(set)
    for rec, *_ in rows:
        g[find(("r", rec))].add(rec)
    return g.values()


REC = "rec_no bigint, source_ids array<string>, language string, split string"


def test_related_pairs(spark):
    rng = random.Random(2)
    rows = [(i, [rng.choice([f"s{rng.randrange(160)}", f" S{rng.randrange(160)} ", "unknown", None, "", "hot" if i % 3 == 0 else "n/a"]) for _ in range(rng.randrange(3))], rng.choice(["mhr", "MHR ", "udm", None])) for i in range(300)]
    rows += [(300, None, "mhr"), (301, [], "mhr"), (302, ["x", "x"], "mhr"), (302, ["x"], "mhr")]
    df = spark.createDataFrame([(*r, None) for r in rows], REC).withColumn("key", F.lit("clash")).withColumn("root", F.lit(1))
    want = {(min(g), x) for g in _related(rows) for x in g if x != min(g)}
    assert {(r.rec_a, r.rec_b) for r in groups.related_pairs(df).collect()} == want
    assert groups.related_pairs(df.limit(0)).count() == 0


def test_assign_splits_incrementally(spark):
    first = [(i, [f"a{i // 4}"], "mhr", None) for i in range(400)] + [(900, ["q1"], "mhr", "Train"), (901, ["q2"], "mhr", "test"), (902, None, None, "dev")]
    out, state = groups.assign_splits(spark.createDataFrame(first, REC))
    one = {r.rec: r for r in out.collect()}
    assert len(one) == 403 and one[900].split == "train" and one[901].split == "test" and one[902].split == "validation" and one[902].status == "kept"
    share = collections.Counter(r.split for r in one.values())
    assert 330 < share["train"] < 390 and share["validation"] >= 8 and share["test"] >= 8
    for i in range(0, 400, 4):
        assert len({one[i + k].split for k in range(4)}) == 1
    state = state.cache()
    second = [(1000, ["A0 ", "new"], "MHR", None), (1001, ["new"], "mhr", None), (1002, ["q1", "q2"], "mhr", None), (1003, ["fresh"], "mhr", None), (1004, [None, "unknown"], "mhr", None), (1003, ["fresh"], "mhr", None)]
    out2, state2 = groups.assign_splits(spark.createDataFrame(second, REC), state)
    two = {r.rec: r for r in out2.collect()}
    assert two[1000].split == two[1001].split == one[0].split and two[1000].status == "kept"
    assert two[1002].status == "quarantined" and two[1002].split is None
    assert two[1003].status == "new" and two[1003].split in groups.PROPORTIONS and len(two) == 5
    third, _ = groups.assign_splits(spark.createDataFrame([(2000, ["q1"], "mhr", None), (2001, ["new"], "mhr", None)], REC), state2)
    three = {r.rec: r for r in third.collect()}
    assert three[2000].status == "quarantined" and three[2001].split == one[0].split


def test_same_delivery_changes_nothing(spark):
    rng = random.Random(3)
    rows = [(i, [rng.choice([f"s{rng.randrange(90)}", None, "hot" if i % 3 == 0 else "n/a"]) for _ in range(rng.randrange(3))], rng.choice(["mhr", "udm", None]), rng.choice([None, None, None, "train", "Dev"])) for i in range(200)]
    df = spark.createDataFrame(rows, REC)
    out, state = groups.assign_splits(df)
    state = state.cache()
    first, table = sorted(out.collect()), sorted(state.collect())
    comps = {tuple(sorted(g)) for g in _related([r[:3] for r in rows])}
    got = collections.defaultdict(list)
    for r in first:
        got[r.component].append(r.rec)
    assert {tuple(sorted(v)) for v in got.values()} == comps and {r.component: r.n_records for r in table} == {k: len(v) for k, v in got.items()}
    for _ in range(2):
        out, state = groups.assign_splits(df, state)
        state = state.cache()
        plain = lambda rows: sorted((*r[:-1], "kept" if r[-1] == "new" else r[-1]) for r in rows)
        assert plain(out.collect()) == plain(first)
        assert sorted(plain((*r[:3], r[4], r[3]) for r in state.collect())) == sorted(plain((*r[:3], r[4], r[3]) for r in table))


def test_splits_of_other_names(spark):
    rows = [(1, ["a"], "mhr", "A"), (2, ["b"], "mhr", "b "), (3, ["c"], "mhr", None)]
    out, state = groups.assign_splits(spark.createDataFrame(rows, REC), proportions={"a": 1, "b": 1})
    assert {r.rec: r.split for r in out.collect()}.items() >= {1: "a", 2: "b"}.items()
    state = state.cache()
    out, state = groups.assign_splits(spark.createDataFrame([(4, ["a", "b"], "mhr", None)], REC), state, proportions={"a": 1, "b": 1})
    state = state.cache()
    assert [(r.split, r.status, r.component) for r in out.collect()] == [(None, "quarantined", "r" + "1".zfill(20))]
    assert {(r.node, r.n_records) for r in state.collect() if r.status == "quarantined" and r.node[0] == "r"} == {("r" + str(k).zfill(20), 3) for k in (1, 2, 4)}
    out, _ = groups.assign_splits(spark.createDataFrame([(2, None, None, "b"), (5, ["B"], "MHR", "a")], REC), state, proportions={"a": 1, "b": 1})
    assert {r.rec: r.status for r in out.collect()} == {2: "quarantined", 5: "quarantined"}


# ---- mixing -------------------------------------------------------------------------------------------


BLOCK = "id string, language string, split string, input_ids array<int>, special_tokens_mask array<int>"
TARGET = "mix string, language string, weight double, max_repeats int, budget_tokens bigint"


def _block(i, lang, n, split="train"):
    return (i, lang, split, list(range(n + 2)), [1, *[0] * n, 1])


def test_mixing(spark):
    rng = random.Random(4)
    rows = [_block(f"a{i}", rng.choice(["mhr", "MHR ", " mhr"]), rng.randrange(1, 126)) for i in range(600)] + [_block(f"b{i}", "udm", 100) for i in range(50)]
    rows += [rows[0], _block("c", None, 50), _block("d", "mhr", 50, "test"), ("e", "mhr", "train", None, None), ("f", "udm", "train", [], []), (None, "udm", "train", [1], [0])]
    blocks = spark.createDataFrame(rows, BLOCK).withColumn("n", F.lit(9))
    t = [("m", "mhr", 0.5, 3, 20_000), ("m", "udm", 0.5, 2, 20_000), ("x", "udm", 1.0, 2, 10_001), ("y", "udm", 1.0, 2, 10_000), ("y", "zz", None, 2, 10_000), ("z", "zz", 1.0, 2, 10), ("w", "mhr", 2.0, 4, 90_000), (None, "udm", 1.0, 1, 1), ("u", "udm", 1.0, 2, 2_600)]
    targets = spark.createDataFrame(t, TARGET)
    assert {(r.mix, r.language) for r in mixing.unreachable(blocks, targets).collect()} == {("x", "udm"), ("z", "zz")}
    rep = {(r.mix, r.language): r for r in mixing.mix_report(blocks, targets).collect()}
    for k in (("m", "mhr"), ("m", "udm"), ("w", "mhr"), ("y", "udm"), ("u", "udm")):
        assert abs(rep[k].tokens_reached - rep[k].tokens_wanted) <= 126, k
    assert rep["x", "udm"].tokens_reached == 10_000 and rep["x", "udm"].most_copies == 2 and not rep["x", "udm"].reachable
    assert abs(rep["m", "mhr"].share_reached - 0.5) < 0.01 and all(r.most_copies <= r.max_repeats for r in rep.values())
    copies = mixing.mix_copies(blocks, targets).collect()
    assert max(collections.Counter((r.mix, r.id) for r in copies).values()) == 1
    assert sum(r.n_tokens * r.copies for r in copies if r.mix == "w") == rep["w", "mhr"].tokens_reached
    assert mixing.unreachable(blocks.limit(0), targets.where("weight > 0 and mix is not null")).count() == 7 and mixing.unreachable(blocks, targets.limit(0)).count() == 0


def test_rates_are_entropy_balanced(spark):
    h = spark.createDataFrame([("a", 10, 50), ("a", 100, 50), ("a", 60, 20)], "language string, n bigint, blocks bigint")
    t = spark.createDataFrame([("m", "a", 2, 1.0, 9_000.0), ("k", "a", 2, 1.0, 13_000.0)], "mix string, language string, cap int, share double, wanted double")
    for d in mixing.solve(h, t):
        rate = {n: min(d["cap"], np.exp(d["dual"] / d["mean"] * n)) for n in (10, 100, 60)}
        assert abs(sum(n * b * rate[n] for n, b in ((10, 50), (100, 50), (60, 20))) - d["wanted"]) < 0.1


def test_deliveries_of_one_block(spark):
    blocks = spark.createDataFrame([("a", None, "train", [1], [0, 0]), ("a", " MHR", "train", [1], [1, 0]), ("a", "", "train", [], []), ("a", "udm", "test", [1], [0] * 9), ("b", " ", "train", [1], [0])], BLOCK)
    assert [tuple(r) for r in mixing.distinct_blocks(blocks).collect()] == [("a", "mhr", 2)]


def test_reachable_from_the_dual(spark):
    rng = random.Random(5)
    hist = [(f"l{i}", n, rng.randrange(1, 2000)) for i in range(6) for n in rng.sample(range(1, 126), rng.randrange(1, 40))]
    stock = collections.Counter()
    for g, n, b in hist:
        stock[g] += n * b
    t = [(f"m{k}", f"l{i}", cap, 0.5, float(x)) for i in range(6) for k, (cap, x) in enumerate([(3, 3 * stock[f"l{i}"]), (3, 3 * stock[f"l{i}"] + 1), (3, math.nextafter(3 * stock[f"l{i}"], math.inf)), (3, 3 * stock[f"l{i}"] - 0.5), (2, 1.0), (1, stock[f"l{i}"] / 2), (0, 1.0), (9, 4.0 * stock[f"l{i}"]), (2, 0.0)])]
    t.append(("none", "zz", 2, 1.0, 5.0))
    found = mixing.solve(spark.createDataFrame(hist, "language string, n bigint, blocks bigint"), spark.createDataFrame(t, "mix string, language string, cap int, share double, wanted double"))
    for d in found:
        assert d["reachable"] == (d["wanted"] <= stock[d["language"]] * d["cap"]) and math.isinf(d["dual"]) == (not d["reachable"] or d["wanted"] == 0), d
        if d["reachable"] and d["wanted"]:
            value = sum(n * b * min(d["cap"], math.exp(min(60, d["dual"] / d["mean"] * n))) for g, n, b in hist if g == d["language"])
            assert abs(value - d["wanted"]) <= 2e-6 * max(1, d["wanted"]), d
    with pytest.raises(RuntimeError):
        mixing.solve(spark.createDataFrame(hist, "language string, n bigint, blocks bigint"), spark.createDataFrame(t[:1], "mix string, language string, cap int, share double, wanted double"), max_steps=1)


# ---- duplicates -----------------------------------------------------------------------------------------


def _slow_key(text, meta):
    drop = lambda s: "".join(c for c in unicodedata.normalize("NFC", unicodedata.normalize("NFC", s).casefold()) if unicodedata.category(c)[0] not in "ZCP")
    parts = sorted((drop(x.partition("=")[0]), x.partition("=")[1], drop(x.partition("=")[2])) for x in (meta or "").split("|") if x.strip())
    return drop(text), tuple(parts)


def test_copies_against_brute_force(spark):
    rng = random.Random(6)
    base = ["Йошкар ола", "йошкар  Ола!", "ййошкар", "Йошкар​ ола", "Йошкар ола 1", "йошкар олa", "123", "—", "", None, "é", "é", LONG]
    metas = ["a=1|b=2", "b=2|a=1", "A = 1|b=2", "a=1", None, "", " ", "a=1|a=1|b=2", "a=|b=2", "a|b=2", "a=12|b="]
    rows = [(i, rng.choice(base), rng.choice(metas)) for i in range(500)]
    df = spark.createDataFrame(rows, "row_id bigint, text string, meta string").withColumn("key", F.lit("x")).withColumn("row_a", F.lit(1))
    g = collections.defaultdict(list)
    for i, t, m in rows:
        if t and any(c.isalpha() for c in t):
            g[_slow_key(t, m)].append(i)
    assert {(r.row_a, r.row_b) for r in dedup.copies(df).collect()} == {(min(v), x) for v in g.values() for x in v if x != min(v)}
    assert {(r.row_id, r.n_copies) for r in dedup.collapse(df).collect()} == {(min(v), len(v)) for v in g.values()}
    assert dedup.copies(df.limit(0)).count() == 0 and dedup.collapse(df.limit(0)).count() == 0


def test_fields_with_and_without_value(spark):
    metas = ["a|b", "a=b", "a=|b", "a", "a=", "=a", "ab", "b|a", "A | B", "a=b=c", "a=bc", "a=b|", " |a=B!", "a|a", None, " ", "|"]
    df = spark.createDataFrame([(i, "Текст", m) for i, m in enumerate(metas)] + [(50, None, "a"), (51, "12", "a"), (3, "текст", "a")], "row_id bigint, text string, meta string")
    key = lambda m: sorted((x.partition("=")[0].strip().lower(), x.partition("=")[1], x.partition("=")[2].lower().strip("! ")) for x in (m or "").split("|") if x.strip())
    g = collections.defaultdict(list)
    for i, m in enumerate(metas):
        g[str(key(m))].append(i)
    g[str(key("a"))].append(3)  # a repeated id
    assert {(r.row_id, r.n_copies) for r in dedup.collapse(df).collect()} == {(min(v), len(v)) for v in g.values()}
    assert {(r.row_a, r.row_b) for r in dedup.copies(df).collect()} == {(min(v), x) for v in g.values() for x in v if x != min(v)}


def test_values_are_canonicalised_once(spark, tmp_path, monkeypatch):
    rows = [(i, f"Слово {i % 3}" + "!" * (i % 2), f"k={i % 5}|K = {i % 5}") for i in range(60)]
    df = spark.createDataFrame(rows, "row_id bigint, text string, meta string").repartition(4)
    d = dedup.value_dictionary(df).collect()
    assert len(d) == 6 + 10 and len({r.integer for r in d}) == 3 + 5 and len({(r.a, r.b) for r in d}) == 16
    assert dedup.collapse(df).count() == 15


# ---- lines ------------------------------------------------------------------------------------------------


def test_repeated_lines(spark):
    rng = random.Random(7)
    pool = ["Школа для рок.", "школа  ДЛЯ рок 12!", "© 2020 Деч", "Уло да уло", "...", "", "42", "редкая"]
    rows = [(i, "\n".join(rng.choice(pool[:7]) if rng.random() < 0.5 else f"своя {chr(1072 + i % 32)}{chr(1072 + i // 32)}" for _ in range(rng.randrange(1, 4))), rng.choice(["s", "t", None]), rng.choice([f"a{i % 25}", None])) for i in range(260)]
    rows += [(900 + i, "редкая", "s", f"b{min(i, 6)}") for i in range(12)] + [(950, None, "s", "a1"), (951, "", "s", "a2")]
    df = spark.createDataFrame(rows, "row_id bigint, text string, source string, source_id string").withColumn("line", F.lit(1)).withColumn("gone", F.lit(1))
    key = lambda x: "".join(c for c in x.casefold() if unicodedata.category(c)[0] not in "ZCPN")
    where = collections.defaultdict(set)
    for _, t, s, a in rows:
        if t and s and a:
            for x in t.split("\n"):
                where[s, key(x)].add(a)
    want = {(i, n) for i, t, s, a in rows if t and s and a for n, x in enumerate(t.split("\n"), 1) if any(c.isalpha() for c in x) and len(where[s, key(x)]) >= 8}
    assert {(r.row_id, r.line_no) for r in lines.repeated_lines(df).collect()} == want and want and not any(i >= 900 for i, _ in want)
    out = {r.row_id: r for r in lines.remove_repeated_lines(df).collect()}
    assert len(out) == len(rows) and out[950].text is None and out[951].text == ""
    for i, t, s, a in rows:
        if t is not None:
            assert out[i].text == "\n".join(x for n, x in enumerate(t.split("\n"), 1) if (i, n) not in want)
    assert lines.repeated_lines(df.limit(0)).count() == 0


def _sequences(spark, rows, **kw):
    lt = lines.line_table(spark.createDataFrame(rows, "row_id bigint, text string, source string, source_id string")).cache()
    return lines.named(lines.closed_sequences(lt, **kw)).collect()


def test_closed_sequences(spark):
    rows = [(10 * a + k, x, "s", f"a{a}") for a in range(9) for k, x in enumerate(["начало", f"своё {'абвгдежзи'[a]}", "середина", "конец"] if a < 8 else ["конец", "начало"])]
    got = collections.Counter((len(r.sequence), r.n_articles) for r in _sequences(spark, rows))
    assert got == {(1, 9): 2, (3, 8): 1}


@pytest.mark.parametrize("n", [12, 20])
def test_long_notice_is_one_sequence(spark, n):
    rows = [(100 * a + k, f"строка {chr(1072 + k)}", "s", f"a{a}") for a in range(8) for k in range(n)] + [(9000 + a, "строка а", "s", f"b{a}") for a in range(3)]
    assert sorted((len(r.sequence), r.n_articles) for r in _sequences(spark, rows)) == [(1, 11), (n, 8)]


def test_closed_sequences_against_brute_force(spark):
    rng = random.Random(12)
    rows = []
    for i in range(400):
        text = "\n".join(rng.choice(["а", "б", "в", "г", "д", f"своя {chr(1072 + i % 32)}{chr(1072 + i // 32)}", "12", ""]) for _ in range(rng.randrange(1, 4)))
        rows.append((i // 2 if i % 7 == 0 else i, text, rng.choice("st"), None if i % 50 == 0 else f"a{rng.randrange(45)}" if i % 3 else "hot"))
    rows += [(1000 + i, "а\nб\nа\nб\nг", "s", f"z{i}") for i in range(9)]
    letters = lambda x: "".join(c for c in x if c.isalpha())
    where, seen = collections.defaultdict(list), collections.defaultdict(set)
    for i, t, s, a in sorted((r for r in rows if r[3]), key=lambda r: r[0]):
        for n, x in enumerate(t.split("\n"), 1):
            if letters(x):
                where[s, a].append((i, n, letters(x)))
                seen[s, letters(x)].add(a)
    support = collections.defaultdict(set)
    for (s, a), v in where.items():
        v = [x for _, _, x in sorted(v) if len(seen[s, x]) >= 8]
        for i in range(len(v)):
            for j in range(i + 1, len(v) + 1):
                support[s, tuple(v[i:j])].add(a)
    frequent = {k: len(v) for k, v in support.items() if len(v) >= 8}
    longer = collections.Counter()
    for (s, q), n in frequent.items():
        for part in (q[1:], q[:-1]):
            longer[s, part] = max(longer[s, part], n)
    want = sorted((s, len(q), n) for (s, q), n in frequent.items() if longer[s, q] < n)
    assert sorted((r.source, len(r.sequence), r.n_articles) for r in _sequences(spark, rows)) == want and max(k for _, k, _ in want) >= 3


def test_repeated_lines_without_article(spark, tmp_path):
    rows = [(i, "повтор", "s", f"a{i}") for i in range(8)] + [(20, "своя\nПовтор!", "s", None), (21, "повтор", "t", None), (22, "повтор", None, None)]
    rows += [(30 + i, "редкая", "s", f"a{i}" if i < 7 else None) for i in range(9)]
    spark.createDataFrame(rows, "row_id bigint, text string, source string, source_id string").write.parquet(str(tmp_path / "sentences.parquet"))
    assert {(r.row_id, r.line_no) for r in queries.p6_found(spark, str(tmp_path)).collect()} == {*((i, 1) for i in range(8)), (20, 2)}
    out = {r.row_id: r.text for r in queries.p6_removed(spark, str(tmp_path)).collect()}
    assert out == {i: "" if i < 8 else "своя" if i == 20 else t for i, t, _, _ in rows}


# ---- leaks ------------------------------------------------------------------------------------------------


def _edits(part, doc):
    row = list(range(len(doc) + 1))
    for i, x in enumerate(part, 1):
        new = [i]
        for j, y in enumerate(doc, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[j - 1] + 1))
        row = new
    return row[-1]


def _slow_leak(item, doc, min_words=12):
    """Whether some stretch of the document is a passage of the item, by edit distance over all spans."""
    n = len(item)
    if n < min_words:
        return any(_edits(item, doc[i:j]) <= n // 8 for i in range(len(doc)) for j in range(i + 1, min(len(doc), i + n + 1) + 1))
    for a in range(n):
        for b in range(a + min_words, n + 1):
            k = (b - a) // 8
            for i in (i for i, x in enumerate(doc) if x == item[a]):  # first and last word are the item's
                for j in range(max(i + 2, i + b - a - k), min(len(doc), i + b - a + k) + 1):
                    if doc[j - 1] == item[b - 1] and _edits(item[a + 1 : b - 1], doc[i + 1 : j - 1]) <= k:
                        return True
    return False


def test_leaks_against_brute_force(spark):
    rng = random.Random(9)
    voc = [f"w{i}" for i in range(300)]
    items = [[rng.choice(voc) for _ in range(rng.choice([1, 2, 3, 5, 8, 9, 11, 12, 14, 20, 30]))] for _ in range(40)]
    items += [["the"] * 14, ["the", "a"] * 8]
    texts = []
    for d in range(220):
        w = rng.choice(items)
        m = rng.choice([5, 7, 11, 12, 13, 16, 20, 30, 8])
        a = rng.randrange(max(1, len(w) - m + 1))
        part = w[a : a + m]
        for _ in range(rng.choice([0, 1, 2, len(part) // 8])):
            p = rng.randrange(len(part))
            part = rng.choice([part[:p] + ["zz"] + part[p + 1 :], part[:p] + part[p + 1 :], part[:p] + ["zz"] + part[p:]]) or ["zz"]
        if rng.random() < 0.15:
            part = rng.sample(part, len(part))
        body = [rng.choice(voc) + rng.choice(["q", "q", ""]) for _ in range(10)]
        texts.append(body[:5] + part + body[5:])
    texts += [["the"] * 40, ["the", "a"] * 30, texts[3], texts[3]]
    want = {(d, k) for d, t in enumerate(texts) for k, w in enumerate(items) if set(w) & set(t) and _slow_leak(w, t)}
    docs = spark.createDataFrame([(d, " ".join(t)) for d, t in enumerate(texts)], "doc_id bigint, text string")
    tests = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id bigint, text string")
    got = [(r.doc_id, r.item_id) for r in leaks.leaked(docs, tests).collect()]
    assert set(got) == want and len(got) == len(want) > 80


def test_suffix_array_and_longest_matches():
    rng = random.Random(1)
    for _ in range(60):
        voc = [f"w{i}" for i in range(rng.choice([1, 2, 3, 10, 50]))]
        shard = leaks.Shard([[rng.choice(voc) for _ in range(rng.randrange(1, 40))] for _ in range(rng.randrange(1, 12))])
        flat = shard.flat.tolist()
        suffix = lambda p: flat[p : flat.index(0, p)]
        assert sorted(shard.array.tolist()) == [i for i, x in enumerate(flat) if x] and shard.words == sorted(shard.words)
        assert [suffix(p) for p in shard.array] == sorted(suffix(p) for p in shard.array)
        items = leaks.Items([(i, " ".join(rng.choice([*voc, "zz"]) for _ in range(rng.randrange(1, 12)))) for i in range(4)])
        wanted, _ = items.numbers_in(shard.words)
        found = zip(*(x.tolist() for x in leaks.longest_matches(shard.flat, shard.array, wanted, np.ones(len(wanted), int))))
        got = {(q, int(shard.array[k]), n) for q, low, high, n in found for k in range(low, high)}
        common = lambda a, b: len(os.path.commonprefix([a, b]))
        parts = [wanted[q : next(i for i in range(q, len(wanted)) if wanted[i] < 0)].tolist() for q in range(len(wanted))]
        assert got == {(q, int(p), common(parts[q], suffix(p))) for q in range(len(wanted)) for p in shard.array if common(parts[q], suffix(p))}


def test_leaks_index_and_portions(spark, monkeypatch):
    w = [f"s{i}" for i in range(40)]
    docs = spark.createDataFrame([(i, " ".join(w[i % 25 : i % 25 + 14])) for i in range(60)] + [(60, None), (61, "—"), (None, " ".join(w))], "doc_id int, text string").repartition(2)
    shards = leaks.suffix_shards(docs, shard_words=50).cache()
    assert shards.count() > 10 and sum(len(r.doc_ids) for r in shards.collect()) == 61
    items = spark.createDataFrame([(1, " ".join(w)), (2, " ".join(w[10:30])), (3, "s1 s2")], "item_id int, text string")
    got = collections.Counter((r.doc_id, r.item_id) for r in leaks.leaks_in_shards(shards, items).collect())
    whole = {(d, k) for d in range(60) for k, (a, b) in {1: (0, 40), 2: (10, 30)}.items() if min(b, d % 25 + 14) - max(a, d % 25) >= 12}
    assert got == collections.Counter([*whole, *((d, 3) for d in range(60) if d % 25 <= 1), (None, 1), (None, 2), (None, 3)])
    s = leaks.Shard([leaks.item_words(r.text) for r in docs.collect() if r.text and r.text != "—"])
    it = leaks.Items([(1, " ".join(w)), (2, " ".join(w[10:30]))])
    whole = sorted(leaks.find(s.flat, s.array, s.words, it))
    monkeypatch.setattr(leaks, "HITS", 7)
    assert sorted(leaks.find(s.flat, s.array, s.words, it)) == whole


def test_leaks_edges(spark):
    w = [f"Слово{i}" for i in range(20)]
    docs = [(1, "начало " + ",\n".join(w).upper() + " конец"), (2, " ".join(w[:11])), (3, None), (4, ""), (5, LONG + " ".join(w[3:17])), (6, " ".join(reversed(w))), (7, "кратко из пяти слов")]
    items = [(10, " ".join(w)), (11, " ".join(w)), (12, None), (13, ""), (14, "—"), (15, "Кратко: из пяти слов")]
    d = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("item_id", F.lit("clash"))
    i = spark.createDataFrame(items, "item_id int, text string")
    want = {(1, 10), (1, 11), (5, 10), (5, 11), (7, 15)}
    assert {(r.doc_id, r.item_id) for r in leaks.leaked(d, i).collect()} == want
    assert {(r.doc_id, r.item_id) for r in leaks.leaked(d, i, block_bytes=40).collect()} == want
    assert {r.doc_id for r in leaks.without_leaks(d, i).collect()} == {2, 3, 4, 6}
    assert leaks.leaked(d.limit(0), i).count() == 0 and leaks.leaked(d, i.limit(0)).count() == 0


def test_leaks_of_very_short_items(spark):
    rng = random.Random(4)
    voc = [f"w{i}" for i in range(4)]
    items = [[rng.choice(voc) for _ in range(1 + k % 5)] for k in range(40)]
    texts = [" ".join(rng.choice([*voc, "x"]) for _ in range(rng.randrange(9))) for _ in range(300)] + [None, ""]
    want = {(d, k) for d, t in enumerate(texts) for k, w in enumerate(items) if f" {' '.join(w)} " in f" {t or ''} "}
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    i = spark.createDataFrame([(k, " ".join(w).upper()) for k, w in enumerate(items)], "item_id int, text string")
    got = [(r.doc_id, r.item_id) for r in leaks.leaked(d, i).collect()]
    assert set(got) == want and len(got) == len(want) and {len(items[k]) for _, k in want} >= {1, 2, 3, 4}


# ---- reading -----------------------------------------------------------------------------------------------


def test_trees_fit_and_hold_out():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1500, 8))
    y = np.clip(np.round(2.5 + x[:, 0] + (x[:, 1] > 0) - 0.5), 1, 4)
    source = np.array([f"s{i % 12}" for i in range(1500)])
    g = reading.fit_grader(x[:1000], y[:1000], np.ones(1000), source[:1000], n_trees=60)
    value, band = g.grade(x[1000:])
    assert (band == y[1000:]).mean() > 0.85 and value.min() >= 1 and value.max() <= 4 and 0.7 < g.accuracy <= 1


def test_reading_edges(spark):
    easy, hard = "Кот ест. Мы тут. ", "Институциональная трансформация, обусловленная многофакторностью взаимодействия, предполагает переосмысление. "
    docs = [(i, (easy if i % 2 else hard) * (12 + i % 7) * (1 if i % 2 else 2), f"s{i % 9}") for i in range(160)] + [(900, None, "s"), (901, "", "s"), (902, "мало слов", None), (903, "слово " * 39, "s"), (904, "— " * 60, "s"), (905, easy * 8000, None)]
    d = spark.createDataFrame(docs, "doc_id bigint, text string, source string").withColumn("band", F.lit("clash"))
    lab = [(i, r, 1 if i % 2 else 4) for i in range(160) for r in ("r1", "r2")] + [(3, "r1", 1), (4, "r9", None), (5, "r9", 77), (9999, "r1", 2), (None, "r1", 2)]
    labels = spark.createDataFrame(lab, "doc_id bigint, rater string, band int")
    got = {r.doc_id: r for r in reading.reading_bands(d, labels).collect()}
    assert set(got) == {*range(160), 904, 905} and got[905].band == 1
    assert np.mean([got[i].band == (1 if i % 2 else 4) for i in range(160)]) > 0.97
    none = reading.reading_bands(d, labels.limit(0)).collect()
    assert {r.band for r in none} == {2} and reading.reading_bands(d.limit(0), labels).count() == 0


@pytest.mark.parametrize("sources", [1, 5])
def test_few_ratings_are_fitted(sources):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(424, 6))
    y = np.where(x[:, 0] > 0, 4.0, 1.0)
    g = reading.fit_grader(x[:24], y[:24], np.ones(24), np.array([f"s{i % sources}" for i in range(24)]))
    band = g.grade(x[24:])[1]
    assert (np.abs(band - y[24:]) <= 1).mean() > 0.85 and len(set(band)) > 1
    for n in (1, 2):
        assert set(reading.fit_grader(x[:n], np.full(n, 4.0), np.ones(n), np.array(["s"] * n)).grade(x)[1]) == {4}
