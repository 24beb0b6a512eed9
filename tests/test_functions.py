import hashlib
import html
import json
import unicodedata

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quern.functions import hashing as H
from quern.functions import text as T
from quern.functions import treebank as TB

TEXTS = ["", "  a b c ", "Straße\tҮ", "x\x1cy z　w\n", "е́ё é", "line\r\nnext\x0bmore end\x85", None, "\n", "a" * 5000 + " b", "I&amp;nbsp;&lt;"]


def _rows(spark, *cols):
    return spark.createDataFrame([(i, x) for i, x in enumerate(TEXTS)], "i int, x string").select("i", "x", *cols).orderBy("i").collect()


def test_text_functions_equal_python(spark):
    for r in _rows(spark, T.split_words("x").alias("w"), T.split_lines("x").alias("l"), T.strip("x").alias("s"), T.canonical_exact("x").alias("c"), T.html_unescape("x").alias("h")):
        if r.x is None:
            assert (r.w, r.l, r.s, r.c, r.h) == (None, None, None, None, None)
            continue
        assert r.w == r.x.split()
        assert r.l == r.x.splitlines()
        assert r.s == r.x.strip()
        assert r.c == " ".join(unicodedata.normalize("NFC", r.x).casefold().split())
        assert r.h == html.unescape(r.x)


def test_fingerprint_equals_json(spark):
    want = lambda v: hashlib.sha256(json.dumps(v, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    texts = [x for x in TEXTS if x is not None] + ["".join(map(chr, range(1, 128))), 'q"\\']
    df = spark.createDataFrame([(x, [x, "b"]) for x in texts], "x string, a array<string>")
    for r in df.select("x", H.fingerprint(F.col("x")).alias("f"), H.fingerprint_list(42, F.col("x"), F.col("a"), None).alias("g")).collect():
        assert r.f == want(r.x) == H.fingerprint_value(r.x)
        assert r.g == want([42, r.x, [r.x, "b"], None])
    with pytest.raises(ValueError):
        H.fingerprint_value(float("nan"))


def test_record_ids(spark):
    df = spark.createDataFrame([("Титул", 2, "x"), ("", 3, 'q"'), (None, 4, "y")], "t string, i bigint, x string")
    got = [r[0] for r in df.select(H.record_id("mhr", F.col("t"), F.col("i"), F.col("x"))).collect()]
    assert got == ["mhr:wiki:" + H.fingerprint_value(v)[:20] for v in ("Титул", [3, 'q"'], [4, "y"])]


def test_file_hash(tmp_path):
    p = tmp_path / "f"
    p.write_bytes(b"x" * (3 << 20))
    assert H.file_hash(str(p)) == hashlib.sha256(b"x" * (3 << 20)).hexdigest()


def test_ngrams(spark):
    df = spark.createDataFrame([("a b c a b c",), ("a b",), ("",)], "x string")
    got = [sorted(r.g) for r in df.select(T.ngrams(T.split_words("x"), 3).alias("g")).collect()]
    assert got == [["a b c", "b c a", "c a b"], [], []]


def test_usable_forms(spark):
    df = spark.createDataFrame([(["мый", "толам", "тыш"],), (["мый", "tol", "тыш", "да"],), (["мый", "толам"],), (["мый", "да", "тый", "1", "2"],), (["мый", "да", "тый", "1"],)], "f array<string>")
    assert [r.u for r in df.select(T.usable_forms(F.col("f")).alias("u")).collect()] == [True, False, False, False, True]


def test_features(spark):
    rows = ["_", "B=2|A=1", "A=1=2", "A", "A=|B=1", "A=1|A=2", ""]
    df = spark.createDataFrame([(x,) for x in rows], "f string")
    got = [r.f for r in df.select(TB.format_feats(TB.parse_feats(F.col("f"))).alias("f")).collect()]
    assert got == ["_", "A=1|B=2", "A=1=2", None, None, None, None]


@settings(max_examples=60, deadline=None)
@given(st.text("абвгдabc", min_size=1, max_size=9), st.text("абвгдabc", min_size=1, max_size=9))
def test_lemma_rule_rebuilds(word, lemma):
    a, b, c, d = json.loads(TB.lemma_rule_value(word, lemma))
    assert c + word[a : len(word) - b] + d == lemma


def test_lemma_rule_columns(spark):
    df = spark.createDataFrame([("книгами", "книга"), ("шёл", "идти"), ("a", "_"), (None, "x")], "w string, l string")
    r = df.withColumn("r", TB.lemma_rule("w", "l")).withColumn("b", TB.apply_lemma_rule(F.col("w"), F.col("r"))).collect()
    assert [x.b for x in r] == ["книга", "идти", "a", None] and r[2].r is None
    bad = spark.createDataFrame([("abc", x) for x in ('[9,0,"",""]', "nope", '[1,1,"x"]', '[-1,0,"",""]')], "w string, r string")
    assert {x.b for x in bad.select(TB.apply_lemma_rule(F.col("w"), F.col("r")).alias("b")).collect()} == {"abc"}


def test_spacing(spark):
    rows = [(["Мый", "толам", "."], "Мый толам."), (["a", "b"], "a x b"), (["a", "q"], "a b"), (["a"], " a "), ([], "a"), (["aa", "a"], "aaa")]
    df = spark.createDataFrame(rows, "f array<string>, t string")
    got = [r.s for r in df.select(TB.spaces_after(F.col("f"), F.col("t")).alias("s")).collect()]
    assert got == [[False, True, False], None, None, [False], None, [True, False]]


def test_cycles(spark):
    rows = [[0, 1, 2], [2, 1, 0], [0, 3, 2], [0], [2, 3, 4, 5, 6, 7, 8, 0], [2, 3, 4, 5, 6, 7, 8, 1]]
    df = spark.createDataFrame([(x,) for x in rows], "h array<int>")
    assert [r.c for r in df.select(TB.has_cycle(F.col("h")).alias("c")).collect()] == [False, True, True, False, False, True]


def _best_tree(s):
    """All head lists of a small matrix."""
    import itertools

    n, best, heads = len(s), -1e18, None
    for hs in itertools.product(range(n), repeat=n - 1):
        if sum(h == 0 for h in hs) != 1 or any(h == d for d, h in enumerate(hs, 1)):
            continue
        ok = True
        for d in range(1, n):
            seen, at = set(), d
            while at and at not in seen:
                seen.add(at)
                at = hs[at - 1]
            ok &= at == 0
        score = sum(s[h][d] for d, h in enumerate(hs, 1))
        if ok and score > best:
            best, heads = score, hs
    return best, heads


def test_decoder_is_exact():
    rng = np.random.default_rng(7)
    for n in range(2, 7):
        for _ in range(8):
            s = rng.uniform(-2, 2, (n, n))
            got = TB.decode_tree(s)
            best, _ = _best_tree(s)
            assert sum(h == 0 for h in got[1:]) == 1
            assert abs(sum(s[h][d] for d, h in enumerate(got) if d) - best) < 1e-9


def test_decoder_larger_is_a_tree():
    rng = np.random.default_rng(8)
    for n in (9, 11, 20):
        got = TB.decode_tree(rng.uniform(-2, 2, (n, n)))
        for d in range(1, n):
            at, steps = d, 0
            while at:
                at, steps = got[at], steps + 1
                assert steps <= n


def test_common_subsequence():
    assert TB.common_subsequence(["A", "b", "c"], ["a", "c"]) == [(0, 0), (2, 1)]
    assert TB.common_subsequence([], ["a"]) == []


def test_lemma_rule_without_common_part():
    assert TB.lemma_rule_value("abc", "xyz") == '[0,3,"","xyz"]'
    assert TB.lemma_rule_value("", "xyz") == '[0,0,"","xyz"]' and TB.lemma_rule_value("abc", "") == '[0,3,"",""]'
    assert TB.lemma_rule_value("abxab", "zzaby") == '[0,3,"zz","y"]'


@given(st.text(alphabet="abc", max_size=9), st.text(alphabet="abc", max_size=9))
def test_lemma_rule_keeps_the_longest_common_part(word, lemma):
    a, b, c, d = json.loads(TB.lemma_rule_value(word, lemma))
    parts = [(-(j - i), i) for i in range(len(word)) for j in range(i + 1, len(word) + 1) if word[i:j] in lemma]
    size, at = min(parts) if parts else (0, 0)
    assert (a, len(word) - a - b) == (at, -size) and c + word[a : len(word) - b] + d == lemma and len(c) == lemma.find(word[at : at - size])
