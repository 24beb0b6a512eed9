import os
import random

from pyspark.sql import functions as F

from quern.operators import scoring
from quern.operators.paired import metrics_of_pairs
from quern.plans.registry import QUERIES
from quern.session import shared_dir

WORD = "id int, form string, lemma string, upos string, xpos string, feats string, head int, deprel string, span_first int, span_form string"
PAIR = f"doc string, sent int, gold array<struct<{WORD.replace(' ', ':').replace(',:', ',')}>>, system array<struct<{WORD.replace(' ', ':').replace(',:', ',')}>>"


def _cut(rng, text):
    """The text cut into words at random, some of them in multi-word tokens whose words are others than its characters."""
    words, at = [], 0
    while at < len(text):
        token = text[at : at + rng.choice([1, 1, 2, 3])]
        at += len(token)
        if len(token) > 1 and rng.random() < 0.5:
            first = len(words) + 1
            inner = list(token) if rng.random() < 0.6 else [rng.choice(["a", "B", "x", "ab"]) for _ in range(rng.randint(1, 3))]
            words += [(x, first, token) for x in inner]
        else:
            words.append((token if rng.random() < 0.9 else token[0] + " " + token[1:], None, None))
    out = []
    for i, (form, first, span) in enumerate(words, 1):
        head = rng.choice([0, i - 1, i - 1, i + 1, rng.randint(0, len(words) + 1)])
        feats = rng.choice(["_", None, "Case=Nom|Foo=Bar", "Number=Sing|Case=Nom", "Case=Nom|Number=Sing"])
        out.append((i, form, rng.choice(["l", "_", "m", None]), rng.choice(["N", "N", "V", None]), "_", feats, head, rng.choice(["root", "case", "case:x", "det", "obj", "nsubj:y"]), first, span))
    return out


def _by_words(spark, pairs):
    return scoring.metrics(*[pairs.select("doc", "sent", F.explode(c).alias("w")).select("doc", "sent", "w.*") for c in ("gold", "system")])


def test_pairs_score_as_aligned_words(spark):
    rng = random.Random(5)
    rows = []
    for sent in range(400):
        text = "".join(rng.choice("abAB") for _ in range(rng.randint(1, 9)))
        gold = _cut(rng, text)
        system = _cut(rng, text) if sent % 4 else [(*w[:3], rng.choice(["N", w[3]]), *w[4:]) for w in gold]
        rows.append((f"d{sent % 3}", sent, gold, system if sent % 5 else system[::-1]))  # words in any order
    pairs = spark.createDataFrame(rows, PAIR).repartition(3)
    got, want = ({r.metric: tuple(r) for r in m.collect()} for m in (metrics_of_pairs(pairs), _by_words(spark, pairs)))
    assert got == want and len(got) == 13 and 0 < got["MLAS"][1] < got["CLAS"][1] < got["LAS"][1] < got["Words"][1] < got["Words"][2]


def test_pairs_of_other_stretches(spark):
    word = lambda i, form: (i, form, "l", "N", "_", "_", 0, "root", None, None)
    pairs = spark.createDataFrame([("d", 0, [word(1, "ab"), word(2, "c")], [word(1, "ab")]), ("d", 1, [word(1, "d")], [word(1, "c"), word(2, "d")])], PAIR)
    m = {r.metric: r for r in metrics_of_pairs(pairs).collect()}
    assert m["Words"].correct == 3 and m["Tokens"].correct == 3 and m["Sentences"].correct == 0
    assert [tuple(r)[1:4] for r in metrics_of_pairs(pairs.limit(0)).collect()] == [(0, 0, 0)] * 13


def test_multiword_scores_keep_words_in_place(spark):
    """No word of the table is written into the shared folder."""
    path = shared_dir(spark).removeprefix("file:")
    files = lambda: {os.path.join(d, f) for d, _, names in os.walk(path) for f in names}
    before = files()
    assert QUERIES["a8_multiword_metrics"](spark, "/root/testdata/sf0.001").count() == 13 and not files() - before
