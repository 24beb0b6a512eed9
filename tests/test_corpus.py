import collections
import random

import pytest
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import blocks as B
from quern.operators import cleaning, components, corpus, selection


def test_clean_wiki(spark):
    text = "\n".join(["Категория:Тест", "  [[Йошкар-Ола|ола]] &amp; <b>эҥер</b>  ", "{| таблица", "123 456", "{{т|{{у}}}} лу", "мый", "категория:x", "", "100px|x"])
    r = corpus.clean_wiki(spark.createDataFrame([(1, text), (2, None), (3, "")], "id int, text string")).orderBy("id").collect()
    assert r[0].clean == "ола & эҥер\n{{т|}} лу\nмый"
    assert [(a.line_no, a.reason) for a in r[0].audit] == [(1, "wiki_metadata_line"), (2, "wiki_inline_cleanup"), (3, "wiki_metadata_line"), (5, "wiki_inline_cleanup"), (7, "wiki_metadata_line"), (9, "wiki_metadata_line")]
    assert r[1].clean == "" and r[2].clean == "" and not r[1].audit


def test_representation_guard(spark):
    with pytest.raises(ValueError):
        corpus.stamp_representation(spark.range(1), "other")


def _naive_components(keys):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for r, k in keys:
        a, b = find(("r", r)), find(("k", k))
        parent[a] = b
    groups = collections.defaultdict(list)
    for r, _ in keys:
        groups[find(("r", r))].append(r)
    return {r: min(v) for v in groups.values() for r in v}


def test_components_against_union_find(spark):
    rng = random.Random(3)
    keys = [(rng.randrange(300), f"k{rng.randrange(220)}") for _ in range(420)] + [(i, f"chain{i}") for i in range(60)] + [(i + 1, f"chain{i}") for i in range(60)] + [(400 + i, "hot") for i in range(150)]
    got = {r.rec: r.root for r in components.group_by_shared_keys(spark.createDataFrame(keys, "rec int, key string")).collect()}
    assert got == _naive_components(keys)


def test_components_of_nothing(spark):
    assert components.group_by_shared_keys(spark.createDataFrame([], "rec int, key string")).count() == 0


def test_rank_by_hash_is_a_sort(spark):
    df = spark.range(500).withColumn("g", F.col("id") % 3)
    got = components.rank_by_hash(df, ["g"], F.sha2(F.col("id").cast("string"), 256), ["id"]).collect()
    import hashlib

    for g in range(3):
        want = sorted((hashlib.sha256(str(i).encode()).hexdigest(), i) for i in range(500) if i % 3 == g)
        assert [i for _, i in want] == [r.id for r in sorted((x for x in got if x.g == g), key=lambda x: x["rank"])]


def test_splits_and_merge(spark):
    rows = [(f"r{i:02d}", [f"s{i}", "shared" if i in (3, 7) else f"t{i}"], "Мый толам" if i in (1, 2) else f"текст {i}", "mhr") for i in range(12)] + [("e1", ["s1"], "Мый толам", "enets"), ("n1", None, None, "mhr")]
    df = spark.createDataFrame(rows, "id string, source_ids array<string>, text string, language string")
    roots = corpus.duplicate_groups(df)
    by = {r.rec: r.root for r in roots.collect()}
    assert by["r01"] == by["r02"] == "r01" and by["r03"] == by["r07"] == "r03" and by["e1"] == "e1"
    merged = corpus.merge_groups(df, roots)
    m = {r.root: r for r in merged.collect()}
    assert m["r01"].text == "Мый толам" and m["r01"].source_ids == ["s1", "s2", "t1", "t2"] and m["r03"].n_records == 2
    split = {r.root: r.split for r in corpus.ranked_splits(merged, targets=["mhr"]).collect()}
    again = {r.root: r.split for r in corpus.ranked_splits(merged.orderBy(F.desc("root")), targets=["mhr"]).collect()}
    assert split == again and split["e1"] == "train"
    assert collections.Counter(v for k, v in split.items() if k != "e1") == {"train": 8, "test": 1, "validation": 1}


def test_overlap_order(spark):
    w = [f"w{i}" for i in range(40)]
    rows = [("t", "test", " ".join(w[:14])), ("v", "validation", "своё\n" + " ".join(w[1:14])), ("a", "train", "x " + " ".join(w[2:14]).upper() + "\nчистая строка\n\nсвоё"), ("b", "train", "совсем другое"), ("n", "train", None)]
    kept, audit = corpus.remove_overlap(spark.createDataFrame(rows, "id string, split string, text string"), None, 12)
    assert {r.id: r.text for r in kept.collect()} == {"t": rows[0][2], "v": "своё", "a": "чистая строка", "b": "совсем другое"}
    assert sorted((r.id, r.line_no, r.reason) for r in audit.collect()) == [("a", 1, "protected_passage"), ("a", 4, "protected_passage"), ("v", 2, "protected_passage")]


def test_recovery(spark):
    utt = spark.createDataFrame([("один", "A"), ("общая", "A"), ("общая", "B"), ("два", "A"), ("три", "B")], "text string, recording string")
    lines = spark.createDataFrame([("d", i, x) for i, x in enumerate(["один ", "общая", "два", "нет", "общая", "три"])], "doc string, line int, text string")
    got = {r.line: (r.method, r.recording) for r in corpus.recover_recordings(lines, utt).collect()}
    assert got == {0: ("unique_exact_recording", "A"), 1: ("exact_with_matching_neighbor_anchors", "A"), 2: ("unique_exact_recording", "A"), 3: ("unmatched", None), 4: ("ambiguous_recording", None), 5: ("unique_exact_recording", "B")}


def test_language_filter(spark):
    d = spark.createDataFrame([(x,) for x in "это дом большой новый город".split()], "word string")
    ru, lo, uk = (["ru", "uk", "x"], [0.9, 0.05, 0.05]), (["ru", "uk", "x"], [0.4, 0.3, 0.3]), (["uk", "ru", "x"], [0.9, 0.05, 0.05])
    rows = [
        (1, "это дом", "mhr", *ru), (2, "это дом", "mhr", *lo), (3, "это ӱдыр", "mhr", *ru), (4, "тиде дом", "mhr", *ru), (5, "домлэн это", "udm", *ru),
        (6, "місто це", "mhr", *uk), (7, "это дом большой новый Пекшвар", "mhr", *ru), (8, "это дом большой новый пекшвар", "mhr", *ru), (9, "это дом house", "mhr", *ru), (10, None, "mhr", *ru), (11, "", "mhr", None, None),
    ]
    df = spark.createDataFrame(rows, "sent_id int, text string, language string, labels array<string>, probs array<double>")
    got = {r.id: r.reason for r in cleaning.language_decision(df, d).collect()}
    assert {k for k, v in got.items() if v == "russian_only"} == {1, 7} and {k for k, v in got.items() if v == "ukrainian"} == {6} and len(got) == 11


def test_deduplicate(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, None), (5, None)], "sent_id int, text string")
    got = {r.sent_id: (r.kept_sent_id, r.is_kept) for r in cleaning.deduplicate(df, F.col("text"), ["sent_id"], preferred=F.col("sent_id") == 2).collect()}
    assert got == {1: (2, False), 2: (2, True), 3: (3, True), 4: (4, True), 5: (5, True)}


def test_selection(spark):
    s = spark.createDataFrame([("a", "1", [1, 2, 3], ["мый", "толам", "тыш"], "мый толам тыш"), ("a", "2", [1, 2, 3], ["тый", "толат", "тыш"], "тый толат тыш"), ("b", "3", [1, 3, 4], ["мый", "толам", "тыш"], "мый толам тыш"),
                               ("c", "4", [1, 2, 3], ["мый", "tol", "тыш"], "мый tol тыш")], "article string, sent_id string, ids array<int>, forms array<string>, text string")
    from quern.functions.hashing import fingerprint_value

    sid = "mhr:wiki:" + fingerprint_value("a")[:20]
    splits = spark.createDataFrame([(sid, "train")], "source_id string, split string")
    used = spark.createDataFrame([(sid, "1")], "source_id string, source_sent_id string")
    none = spark.createDataFrame([], "source_id string")
    e = selection.eligible(s, "mhr", splits, used, none, 3, 5)
    assert [(r.source_id, r.sent_id) for r in e.collect()] == [(sid, "2")]
    assert [r.sent_id for r in selection.select_batch(e, "mhr", "r1", 5, 42).collect()] == ["mhr-fewshot-r1-0001"]


def test_dev_batches(spark):
    mk = lambda n, o: spark.createDataFrame([(f"s{o + i}", str(i)) for i in range(n)], "source_id string, source_sent_id string")
    got = selection.assign_dev_batches([mk(10, 0), mk(10, 5)], "mhr").collect()
    by = collections.defaultdict(set)
    for r in got:
        by[r.source_id].add(r.split)
    assert all(len(v) == 1 for v in by.values())
    assert sum(r.split == "dev" for r in got if r.batch == 0) == 1 and sum(v == {"dev"} for v in by.values()) == 2


def test_dev_batches_past_the_cap(spark):
    from quern.functions.hashing import fingerprint_value

    mk = lambda n, o: spark.createDataFrame([(f"s{o + i}", f"{o + i}-{k}") for i in range(n) for k in range(4)], "source_id string, source_sent_id string")
    batches = [mk(10, 0), mk(10, 5), mk(10, 30)]
    got = selection.assign_dev_batches(batches, "mhr", dev_cap=5)
    rows = got.collect()
    first = sorted(range(10), key=lambda i: fingerprint_value([42, "mhr", f"s{i}"]))[:4]  # 40 rows allow four articles: 16 rows, more than the cap
    assert len(rows) == 120 and {r.source_id for r in rows if r.split == "dev"} == {f"s{i}" for i in first}
    dev = 4 * (len(first) + sum(i >= 5 for i in first))
    assert [r.dev_rows for r in selection.over_cap(got, 5).collect()] == [dev] and selection.over_cap(got, dev).isEmpty()


def test_draws_follow_weights(spark):
    df = spark.range(300).select(F.when(F.col("id") < 30, "a").otherwise("b").alias("language"), F.col("id").cast("string").alias("id"))
    w = spark.createDataFrame([("a", 0.5), ("b", 0.5)], "language string, weight double")
    n = {r.language: r["count"] for r in selection.hash_draw(df, w, 2000, 1).groupBy("language").count().collect()}
    assert sum(n.values()) == 2000 and abs(n["a"] - 1000) < 120


def test_chunks_and_padding(spark):
    df = spark.createDataFrame([("d", list(range(5))), ("e", []), ("f", None)], "id string, ids array<int>")
    got = B.chunks(df, 2).orderBy("block_offset").collect()
    assert [(r.block_offset, r.input_ids, r.special_tokens_mask) for r in got] == [(0, [0, 0, 1, 2], [1, 0, 0, 1]), (2, [0, 2, 3, 2], [1, 0, 0, 1]), (4, [0, 4, 2], [1, 0, 1])]
    p = B.pad_batches(spark.createDataFrame([(1, [5, 6], [5, -100]), (1, [7], [7])], "batch int, input_ids array<int>, labels array<int>")).collect()
    assert sorted((r.input_ids, r.attention_mask, r.labels) for r in p) == [([5, 6], [1, 1], [5, -100]), ([7, 1], [1, 0], [7, -100])]


def test_masking_is_fixed(spark):
    df = spark.createDataFrame([("x", [0, *range(10, 60), 2], [1, *[0] * 50, 1])], "id string, input_ids array<int>, special_tokens_mask array<int>")
    a, b = (B.mask_blocks(df, 0.15, 42, 4, 100, [0, 1, 2, 3, 4]).collect()[0] for _ in range(2))
    assert a == b and sum(x != -100 for x in a.labels) >= 1 and a.input_ids[0] == 0
    assert all(a.labels[i] in (-100, v) for i, v in enumerate([0, *range(10, 60), 2]))


def test_arrays(spark):
    df = spark.createDataFrame([([0.1, 0.5, 0.5, 0.2],)], "s array<double>")
    r = df.select(B.top_predictions(F.col("s"), 2).alias("t"), B.gold_rank(F.col("s"), F.lit(3)).alias("g")).first()
    assert [(x.score, x["index"]) for x in r.t] == [(0.5, 1), (0.5, 2)] and r.g == 3


def test_text_canonical_native(spark):
    assert spark.createDataFrame([("  A b ",)], "x string").select(T.canonical("x")).first()[0] == "a b"


def test_epoch_draws():
    got = selection.epoch_draws({"b": 3, "a": 5}, {"b": 1.0, "a": 3.0}, 42, 1)
    assert len(got) == 8 and got == selection.epoch_draws({"a": 5, "b": 3}, {"a": 3.0, "b": 1.0}, 42, 1) != selection.epoch_draws({"a": 5, "b": 3}, {"a": 3.0, "b": 1.0}, 42, 2)
    assert all(0 <= i < {"a": 5, "b": 3}[n] for n, i in got)
    many = selection.epoch_draws({"a": 3000, "b": 1000}, {"a": 1.0, "b": 1.0}, 7, 0)
    assert abs(sum(n == "a" for n, _ in many) - 2000) < 200
    for bad in ({"a": 3}, {"a": 3, "b": 0}):
        with pytest.raises(ValueError):
            selection.epoch_draws(bad, {"a": 1.0, "b": 1.0}, 1, 1)
    again = selection.seeded_schedule({"a": 5, "b": 3}, {"a": 3.0, "b": 1.0}, 50, 42)
    assert again == selection.seeded_schedule({"a": 5, "b": 3}, {"a": 3.0, "b": 1.0}, 50, 42) and {n for n, _ in again} == {"a", "b"}


def test_greedy_groups_against_a_loop(spark):
    import random

    from quern.functions.hashing import fingerprint_value
    from quern.operators.treebank import greedy_groups

    rng = random.Random(8)
    rows, want = [], set()
    for b in range(12):
        sizes = {f"k{i}": rng.choice([1, 1, 2, 3, 30, rng.randrange(1, 60)]) for i in range(rng.randrange(1, 60))}
        goal = rng.choice([0, 1, round(sum(sizes.values()) * 0.1), round(sum(sizes.values()) * 0.4), 10_000])
        rows += [(b, k, n, goal) for k, n in sizes.items()]
        taken, total = [], 0
        for k in sorted(sizes, key=lambda k: (fingerprint_value([42, k]), k)):
            if total >= goal:
                break
            if not total or total + sizes[k] <= max(1.2 * goal, goal + 2):
                taken.append(k)
                total += sizes[k]
        want |= {(b, k) for k in taken or [min(sizes, key=lambda k: (sizes[k], fingerprint_value([42, k]), k))]}
    df = spark.createDataFrame(rows, "b int, key string, n int, goal bigint")
    assert {(r.b, r.key) for r in greedy_groups(df, ["b"], F.col("goal"), 42).collect()} == want
