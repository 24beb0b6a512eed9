"""Scores of treebanks whose sentences stand side by side, so that no word moves.

Where gold and system hold the same sentences in one row each, and each of them is as many characters
long on both sides, all sentences have the same stretches of their documents. Words, multi-word tokens,
parents and children are then compared within the row, as arrays over many sentences at once, and
only counts leave a task. Otherwise words are aligned over the documents (:func:`scoring.metrics`).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.treebank import common_subsequence
from .scoring import CONTENT_RELATIONS, FUNCTIONAL_RELATIONS, UNIVERSAL_FEATURES, metrics, with_rates

_TESTS = ["UPOS", "XPOS", "UFeats", "AllTags", "Lemmas", "UAS", "LAS", "CLAS", "MLAS", "BLEX"]
_COUNTS = ["uneven", "sentences", "gold", "system", "gold_content", "system_content", "gold_spans", "system_spans", "spans", "aligned", "aligned_content", *_TESTS]
_FEATURES = frozenset(UNIVERSAL_FEATURES)
_STRINGS = ["lemma", "upos", "xpos", "feats", "deprel"]


def _universal(x: str | None) -> str | None:
    return None if x is None else "|".join(sorted(f for f in x.split("|") if f.split("=", 1)[0] in _FEATURES))


_AS_SCORED = {"feats": _universal, "deprel": lambda x: None if x is None else x.split(":", 1)[0]}


class _Side:
    """The words of one side of a batch, in order, with their places: sentence ``k`` begins at ``k * reach``."""

    def __init__(self, words: pa.Array):
        n = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = words.flatten()
        number = lambda c, empty: pc.fill_null(pc.struct_field(flat, c), empty).to_numpy(zero_copy_only=False).astype(np.int64)
        self.sent, ids = np.repeat(np.arange(len(n)), n), number("id", 0)
        key = (self.sent << 32) + ids
        if (np.diff(key) < 0).any():
            order = np.argsort(key, kind="stable")
            flat, ids, key = flat.take(pa.array(order)), ids[order], key[order]
        bare = lambda c: pc.replace_substring_regex(pc.struct_field(flat, c), r"\p{Zs}", "")
        self.n, self.ids, self.key, self.head = n, ids, key, number("head", -1)
        self.strings = {c: pc.struct_field(flat, c) for c in _STRINGS}
        first, span, self.form = number("span_first", -1), bare("span_form"), bare("form")
        self.multi = first >= 0
        chars = lambda x: pc.fill_null(pc.utf8_length(x), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        form, own = chars(self.form), chars(pc.coalesce(span, self.form))
        step = np.where(~self.multi, form, np.where(ids == first, chars(span), 0))
        self.length = np.bincount(self.sent, step, len(n)).astype(np.int64)
        through = np.cumsum(step)
        before = np.concatenate([[0], np.cumsum(self.length)])[:-1]
        self.end = through - before[self.sent]
        self.start = self.end - own

    def place(self, reach: int) -> None:
        self.start, self.end = self.start + self.sent * reach, self.end + self.sent * reach

    def word_of(self, number: np.ndarray) -> np.ndarray:
        """Where the word of a number is in the sentence of each word; -1 where it has none."""
        if not len(self.key):
            return np.empty(0, np.int64)
        want = (self.sent << 32) + number
        at = np.minimum(np.searchsorted(self.key, want), len(self.key) - 1)
        return np.where((number > 0) & (self.key[at] == want), at, -1)


def _islands(g: _Side, s: _Side) -> tuple[np.ndarray, np.ndarray]:
    """Where the smallest stretches begin and end that no multi-word token of either side crosses."""
    start, end = (np.concatenate([getattr(t, c)[t.multi] for t in (g, s)]) for c in ("start", "end"))
    order = np.lexsort((end, start))
    start, reach = start[order], np.maximum.accumulate(end[order]) if len(end) else end
    begins = np.ones(len(start), bool)
    begins[1:] = start[1:] >= reach[:-1]
    last = np.concatenate([np.flatnonzero(begins)[1:] - 1, [len(start) - 1]]) if len(start) else np.empty(0, np.int64)
    return start[begins], reach[last]


def _aligned(g: _Side, s: _Side) -> tuple[np.ndarray, np.ndarray]:
    """Aligned words: of equal span, inside islands by a longest common subsequence of their forms."""
    low, high = _islands(g, s)

    def island(t: _Side) -> np.ndarray:
        if not len(low):
            return np.full(len(t.ids), -1)
        i = np.maximum(np.searchsorted(low, t.start, "right") - 1, 0)
        return np.where((t.start >= low[i]) & (t.start < high[i]) & (t.end <= high[i]), i, -1)

    gi, si = island(g), island(s)
    gp, sp = np.flatnonzero(gi < 0), np.flatnonzero(si < 0)
    _, a, b = np.intersect1d(g.start[gp], s.start[sp], assume_unique=True, return_indices=True)
    gp, sp = gp[a], sp[b]
    same = g.end[gp] == s.end[sp]
    found = [(gp[same], sp[same])]
    gw, sw = np.flatnonzero(gi >= 0), np.flatnonzero(si >= 0)
    gn, sn = (np.bincount(x, minlength=len(low)).astype(np.int64) for x in (gi[gw], si[sw]))
    g0, s0 = np.cumsum(gn) - gn, np.cumsum(sn) - sn
    # islands with the same forms on both sides are aligned one to one
    like = gn == sn
    ga, sa = gw[np.repeat(like, gn)], sw[np.repeat(like, sn)]
    differ = pc.fill_null(pc.not_equal(g.form.take(pa.array(ga)), s.form.take(pa.array(sa))), True).to_numpy(zero_copy_only=False)
    like[gi[ga[differ]]] = False
    found.append((gw[np.repeat(like, gn)], sw[np.repeat(like, sn)]))
    more = [(gw[g0[x] + i], sw[s0[x] + j]) for x in np.flatnonzero(~like & (gn > 0) & (sn > 0))
            for i, j in common_subsequence(g.form.take(pa.array(gw[g0[x]:g0[x] + gn[x]])).to_pylist(), s.form.take(pa.array(sw[s0[x]:s0[x] + sn[x]])).to_pylist())]
    if more:
        found.append(tuple(np.array(more, np.int64).T))
    return np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])


def _coded(g: _Side, s: _Side, column: str) -> tuple[np.ndarray, np.ndarray, list]:
    """A column of both sides as numbers of its values as the scorer sees them, and the values."""
    coded = pa.concat_arrays([g.strings[column], s.strings[column]]).dictionary_encode("encode")
    written = coded.dictionary.to_pylist()
    as_scored = _AS_SCORED.get(column, lambda x: x)
    number: dict = {}
    to = np.array([number.setdefault(as_scored(x), len(number)) for x in written], np.int64)
    codes = to[coded.indices.to_numpy(zero_copy_only=False)] if len(to) else np.empty(0, np.int64)
    return codes[: len(g.ids)], codes[len(g.ids) :], list(number)


def compare(gold: pa.Array, system: pa.Array) -> dict[str, int]:
    """The counts of :data:`_COUNTS` over a batch of sentences; only ``uneven`` ones where sentences differ in length."""
    g, s = _Side(gold), _Side(system)
    uneven = (g.length != s.length) | ((g.n > 0) != (s.n > 0))
    for t in (g, s):  # words without characters, or with a token of which the first word is missing
        uneven[t.sent[(t.start < 0) | (t.start >= t.end)]] = True
    reach = int(max(g.length.max(initial=0), 1)) + 1
    if uneven.any() or len(uneven) * reach**2 >= 1 << 62:  # spans are numbers below that
        return dict.fromkeys(_COUNTS, 0) | {"uneven": max(1, int(uneven.sum()))}
    g.place(reach)
    s.place(reach)
    codes = {c: _coded(g, s, c) for c in _STRINGS}
    spans = [np.unique(t.start * reach + (t.end - t.start)) for t in (g, s)]
    a, b = _aligned(g, s)
    eq = {c: x[a] == y[b] for c, (x, y, _) in codes.items()}
    among = lambda names: np.isin(np.arange(len(codes["deprel"][2])), [i for i, x in enumerate(codes["deprel"][2]) if x in names])
    content, functional = among(CONTENT_RELATIONS), among(FUNCTIONAL_RELATIONS)
    gd, sd = codes["deprel"][:2]
    system_of = np.full(len(g.ids), -1)
    system_of[a] = b
    g_parent, s_parent = g.word_of(g.head), s.word_of(s.head)
    gp, sp = g_parent[a], s_parent[b]
    met = (gp >= 0) & (sp >= 0) & (system_of[gp] == sp)  # parents that are aligned
    parent = ((g.head[a] == 0) & (s.head[b] == 0)) | met
    kids = lambda p, d: np.bincount(p[(p >= 0) & functional[d]], minlength=len(p)) if len(p) else np.empty(0, np.int64)
    shared = met & functional[gd[a]] & eq["deprel"] & eq["upos"] & eq["feats"]
    in_common = np.bincount(gp[shared], minlength=len(g.ids))[a] if len(a) else np.empty(0, np.int64)
    same_kids = (kids(g_parent, gd)[a] == in_common) & (kids(s_parent, sd)[b] == in_common)
    any_lemma = [i for i, x in enumerate(codes["lemma"][2]) if x == "_"]
    lemma = eq["lemma"] | np.isin(codes["lemma"][0][a], any_lemma)
    las, of_content = parent & eq["deprel"], content[gd[a]]
    tests = [eq["upos"], eq["xpos"], eq["feats"], eq["upos"] & eq["xpos"] & eq["feats"], lemma, parent, las, las & of_content, las & of_content & eq["upos"] & eq["feats"] & same_kids, las & of_content & lemma]
    return {
        "uneven": 0, "sentences": int((g.n > 0).sum()), "gold": len(g.ids), "system": len(s.ids), "gold_content": int(content[gd].sum()), "system_content": int(content[sd].sum()),
        "gold_spans": len(spans[0]), "system_spans": len(spans[1]), "spans": len(np.intersect1d(*spans, assume_unique=True)), "aligned": len(a), "aligned_content": int(of_content.sum()),
        **{k: int(x.sum()) for k, x in zip(_TESTS, tests)},
    }


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_pylist([compare(b.column("gold"), b.column("system"))], pa.schema([(c, pa.int64()) for c in _COUNTS]))


def metrics_of_pairs(pairs: DataFrame) -> DataFrame:
    """The table of :func:`scoring.metrics` from ``(doc, sent, gold, system)``, a row for each sentence.

    ``gold`` and ``system`` are arrays of ``(id, form, lemma, upos, xpos, feats, head, deprel, span_first, span_form)``.
    Where a sentence isn't as long on both sides, or words have no characters, all words are aligned over their documents instead.
    """
    sums = pairs.select("gold", "system").mapInArrow(_compared, ", ".join(f"{c} bigint" for c in _COUNTS)).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in _COUNTS])
    n = sums.first()  # one row
    if n["uneven"]:
        return metrics(*[pairs.select("doc", "sent", F.explode(side).alias("w")).select("doc", "sent", "w.*") for side in ("gold", "system")])
    by_content = {"CLAS", "MLAS", "BLEX"}
    rows = [(k, n[k], n["gold_content"], n["system_content"], n["aligned_content"]) if k in by_content else (k, n[k], n["gold"], n["system"], n["aligned"]) for k in _TESTS]
    rows += [("Words", n["aligned"], n["gold"], n["system"], None), ("Tokens", n["spans"], n["gold_spans"], n["system_spans"], None), ("Sentences", *[n["sentences"]] * 3, None)]
    return with_rates(pairs.sparkSession.createDataFrame(rows, "metric string, correct bigint, gold_total bigint, system_total bigint, aligned_total bigint"))
