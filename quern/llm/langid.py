"""Languages of texts and of their passages (problem 2), by prediction by partial matching.

For each language a variable-order tree of byte contexts (up to seven bytes, within a word)
with escape probabilities is trained on samples and then frozen. The exact code length of a
word in bits under each tree is the evidence; a shortest-path pass over the words of a text
pays a fixed number of bits for each change of language and yields passages. A word's code
lengths don't depend on its neighbours, so each distinct word is scored once and remembered.

Defined results: null, blank and letterless texts have no passage. Ties go to the language
that comes first in alphabetical order. Repeated rows are treated alike. Very long texts are
read whole. Other columns of the input are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .canon import WORD, fold, invisible_free, words

#: The codes that a text can be given.
CODES = ["en", "enets", "mhr", "nenets", "nio", "ru", "sel", "udm", "uk"]
ORDER = 8  # a symbol and at most seven bytes before it
#: Bits that a change of language costs between two words, and at a quotation mark, bracket or line end.
SWITCH_BITS, BORDER_BITS = 28.0, 7.0
#: Words that make a language present in a text.
MIN_WORDS = 4


_BORDERS = "«»“”„\"()[]\n"
_TOKEN = re.compile(WORD.pattern + "|[" + re.escape(_BORDERS) + "]")


def tokens_of(text: str | None) -> list[str]:
    """Words and the marks at which a language is likely to change, in reading order."""
    return _TOKEN.findall(fold(invisible_free(text))) if text else []


@dataclass(frozen=True)
class Samples:
    """Training words by language, in the order of ``codes``."""

    codes: list[str]
    words: list[list[str]]


def _pack(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of `` word `` for every word, the start of each, and each byte's offset in it."""
    raw = [b" " + t.encode("utf-8") + b" " for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    size = np.fromiter(map(len, raw), np.int64, len(raw))
    starts = np.zeros(len(raw), np.int64)
    np.cumsum(size[:-1], out=starts[1:])
    return data, starts, np.arange(len(data)) - np.repeat(starts, size)


def _grams(data: np.ndarray, offset: np.ndarray):
    """For lengths 1 to ORDER: the positions whose gram of that length stays in the word, and the packed grams."""
    g = data.astype(np.uint64)
    at = np.arange(len(data))
    yield at, g
    packed = g
    for m in range(2, ORDER + 1):
        shifted = np.zeros_like(packed)
        shifted[1:] = packed[:-1] << np.uint64(8)
        packed = shifted | g
        at = np.flatnonzero(offset >= m - 1)
        yield at, packed[at]


class PartialMatching:
    """Frozen context trees of all languages in one table of grams.

    Row ``i`` of ``gain`` holds the bits of the gram's last byte after the rest of the gram,
    less the escapes of that context; row ``i`` of ``escapes`` the bits of all escapes from
    the gram, as a context, down to the empty one. A byte then costs ``gain`` of the longest
    gram known that ends there plus ``escapes`` of the longest one that ends just before.
    """

    def __init__(self, samples: Samples):
        n = len(samples.codes)
        parts = []
        for texts in samples.words:
            data, _, offset = _pack(texts or ["a"])
            parts.append((data, offset))
        keys, tables = [], []
        made = [list(_grams(d, o)) for d, o in parts]
        for m in range(1, ORDER + 1):
            key = np.unique(np.concatenate([x[m - 1][1] for x in made]))
            table = np.zeros((len(key), n))
            for k, x in enumerate(made):
                at, g = x[m - 1]
                coded = parts[k][1][at] > 0  # the blank that opens a word is given, not coded
                table[:, k] = np.bincount(np.searchsorted(key, g), weights=coded, minlength=len(key))
            keys.append(key)
            tables.append(table)
        total = tables[0].sum(0)
        kinds = (tables[0] > 0).sum(0)
        empty = np.log2((total + kinds) / np.maximum(kinds, 1))
        cost = np.where(tables[0] > 0, np.log2((total + kinds) / np.maximum(tables[0], 1)), empty + 8.0)
        below = np.broadcast_to(empty, cost.shape)  # escapes of the context without its first byte
        costs, escapes, gains = [], [], [cost - empty]
        for m in range(1, ORDER + 1):
            key = keys[m - 1]
            t, d = np.zeros((len(key), n)), np.zeros((len(key), n))
            if m < ORDER:
                nxt, context = tables[m], np.searchsorted(key, keys[m] >> np.uint64(8))
                for k in range(n):
                    t[:, k] = np.bincount(context, weights=nxt[:, k], minlength=len(key))
                    d[:, k] = np.bincount(context, weights=nxt[:, k] > 0, minlength=len(key))
            esc = np.where(t > 0, np.log2(np.maximum(t + d, 1) / np.maximum(d, 1)), 0.0)
            if m > 1:
                tail = np.searchsorted(keys[m - 2], key & np.uint64((1 << 8 * (m - 1)) - 1))
                below = escapes[m - 2][tail]
            escapes.append(below + esc)
            costs.append(cost)
            if m < ORDER:
                tail = np.searchsorted(key, keys[m] & np.uint64((1 << 8 * m) - 1))
                c = tables[m]
                after = t[context] + d[context]
                cost = np.where(c > 0, np.log2(np.maximum(after, 1) / np.maximum(c, 1)), esc[context] + costs[m - 1][tail])
                gains.append(cost - escapes[m - 1][context])
        self.codes = samples.codes
        self.keys = keys
        self.first = np.concatenate([[0], np.cumsum([len(k) for k in keys])])
        self.gain = np.concatenate([*gains, np.full((1, n), 0.0)]).astype(np.float32)
        self.escapes = np.concatenate([*escapes, empty[None]]).astype(np.float32)
        self.gain[-1] = 8.0  # a byte that no language has seen, after the escape from the empty context

    def bits(self, texts: list[str]) -> np.ndarray:
        """Code length of each word in each language, shape (words, languages)."""
        if not texts:
            return np.zeros((0, len(self.codes)), np.float32)
        data, starts, offset = _pack(texts)
        nothing = len(self.gain) - 1
        row = np.full(len(data), nothing)
        alive = np.ones(len(data), bool)
        for m, (at, g) in enumerate(_grams(data, offset), 1):
            keep = alive[at]
            at, g = at[keep], g[keep]
            i = np.searchsorted(self.keys[m - 1], g)
            i[i == len(self.keys[m - 1])] = 0
            hit = self.keys[m - 1][i] == g
            row[at[hit]] = self.first[m - 1] + i[hit]
            alive[:] = False
            alive[at[hit]] = True
        each = self.gain[row]
        each[1:] += self.escapes[row[:-1]]
        each[starts] = 0
        return np.add.reduceat(each, starts, axis=0)


class Labeller:
    """Passages of texts; remembers the code lengths of at most ``memory`` words."""

    def __init__(self, model: PartialMatching, switch_bits: float = SWITCH_BITS, border_bits: float = BORDER_BITS, memory: int = 400_000):
        self.model, self.switch, self.border, self.memory = model, switch_bits, border_bits, memory
        self.borders = {c: i for i, c in enumerate(_BORDERS)}  # rows of zero bits
        self.known: dict[str, int] = dict(self.borders)
        self.table = np.zeros((memory + len(self.borders) + 1, len(model.codes)), np.float32)

    def _ids(self, flat: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Row of each word, and the table that holds the rows."""
        new = list(dict.fromkeys(w for w in flat if w not in self.known))
        if len(new) + len(self.known) > self.memory:
            self.known = dict(self.borders)
            new = list(dict.fromkeys(w for w in flat if w not in self.borders))
        if len(new) > self.memory:  # more distinct words in one batch than are remembered
            index = self.borders | {w: i for i, w in enumerate(new, len(self.borders))}
            table = np.concatenate([self.table[: len(self.borders)], *(self.model.bits(new[i : i + 50_000]) for i in range(0, len(new), 50_000))])
            return np.fromiter(map(index.__getitem__, flat), np.int64, len(flat)), table
        base = len(self.known)
        for i in range(0, len(new), 50_000):
            part = new[i : i + 50_000]
            self.table[base + i : base + i + len(part)] = self.model.bits(part)
        self.known.update(zip(new, range(base, base + len(new))))
        return np.fromiter(map(self.known.__getitem__, flat), np.int64, len(flat)), self.table

    def label(self, split: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For the tokens of each text: the language of every word (flat), the words' offsets by text, and bits."""
        lang, offsets, bits, word = self._paths(split)
        before = np.concatenate([[0], np.cumsum(word)])
        return lang[word], before[offsets], bits[word]

    def _paths(self, split: list[list[str]]):
        size = np.fromiter(map(len, split), np.int64, len(split))
        offsets = np.concatenate([[0], np.cumsum(size)])
        flat = [w for x in split for w in x]
        n = len(self.model.codes)
        if not flat:
            return np.zeros(0, np.int64), offsets, np.zeros((0, n), np.float32), np.zeros(0, bool)
        ids, table = self._ids(flat)
        bits = table[ids]
        word = ids >= len(self.borders)
        price = np.where(word, self.switch, self.border)
        lang = np.zeros(len(flat), np.int64)
        # texts in order of length; step t advances all texts that have a word t
        order = np.argsort(-size, kind="stable")
        order = order[size[order] > 0]
        lengths = size[order]
        start = offsets[:-1][order]
        most = int(lengths[0])
        counts = np.searchsorted(-lengths, -np.arange(most), side="left")  # texts longer than t
        path = np.zeros((len(order), n), np.float64)
        came = np.zeros(len(flat), np.int64)
        switched = np.zeros((len(flat), n), bool)
        for t in range(most):
            k = counts[t]
            at = start[:k] + t
            if t:
                p = path[:k]
                best = p.argmin(1)
                least = p[np.arange(k), best] + price[at]
                s = p > least[:, None]
                came[at], switched[at] = best, s
                path[:k] = np.where(s, least[:, None], p)
            path[:k] += bits[at]
        state = path.argmin(1)
        for t in range(most - 1, -1, -1):
            k = counts[t]
            at = start[:k] + t
            lang[at] = state[:k]
            if t:
                s = switched[at, state[:k]]
                state[:k] = np.where(s, came[at], state[:k])
        return lang, offsets, bits, word


_MODELS: dict[int, Labeller] = {}


def _labeller(shared) -> Labeller:
    found = _MODELS.get(shared.id)
    if found is None:
        _MODELS.clear()
        found = _MODELS[shared.id] = Labeller(PartialMatching(shared.value))
    return found


def read_samples(samples: DataFrame, lang_col: str = "language", text_col: str = "text", per_language: int = 2_000) -> Samples:
    """Training words of a labelled table: of each language the ``per_language`` rows with the
    least hash of the text, a bound that keeps the model's size fixed."""
    rows = samples.select(F.lower(F.trim(lang_col)).alias("code"), F.col(text_col).alias("text")).where("text is not null").withColumn("h", F.xxhash64("text"))
    by: dict[str, list[str]] = {}
    for code in CODES:  # each task keeps its per_language least rows, and so does the driver
        taken = rows.where(F.col("code") == code).orderBy("h", "text").limit(per_language).select("text").collect()
        by[code] = [w for r in taken for w in words(r["text"])]
    return Samples(CODES, [by[c] for c in CODES])


def stated_language(column: str) -> Column:
    """The stated label without regard to case and blanks; null where it is no code."""
    c = F.lower(F.regexp_replace(F.col(column), r"(?U)^\s+|\s+$", ""))
    return F.when(c.isin(CODES), c)


def _passages(lang: np.ndarray, offsets: np.ndarray):
    """Start, end (flat) and language of each run of one language within a text."""
    new = np.ones(len(lang), bool)
    new[1:] = lang[1:] != lang[:-1]
    new[offsets[:-1][offsets[:-1] < len(lang)]] = True
    start = np.flatnonzero(new)
    end = np.append(start[1:], len(lang))
    return start, end, lang[start] if len(lang) else lang


def label_passages(df: DataFrame, samples: Samples, id_col: str = "row_id", text_col: str = "text") -> DataFrame:
    """``(id, passage, first_word, n_words, lang, confidence)``: the passages of every text.

    ``confidence`` is the posterior probability of the language over the nine, given the code
    lengths of the passage's words. Map-only.
    """
    from .tokens import _Shared

    shared = _Shared(df.sparkSession, samples)
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        m = _labeller(shared)
        codes = np.array(m.model.codes, object)
        for b in batches:
            split = [tokens_of(t) for t in b.column(1).to_pylist()]
            lang, offsets, bits = m.label(split)
            start, end, code = _passages(lang, offsets)
            if not len(start):
                continue
            sums = np.add.reduceat(bits.astype(np.float64), start, axis=0)
            own = sums[np.arange(len(start)), code]
            p = 1 / np.exp2(np.clip(own[:, None] - sums, -60, 60)).sum(1)
            row = np.searchsorted(offsets, start, side="right") - 1
            first = np.searchsorted(row, row, side="left")
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(row)), pa.array((np.arange(len(row)) - first).astype(np.int32)),
                 pa.array((start - offsets[row]).astype(np.int32)), pa.array((end - start).astype(np.int32)),
                 pa.array(codes[code], pa.string()), pa.array(p)],
                names=[id_col, "passage", "first_word", "n_words", "lang", "confidence"],
            )

    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, passage int, first_word int, n_words int, lang string, confidence double")


def wrong_labels(
    df: DataFrame, samples: Samples, id_col: str = "row_id", text_col: str = "text", lang_col: str = "language", min_words: int = MIN_WORDS
) -> DataFrame:
    """``(id, lang)``: rows whose label is missing, no code, or not exactly the language of the
    text, one row for each language that has ``min_words`` words in it.

    A text with fewer words than that is never a case. Where no language reaches the number,
    the one with most words stands for the text. Map-only.
    """
    from .tokens import _Shared

    shared = _Shared(df.sparkSession, samples)
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        m = _labeller(shared)
        codes = m.model.codes
        number = {c: i for i, c in enumerate(codes)}
        n = len(codes)
        for b in batches:
            split = [tokens_of(t) for t in b.column(2).to_pylist()]
            stated = np.array([number.get(s, -1) for s in b.column(1).to_pylist()], np.int64)
            lang, offsets, _ = m.label(split)
            size = np.diff(offsets)
            row = np.repeat(np.arange(len(split)), size)
            count = np.bincount(row * n + lang, minlength=len(split) * n).reshape(-1, n)
            there = count >= min_words
            none = ~there.any(1)
            there[none, count.argmax(1)[none]] = True
            alone = there.sum(1) == 1
            right = (stated >= 0) & alone & there[np.arange(len(split)), np.maximum(stated, 0)]
            there[(size < min_words) | right] = False
            r, c = np.nonzero(there)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(r)), pa.array([codes[i] for i in c], pa.string())], names=[id_col, "lang"]
            )

    rows = df.select(F.col(id_col), stated_language(lang_col).alias("stated"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"`{id_col}` {kind}, lang string")
