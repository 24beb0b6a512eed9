"""Evaluation passages inside training text (problem 8), by suffix arrays over the training text.

The documents are cut into shards. Each shard's distinct words, in their order, are its
dictionary; its texts become the numbers of their words, and a suffix array lists all suffixes
of these texts in the order of their words, each up to the end of its text. Shards are stored in
the shared folder: an index that any number of test sets can be looked up in. Every suffix of
every test item is then binary-searched in every shard, word by word: the interval of suffixes
that share its first words narrows until it is empty, which gives the longest verbatim matches
with their lengths and places. Pairs of document and item with enough matched words are checked
by an exact alignment. Texts are not shuffled.

A passage counts if it holds at least ``min_words`` words of the item in order, or the whole item
where that is shorter, with at most one word in eight altered, missing or added. A passage begins
and ends with a word of the item; where the item is short, its end words may be altered too.

Defined results: case, spacing, line breaks, punctuation, invisible characters and composition don't
matter. Null, empty and wordless items match nothing, nor do such documents. Items with the same
text count each. A document is reported once for each item however often it holds it; a repeated
document id is reported for each of its rows. Very long documents are read whole. Other columns
are ignored. The items are a stated query set: distinct texts are taken in blocks of about
``block_bytes``, one block after the other, each against all shards; only one block is on the
driver and in the executors at a time.
"""

from __future__ import annotations

import unicodedata
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..session import cut
from .canon import Translation, fold

MIN_WORDS = 12
EDITS_PER = 8
#: No admissible passage of an item of eight or more words lacks a verbatim run of so many; shorter items have no edits.
SEED = 4
#: Words of a shard; a longer text is a shard of its own.
SHARD_WORDS = 1_000_000
#: Matches that are looked at together.
HITS = 2_000_000


def _mark(ch: str) -> str | None:
    """White space stays, dashes and dots part words, other punctuation and invisible characters go."""
    kind = unicodedata.category(ch)
    if ch.isspace() or kind[0] not in "CP":
        return ch
    return " " if ch == "\u2026" or (kind == "Pd" and ch not in "-\u2010\u2011") else None


_STRIP = Translation(_mark)


def item_words(text: str | None) -> list[str]:
    """Words of a text without case, punctuation and invisible characters; dashes part words."""
    if not text:
        return []
    return fold(text).translate(_STRIP).split()


# ---- the index ----------------------------------------------------------------------------


def suffix_array(flat: np.ndarray) -> np.ndarray:
    """Positions of all words in the order of the suffixes that begin there.

    ``flat`` holds word numbers from 1 and a 0 after each text; a suffix ends at the 0. Suffixes
    are sorted by up to three words at once, then those still tied by the ranks of what follows, at
    twice the distance each time. Suffixes that are equal to their end stay in any order.
    """
    n = len(flat)
    at = np.flatnonzero(flat)
    if not len(at):
        return at.astype(np.int32)
    bits = int(flat.max()).bit_length()
    size = max(1, min(3, 62 // bits))
    wide = np.zeros(n + size, np.int64)
    wide[:n] = flat
    key, word = np.zeros(len(at), np.int64), np.ones(len(at), np.int64)
    for k in range(size):
        word = np.where(word > 0, wide[at + k], 0)  # nothing follows an end
        key = (key << bits) | word
    order = np.argsort(key)
    array, key = at[order], key[order]
    # how far each position is from the end of its text
    ends = np.flatnonzero(flat == 0)
    if not len(ends) or ends[-1] != n - 1:
        ends = np.append(ends, n)
    left = ends[np.searchsorted(ends, array)] - array
    new = np.ones(len(array), bool)
    new[1:] = key[1:] != key[:-1]
    rank = np.zeros(n + 1, np.int64)  # 0 where a text ends
    first = np.maximum.accumulate(np.where(new, np.arange(len(array)), 0))
    rank[array] = first + 1
    tied = np.flatnonzero(_tied(new) & (left >= size))
    while len(tied):
        place, group = array[tied], first[tied]
        following = rank[place + size]  # the text goes on for ``size`` words, so this is in it or at its end
        order = np.lexsort((following, group))
        place, following = place[order], following[order]  # groups stay where they are: tied is in their order
        array[tied] = place
        border = np.ones(len(tied), bool)
        border[1:] = (group[1:] != group[:-1]) | (following[1:] != following[:-1])
        first[tied] = np.maximum.accumulate(np.where(border, tied, 0))
        rank[place] = first[tied] + 1
        left[tied] = left[tied][order]
        size *= 2
        tied = tied[_tied(border) & (left[tied] >= size)]
    return array.astype(np.int32)


def _tied(new: np.ndarray) -> np.ndarray:
    """Whether an element shares its group, given where groups begin."""
    out = ~new
    out[:-1] |= ~new[1:]
    return out


class Shard:
    """Texts of one shard: dictionary in word order, word numbers, suffix array, and the rows of each text."""

    def __init__(self, texts: list[list[str]]):
        number: dict[str, int] = {}
        seen: dict[tuple, int] = {}
        add = number.setdefault
        parts, self.text_of = [], []
        for words in texts:  # equal texts are kept once
            w = tuple(words)
            k = seen.get(w)
            if k is None:
                k = seen[w] = len(parts)
                parts.append(np.array([*[add(x, len(number) + 1) for x in words], 0], np.int64))
            self.text_of.append(k)
        self.words = sorted(number)
        order = np.zeros(len(number) + 1, np.int64)
        for i, w in enumerate(self.words, 1):
            order[number[w]] = i
        self.flat = order[np.concatenate(parts)] if parts else np.zeros(0, np.int64)
        self.array = suffix_array(self.flat)


SHARD_SCHEMA = "doc_ids array<{kind}>, text_of binary, words string, flat binary, suffixes binary"


def suffix_shards(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_words: int = SHARD_WORDS) -> DataFrame:
    """The index: one row for each shard, to be stored. Map-only; every document with a word is in one shard."""
    field = documents.schema[id_col].dataType
    id_type = to_arrow_type(field)
    names = ["doc_ids", "text_of", "words", "flat", "suffixes"]

    def row(ids, texts):
        s = Shard(texts)
        columns = [pa.array([pa.array(ids, id_type)], pa.list_(id_type)), pa.array([np.array(s.text_of, "<i4").tobytes()], pa.binary()), pa.array([" ".join(s.words)], pa.string())]
        columns += [pa.array([x.astype("<i4").tobytes()], pa.binary()) for x in (s.flat, s.array)]
        return pa.RecordBatch.from_arrays(columns, names=names)

    def run(batches):
        ids, texts, size = [], [], 0
        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1)):
                words = item_words(t.as_py())
                if not words:
                    continue
                if texts and size + len(words) > shard_words:
                    yield row(ids, texts)
                    ids, texts, size = [], [], 0
                ids.append(i)
                texts.append(words)
                size += len(words)
        if texts:
            yield row(ids, texts)

    return documents.select(id_col, text_col).where(F.col(text_col).isNotNull()).mapInArrow(run, SHARD_SCHEMA.format(kind=field.simpleString()))


# ---- lookup ---------------------------------------------------------------------------------


class Items:
    """Test items of one block: distinct word sequences, and the keys of the texts that have them."""

    def __init__(self, rows: list[tuple]):
        by_words: dict[tuple, list] = defaultdict(list)
        for key, text in rows:
            w = tuple(item_words(text))
            if w:
                by_words[w].append(key)
        self.keys = list(by_words.values())
        self.vocabulary: dict[str, int] = {}
        add = self.vocabulary.setdefault
        self.words = [np.array([add(x, len(self.vocabulary)) for x in w], np.int64) for w in by_words]
        self.size = np.array([len(w) for w in self.words], np.int64)
        #: all items one after the other, each closed by -1
        self.flat = np.concatenate([np.append(w, -1) for w in self.words] or [np.zeros(0, np.int64)])
        self.item = np.repeat(np.arange(len(self.words)), self.size + 1)
        self.start = np.concatenate([[0], np.cumsum(self.size + 1)]).astype(np.int64)

    def numbers_in(self, words: list[str]) -> tuple[np.ndarray, list[np.ndarray]]:
        """The flat sequence and each item in a shard's word numbers; -1 for a word that it lacks and for ends."""
        get = self.vocabulary.get
        table = np.full(len(self.vocabulary) + 1, -1, np.int64)  # the last entry is the end's
        for i, w in enumerate(words, 1):
            k = get(w)
            if k is not None:
                table[k] = i
        return table[self.flat], [table[w] for w in self.words]


def _narrow(flat: np.ndarray, array: np.ndarray, low: np.ndarray, high: np.ndarray, depth: int, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each interval of suffixes equal in ``depth`` words the part whose next word is ``word``, by binary search."""

    def bound(low, high, strict):
        a, b = low.copy(), high.copy()
        open_ = np.flatnonzero(a < b)
        while len(open_):
            middle = (a[open_] + b[open_]) >> 1
            here = flat[array[middle] + depth]
            up = here <= word[open_] if strict else here < word[open_]
            a[open_[up]] = middle[up] + 1
            b[open_[~up]] = middle[~up]
            open_ = open_[a[open_] < b[open_]]
        return a

    first = bound(low, high, False)
    return first, bound(first, high, True)


def longest_matches(flat: np.ndarray, array: np.ndarray, wanted: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, ...]:
    """Longest verbatim matches of all suffixes of ``wanted`` in a shard, as intervals of its suffix array.

    Gives the place in ``wanted``, the interval (low, high) and the length that its suffixes share
    with what stands there; matches of fewer than ``least`` words (by place) are left out.
    """
    query = np.flatnonzero(wanted > 0)
    if not len(array) or not len(query):
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    begins = np.searchsorted(flat[array], np.arange(flat.max() + 2))  # where the suffixes of each first word begin
    low, high = begins[wanted[query]], begins[wanted[query] + 1]
    after = np.append(wanted, -1)
    found, depth = [], 1
    while len(query):
        word = after[query + depth]  # an item ends with a number below 0, so no match goes beyond it
        on = np.flatnonzero(word > 0)
        first, last = low.copy(), low.copy()
        first[on], last[on] = _narrow(flat, array, low[on], high[on], depth, word[on])
        for a, b in ((low, first), (last, high)):  # what the next word leaves out ends here
            ends = np.flatnonzero((depth >= least[query]) & (b > a))
            found.append((query[ends], a[ends], b[ends], np.full(len(ends), depth)))
        more = np.flatnonzero(last > first)
        query, low, high = query[more], first[more], last[more]
        depth += 1
    return tuple(np.concatenate(x) for x in zip(*found))


def places(flat: np.ndarray, array: np.ndarray, wanted: np.ndarray, query: np.ndarray, low: np.ndarray, high: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, ...]:
    """Places of the matches in shard and ``wanted`` and their lengths, without those that a longer match to the left covers.

    The intervals are laid out ``HITS`` at a time.
    """
    begin = np.concatenate([[0], np.cumsum(high - low)])
    kept = []
    for done in range(0, int(begin[-1]), HITS):
        rank = np.arange(done, min(done + HITS, int(begin[-1])))
        which = np.searchsorted(begin, rank, "right") - 1
        here, there = array[low[which] + rank - begin[which]].astype(np.int64), query[which]
        covered = (here > 0) & (there > 0) & (flat[here - 1] == wanted[there - 1])
        kept.append((here[~covered], there[~covered], length[which[~covered]]))
    return tuple(np.concatenate(x) for x in zip(*kept))


def aligned(item: np.ndarray, window: np.ndarray, min_words: int = MIN_WORDS, per: int = EDITS_PER) -> bool:
    """Whether the window holds an admissible passage of the item."""
    n, w = len(item), len(window)
    most = n // per
    short = n < min_words
    low = -10_000
    prev = np.full((most + 1, w + 1), low)
    need = np.maximum(min_words, per * np.arange(most + 1))[:, None]
    for i in range(n):
        hit = window == item[i]
        cur = np.full((most + 1, w + 1), low)
        # the span so far plus this word; a passage may begin here (short items: with its first words altered)
        m = np.where(hit, prev[:, :-1] + 1, low)
        if short:
            if i <= most:
                m[i] = np.where(hit, np.maximum(m[i], i + 1), m[i])
        else:
            m[0] = np.where(hit, np.maximum(m[0], 1), m[0])
        if short:
            rest = n - 1 - i
            if rest <= most and (m[: most - rest + 1] >= i + 1).any():
                return True
        elif (m >= need).any():
            return True
        cur[:, 1:] = m
        if most:
            cur[1:, 1:] = np.maximum(cur[1:, 1:], prev[:-1, :-1] + 1)
            cur[1:, :] = np.maximum(cur[1:, :], prev[:-1, :] + 1)
            for k in range(1, most + 1):
                np.maximum(cur[k, 1:], cur[k - 1, :-1], out=cur[k, 1:])
        prev = cur
    return False


def _windows(here: np.ndarray, length: np.ndarray, reach: int, enough: int, start: int, end: int):
    """Stretches of a text around matches of which enough words lie within reach, joined where they overlap."""
    last = np.searchsorted(here, here + reach, "right")
    total = np.concatenate([[0], np.cumsum(length)])
    good = np.flatnonzero(total[last] - total[: len(here)] >= enough)
    a = np.maximum(start, here[good] - reach)
    b = np.minimum(end, here[good] + reach + np.maximum(length[good], reach))
    if not len(a):
        return
    cut_at = np.flatnonzero(a[1:] > np.maximum.accumulate(b)[:-1]) + 1
    for i, j in zip(np.append(0, cut_at), np.append(cut_at, len(a))):
        lo, hi = int(a[i]), int(b[i:j].max())
        for x in range(lo, hi, 16 * reach):  # a long stretch in parts; any passage is within one of them
            yield x, min(hi, x + 18 * reach)


def find(flat: np.ndarray, array: np.ndarray, words: list[str], items: Items, min_words: int = MIN_WORDS) -> list[tuple[int, int]]:
    """Pairs of text (by number) and item in one shard."""
    wanted, item_in = items.numbers_in(words)
    ends = np.flatnonzero(flat == 0)
    starts = np.concatenate([[0], ends + 1])
    query, low, high, size = longest_matches(flat, array, wanted, np.minimum(SEED, items.size)[items.item])
    order = np.argsort(query, kind="stable")  # by item
    query, low, high, size = (x[order] for x in (query, low, high, size))
    # items are taken together up to HITS matches; all matches of one item stay together
    each = np.bincount(items.item[query], high - low, len(items.size)).cumsum() // HITS
    edge = np.flatnonzero(np.diff(each[items.item[query]])) + 1
    found = []
    for i, j in zip(np.append(0, edge), np.append(edge, len(query))):
        if i == j:
            continue
        here, there, length = places(flat, array, wanted, query[i:j], low[i:j], high[i:j], size[i:j])
        text, item = np.searchsorted(ends, here), items.item[there]
        order = np.lexsort((here, item, text))
        here, length, text, item = (x[order] for x in (here, length, text, item))
        edge = np.flatnonzero((np.diff(text) != 0) | (np.diff(item) != 0)) + 1
        for a, b in zip(np.append(0, edge), np.append(edge, len(here))):
            d, k = int(text[a]), int(item[a])
            n = int(items.size[k])
            # runs shorter than the seed aren't in the matches: where they may be missing, a lone match must be long
            enough = min(2 * SEED if n >= min_words else SEED, n - n // EDITS_PER)
            for x, y in _windows(here[a:b], length[a:b], n + n // EDITS_PER + 1, enough, int(starts[d]), int(ends[d])):
                if aligned(item_in[k], flat[x:y], min_words):
                    found.append((d, k))
                    break
    return found


def leaks_in_shards(shards: DataFrame, items: DataFrame, item_col: str = "item_id", item_text_col: str = "text", min_words: int = MIN_WORDS, block_bytes: int = 4_000_000) -> DataFrame:
    """``(doc_id, item_id)`` of every document of a stored index with an admissible passage of an item."""
    spark = shards.sparkSession
    rows = items.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("t")).where("t is not null")
    texts = rows.groupBy("t").agg(F.lit(1).alias("x"))
    total = texts.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = 1 + total // block_bytes
    id_type = to_arrow_type(shards.schema["doc_ids"].dataType.elementType)
    kind = shards.schema["doc_ids"].dataType.elementType.simpleString()
    key = F.sha2("t", 256)
    out = None
    for k in range(blocks):
        block = texts.where(F.pmod(F.xxhash64("t"), F.lit(blocks)) == k).select(key.alias("k"), "t")
        made = spark.sparkContext.broadcast(Items([(r["k"], r["t"]) for r in block.collect()]))  # one block: about block_bytes

        def run(batches, made=made):
            it = made.value
            for b in batches:
                for i in range(b.num_rows):
                    ids, text_of, words, flat, suffixes = (c[i] for c in b.columns)
                    flat, suffixes, text_of = (np.frombuffer(x.as_buffer(), "<i4") for x in (flat, suffixes, text_of))
                    pairs = find(flat, suffixes, words.as_py().split(" "), it, min_words)
                    rows_of: dict[int, list[int]] = defaultdict(list)
                    hit = {d for d, _ in pairs}
                    for r in np.flatnonzero(np.isin(text_of, np.array(sorted(hit), np.int64))):
                        rows_of[int(text_of[r])].append(int(r))
                    at = [(r, key) for d, x in pairs for r in rows_of[d] for key in it.keys[x]]
                    doc = ids.values.take(pa.array([r for r, _ in at], pa.int64()))
                    yield pa.RecordBatch.from_arrays([doc.cast(id_type), pa.array([key for _, key in at], pa.string())], names=["doc_id", "k"])

        part = shards.mapInArrow(run, f"doc_id {kind}, k string")
        if blocks > 1:  # the next block takes this one's place
            part = cut(part)
            made.destroy()
        out = part if out is None else out.unionByName(part)
    return out.join(rows.select("item_id", key.alias("k")), "k").select("doc_id", "item_id")


def leaked(
    documents: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    min_words: int = MIN_WORDS,
    block_bytes: int = 4_000_000,
) -> DataFrame:
    """``(doc_id, item_id)`` of every document with an admissible passage of an item.

    The index is stored first; keep :func:`suffix_shards` yourself and call
    :func:`leaks_in_shards` to use it for several test sets.
    """
    return leaks_in_shards(cut(suffix_shards(documents, id_col, text_col)), items, item_col, item_text_col, min_words, block_bytes)


def without_leaks(documents: DataFrame, items: DataFrame, id_col: str = "doc_id", **columns) -> DataFrame:
    """The documents in which no test item leaked, all columns."""
    bad = leaked(documents, items, id_col=id_col, **columns).select(F.col("doc_id").alias("__leaked")).distinct()
    return documents.join(bad, documents[id_col] == bad["__leaked"], "left_anti")
