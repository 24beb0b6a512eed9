"""Reading bands of documents (problem 9), by gradient-boosted regression trees.

Every document gets features of length, vocabulary, syntax and cohesion in one pass over the
texts; they are written to the shared folder, so texts are read once and never shuffled. On the
rated documents (at most ``max_rated``, those with the least hash of their id) boosted trees are
fitted to the raters' mean band; folds by source give predictions for sources not seen, which
calibrate the cut points between bands. The fitted trees, of fixed size, then grade all features.

Defined results: only texts with at least ``min_words`` words separated by white space are
graded. Null bands and bands outside 1 to 4 are no ratings; a rater's repeated row counts once.
Ratings of unknown documents are ignored. Without any usable rating the grade is 2. Ties in the
choice of a split go to the first feature. Very long texts are read whole. A repeated document
is graded each time it occurs. Other columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .canon import fold

MIN_WORDS = 40
MAX_RATED = 12_000
#: A leaf holds at least this share of the ratings' weight, and no more than ``LEAF`` need be in one.
LEAF_SHARE, LEAF = 0.24, 12.0
_SENTENCE = re.compile(r"[.!?…]+[\"'»“”)\]]*\s+|\n\s*\n")
_WORD = re.compile(r"[^\W\d_]+(?:[-'’ʼ][^\W\d_]+)*")
#: Letters whose shares tell the languages apart.
_LETTERS = "aeiouyntsəɔɨʔüšıыиіаоеэӱӧҥӈӟӵъяюё"
N_FEATURES = 30 + len(_LETTERS)


def _at(ordered: np.ndarray, share: float) -> float:
    """The value below which a share of ordered values lies."""
    return ordered[int(share * (len(ordered) - 1))]


def features(text: str) -> list[float]:
    """The features of one text; independent of case and, where possible, of its length."""
    low = fold(text)
    tokens = low.split()
    words = _WORD.findall(low)
    n = max(1, len(words))
    size = np.fromiter(map(len, words), np.float64, len(words)) if words else np.ones(1)
    counts: dict[str, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    freq = np.fromiter(counts.values(), np.float64, len(counts)) if counts else np.ones(1)
    kinds = len(freq)
    kind_size = np.fromiter(map(len, counts), np.float64, len(counts)) if counts else np.ones(1)
    sentences = [s for s in (_WORD.findall(x) for x in _SENTENCE.split(low)) if s]
    spans = np.fromiter(map(len, sentences), np.float64, len(sentences)) if sentences else np.ones(1)
    shared, near = 0.0, 0
    before: set[str] = set()
    for s in sentences:
        now = set(s)
        if before:
            shared += len(before & now) / min(len(before), len(now))
            near += 1
        before = now
    letters = max(1, sum(map(len, words)))
    top = np.sort(freq)[::-1]
    ordered, laid = np.sort(size), np.sort(spans)
    tail = size[size > 3] if (size > 3).any() else size
    out = [
        np.log(n), size.mean(), size.std(), _at(ordered, 0.5), _at(ordered, 0.75), _at(ordered, 0.9), _at(ordered, 0.97),
        (size >= 7).mean(), (size >= 9).mean(), (size >= 11).mean(), (size >= 14).mean(), (size <= 3).mean(), tail.mean(),
        kind_size.mean(), kind_size.std(), kinds / np.sqrt(2.0 * n), (freq == 1).sum() / n, top[:10].sum() / n, top[:30].sum() / n,
        spans.mean(), _at(laid, 0.5), spans.std(), _at(laid, 0.8), np.log1p(len(sentences)),
        100.0 * text.count(",") / n, 100.0 * (text.count("(") + text.count("«")) / n, 100.0 * sum(t[0].isdigit() for t in tokens) / n,
        100.0 * (text.count("?") + text.count("!")) / n, shared / max(1, near), 100.0 * (text.count("—") + text.count(";") + text.count(":")) / n,
    ]
    out += [100.0 * low.count(c) / letters for c in _LETTERS]
    return [float(x) for x in out]


@dataclass
class Trees:
    """Boosted regression trees of one depth, as arrays; thresholds are feature values."""

    base: float
    depth: int
    feature: list[np.ndarray] = field(default_factory=list)
    threshold: list[np.ndarray] = field(default_factory=list)
    leaf: list[np.ndarray] = field(default_factory=list)

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        row = np.arange(len(x))
        for f, t, v in zip(self.feature, self.threshold, self.leaf):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[row, f[node]] > t[node])
            out += v[node - (2**self.depth - 1)]
        return out


def fit_trees(
    x: np.ndarray, y: np.ndarray, weight: np.ndarray, n_trees: int = 140, depth: int = 4, rate: float = 0.1, bins: int = 48, least: float = 12.0, seed: int = 7
) -> Trees:
    """Least-squares boosting over binned features; each tree sees 60 % of the features."""
    rng = np.random.default_rng(seed)
    n, k = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(k)]
    binned = np.stack([np.searchsorted(edges[j], x[:, j], "left") for j in range(k)], 1)
    trees = Trees(float(np.average(y, weights=weight)), depth)
    current = np.full(n, trees.base)
    inner = 2**depth - 1
    for _ in range(n_trees):
        residual = (y - current) * weight
        chosen = np.sort(rng.choice(k, max(1, int(0.6 * k)), replace=False))
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            local = node - first
            best, pick, cutbin = np.full(width, 1e-9), np.zeros(width, np.int64), np.full(width, -1)
            whole_g = np.bincount(local, residual, width)
            whole_w = np.bincount(local, weight, width)
            whole = whole_g**2 / np.maximum(whole_w, 1e-9)
            for j in chosen:
                at = local * bins + binned[:, j]
                g = np.bincount(at, residual, width * bins).reshape(width, bins).cumsum(1)[:, :-1]
                w = np.bincount(at, weight, width * bins).reshape(width, bins).cumsum(1)[:, :-1]
                rw = whole_w[:, None] - w
                ok = (w >= least) & (rw >= least)
                gain = np.where(ok, g**2 / np.maximum(w, 1e-9) + (whole_g[:, None] - g) ** 2 / np.maximum(rw, 1e-9) - whole[:, None], 0.0)
                b = gain.argmax(1)
                v = gain[np.arange(width), b]
                better = v > best
                best[better], pick[better], cutbin[better] = v[better], j, b[better]
            for i in range(width):
                if cutbin[i] >= 0 and cutbin[i] < len(edges[pick[i]]):
                    feature[first + i], threshold[first + i] = pick[i], edges[pick[i]][cutbin[i]]
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > threshold[node])
        leaf = node - inner
        value = rate * np.bincount(leaf, residual, inner + 1) / np.maximum(np.bincount(leaf, weight, inner + 1), 1e-9)
        current += value[leaf]
        trees.feature.append(feature)
        trees.threshold.append(threshold)
        trees.leaf.append(value)
    return trees


def cut_points(raw: np.ndarray, y: np.ndarray, weight: np.ndarray) -> list[float]:
    """Borders between the bands that err least on predictions made without the rating's source."""
    order = np.argsort(raw, kind="stable")
    r = raw[order]
    found = []
    for b in (1, 2, 3):
        wrong = np.where(y[order] > b + 0.5, weight[order], np.where(y[order] < b + 0.5, -weight[order], 0.0))
        cost = np.concatenate([[0.0], np.cumsum(wrong)])  # rated higher but below the border
        i = int(cost.argmin())
        at = (r[i - 1] + r[i]) / 2 if 0 < i < len(r) else b + 0.5
        found.append(min(max(float(at), b + 0.1), b + 0.9))
    return found


@dataclass
class Grader:
    trees: Trees | None
    cuts: list[float]
    accuracy: float  # share of right bands on sources held out

    def grade(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.trees is None:
            return np.full(len(x), 2.0), np.full(len(x), 2)
        raw = self.trees.predict(x)
        band = 1 + sum((raw > c).astype(np.int64) for c in self.cuts)
        # calibrated: borders fall on the halves between bands
        value = np.interp(raw, [0.0, *self.cuts, 5.0], [0.5 + self.cuts[0] - 1.5, 1.5, 2.5, 3.5, 4.5])
        return np.clip(value, 1.0, 4.0), band


def fit_grader(x: np.ndarray, y: np.ndarray, weight: np.ndarray, source: np.ndarray, folds: int = 4, **options) -> Grader:
    """Trees on all rated documents, and cut points from folds in which no source is split.

    Where all ratings are of one source, folds are made of its documents. A fold that holds all
    ratings is predicted by their mean.
    """
    if not len(y):
        return Grader(None, [1.5, 2.5, 3.5], 0.0)
    options = {"least": min(LEAF, max(1.0, LEAF_SHARE * len(y)))} | options
    names, number = np.unique(source, return_inverse=True)
    if len(names) < 2:
        names, number = np.arange(len(y)), np.arange(len(y))
    size = np.bincount(number)
    load, fold_of = np.zeros(folds), np.zeros(len(names), np.int64)
    for s in np.argsort(-size, kind="stable"):
        fold_of[s] = load.argmin()
        load[fold_of[s]] += size[s]
    part = fold_of[number]
    raw = np.full(len(y), float(np.average(y, weights=weight)))
    for k in range(folds):
        held = part == k
        if held.any() and not held.all():
            raw[held] = fit_trees(x[~held], y[~held], weight[~held], **options).predict(x[held])
    cuts = cut_points(raw, y, weight)
    band = 1 + sum((raw > c).astype(int) for c in cuts)
    return Grader(fit_trees(x, y, weight, **options), cuts, float(np.average(np.abs(band - y) < 0.5, weights=weight)))


def feature_table(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``(doc_id, x)`` of the texts with at least ``min_words`` words."""
    kind = documents.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            at, rows = [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                if t and len(t.split()) >= min_words:
                    at.append(i)
                    rows.append(np.array(features(t), np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(rows, pa.binary())], names=["doc_id", "x"])

    return documents.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, x binary")


def ratings(labels: DataFrame) -> DataFrame:
    """``(doc_id, y, n)``: mean band and number of raters, each rater once."""
    usable = labels.where("doc_id is not null and band between 1 and 4").select("doc_id", "rater", "band").distinct()
    return usable.groupBy("doc_id").agg(F.avg("band").alias("y"), F.count("*").alias("n"))


def train(table: DataFrame, labels: DataFrame, sources: DataFrame, max_rated: int = MAX_RATED, **options) -> Grader:
    """Fit on the rated rows of a feature table; ``sources`` is ``(doc_id, source)``.

    At most ``max_rated`` rows of 250 bytes reach the driver.
    """
    rows = (
        table.join(ratings(labels), "doc_id")
        .join(sources.groupBy("doc_id").agg(F.min("source").alias("source")), "doc_id", "left")
        .withColumn("h", F.xxhash64("doc_id"))
        .orderBy("h", "doc_id")
        .limit(max_rated)
        .select("x", "y", "n", F.coalesce("source", F.lit("")).alias("source"))
        .toArrow()
    )
    if not rows.num_rows:
        return Grader(None, [1.5, 2.5, 3.5], 0.0)
    x = np.frombuffer(b"".join(rows.column("x").to_pylist()), np.float32).reshape(-1, N_FEATURES).astype(np.float64)
    n = rows.column("n").to_numpy().astype(np.float64)
    return fit_grader(x, rows.column("y").to_numpy(), np.sqrt(n), np.array(rows.column("source").to_pylist(), object).astype(str), **options)


def grade(table: DataFrame, grader: Grader) -> DataFrame:
    """``(doc_id, grade, band)`` of every row of a feature table."""
    shared = table.sparkSession.sparkContext.broadcast(grader)
    kind = table.schema["doc_id"].dataType.simpleString()

    def run(batches):
        g = shared.value
        for b in batches:
            x = np.frombuffer(b"".join(b.column(1).to_pylist()), np.float32).reshape(-1, N_FEATURES).astype(np.float64)
            value, band = g.grade(x)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(value), pa.array(band.astype(np.int32))], names=["doc_id", "grade", "band"])

    return table.select("doc_id", "x").mapInArrow(run, f"doc_id {kind}, grade double, band int")


def reading_bands(documents: DataFrame, labels: DataFrame, min_words: int = MIN_WORDS, max_rated: int = MAX_RATED) -> DataFrame:
    """``(doc_id, grade, band)`` of every document with at least ``min_words`` words."""
    table = cut(feature_table(documents, min_words=min_words))
    return grade(table, train(table, labels, documents.select("doc_id", "source"), max_rated))
