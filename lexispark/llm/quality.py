"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics are taken from the whole text; labels, language, source and id are never among them. Trees are fitted on
the driver over a bounded sample of labelled training rows (TRAIN_ROWS statistics vectors), binned once into at most
BINS quantile bins; they are flattened into arrays (feature, threshold, child, value) that numpy walks for a whole
batch of documents at a time.

Defined cases: null and empty texts have zero statistics and get a score like any other; a null doc_id counts as
training part; labels that are null are left out, repeated labels of a document count once (the highest); without any
training row of either class every score is the share of good labels (0.5 without labels); an empty table gives an
empty result; further columns are ignored, and kept as they are by ``keep_good``; very long
texts are measured whole; rows that repeat a doc_id are scored one by one.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexispark.llm.common import forget, fresh, held_out, short_batches, trim, words

#: At most so many labelled rows are learned from; beyond that, those with the smallest hash of their id.
TRAIN_ROWS = 20_000
BINS, TREES, DEPTH, RATE, L2, MIN_CHILD = 64, 60, 4, 0.15, 1.0, 5
STATISTICS = (
    "log_chars", "log_words", "mean_word", "long_words", "distinct_words", "top_word", "repeated_next", "distinct_pairs", "distinct_lines", "upper", "digits", "symbols", "pipes", "exclamations", "stops", "commas", "spaces",
    "line_words", "capital_words", "distinct_chars", "letterless_words", "symbol_ends", "hyphens", "longest_run",
)
_SYMBOLS = re.compile(r"[#$%&*|<>{}\[\]\\^~@_=+/]")
_UPPER, _DIGITS = re.compile(r"[A-ZÄÖÜÉÈÀÑÇÊÓÍÁÚ]"), re.compile(r"[0-9]")
_RUN = re.compile(r"(\S)\1{3,}")


def statistics(text: str | None) -> list[float]:
    text = text or ""
    chars = len(text)
    tokens = words(text)
    n = len(tokens)
    if not n:
        return [float(np.log1p(chars))] + [0.0] * (len(STATISTICS) - 1)
    counts = Counter(tokens)
    lines = [x for x in text.split("\n") if x]
    symbols = len(_SYMBOLS.findall(text))
    visible = sum(map(len, tokens))
    pairs = len(set(zip(tokens, tokens[1:], strict=False)))
    per = 1.0 / n
    return [
        float(np.log1p(chars)), float(np.log1p(n)), visible * per, sum(len(w) * c for w, c in counts.items() if len(w) > 14) / visible, len(counts) * per, max(counts.values()) * per,
        sum(map(str.__eq__, tokens, tokens[1:])) * per, pairs / max(1, n - 1), len(set(lines)) / max(1, len(lines)), len(_UPPER.findall(text)) / visible, len(_DIGITS.findall(text)) / visible, symbols / visible, text.count("|") * per,
        text.count("!") * per, text.count(".") * per, text.count(",") * per, (chars - visible) / chars, n / max(1, len(lines)),
        sum(c for w, c in counts.items() if w[:1].isupper()) * per, len(set(text)) / 64.0, sum(c for w, c in counts.items() if w.lower() == w.upper()) * per, sum(c for w, c in counts.items() if not w[-1].isalnum() and w[-1] not in ".,;:?!") * per,
        text.count("-") * per, max((len(m[0]) for m in _RUN.finditer(text)), default=0) * per,
    ]


class Forest:
    """Trees in flat arrays: node i tests feature[i] <= threshold[i], goes to left[i] or left[i] + 1; leaves have left 0."""

    def __init__(self, prior: float = 0.0):
        self.prior, self.roots = prior, []
        self.feature, self.threshold, self.left, self.value = [], [], [], []

    def freeze(self) -> Forest:
        for name, kind in (("feature", np.int32), ("threshold", np.float64), ("left", np.int32), ("value", np.float64), ("roots", np.int32)):
            setattr(self, name, np.asarray(getattr(self, name), kind))
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.prior)
        if not len(self.roots) or not len(x):
            return total
        at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        rows = np.arange(len(x))[:, None]
        for _ in range(DEPTH):
            left = self.left[at]
            right = x[rows, self.feature[at]] > self.threshold[at]
            at = np.where(left > 0, left + right, at)
        return total + self.value[at].sum(1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.margin(x), -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE) -> Forest:
    """Newton boosting of the logistic loss on histograms of gradients."""
    share = float(np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3))
    forest = Forest(float(np.log(share / (1 - share))))
    if not len(y) or y.min() == y.max():
        return forest.freeze()
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], 1)
    features, margin = x.shape[1], np.full(len(y), forest.prior)
    offsets = np.arange(features) * BINS
    for _ in range(trees):
        p = 1.0 / (1.0 + np.exp(-margin))
        grad, hess = p - y, p * (1 - p)
        forest.roots.append(len(forest.feature))
        _node(forest)
        level = [(forest.roots[-1], np.arange(len(y)))]
        for d in range(depth + 1):
            below = []
            for node, rows in level:
                g, h = grad[rows].sum(), hess[rows].sum()
                split = _best_split(binned[rows], grad[rows], hess[rows], g, h, offsets, edges) if d < depth and len(rows) >= 2 * MIN_CHILD else None
                if split is None:
                    forest.value[node] = -rate * g / (h + L2)
                    margin[rows] += forest.value[node]
                    continue
                f, b = split
                forest.feature[node], forest.threshold[node], forest.left[node] = f, edges[f][b], len(forest.feature)
                _node(forest), _node(forest)
                goes = binned[rows, f] > b
                below += [(forest.left[node], rows[~goes]), (forest.left[node] + 1, rows[goes])]
            level = below
    return forest.freeze()


def _node(forest: Forest) -> None:
    for name in ("feature", "threshold", "left", "value"):
        getattr(forest, name).append(0)


def _best_split(binned: np.ndarray, grad: np.ndarray, hess: np.ndarray, g: float, h: float, offsets: np.ndarray, edges: list[np.ndarray]) -> tuple[int, int] | None:
    flat = (binned + offsets).ravel()
    size, width = len(offsets) * BINS, len(offsets)
    table = lambda w: np.bincount(flat, np.repeat(w, width), size).reshape(width, BINS).cumsum(1)[:, :-1]
    gl, hl, nl = table(grad), table(hess), table(np.ones(len(grad)))
    gain = gl**2 / (hl + L2) + (g - gl) ** 2 / (h - hl + L2) - g**2 / (h + L2)
    gain[(nl < MIN_CHILD) | (len(grad) - nl < MIN_CHILD)] = 0
    for f, e in enumerate(edges):
        gain[f, len(e) :] = 0
    f, b = divmod(int(gain.argmax()), BINS - 1)
    return (f, b) if gain[f, b] > 1e-6 else None


def labelled(docs: DataFrame, labels: DataFrame, label: str, most: int = TRAIN_ROWS) -> DataFrame:
    """text, label of at most ``most`` labelled documents outside the held-out part."""
    known = labels.filter(F.col(label).isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max(label).cast("int").alias("_label"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    # Bounded by ``most`` pairs of id and label, so the documents are not moved.
    return docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("text", F.col("_label").alias("label"))


def train(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> Forest:
    short_batches(docs.sparkSession)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([statistics(t) for t in batch.column(0).to_pylist()], pa.list_(pa.float64())), batch.column(1)], ["x", "label"])

    got = labelled(docs, labels, "quality", most).mapInArrow(measure, "x array<double>, label int").toArrow()
    x = np.array(got.column("x").to_pylist(), float).reshape(-1, len(STATISTICS))
    y = np.array(got.column("label").to_pylist(), float)
    order = np.lexsort((y, *x.T))  # the same sample in the same order gives the same trees
    return fit(x[order], y[order])


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, most: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of ``docs``."""
    scored = with_score(docs.select("doc_id", "text"), train(docs, labels, most)).select("doc_id", "score")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def with_score(docs: DataFrame, forest: Forest, name: str = "score") -> DataFrame:
    """``docs`` with the score in a column of the given name, in place of one that has it."""
    short_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            x = np.array([statistics(t) for t in texts], float).reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(forest.score(x), pa.float64())], [*batch.schema.names, name])
        trim()

    source = docs.drop(name)
    return source.mapInArrow(run, source.withColumn(name, F.lit(0.0)).schema)


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, most: int = TRAIN_ROWS) -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject; columns unchanged."""
    (score,) = fresh(docs, "_score")
    return with_score(docs, train(docs, labels, most), score).filter(F.col(score) >= threshold).select(*docs.columns)
