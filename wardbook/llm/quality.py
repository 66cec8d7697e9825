"""Quality classifier: histogram gradient-boosted trees over document statistics.

Trees are grown on a bounded sample of labelled rows and flattened into arrays: a tree is complete,
node i has the children 2i + 1 and 2i + 2, so that scoring a batch is one numpy step per level.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardbook.llm.common import by_batch, texts_of

LABELLED_ROWS = 20_000
BINS = 64
TREES = 120
DEPTH = 4
RATE = 0.1
PENALTY = 1.0
LEAST_HESSIAN = 2.0
THRESHOLD = 0.7

FEATURES = (
    "chars", "words", "lines", "mean_word", "sd_word", "distinct_words", "top_word", "same_as_before",
    "repeated_lines", "capital_words", "letterless_words", "odd_ends", "full_stops", "commas", "letters", "capitals",
    "digits", "symbols", "beyond_ascii", "short_words", "mean_line",
)

_CLASSES = np.array([
    [chr(b).isalpha() and b < 128 for b in range(256)], [65 <= b <= 90 for b in range(256)],
    [48 <= b <= 57 for b in range(256)],
    [33 <= b < 127 and not chr(b).isalnum() and chr(b) not in ".,;:'\"!?-()" for b in range(256)],
    [b >= 0xC0 for b in range(256)], [b == 46 for b in range(256)], [b == 44 for b in range(256)],
], float)
_USUAL_ENDS = set(".,;:!?)\"'")


def statistics(text: str) -> list[float]:
    """The features of one text; 0 throughout for the empty text."""
    if not text:
        return [0.0] * len(FEATURES)
    letters, capitals, digits, symbols, beyond, stops, commas = (
        _CLASSES @ np.bincount(np.frombuffer(text.encode(), np.uint8), minlength=256)).tolist()
    chars = len(text)
    words = text.split()
    lines = text.split("\n")
    n = max(1, len(words))
    lengths = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    counts = Counter(words)
    ends = Counter(w[-1] for w in words)
    odd = sum(k for c, k in ends.items() if not c.isalnum() and c not in _USUAL_ENDS)
    return [
        np.log1p(chars), np.log1p(len(words)), np.log1p(len(lines)), lengths.mean(), lengths.std(),
        len(counts) / n, max(counts.values(), default=0) / n, sum(map(eq, words, words[1:])) / n,
        1 - len(set(lines)) / len(lines), sum(map(str.isupper, words)) / n,
        sum(k for w, k in counts.items() if not any(map(str.isalpha, w))) / n, odd / n, stops / n, commas / n,
        letters / chars, capitals / chars, digits / chars, symbols / chars, beyond / chars,
        float((lengths <= 3).mean()), np.log1p(n / len(lines)),
    ]


@dataclass
class Trees:
    """features and cuts by tree and inner node, values by tree and leaf; ``learned`` is False without two classes."""

    base: float
    features: np.ndarray
    cuts: np.ndarray
    values: np.ndarray
    learned: bool = True

    def scores(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        if len(self.features):
            rows, trees = np.arange(len(x))[:, None], np.arange(len(self.features))[None, :]
            node = np.zeros((len(x), len(self.features)), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, self.features[trees, node]] > self.cuts[trees, node])
            total = total + self.values[trees, node - (2 ** DEPTH - 1)].sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def grow(x: np.ndarray, y: np.ndarray) -> Trees:
    """Boosted trees on the logistic loss, from histograms of gradients over quantile bins."""
    inner, leaves = 2 ** DEPTH - 1, 2 ** DEPTH
    none = np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves))
    share = y.mean() if len(y) else 0.5
    if not len(y) or not 0 < share < 1:
        return Trees(float(np.log((share + 1e-6) / (1 - share + 1e-6))), *none, learned=False)
    cuts = [np.unique(np.quantile(c, np.arange(1, BINS) / BINS, method="lower")) for c in x.T]
    binned = np.stack([np.searchsorted(cut, c, "left") for cut, c in zip(cuts, x.T)])  # c > cut[b] iff bin > b
    base = float(np.log(share / (1 - share)))
    margin = np.full(len(y), base)
    all_features, all_cuts, all_values = [], [], []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        features, levels = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for depth in range(DEPTH):
            n, offset = 2 ** depth, 2 ** depth - 1
            best = np.full(n, 1e-6)
            place = node * BINS
            chosen = np.full(n, BINS)  # a bin that nothing is beyond
            feature = np.zeros(n, np.int64)
            for f, b in enumerate(binned):
                gs = np.bincount(place + b, g, n * BINS).reshape(n, BINS).cumsum(axis=1)
                hs = np.bincount(place + b, h, n * BINS).reshape(n, BINS).cumsum(axis=1)
                gt, ht = gs[:, -1:], hs[:, -1:]
                gain = (gs ** 2 / (hs + PENALTY) + (gt - gs) ** 2 / (ht - hs + PENALTY) - gt ** 2 / (ht + PENALTY))
                gain[(hs < LEAST_HESSIAN) | (ht - hs < LEAST_HESSIAN)] = 0
                at = gain[:, :-1].argmax(axis=1)
                value = gain[np.arange(n), at]
                better = value > best
                best[better], chosen[better], feature[better] = value[better], at[better], f
            for i in range(n):
                features[offset + i] = feature[i]
                if chosen[i] < len(cuts[feature[i]]):
                    levels[offset + i] = cuts[feature[i]][chosen[i]]
            node = 2 * node + (binned[feature[node], np.arange(len(y))] > chosen[node])
        gs, hs = np.bincount(node, g, leaves), np.bincount(node, h, leaves)
        values = -RATE * gs / (hs + PENALTY)
        margin += values[node]
        all_features.append(features)
        all_cuts.append(levels)
        all_values.append(values)
    return Trees(base, np.array(all_features), np.array(all_cuts), np.array(all_values))


def train(docs: DataFrame, labels: DataFrame, rows: int = LABELLED_ROWS) -> Trees:
    """Trees from ``labels`` (doc_id, label 0 or 1) and the texts of ``docs``.

    From a sample of ``rows`` labelled ids at most, those with the smallest hashes, and one text of each: the
    statistics of that many texts come to the driver. Rows with a null id or label are not
    learned from; of several labels of an id the larger holds, of several texts the one whose statistics are smallest.
    """
    chosen = (
        labels.where("label in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows))
    labelled = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select(
        "doc_id", "text", F.col("label").cast("int").alias("label"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"), "label": batch.column("label"),
                "x": pa.array([statistics(t) for t in texts_of(batch)], pa.list_(pa.float64()))})

    kind = docs.schema["doc_id"].dataType.simpleString()
    described = by_batch(labelled, work, f"doc_id {kind}, label int, x array<double>")
    table = described.groupBy("doc_id").agg(F.max("label").alias("label"), F.min("x").alias("x")).toArrow()
    if not table.num_rows:
        return grow(np.zeros((0, len(FEATURES))), np.zeros(0))
    x, y = np.array(table["x"].to_pylist()), table["label"].to_numpy().astype(float)
    order = np.lexsort((*x.T, y))  # sums must not depend on the order of tasks
    return grow(x[order], y[order])


def score(docs: DataFrame, trees: Trees, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score, predicted of every row.

    Null counts as the empty text, whose statistics are all 0. Where nothing or one
    class only was learned, every score is the share of good labels, or 0.5.
    Rows are independent; other columns are not looked at.
    """
    box = docs.sparkSession.sparkContext.broadcast(trees)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = _scores(box.value, batch)
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"), "score": scores,
                "predicted": pa.array(scores >= threshold).cast(pa.int32())})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return by_batch(docs.select("doc_id", "text"), work, f"doc_id {kind}, score double, predicted int")


def good_documents(docs: DataFrame, trees: Trees, threshold: float = THRESHOLD) -> DataFrame:
    """The rows whose score reaches ``threshold``, with all their columns; all rows if nothing was learned."""
    if not trees.learned:
        return docs
    box = docs.sparkSession.sparkContext.broadcast(trees)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_scores(box.value, batch) >= threshold))

    return by_batch(docs, work, docs.schema)


def _scores(trees: Trees, batch: pa.RecordBatch) -> np.ndarray:
    if not batch.num_rows:
        return np.zeros(0)
    return trees.scores(np.array([statistics(t) for t in texts_of(batch)]))
