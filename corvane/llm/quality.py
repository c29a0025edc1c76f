"""Quality classifier: histogram gradient-boosted trees over statistics of a document.

Statistics come from the whole text. Trees are fitted on a bounded sample of labelled rows: values are put into bins, a
level's histograms of gradients are one bincount, and the splits of all nodes of a level are found together. The fitted
trees are complete binary trees in flat arrays, so scoring walks all rows down a level at a time in numpy.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TREES, DEPTH, BINS, RATE, L2, LEAST_ROWS = 80, 4, 64, 0.15, 1.0, 10
SAMPLE = 20_000  # labelled rows that the trees are fitted on
FOLDS, HELD_OUT = 5, 0
THRESHOLD = 0.3

FEATURES = (
    "log_bytes", "log_words", "log_lines", "mean_word", "sd_word", "longest_word", "lower", "upper", "digit", "space", "stop_mark",
    "other_ascii", "high_bytes", "byte_entropy", "distinct_words", "top_word", "top_three_words", "repeated_pairs", "distinct_pairs",
    "repeated_lines", "end_marked", "capital_words", "capital_sentences", "mixed_words", "hash_or_brace_words", "mean_line", "short_words", "once_words",
)

_KIND = np.full(256, 5, np.uint8)  # other ASCII
_KIND[ord("a") : ord("z") + 1], _KIND[ord("A") : ord("Z") + 1], _KIND[ord("0") : ord("9") + 1] = 0, 1, 2
_KIND[[0x20, *range(0x09, 0x0E)]] = 3
_KIND[[ord(c) for c in ".,;:!?'\""]] = 4
_KIND[128:] = 6
_WORD, _ENDS_SENTENCE = _KIND != 3, np.zeros(256, bool)
_ENDS_SENTENCE[[ord(c) for c in ".!?"]] = True
_ODD_END = ~np.isin(_KIND, (0, 1, 2, 6))  # of the last byte of a word
_ODD_END[[ord(c) for c in ",.;:"]] = False


def statistics(text: bytes | None) -> list[float]:
    """The values of FEATURES; all zero for a text without words or a null."""
    words = (text or b"").split()
    if not words:
        return [0.0] * len(FEATURES)
    n, data = len(words), np.frombuffer(text, np.uint8)
    count, size = np.bincount(data, minlength=256), len(text)
    kinds = np.bincount(_KIND, weights=count, minlength=7) / size
    p = count[count > 0] / size
    # words are split by the white space of _KIND, so their bounds follow from the bytes
    edge = np.flatnonzero(np.diff(_WORD[data], prepend=False, append=False))
    begin, end = edge[::2], edge[1::2]
    lengths, first, last = end - begin, data[begin], data[end - 1]
    number = {w: i for i, w in enumerate(dict.fromkeys(words))}
    ids = np.fromiter(map(number.__getitem__, words), np.int64, n)
    often = np.bincount(ids)
    top = np.sort(often)[::-1]
    if n > 1:
        pairs = np.sort(ids[:-1] * len(often) + ids[1:])
        again = pairs[1:] == pairs[:-1]
        repeated, distinct = again.mean() if n > 2 else 0.0, 1 - again.sum() / (n - 1)
    else:
        repeated, distinct = 0.0, 1.0
    lines = [x for x in text.split(b"\n") if x.strip()]
    capital = (first >= 65) & (first <= 90)
    ended, odd = _ENDS_SENTENCE[last], _ODD_END[last]
    starts = np.concatenate([[True], ended[:-1]])
    return [
        np.log1p(size), np.log1p(n), np.log1p(len(lines)), lengths.mean(), lengths.std(), np.log1p(lengths.max()), kinds[0], kinds[1], kinds[2],
        kinds[3], kinds[4], kinds[5], kinds[6], float(-(p * np.log2(p)).sum()), len(often) / n, top[0] / n, top[:3].sum() / n, repeated, distinct,
        1 - len(set(lines)) / len(lines), ended.mean(), capital.mean(), (capital & starts).sum() / starts.sum(), ((first < 128) & ~capital & (_KIND[first] > 0)).mean(),
        odd.mean(), n / len(lines), (lengths <= 3).mean(), (often == 1).sum() / n,
    ]


@dataclass(frozen=True)
class Trees:
    """Complete trees of one depth in level order: feature and cut of inner nodes, values of leaves."""

    start: float
    feature: np.ndarray  # (trees, 2^depth - 1)
    cut: np.ndarray  # values up to the cut go left
    leaf: np.ndarray  # (trees, 2^depth)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of label 1 for the rows of x."""
        rows, total = np.arange(len(x)), np.full(len(x), self.start)
        inner = self.feature.shape[1]
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf):
            node = np.zeros(len(x), np.int64)
            while len(node) and node[0] < inner:  # all rows are on the same level
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            total += leaf[node - inner]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS) -> Trees:
    """Logistic boosting. Without rows, or with one label only, the score is constant."""
    if not len(x):
        return Trees(0.0, np.zeros((0, 2**depth - 1), np.int64), np.zeros((0, 2**depth - 1)), np.zeros((0, 2**depth)))
    n, features = x.shape
    mean = np.clip(y.mean(), 1e-6, 1 - 1e-6)
    cuts = np.quantile(x, np.arange(1, bins) / bins, axis=0, method="lower")  # (bins - 1, features)
    binned = np.stack([np.searchsorted(cuts[:, f], x[:, f], "left") for f in range(features)], axis=1)
    start = float(np.log(mean / (1 - mean)))
    raw, out = np.full(n, start), []
    for _ in range(trees if 0 < y.sum() < n else 0):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, p * (1 - p)
        feature, cut = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, np.inf)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            at, width = 2**level - 1, 2**level
            cell = ((node[:, None] * features + np.arange(features)) * bins + binned).ravel()
            sums = [
                np.bincount(cell, np.repeat(v, features), width * features * bins).reshape(width, features, bins).cumsum(2)
                for v in (g, h, np.ones(n))
            ]
            (gl, hl, nl), (ga, ha, na) = sums, (s[:, :, -1:] for s in sums)
            gain = gl**2 / (hl + L2) + (ga - gl) ** 2 / (ha - hl + L2) - ga**2 / (ha + L2)
            gain = np.where((nl >= LEAST_ROWS) & (na - nl >= LEAST_ROWS), gain, 0)[:, :, : bins - 1].reshape(width, -1)
            best = gain.argmax(1)
            f, b = np.divmod(best, bins - 1)
            split = gain[np.arange(width), best] > 1e-9
            feature[at : at + width] = f
            cut[at : at + width] = np.where(split, cuts[b, f], np.inf)  # all go left where nothing is gained
            node = 2 * node + (split[node] & (binned[np.arange(n), f[node]] > b[node]))
        leaf = -RATE * np.bincount(node, g, 2**depth) / (np.bincount(node, h, 2**depth) + L2)
        raw += leaf[node]
        out.append((feature, cut, leaf))
    shape = ((0, 2**depth - 1), (0, 2**depth - 1), (0, 2**depth))
    return Trees(start, *(np.array([t[i] for t in out]) if out else np.zeros(shape[i], np.int64 if i == 0 else float) for i in range(3)))


def _held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % FOLDS == HELD_OUT


def _matrix(col: pa.Array) -> np.ndarray:
    return np.array([statistics(x.as_py()) for x in col], np.float64).reshape(len(col), len(FEATURES))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Trees:
    """Trees fitted on `sample` labelled rows at most, chosen by a hash of their ids among those that are not held out.

    Of rows that share a chosen id, one is taken, by a hash of its text.
    """
    known = (
        labels.where("quality is not null and doc_id is not null")
        .groupBy(F.col("doc_id").cast("long").alias("_id"))
        .agg((F.avg("quality") >= 0.5).cast("double").alias("y"))
        .where(~_held_out(F.col("_id")))
        .orderBy(F.xxhash64("_id"), "_id")
        .limit(sample)
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("_id"), b.column("y"), b.column("h"), pa.FixedSizeListArray.from_arrays(x.ravel(), x.shape[1]).cast(pa.list_(pa.float64()))], ["_id", "y", "h", "x"])

    # at most `sample` ids are broadcast
    rows = docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").cast("binary").alias("text"))
    found = rows.join(F.broadcast(known), "_id").select("_id", "y", F.xxhash64("text").alias("h"), "text").mapInArrow(run, "_id long, y double, h long, x array<double>")
    got = found.groupBy("_id", "y").agg(F.min_by("x", "h").alias("x")).toPandas()  # `sample` rows at most
    got = got.sort_values("_id", kind="stable")
    return fit(np.array(got["x"].tolist(), np.float64).reshape(-1, len(FEATURES)), got["y"].to_numpy(np.float64))


def scorer(spark: SparkSession, trees: Trees) -> Callable[[Column], Column]:
    """A column function from texts to scores, 0 to 1; null texts count as empty."""
    sent = spark.sparkContext.broadcast(trees)

    @F.pandas_udf("double")
    def of(texts: pd.Series) -> pd.Series:
        x = np.array([statistics(t) for t in texts], np.float64).reshape(len(texts), len(FEATURES))
        return pd.Series(sent.value.score(x))

    return lambda text: of(text.cast("binary"))


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """One row for each row of `docs`: doc_id, held_out, score, predicted (1 if score >= THRESHOLD).

    Only texts are scored; ids choose the fold and nothing else. Null texts count as empty and get the score that the
    trees give to a text without words. Without labels each score is 0.5. Labels that contradict each other count by
    their mean; those with a null id or label count as missing. Columns other than doc_id and text are not read.
    """
    docs = docs.select("doc_id", "text")
    score = scorer(docs.sparkSession, train(docs, labels, sample))
    return docs.select("doc_id", _held_out(F.col("doc_id")).alias("held_out"), score(F.col("text")).alias("score")).withColumn(
        "predicted", (F.col("score") >= THRESHOLD).cast("int")
    )


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs` that the classifier predicts to be good, with their columns."""
    score = scorer(docs.sparkSession, train(docs, labels))
    return docs.where(score(F.col("text")) >= THRESHOLD)
