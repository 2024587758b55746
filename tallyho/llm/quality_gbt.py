"""Quality classifier: histogram gradient boosting over document statistics.

Statistics of whole texts are computed in Arrow batches on the executors.
Trees are grown level by level from gradient histograms over quantile bins,
on a bounded sample of labelled rows, and flattened into complete binary
trees held in arrays (feature, threshold, leaf value), which numpy walks for
a whole batch at once.

Null and empty texts have the statistics of no words (all zero) and a score
like any other text.  Rows are scored one by one, so repeated rows repeat.
Only ``doc_id`` and ``text`` are read; further columns do no harm.  Without
labelled rows every score is 0.5.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyho.llm.common import fold, labelled_sample, map_texts

SAMPLE_PER_CLASS = 10_000   # labelled rows of each class that the trees are fitted on
TREES, DEPTH, BINS, RATE, RIDGE, LEAST = 60, 4, 64, 0.2, 1.0, 5

_DIGITS = bytes(range(48, 58))
_UPPER = bytes(range(65, 91))
_LETTERS = _UPPER + bytes(range(97, 123)) + bytes(range(128, 256))
_STOPS = b".,;:"
_SYMBOLS = b"#*$%&|<>"
_LOUD = b"!?"

FEATURES = ["words", "bytes_per_word", "distinct_words", "top_word", "same_as_next",
            "distinct_trigrams", "short_words", "long_words", "symbols", "loud", "digits", "upper",
            "letters", "stops", "line_words", "distinct_lines", "line_ends", "entropy",
            "symbol_ends", "wide"]


def statistics(text: str | None) -> list[float]:
    """The values of ``FEATURES`` for one text."""
    raw = (text or "").encode("utf-8", "replace")
    words = raw.split()
    n, size = len(words), len(raw)
    if not n:
        return [0.0] * len(FEATURES)

    def share(chars: bytes) -> float:
        return 1 - len(raw.translate(None, chars)) / size

    lengths = np.fromiter(map(len, words), np.int32, n)
    seen = Counter(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    hist = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    p = hist[hist > 0] / size
    after = words[1:]
    trigrams = len(set(zip(words, after, words[2:]))) / (n - 2) if n > 2 else 1.0
    return [np.log1p(n), lengths.mean(), len(seen) / n, max(seen.values()) / n,
            sum(map(bytes.__eq__, words, after)) / n, trigrams,
            (lengths <= 3).mean(), (lengths >= 20).mean(), share(_SYMBOLS), share(_LOUD),
            share(_DIGITS), share(_UPPER), share(_LETTERS), share(_STOPS),
            np.log1p(n / len(lines)), len(set(lines)) / len(lines),
            sum(x.rstrip()[-1:] in b".!?" for x in lines) / len(lines), -(p * np.log2(p)).sum(),
            sum(w[-1] in _SYMBOLS for w in words) / n, hist[128:].sum() / size]


@dataclass
class Trees:
    """Complete trees: inner node i has children 2i+1 and 2i+2."""

    feature: np.ndarray     # trees x inner nodes
    threshold: np.ndarray   # trees x inner nodes; a value above it goes right
    leaf: np.ndarray        # trees x leaves
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        rows = np.arange(len(x))
        total = np.full(len(x), self.base)
        inner = self.feature.shape[1]
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf):
            node = np.zeros(len(x), np.int64)
            while inner and len(x) and node[0] < inner:
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            total += leaf[node - inner]
        return 1 / (1 + np.exp(-total))


def boost(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, trees: int = TREES,
          depth: int = DEPTH, bins: int = BINS) -> Trees:
    """Fit boosted trees for the logistic loss by gradient histograms."""
    n, f = x.shape
    weight = np.ones(n) if weight is None else weight / weight.mean()
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(f)]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], 1)
    mean = np.clip((weight * y).sum() / weight.sum(), 1e-3, 1 - 1e-3)
    base = float(np.log(mean / (1 - mean)))
    inner, leaves = 2 ** depth - 1, 2 ** depth
    out = Trees(np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf),
                np.zeros((trees, leaves)), base)
    total = np.full(n, base)
    offset = np.arange(f) * bins
    for t in range(trees):
        p = 1 / (1 + np.exp(-total))
        grad, hess = weight * (y - p), weight * p * (1 - p)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, width = 2 ** level - 1, 2 ** level
            cell = ((node - first)[:, None] * (f * bins) + offset + binned).ravel()
            shape = (width, f, bins)
            g, h, c = (np.bincount(cell, np.repeat(v, f), width * f * bins).reshape(shape).cumsum(2)
                       for v in (grad, hess, np.ones(n)))
            def worth(a, b):
                return a * a / (b + RIDGE)
            gain = worth(g, h) + worth(g[..., -1:] - g, h[..., -1:] - h) - worth(g[..., -1:], h[..., -1:])
            gain[(c < LEAST) | (c[..., -1:] - c < LEAST)] = 0
            best = gain.reshape(width, -1).argmax(1)
            for k in range(width):
                j, cut = divmod(int(best[k]), bins)
                if gain[k, j, cut] > 1e-9 and cut < len(edges[j]):
                    out.feature[t, first + k], out.threshold[t, first + k] = j, edges[j][cut]
            node = 2 * node + 1 + (x[np.arange(n), out.feature[t, node]] > out.threshold[t, node])
        leaf = node - inner
        g, h = np.bincount(leaf, grad, leaves), np.bincount(leaf, hess, leaves)
        out.leaf[t] = RATE * g / (h + RIDGE)
        total += out.leaf[t][leaf]
    return out


def fit_quality(docs: DataFrame, labels: DataFrame, learn: Column) -> Trees | None:
    """Fit on at most ``SAMPLE_PER_CLASS`` labelled rows of each class where ``learn`` holds."""
    ids = labelled_sample(labels.select("doc_id", "quality"), "quality", learn, SAMPLE_PER_CLASS)

    def task(batches):
        for b in batches:
            yield pd.DataFrame({"doc_id": b.doc_id, "y": b.y,
                                "x": [statistics(t) for t in b.text]})

    rows = (docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")
            .mapInPandas(task, "doc_id long, y int, x array<double>")
            .toPandas().drop_duplicates("doc_id").sort_values("doc_id"))
    if rows.empty:
        return None
    y = rows.y.to_numpy()
    share = {r.quality: r["count"] for r in labels.where(learn & F.col("quality").isin(0, 1))
             .groupBy("quality").count().collect()}
    size = np.bincount(y, minlength=2)
    weight = np.where(y == 1, share.get(1, 0) / max(1, size[1]), share.get(0, 0) / max(1, size[0]))
    return boost(np.array(list(rows.x)), y.astype(float), weight)


def score_quality(docs: DataFrame, trees: Trees | None) -> DataFrame:
    """``doc_id, score``: one row for each row of ``docs``."""
    def work(texts):
        x = np.array([statistics(t) for t in texts]).reshape(len(texts), len(FEATURES))
        return [trees.score(x) if trees else np.full(len(texts), 0.5)]

    return map_texts(docs, {"score": pa.float64()}, lambda: work)


def quality_query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Score every document; learn only where crc32(doc_id) mod 3 is not 1."""
    trees = fit_quality(docs, labels, fold(F.col("doc_id"), 3) != 1)
    return score_quality(docs, trees).select(
        "doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))
