"""Toxicity by compression distance.

Two zstandard dictionaries are made from a bounded sample of labelled texts:
one from ordinary text, one from toxic text.  A text is cut into windows of
``WINDOW_WORDS`` words; each window is compressed with both dictionaries, and
the bytes that the toxic dictionary saves are the window's margin.  The
numbers of windows beyond each margin threshold are calibrated into a
probability by logistic regression on labelled texts that made no dictionary.

Texts are lower-cased and white space is one blank.  Null and empty texts
have no windows and get the calibrated score of zero margins.  Any number of
repeated rows is scored row by row; only ``doc_id`` and ``text`` are read, so
further columns of any name do no harm.  Without labelled texts of both
classes every score is 0.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyho.llm.common import fold, labelled_sample, map_texts

WINDOW_WORDS = 12
MARGINS = (1, 2, 3, 4, 5, 6, 8, 10)
SAMPLE_PER_CLASS = 1600     # labelled texts of each class that are fitted on
DRAWN_BYTES = 32_768        # of windows that a text gives to the dictionaries, by hash order
ORDINARY_BYTES = 16_384     # size of the ordinary dictionary
TOXIC_BYTES = 2_048         # most bytes of toxic passages
LEVEL = 3
GRAM = 6


def normal(text: str | None) -> bytes:
    return b" " + b" ".join((text or "").lower().encode("utf-8", "replace").split()) + b" "


def windows(text: str | None, n: int = WINDOW_WORDS) -> list[bytes]:
    """Consecutive windows of ``n`` words, with blanks at both ends."""
    words = (text or "").lower().encode("utf-8", "replace").split()
    return [b" " + b" ".join(words[i:i + n]) + b" " for i in range(0, len(words), n)]


def drawn(text: str | None) -> str:
    """Windows of the whole text by hash order, up to ``DRAWN_BYTES``, in their own order."""
    found = windows(text)
    size, kept = 0, []
    for i in sorted(range(len(found)), key=lambda i: (zlib.crc32(b"%d" % i + found[i]), i)):
        if size + len(found[i]) <= DRAWN_BYTES:
            size += len(found[i])
            kept.append(i)
    return b"".join(found[i][1:] for i in sorted(kept)).decode("utf-8", "replace")


def toxic_passages(toxic: list[str], ordinary: list[str]) -> bytes:
    """The words that set toxic texts apart, the most frequent last.

    A ``GRAM``-byte string counts once a text; a string is telling if it is
    at least e**2.5 times as frequent among toxic texts.  Words are taken by
    frequency while half of their telling strings are not covered yet.
    """
    def grams(b: bytes) -> set[bytes]:
        return {b[i:i + GRAM] for i in range(len(b) - GRAM + 1)}

    seen_t, seen_o = Counter(), Counter()
    for t in toxic:
        seen_t.update(grams(normal(t)))
    for t in ordinary:
        seen_o.update(grams(normal(t)))
    least = max(3, len(toxic) // 100)
    ratio = np.exp(2.5) * (len(toxic) + 1) / (len(ordinary) + 1)
    telling = {g for g, n in seen_t.items() if n >= least and n + 0.5 > ratio * (seen_o[g] + 0.5)}
    counts: Counter = Counter()
    for t in toxic:
        counts.update(b" " + w + b" " for w in normal(t).split())
    covered: set[bytes] = set()
    chosen: list[bytes] = []
    size = 0
    for word, n in sorted(counts.items(), key=lambda x: (-x[1], x[0])):
        own = grams(word) & telling
        new = own - covered
        if n >= least and new and 2 * len(new) >= len(own) and size + len(word) <= TOXIC_BYTES:
            chosen.append(word)
            covered |= new
            size += len(word)
    return b"".join(reversed(chosen))


def ordinary_passages(ordinary: list[str]) -> bytes:
    samples = [w for t in ordinary for w in windows(t)]
    try:
        return zstandard.train_dictionary(ORDINARY_BYTES, samples, k=40, d=6).as_bytes()
    except zstandard.ZstdError:  # too little text to train on
        return b"".join(samples)[-ORDINARY_BYTES:]


class Margins:
    """Compresses windows with both dictionaries."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        def made(content: bytes) -> zstandard.ZstdCompressor:
            return zstandard.ZstdCompressor(
                level=LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False,
                dict_data=zstandard.ZstdCompressionDict(
                    content, dict_type=zstandard.DICT_TYPE_RAWCONTENT))
        self.ordinary, self.toxic = made(ordinary).compress, made(toxic).compress

    def features(self, text: str | None) -> np.ndarray:
        """Number (log) and share of windows beyond each margin, best margins, mean."""
        m = np.array([len(self.ordinary(w)) - len(self.toxic(w)) for w in windows(text)] or [0])
        over = (m[:, None] >= np.array(MARGINS)).sum(0)
        best = -np.sort(-m)[:3]
        return np.concatenate([np.log1p(over), over / len(m),
                               [best[0], best.mean(), m.mean(), np.log(len(m))]])


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3) -> tuple:
    """Newton's method for weighted ridge logistic regression: centre, scale, weights."""
    weight = weight / weight.mean()
    mu, sd = x.mean(0), x.std(0) + 1e-6
    z = np.c_[(x - mu) / sd, np.ones(len(x))]
    w = np.zeros(z.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = (z * (weight * p * (1 - p))[:, None]).T @ z + np.eye(len(w)) * ridge * len(y)
        w = w - np.linalg.solve(h, z.T @ (weight * (p - y)) + ridge * len(y) * w)
    return mu, sd, w


@dataclass
class ToxicityModel:
    """Both dictionaries and the calibration; about 40 KB."""

    ordinary: bytes
    toxic: bytes
    calibration: tuple | None

    def score(self, texts) -> np.ndarray:
        if self.calibration is None:
            return np.zeros(len(texts))
        margins = Margins(self.ordinary, self.toxic)
        mu, sd, w = self.calibration
        x = np.array([margins.features(t) for t in texts]).reshape(len(texts), len(mu))
        z = np.clip(np.c_[(x - mu) / sd, np.ones(len(x))] @ w, -30, 30)
        return 1 / (1 + np.exp(-z))


def fit_toxicity(docs: DataFrame, labels: DataFrame, learn: Column) -> ToxicityModel:
    """Fit on at most ``SAMPLE_PER_CLASS`` texts of each class where ``learn`` holds."""
    ids = labelled_sample(labels.select("doc_id", "toxic"), "toxic", learn, SAMPLE_PER_CLASS)
    rows = (docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")
            .withColumn("half", fold(F.concat(F.lit("half"), F.col("doc_id").cast("string")), 2)))

    def draw(batches):
        for b in batches:
            yield pd.DataFrame({"doc_id": b.doc_id, "y": b.y, "text": [drawn(t) for t in b.text]})

    passages = (rows.where("half = 0").mapInPandas(draw, "doc_id long, y int, text string")
                .groupBy("doc_id", "y").agg(F.min("text").alias("text")).toPandas().sort_values(["y", "text"]))

    def part(y: int) -> list[str]:
        return list(passages.text[passages.y == y])

    if not part(0) or not part(1):
        return ToxicityModel(b"", b"", None)
    ordinary = ordinary_passages(part(0))
    toxic = ordinary + toxic_passages(part(1), part(0))

    def measure(batches):   # whole texts, as in scoring
        margins = Margins(ordinary, toxic)
        for b in batches:
            yield pd.DataFrame({"doc_id": b.doc_id, "y": b.y, "x": [margins.features(t) for t in b.text]})

    rest = (rows.where("half = 1").mapInPandas(measure, "doc_id long, y int, x array<double>")
            .groupBy("doc_id", "y").agg(F.min("x").alias("x")).toPandas().sort_values(["y", "doc_id"]))
    if rest.y.nunique() < 2:
        return ToxicityModel(b"", b"", None)
    x = np.array(list(rest.x))
    # the sample holds more of the rarer class than the corpus: weights put the prior back
    share = {r.toxic: r["count"] for r in labels.where(learn & F.col("toxic").isin(0, 1))
             .groupBy("toxic").count().collect()}
    y = rest.y.to_numpy()
    weight = np.where(y == 1, share[1] / (y == 1).sum(), share[0] / (y == 0).sum())
    return ToxicityModel(ordinary, toxic, logistic(x, y.astype(float), weight))


def score_toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """``doc_id, score``: one row for each row of ``docs``."""
    return map_texts(docs, {"score": pa.float64()}, lambda: lambda texts: [model.score(texts)])


def toxicity_query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Score every document; learn only where crc32(doc_id) mod 5 is not 0."""
    model = fit_toxicity(docs, labels, fold(F.col("doc_id"), 5) != 0)
    return score_toxicity(docs, model).select(
        "doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))
