"""Importance resampling towards a target distribution by hashed words.

The texts of two tables, the pool and the target, are lower-cased (A-Z only)
and cut into words by an untrained Regex Split of the tokenizers library,
which returns each word with its offsets.  Features are all runs of 1 to
``max_words`` consecutive words, joined by one space: windows over pairs of
offsets, from the start of their first word to the end of their last.  A
feature's bucket is the crc32 of its UTF-8 bytes modulo ``buckets``.  The two
histograms of buckets give each bucket a gain, the smoothed log ratio of
target to pool (in thousandths, rounded down); a text's weight is the mean of
its features' gains, rounded down.  Gumbel noise from a hash of the id is
added to the weight, and the share ``percent`` of the texts with at least
``min_words`` words that score highest is drawn, which is sampling without
replacement in proportion to the weights' exponentials.

Texts are read once: their buckets (two or four bytes a feature) are written
to the shared checkpoint folder and histograms and weights are made of them.
The driver holds one number a bucket for each table and nothing else.  Drawn
rows are ranked by a range-partitioned sort, so no task holds all of them.

Null texts have no words, a null id counts as an empty one in the hash, a text
without features has weight 0, and repeated rows are drawn one by one (equal
ones by their place in the written table).  Only ``doc_id`` and ``text`` are
read, so further columns do no harm; the target may have any id or none.
Empty tables give an empty result, an empty target gains by the pool alone.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, pre_tokenizers

from tallyho.llm.common import staged
from tallyho.operators.batching import with_global_index

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"   # of lower-cased texts
BUCKETS, SEED, MIN_WORDS, PERCENT = 10_000, 2024, 20, 10
BLOCK_CHARS = 300          # a text is split in blocks of about so many characters, cut at separators
CACHED_FEATURES = 300_000  # a task keeps the buckets of so many features,
CACHED_CHARS = 40          # of up to so many characters
BLOCK_BYTES = 1 << 22      # of written buckets are counted together
_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(ord("A"), ord("Z") + 1)})


def bucket_type(buckets: int) -> str:
    """How a bucket number is written."""
    return "<u2" if buckets <= 1 << 16 else "<u4"


class Words:
    """Cuts texts into words with offsets and hashes their windows."""

    def __init__(self, max_words: int, buckets: int):
        self.max_words, self.buckets = max_words, buckets
        self.split = pre_tokenizers.Split(Regex(SEPARATORS + "+"), "removed").pre_tokenize_str
        self.separator = re.compile(SEPARATORS).search
        self.known: dict[str, int] = {}

    def words(self, text: str) -> list[tuple[str, tuple[int, int]]]:
        """Words of a text, lower-cased, with their offsets in it."""
        low = text.translate(_LOWER)
        out, begin = [], 0
        while begin < len(low):
            cut = self.separator(low, begin + BLOCK_CHARS)
            end = cut.start() if cut else len(low)
            out += (self.split(low[begin:end]) if not begin else
                    [(w, (a + begin, b + begin)) for w, (a, b) in self.split(low[begin:end])])
            begin = end
        return out

    def features(self, words: list[tuple[str, tuple[int, int]]]) -> list[str]:
        """Windows of 1 to ``max_words`` words: all of one word, then all of two, and so on."""
        out = [w for w, _ in words]
        if self.max_words == 1:
            return out
        joined, sizes = " ".join(out), [b - a for _, (a, b) in words]
        ends = np.cumsum(np.array(sizes, np.int64) + 1) - 1
        pairs = [zip((ends - sizes).tolist(), ends[n:].tolist()) for n in range(1, self.max_words)]
        return out + [joined[a:b] for a, b in chain(*pairs)]

    def bucket(self, feature: str) -> int:
        at = self.known.get(feature)
        if at is None:
            at = zlib.crc32(feature.encode()) % self.buckets
            if len(feature) <= CACHED_CHARS:
                if len(self.known) >= CACHED_FEATURES:
                    self.known.clear()
                self.known[feature] = at
        return at

    def hashed(self, text: str | None) -> tuple[int, bytes]:
        """Number of words, and the buckets of the features."""
        words = self.words(text or "")
        at = list(map(self.bucket, self.features(words)))
        return len(words), np.array(at, bucket_type(self.buckets)).tobytes()


def hashed_texts(docs: DataFrame, max_words: int, buckets: int) -> DataFrame:
    """``doc_id, n_words, buckets`` of every whole text."""
    def task(batches):
        words = Words(max_words, buckets)
        for b in batches:
            made = [words.hashed(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([n for n, _ in made], pa.int64()), pa.array([x for _, x in made], pa.binary())],
                ["doc_id", "n_words", "buckets"])

    doc_id = F.col("doc_id") if "doc_id" in docs.columns else F.lit(None)
    return (docs.select(doc_id.cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
            .mapInArrow(task, "doc_id long, n_words long, buckets binary"))


def histogram(hashed: DataFrame, buckets: int) -> np.ndarray:
    """Features in each bucket; each task counts its own before they are added up."""
    kind = bucket_type(buckets)

    def task(batches):
        counts, held, size = np.zeros(buckets, np.int64), [], 0
        for b in batches:
            for x in b.column("buckets").to_pylist():
                held.append(x)
                size += len(x)
                if size >= BLOCK_BYTES:
                    counts += np.bincount(np.frombuffer(b"".join(held), kind), minlength=buckets)
                    held, size = [], 0
        counts += np.bincount(np.frombuffer(b"".join(held), kind), minlength=buckets)
        full = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(counts[full], pa.int64())], ["bucket", "n"])

    counted = (hashed.select("buckets").mapInArrow(task, "bucket int, n long")
               .groupBy("bucket").agg(F.sum("n").alias("n")).collect())   # at most ``buckets`` rows
    out = np.zeros(buckets, np.int64)
    for r in counted:
        out[r["bucket"]] = r["n"]
    return out


def gains(pool: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t + 1)(S + B) / ((s + 1)(T + B)))) of each bucket, in doubles."""
    b = float(len(pool))
    s_all, t_all = float(pool.sum()) + b, float(target.sum()) + b
    return np.array([math.floor(1000 * math.log((t + 1.0) * s_all / ((s + 1.0) * t_all)))
                     for s, t in zip(pool.tolist(), target.tolist())], np.int64)


def noise(doc_id: int | None, seed: int) -> int:
    """Gumbel noise in thousandths, from the first 32 bits of a hash of the id."""
    key = f"{seed}:{'' if doc_id is None else doc_id}"
    h = int(hashlib.sha256(key.encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weighed(hashed: DataFrame, gain: np.ndarray, seed: int) -> DataFrame:
    """``doc_id, n_words, n_features, weight, score``."""
    shared = hashed.sparkSession.sparkContext.broadcast(gain)   # one number a bucket
    kind = bucket_type(len(gain))

    def task(batches):
        gain = shared.value
        for b in batches:
            ids, n, weight = b.column("doc_id").to_pylist(), [], []
            for x in b.column("buckets"):
                at = np.frombuffer(x.as_py(), kind)
                n.append(len(at))
                weight.append(int(gain[at].sum()) // len(at) if len(at) else 0)
            score = [w + noise(i, seed) for i, w in zip(ids, weight)]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("n_words"), *[pa.array(x, pa.int64()) for x in (n, weight, score)]],
                ["doc_id", "n_words", "n_features", "weight", "score"])

    return hashed.mapInArrow(task, "doc_id long, n_words long, n_features long, weight long, score long")


def resample(pool: DataFrame, target: DataFrame, max_words: int = 1, buckets: int = BUCKETS, seed: int = SEED,
             min_words: int = MIN_WORDS, percent: int = PERCENT, learn: Column | None = None) -> DataFrame:
    """``doc_id, n_words, n_features, weight, score, rank`` of every row of ``pool``;
    ``rank`` (from 1, by falling score and then rising id) is null for rows not drawn.

    ``learn`` restricts the pool rows that the gains are learned from; default all."""
    hashed = staged(hashed_texts(pool, max_words, buckets), "buckets")
    known = hashed if learn is None else hashed_texts(pool.where(learn), max_words, buckets)
    gain = gains(histogram(known, buckets), histogram(hashed_texts(target, max_words, buckets), buckets))
    # rows equal in score and id are told apart by their place in the written table
    rows = staged(weighed(hashed, gain, seed), "weights").withColumn("_row", F.monotonically_increasing_id())
    able = rows.where(F.col("n_words") >= min_words).withColumn("_down", -F.col("score"))
    placed = with_global_index(able, ["_down", "doc_id", "_row"], "_at", "_n")
    drawn = F.col("_at") < F.floor(F.col("_n") * percent / 100)
    out = ["doc_id", "n_words", "n_features", "weight", "score"]
    return (placed.select(*out, F.when(drawn, F.col("_at") + 1).cast("long").alias("rank"))
            .unionByName(rows.where(F.col("n_words") < min_words).select(*out, F.lit(None).cast("long").alias("rank"))))


def resample_query(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return resample(docs, benchmark).select("doc_id", "n_features", "weight", "score", "rank")


#: crc32 by its bitwise rule over the bytes of each different word.
ORACLE = r"""
WITH RECURSIVE crc(i, bit, v) AS (
  SELECT i, 0, i FROM range(256) r(i)
  UNION ALL
  SELECT i, bit + 1, CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM crc WHERE bit < 8),
tab AS (SELECT list(v ORDER BY i) AS t FROM crc WHERE bit = 8),
docs AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, text FROM documents),
cut AS (
  SELECT rid, text FROM docs UNION ALL SELECT 0, text FROM benchmark),
words AS (
  SELECT rid, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM cut),
hashed AS (
  SELECT word, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(hex(encode(word))) // 2 + 1),
      lambda i: ('0x' || substr(hex(encode(word)), 2 * i - 1, 2))::BIGINT)),
      lambda c, b: xor(c >> 8, t[xor(c, b) % 256 + 1])), 4294967295) % 10000 AS bucket
  FROM (SELECT DISTINCT word FROM words), tab),
hist AS (
  SELECT bucket, count(*) FILTER (rid > 0) AS s, count(*) FILTER (rid = 0) AS t
  FROM words JOIN hashed USING (word) GROUP BY bucket),
totals AS (SELECT sum(s)::DOUBLE + 10000 AS sa, sum(t)::DOUBLE + 10000 AS ta FROM hist),
gain AS (
  SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * sa / ((s + 1)::DOUBLE * ta)))::BIGINT AS g FROM hist, totals),
summed AS (
  SELECT rid, count(*) AS n, sum(g)::BIGINT AS g FROM words JOIN hashed USING (word) JOIN gain USING (bucket)
  WHERE rid > 0 GROUP BY rid),
scored AS (
  SELECT d.rid, doc_id, coalesce(n, 0)::BIGINT AS n_features,
    coalesce((g - ((g % n) + n) % n) // n, 0)::BIGINT AS weight,
    floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE)
      / 4294967296)))::BIGINT AS noise
  FROM docs d LEFT JOIN summed s ON s.rid = d.rid),
ranked AS (
  SELECT rid, row_number() OVER (ORDER BY weight + noise DESC, doc_id) AS place, count(*) OVER () AS able
  FROM scored WHERE n_features >= 20)
SELECT s.doc_id, n_features, weight, weight + noise AS score,
  CASE WHEN place <= 10 * able // 100 THEN place END::BIGINT AS rank
FROM scored s LEFT JOIN ranked r ON r.rid = s.rid
"""
