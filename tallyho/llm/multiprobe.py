"""Approximate nearest neighbours by multiprobe p-stable hashing.

Each table hashes a vector by ``FUNCTIONS`` Gaussian projections, shifted and
cut into slots of ``WIDTH``.  A query visits, in each table, the occupied
buckets in the order of their estimated success (the inner product that the
sum of squared distances from its projections to the slots' borders leaves
possible).  How many is calibrated: the exact neighbours of ``SAMPLE_QUERIES``
queries must be found with a recall of ``RECALL``.  A query whose buckets hold
too few ids goes on until there are enough, or none is left.  The candidates
of all tables are merged and ranked by the inner product of the original
vectors in double precision.

Inner products become distances by scaling the vectors of each norm range
(factor 2) with the largest norm in it and adding one component that fills
each row up to length one; queries get a zero there.  A range of few rows is
one bucket.  Buckets and the queries that visit them meet in tiles of bounded
size, so a bucket may hold any number of rows.  The occupied buckets are kept
on the driver: their number follows the spread of the projections, not the rows.

Vectors that are null, zero, of another length than most, or hold null or
non-finite components take no part.  Rows of one id count as one candidate,
by the nearest of them, and as one query, by the nearest of its rows; a query
leaves out every row of its own id.  Only ``vec_id`` and ``embedding`` are read.  An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyho.llm.common import staged

TABLES, FUNCTIONS, WIDTH = 2, 3, 1.0
NEAREST = 20
RECALL = 0.95            # of the sample's exact neighbours, at least
SAMPLE_QUERIES = 128     # queries that the number of probes is calibrated on
RANGES = 16              # norm ranges; the last one holds all smaller norms
RANGE_ROWS = 512         # up to so many rows, a range is one bucket
TILE_ROWS, TILE_QUERIES = 4096, 1024
SEED = 5


class Hashes:
    """The projections and norm ranges, the same in every task."""

    def __init__(self, size: int, ranges: list[tuple[int, float, int]]):
        """``ranges``: exponent, largest norm and rows, by falling exponent."""
        rng = np.random.default_rng(SEED)
        self.lines = rng.standard_normal((TABLES, FUNCTIONS, size + 1))
        self.shift = rng.uniform(0, 1, (TABLES, FUNCTIONS))
        kept, rest = ranges[:RANGES - 1], ranges[RANGES - 1:]
        if rest:
            kept = [*kept, (rest[0][0], rest[0][1], sum(r[2] for r in rest))]
        self.first = ranges[0][0] if ranges else 0
        # place of each exponent, counted down from the largest
        self.place = np.full(self.first - ranges[-1][0] + 1 if ranges else 1, max(len(kept) - 1, 0))
        for i, (exponent, _, _) in enumerate(kept):
            self.place[self.first - exponent] = i
        self.scale = np.array([norm * (1 + 1e-12) for _, norm, _ in kept] or [1.0])
        self.whole = np.array([n <= RANGE_ROWS for _, _, n in kept] or [True])

    def slots(self, x: np.ndarray) -> np.ndarray:
        """Positions of rows with the added component, in units of slots: rows x tables x functions."""
        return np.einsum("rk,tfk->rtf", x, self.lines) / WIDTH + self.shift

    def rows(self, x: np.ndarray, exponent: np.ndarray) -> np.ndarray:
        """Buckets of candidates: rows x tables."""
        at = self.place[self.first - exponent]
        x = x / self.scale[at][:, None]
        last = np.sqrt(np.clip(1 - (x * x).sum(1, keepdims=True), 0, None))
        slots = np.floor(self.slots(np.hstack([x, last]))).astype(np.int64)
        slots[self.whole[at]] = 0
        packed = ((slots & 0x7FFF) << (15 * np.arange(FUNCTIONS))).sum(-1)
        return packed | (at[:, None] << (15 * FUNCTIONS))

    def queries(self, x: np.ndarray) -> np.ndarray:
        """Positions of queries: rows x tables x functions."""
        x = x / np.abs(x).max(1, keepdims=True)
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        return self.slots(np.hstack([x, np.zeros((len(x), 1))]))

    def order(self, at: np.ndarray, buckets: np.ndarray) -> np.ndarray:
        """Places of one table's ``buckets``, most promising first, for query positions ``at``."""
        place = buckets >> (15 * FUNCTIONS)
        slot = (buckets[:, None] >> (15 * np.arange(FUNCTIONS))) & 0x7FFF
        slot = np.where(slot >= 0x4000, slot - 0x8000, slot)
        cost = np.zeros((len(at), len(buckets)))
        for f in range(FUNCTIONS):
            gap = np.maximum(0, np.maximum(slot[:, f] - at[:, f, None], at[:, f, None] - slot[:, f] - 1))
            cost += gap * gap
        cost[:, self.whole[place]] = 0
        # the inner product at squared distance cost / FUNCTIONS, of a query of length one
        likely = self.scale[place] * (1 - cost * WIDTH ** 2 / (2 * FUNCTIONS))
        return np.argsort(-likely, axis=1, kind="stable")


def usable(vectors: DataFrame) -> tuple[DataFrame, int, list[tuple[int, float, int]]]:
    """``vec_id, v, exponent`` of the vectors that take part, their length, and of
    each norm range the exponent, the largest norm and the number of rows."""
    v = F.col("embedding").cast("array<double>")
    fine = F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
                      & F.exists(v, lambda x: x != 0), F.lit(False))
    rows = vectors.where("vec_id is not null").where(fine).select("vec_id", F.col("embedding").alias("v"))
    sizes = (rows.groupBy(F.size("v").alias("size")).count()
             .orderBy(F.desc("count"), F.desc("size")).limit(1).collect())
    if not sizes:
        return rows.withColumn("exponent", F.lit(0)), 0, []
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    rows = (rows.where(F.size("v") == sizes[0]["size"]).withColumn("norm", norm)
            # borders at 2 ** (n + 0.5), so that vectors of about length one are one range
            .withColumn("exponent", F.floor(F.log2(F.greatest("norm", F.lit(1e-300))) + 0.5).cast("int")))
    ranges = [tuple(r) for r in rows.groupBy("exponent").agg(F.max("norm"), F.count("*")).collect()]
    return rows.drop("norm"), sizes[0]["size"], sorted(ranges, reverse=True)


def by_id(found: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray]:
    """``found`` ordered by id, and where each id begins."""
    found = found.sort_values("vec_id", kind="stable", ignore_index=True)
    ids = found.vec_id.to_numpy()
    return found, np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])


def best_rows(q: np.ndarray, close: np.ndarray, c: np.ndarray, ids: np.ndarray, starts: np.ndarray,
              k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and exact scores of the best rows of the ``k`` best ids; ``close`` are
    rough scores, -inf for rows left out, and ids begin at ``starts``."""
    # all rows up to the k-th id by a margin above rounding, then exactly ranked
    top = np.maximum.reduceat(close, starts) if len(starts) < len(close) else close
    least = np.partition(top, -k)[-k] if len(top) > k else -np.inf
    margin = 1e-9 * (1 + abs(least)) if least > -np.inf else 0.0
    at = np.flatnonzero((close > -np.inf) & (close >= least - margin))
    score = (q * c[at]).sum(1)
    best = np.lexsort((ids[at], -score))
    best = best[np.sort(np.unique(ids[at][best], return_index=True)[1])][:k]
    return at[best], score[best]


def probes_needed(rows: DataFrame, is_query: Column, hashes: Hashes, occupied: list[np.ndarray], k: int) -> int:
    """Buckets a table that a query must visit for ``RECALL`` on a sample of queries.

    The sample's exact neighbours are searched among all rows."""
    sample = (rows.where(is_query).select("vec_id", "v").dropDuplicates(["vec_id"])
              .orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE_QUERIES).toPandas())
    if not len(sample):
        return 0
    ids, x = sample.vec_id.to_numpy(), np.stack(sample.v).astype(float)

    def search(batches):
        best = [pd.DataFrame({"q": [], "vec_id": [], "score": [], "buckets": []})] * len(ids)
        for b in batches:
            if not len(b):
                continue
            b, starts = by_id(b)
            c, own = np.stack(b.v).astype(float), b.vec_id.to_numpy()
            buckets = hashes.rows(c, b.exponent.to_numpy())
            close = x @ c.T
            for i in range(len(ids)):
                at, score = best_rows(x[i], np.where(own == ids[i], -np.inf, close[i]), c, own, starts, k)
                new = pd.DataFrame({"q": i, "vec_id": own[at], "score": score, "buckets": list(buckets[at])})
                best[i] = (pd.concat([best[i], new] if len(best[i]) else [new]).sort_values("score", ascending=False)
                           .drop_duplicates("vec_id").head(k))
        for part in best:
            if len(part):
                yield part

    order = Window.partitionBy("q").orderBy(F.desc("found.score"), "vec_id")
    exact = (rows.mapInPandas(search, "q int, vec_id long, score double, buckets array<long>")
             .groupBy("q", "vec_id").agg(F.max(F.struct("score", "buckets")).alias("found"))
             .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
             .select("q", "found.buckets").toPandas())
    if not len(exact):
        return 0
    q, held = exact.q.to_numpy(), np.stack(exact.buckets)
    ranks = []
    for t in range(TABLES):
        place = np.argsort(hashes.order(hashes.queries(x)[:, t], occupied[t]), axis=1)
        ranks.append(place[q, np.searchsorted(occupied[t], held[:, t])])
    need = np.sort(np.min(ranks, axis=0)) + 1
    return int(need[int(np.ceil(RECALL * len(need))) - 1])


def nearest(vectors: DataFrame, is_query: Column, k: int = NEAREST) -> DataFrame:
    """``query_id, rank, vec_id, score`` for the rows where ``is_query`` holds."""
    rows, size, ranges = usable(vectors)
    hashes = Hashes(size, ranges)

    def index(batches):
        for b in batches:
            if len(b):
                buckets = hashes.rows(np.stack(b.v).astype(float), b.exponent.to_numpy())
                for t in range(TABLES):
                    yield pd.DataFrame({"t": t, "bucket": buckets[:, t], "vec_id": b.vec_id, "v": b.v})

    made = f"t int, bucket long, vec_id long, v {rows.schema['v'].dataType.simpleString()}"
    entries = staged(rows.mapInPandas(index, made), "buckets")
    # ids are counted in one bucket of theirs, so counts of several buckets add up
    counts = (entries.groupBy("t", "vec_id").agg(F.collect_set("bucket").alias("buckets"))
              .select("t", F.posexplode(F.array_sort("buckets")).alias("no", "bucket"))
              .groupBy("t", "bucket").agg(F.sum((F.col("no") == 0).cast("long")).alias("ids")).toPandas()
              .sort_values(["t", "bucket"]))
    occupied = [counts.bucket[counts.t == t].to_numpy(np.int64) for t in range(TABLES)]
    ids = [counts.ids[counts.t == t].to_numpy(np.int64) for t in range(TABLES)]
    least = probes_needed(rows, is_query, hashes, occupied, k)

    def probe(batches):
        step = max(1, 1_000_000 // max(1, *map(len, occupied)))   # the table of costs is queries x buckets
        for b in batches:
            for i in range(0, len(b), step):
                part = b.iloc[i:i + step]
                at = hashes.queries(np.stack(part.v).astype(float))
                for t in range(TABLES):
                    order = hashes.order(at[:, t], occupied[t])
                    # up to k ids besides the query's own, or all
                    enough = (np.cumsum(ids[t][order], axis=1) <= k).sum(1) + 1
                    yield pd.DataFrame({"t": t, "bucket": [occupied[t][o[:max(least, n)]] for o, n in zip(order, enough)],
                                        "vec_id": part.vec_id, "v": part.v})

    visits = staged(rows.where(is_query).mapInPandas(probe, made.replace("bucket long", "bucket array<long>")), "probes")
    visits = visits.withColumn("bucket", F.explode("bucket"))
    key = ["t", "bucket"]
    grid = staged(entries.groupBy(key).agg(F.ceil(F.count("*") / TILE_ROWS).cast("int").alias("across")).join(
        visits.groupBy(key).agg(F.ceil(F.count("*") / TILE_QUERIES).cast("int").alias("down")), key), "tiles")

    def dealt(df: DataFrame, own: str, other: str) -> DataFrame:
        """Each row in one part of its own side, once for each part of the other."""
        return (df.join(grid, key)
                .withColumn(f"{own}_no", F.pmod(F.xxhash64("vec_id"), F.col(own)).cast("int"))
                .withColumn(f"{other}_no", F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
                .select(*key, "across_no", "down_no", "vec_id", "v"))

    tile = [*key, "across_no", "down_no"]

    def rank_tile(queries: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        out = {"query_id": [], "vec_id": [], "score": []}
        if len(queries) and len(found):
            found, starts = by_id(found)
            q, c, ids = np.stack(queries.v).astype(float), np.stack(found.v).astype(float), found.vec_id.to_numpy()
            close = q @ c.T
            for i, (query_id, near) in enumerate(zip(queries.vec_id, close)):
                near = np.where(ids == query_id, -np.inf, near)
                best, score = best_rows(q[i], near, c, ids, starts, k)
                out["query_id"] += [query_id] * len(best)
                out["vec_id"] += ids[best].tolist()
                out["score"] += score.tolist()
        return pd.DataFrame(out)

    found = (dealt(visits, "down", "across").groupBy(tile)
             .cogroup(dealt(entries, "across", "down").groupBy(tile))
             .applyInPandas(rank_tile, "query_id long, vec_id long, score double"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
            .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def ann_query(vectors: DataFrame) -> DataFrame:
    """Queries: ids divisible by 20; candidates: every other row."""
    return nearest(vectors, F.col("vec_id") % 20 == 0)
