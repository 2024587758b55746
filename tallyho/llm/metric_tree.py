"""Exact top-k search by inner product with paged M-trees, best first.

Components are turned into integers, floor(``SCALE`` * x), and scores are
integer inner products.  The metric is the Euclidean distance of the integer
vectors: no member of a ball around c of radius R scores above
<q, c> + |q| R for a query q.

Index.  Rows are dealt to the nearest of some pivots (a bounded sample of the
rows; how many follows the number of rows, up to ``MAX_REGIONS``); a region of
many rows is dealt on by hash into trees of about ``TREE_ROWS`` rows.  Each
tree is bulk-loaded in one task and written as one row a node: a page of up to
``PAGE`` entries with, for each entry, its object, its covering radius (0 for
rows) and its distance to the page's own routing object.

Search.  Each query first searches one tree of its most promising region,
which gives it a score to beat.  Then it visits all trees of the regions whose
ball may still hold as good a score, in blocks of queries and trees of bounded
size.  Within a tree nodes are visited by falling bound; the distance stored
with an entry bounds its score through the routing object's, which is known,
so most inner products that cannot matter are never computed.  A bound equal
to the score to beat is followed, since ties go to the smaller id.  The result
is exact whatever the pivots and trees are.

Vectors that are null, of another length than most, or hold null or non-finite
components take no part; zero vectors do.  Rows of one id count as one
candidate, by the best of them, and as one query, by the best of its rows; a
query leaves out every row of its own id.  Repeated rows are merged first.
Null ids take no part.  Only ``vec_id`` and ``embedding`` are read, an empty
table gives an empty result, and components so large that a score could pass
64 bits raise a ValueError.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyho.llm.common import staged

SCALE, NEAREST = 1024, 10
PAGE = 128              # entries of a node
TREE_ROWS = 4096        # rows of a tree, about
MAX_REGIONS = 1024      # pivots, each broadcast with its radius
QUERY_BLOCK = 1024      # queries that search a tree together


@dataclass
class Kind:
    """How integer vectors are written and multiplied exactly."""

    size: int
    largest: int

    def __post_init__(self):
        if self.size * self.largest ** 2 >= 1 << 63:
            raise ValueError("components are too large for scores of 64 bits")
        self.stored = "<i4" if self.largest < 1 << 31 else "<i8"
        self.work = float if self.size * self.largest ** 2 < 1 << 53 else np.int64

    def read(self, blobs) -> np.ndarray:
        return np.frombuffer(b"".join(blobs), self.stored).reshape(len(blobs), self.size).astype(self.work)


def integer_rows(vectors: DataFrame, scale: int = SCALE) -> tuple[DataFrame, Kind]:
    """``vec_id, v`` (integers as bytes) of the vectors that take part, without repeats."""
    v = F.col("embedding").cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = (vectors.where("vec_id is not null").where(F.coalesce(fine, F.lit(False)))
            .select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")))
    largest = F.aggregate("v", F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x)))
    sizes = (rows.groupBy(F.size("v").alias("size")).agg(F.count("*").alias("n"), F.max(largest).alias("largest"))
             .orderBy(F.desc("n"), F.desc("size")).limit(1).collect())
    if not sizes:
        return rows.select("vec_id", F.lit(b"").alias("v")), Kind(0, 0)
    size = sizes[0]["size"]
    kind = Kind(size, int(sizes[0]["largest"] * scale) + 1)

    def task(batches):
        for b in batches:
            x = b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, size)
            x = np.floor(x * scale).astype(kind.stored)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array([r.tobytes() for r in x], pa.binary())],
                                             ["vec_id", "v"])

    whole = rows.where(F.size("v") == size).mapInArrow(task, "vec_id long, v binary")
    return staged(whole.dropDuplicates(["vec_id", "v"]), "integers"), kind


# the index ------------------------------------------------------------------------------

def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.sqrt(((x - c).astype(float) ** 2).sum(1))


def bulk_load(ids: np.ndarray, x: np.ndarray, page: int = PAGE) -> list[dict]:
    """The nodes of a tree over the rows ``x``; node 0 is the root.

    A node's routing object is the row nearest to the mean of the rows below it."""
    nodes: list[dict] = []

    def load(rows: np.ndarray) -> tuple[int, int, float]:
        """Number, routing row and covering radius of the new node over ``rows``."""
        number = len(nodes)
        nodes.append({})
        near = distances(x[rows], x[rows].mean(0))
        router = rows[int(np.lexsort((ids[rows], near))[0])]
        apart = distances(x[rows], x[router])
        if len(rows) <= page:
            entries, objects, radii, children = ids[rows], rows, np.zeros(len(rows)), np.full(len(rows), -1)
        else:
            parts = min(page, -(-len(rows) // page))
            seeds = x[rows[np.linspace(0, len(rows) - 1, parts).astype(int)]]
            gaps = (seeds.astype(float) ** 2).sum(1) - 2.0 * x[rows].astype(float) @ seeds.T.astype(float)
            to = gaps.argmin(1)
            if (to == to[0]).all():   # seeds that do not part the rows
                to = np.arange(len(rows)) * parts // len(rows)
            made = [load(rows[to == i]) for i in np.unique(to)]
            children, objects, radii = (np.array(v) for v in zip(*made))
            entries = ids[objects]
        nodes[number] = {"node": number, "router": router, "ids": entries, "objects": objects, "radii": radii,
                         "apart": distances(x[objects], x[router]), "children": children}
        return number, router, float(apart.max())

    load(np.arange(len(ids)))
    return nodes


_PAGES = "tree long, node int, router binary, radius double, ids binary, objects binary, radii binary, apart binary, children binary"


def _pages(kind: Kind):
    def build(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("vec_id", kind="stable", ignore_index=True)
        ids, x = rows.vec_id.to_numpy(np.int64), kind.read(rows.v.tolist())
        out = []
        for n in bulk_load(ids, x):
            radius = float(distances(x, x[n["router"]]).max()) if n["node"] == 0 else 0.0
            out.append((rows.tree[0], n["node"], x[n["router"]].astype(kind.stored).tobytes(), radius,
                        n["ids"].astype("<i8").tobytes(), x[n["objects"]].astype(kind.stored).tobytes(),
                        n["radii"].astype("<f8").tobytes(), n["apart"].astype("<f8").tobytes(),
                        n["children"].astype("<i4").tobytes()))
        return pd.DataFrame(out, columns=[c.split()[0] for c in _PAGES.split(", ")])
    return build


@dataclass
class Regions:
    """The pivots with their covering radii and number of trees (at most ``MAX_REGIONS``)."""

    pivots: np.ndarray
    radii: np.ndarray
    trees: np.ndarray

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """No row of a region scores above this: queries x regions."""
        ball = np.linalg.norm(q.astype(float), axis=1)[:, None] * self.radii
        close = (q @ self.pivots.T).astype(float)
        return np.where(self.trees > 0, loose(close, ball), -np.inf)


def loose(score, gap):
    """``score + gap`` as a bound that rounding cannot make too small."""
    return score + gap + 1e-9 * (np.abs(score) + gap) + 1e-6


def build_index(rows: DataFrame, kind: Kind) -> tuple[DataFrame, Regions]:
    """The pages of all trees, and the regions."""
    wanted = min(MAX_REGIONS, -(-rows.count() // TREE_ROWS))
    picked = (rows.dropDuplicates(["vec_id"]).orderBy(F.xxhash64("vec_id"), "vec_id").limit(max(1, wanted)).select("v").collect())
    pivots = np.unique(kind.read([r["v"] for r in picked]), axis=0)
    shared = rows.sparkSession.sparkContext.broadcast(pivots)

    def deal(batches):
        pivots = shared.value
        for b in batches:
            x = kind.read(b.column("v").to_pylist())
            gaps = (pivots.astype(float) ** 2).sum(1) - 2.0 * x.astype(float) @ pivots.T.astype(float)
            region = gaps.argmin(1)
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(region, pa.int32()), pa.array(distances(x, pivots[region]), pa.float64())],
                ["vec_id", "v", "region", "far"])

    dealt = staged(rows.mapInArrow(deal, "vec_id long, v binary, region int, far double"), "dealt")
    radii, trees = np.zeros(len(pivots)), np.zeros(len(pivots), np.int64)
    for r in dealt.groupBy("region").agg(F.max("far").alias("far"), F.count("*").alias("n")).collect():
        radii[r["region"]], trees[r["region"]] = r["far"], -(-r["n"] // TREE_ROWS)
    parts = F.element_at(F.array(*[F.lit(int(n)) for n in trees]), F.col("region") + 1)
    tree = (F.col("region").cast("long") * (1 << 32) + F.pmod(F.xxhash64("vec_id", "v"), parts)).alias("tree")
    pages = dealt.select(tree, "vec_id", "v").groupBy("tree").applyInPandas(_pages(kind), _PAGES)
    return staged(pages, "pages"), Regions(pivots, radii, trees)


# the search -----------------------------------------------------------------------------

class Tree:
    """The pages of one tree, read once for a block of queries."""

    def __init__(self, pages: pd.DataFrame, kind: Kind):
        pages = pages.sort_values("node", ignore_index=True)
        self.router = kind.read([pages.router[0]])[0]
        self.radius = pages.radius[0]
        self.nodes = []
        for p in pages.itertuples():
            radii, apart = np.frombuffer(p.radii, "<f8"), np.frombuffer(p.apart, "<f8")
            objects = np.frombuffer(p.objects, kind.stored).reshape(len(radii), kind.size).astype(kind.work)
            self.nodes.append((np.frombuffer(p.ids, "<i8"), objects, radii, apart + radii, np.frombuffer(p.children, "<i4")))
        self.computed = 0   # inner products

    def search(self, own: int, q: np.ndarray, k: int, beat: float) -> list[tuple[int, int]]:
        """``(score, id)`` of the best k ids, best first, leaving out those below ``beat``."""
        length = float(np.linalg.norm(q.astype(float)))
        best: dict[int, int] = {}
        root = float(self.router @ q)
        heap = [(-loose(root, length * self.radius), 0, root)]
        while heap and -heap[0][0] >= beat:
            _, number, close = heapq.heappop(heap)
            ids, objects, radii, reach, children = self.nodes[number]
            # bounded through the routing object, without a product of the entry
            at = np.flatnonzero(loose(close, length * reach) >= beat)
            if not len(at):
                continue
            score = objects[at] @ q
            self.computed += len(at)
            if children[0] >= 0:
                bound = loose(score, length * radii[at])
                for i in np.flatnonzero(bound >= beat):
                    heapq.heappush(heap, (-float(bound[i]), int(children[at[i]]), float(score[i])))
                continue
            for i in np.flatnonzero(score >= beat):
                vec_id = int(ids[at[i]])
                if vec_id != own:
                    best[vec_id] = max(best.get(vec_id, -1 << 63), int(score[i]))
            if len(best) >= k:
                kept = sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k]
                best = dict(kept)
                beat = max(beat, kept[-1][1])
        return sorted(((s, i) for i, s in best.items()), key=lambda x: (-x[0], x[1]))[:k]


_FOUND = "query_id long, vec_id long, score long"


def _searched(visits: DataFrame, pages: DataFrame, kind: Kind, k: int) -> DataFrame:
    """``query_id, vec_id, score``: what each query (``vec_id, v, beat``) finds in each ``tree`` it visits.

    Many queries of one tree are dealt into blocks, each with the tree's pages."""
    blocks = visits.groupBy("tree").agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("blocks"))
    queries = (visits.join(blocks, "tree").withColumn("block", F.pmod(F.xxhash64("vec_id", "v"), F.col("blocks")).cast("int"))
               .select("tree", "block", "vec_id", "v", "beat"))
    held = pages.join(blocks, "tree").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")

    def search(asked: pd.DataFrame, nodes: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(asked) and len(nodes):
            tree = Tree(nodes, kind)
            for own, q, beat in zip(asked.vec_id.tolist(), kind.read(asked.v.tolist()), asked.beat.tolist()):
                out += [(own, i, s) for s, i in tree.search(own, q, k, beat)]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    return (queries.groupBy("tree", "block").cogroup(held.groupBy("tree", "block")).applyInPandas(search, _FOUND))


def _visits(queries: DataFrame, regions: Broadcast, kind: Kind, first: bool) -> DataFrame:
    """``tree, vec_id, v, beat`` for queries (``vec_id, v, beat, home``): with ``first`` one tree of
    the most promising region, else every tree but ``home`` that may hold a score to ``beat``."""
    def task(batches):
        known = regions.value
        for b in batches:
            if not len(b):
                continue
            q = kind.read(b.v.tolist())
            bounds = known.bounds(q)
            if first:
                at = bounds.argmax(1)
                yield pd.DataFrame({"region": at, "from": b.vec_id % known.trees[at], "to": b.vec_id % known.trees[at],
                                    "vec_id": b.vec_id, "v": b.v, "beat": b.beat, "home": b.home})
                continue
            for i, row in enumerate(b.itertuples()):
                at = np.flatnonzero(bounds[i] >= row.beat)
                if len(at):
                    yield pd.DataFrame({"region": at, "from": 0, "to": known.trees[at] - 1, "vec_id": row.vec_id,
                                        "v": [row.v] * len(at), "beat": row.beat, "home": row.home})

    made = queries.select("vec_id", "v", "beat", "home").mapInPandas(
        task, "region long, `from` long, `to` long, vec_id long, v binary, beat double, home long")
    return (made.withColumn("part", F.explode(F.sequence("from", "to")))
            .withColumn("tree", F.col("region") * (1 << 32) + F.col("part")).where(F.col("tree") != F.col("home")).select("tree", "vec_id", "v", "beat"))


def exact_nearest(vectors: DataFrame, is_query: Column, k: int = NEAREST, scale: int = SCALE) -> DataFrame:
    """``query_id, rank, vec_id, score`` for the rows where ``is_query`` holds."""
    rows, kind = integer_rows(vectors, scale)
    if not kind.size:   # no rows, or vectors without components
        empty = vectors.sparkSession.createDataFrame([], _FOUND)
        return empty.withColumn("rank", F.lit(1)).select("query_id", "rank", "vec_id", "score")
    pages, regions = build_index(rows, kind)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    shared = rows.sparkSession.sparkContext.broadcast(regions)
    queries = rows.where(is_query).withColumn("beat", F.lit(float("-inf"))).withColumn("home", F.lit(-1).cast("long"))
    first = staged(_visits(queries, shared, kind, first=True), "first-visits")
    near = staged(_searched(first, pages, kind, k), "near")
    # the k-th score found at home is to be beaten, or equalled, elsewhere
    goal = (near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") == k)
            .select(F.col("query_id").alias("vec_id"), F.col("score").cast("double").alias("goal")))
    homes = first.select("vec_id", "v", F.col("tree").alias("home"))
    again = (homes.join(goal, "vec_id", "left")
             .select("vec_id", "v", F.coalesce("goal", F.lit(float("-inf"))).alias("beat"), "home"))
    found = near.unionByName(_searched(staged(_visits(again, shared, kind, first=False), "visits"), pages, kind, k))
    return (found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
            .withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def exact_query(vectors: DataFrame) -> DataFrame:
    """Queries: ids divisible by 100; candidates: every other row."""
    return exact_nearest(vectors, F.col("vec_id") % 100 == 0)


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) = len(list_filter(embedding, lambda x: isfinite(x)))),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id, max(list_inner_product(a.q, b.q))::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id GROUP BY a.vec_id, b.vec_id)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM s QUALIFY rank <= 10
"""
