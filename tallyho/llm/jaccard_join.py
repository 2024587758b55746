"""N-gram Jaccard join with Bayesian candidate pruning.

Documents are sets of five-word shingles; two texts are linked if the Jaccard
similarity of their sets is ``SIMILARITY`` or more.

1. Every whole text becomes a MinHash signature; equal shingle sets are one
   text with a number of copies from here on.
2. Signatures are cut into bands.  Buckets of texts that share a band are
   compared in tiles of bounded size: MinHash values are compared a few at a
   time, and a pair is dropped as soon as the posterior probability of
   reaching the threshold, given the matches so far, is below ``TOLERANCE``.
   A tile returns only a spanning forest of what remains, so a bucket of n
   texts gives less than n rows.
3. The forests' components hold all linked texts.  Each component is compared
   in tiles again: pairs that outlast the same pruning are verified exactly on
   their shingle sets.  A tile returns one row a text: the number of linked
   documents and the smallest text it hangs together with.

A large group thus costs tiles, whose number depends on its size, and neither
joins nor results hold its pairs.

Words are runs of bytes other than blank and U+0009 to U+000D.  A text of one
to four words is one shingle; a null text or one without words is linked to
none.  Repeated rows and equal texts are links of each other, and of all that
their text is linked to.  Shingles are compared by 64-bit hashes.  Only
``doc_id`` and ``text`` are read; the stage form leaves all columns as they are.
"""

from __future__ import annotations

import hashlib
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyho.llm.common import staged

WORDS = 5
SIMILARITY = 0.8           # as 4 / 5 in the exact test
BANDS, BAND_ROWS = 25, 5   # a pair at 0.8 shares no band with probability 5e-5
HASHES, STEP = 128, 16     # MinHash values, and how many are compared at a time
TOLERANCE = 1e-6
TILE_TEXTS = 512           # texts of one side of a tile, on average
TILE_SHINGLES = 400_000    # and their shingles

_rng = np.random.default_rng(8)
_BYTES = _rng.integers(1, 2 ** 63, 256, dtype=np.uint64) | np.uint64(1)
_A = _rng.integers(1, 2 ** 63, HASHES, dtype=np.uint64) | np.uint64(1)
_B = _rng.integers(1, 2 ** 63, HASHES, dtype=np.uint64)
_P, _Q, _R = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _Q
    x = (x ^ (x >> np.uint64(27))) * _R
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the five-word shingles of a text."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    if not len(raw):
        return np.empty(0, np.uint64)
    space = _SPACE[raw]
    first = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
    if not len(first):
        return np.empty(0, np.uint64)
    # each byte's number times a power of an odd number by its place in the word
    kept = ~space
    word = np.cumsum(kept & np.concatenate([[True], space[:-1]])) - 1
    place = np.arange(len(raw)) - first[np.maximum(word, 0)]
    powers = np.cumprod(np.full(int(place[kept].max()) + 1, _P, np.uint64))
    value = np.where(kept, _BYTES[raw] * powers[np.where(kept, place, 0)], np.uint64(0))
    words = _mix(np.add.reduceat(value, first))
    n = min(WORDS, len(words))
    out = np.zeros(len(words) - n + 1, np.uint64)
    for i in range(n):
        out = out * _P + words[i:len(words) - n + 1 + i]
    return np.unique(_mix(out + np.uint64(n)))


def minhashes(s: np.ndarray) -> np.ndarray:
    """``HASHES`` MinHash values of a set of shingles."""
    best = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(s), 1024):
        best = np.minimum(best, (s[i:i + 1024, None] * _A + _B).min(0))
    return _mix(best)


def bands(m: np.ndarray) -> np.ndarray:
    """One 64-bit number for each band of a signature."""
    rows = m[:BANDS * BAND_ROWS].reshape(BANDS, BAND_ROWS)
    out = np.arange(BANDS, dtype=np.uint64)
    for i in range(BAND_ROWS):
        out = _mix(out * _P + rows[:, i])
    return out.view(np.int64)


def sketch(m: np.ndarray) -> bytes:
    """The low byte of each MinHash value; others agree by chance in 1 of 256."""
    return m.astype(np.uint8).tobytes()


def least_matches() -> list[int]:
    """Matches needed after each step for the posterior to reach ``TOLERANCE``.

    With a uniform prior the agreement rate c has the posterior
    Beta(m + 1, n - m + 1); P(c >= x) = P(Binomial(n + 1, x) <= m).
    """
    x = SIMILARITY + (1 - SIMILARITY) / 256
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        total = 0.0
        for m in range(n + 1):
            total += comb(n + 1, m) * x ** m * (1 - x) ** (n + 1 - m)
            if total >= TOLERANCE:
                break
        out.append(m)
    return out


def outlasting(sketches: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (a, b) of rows of ``sketches`` that are never dropped."""
    matches = np.zeros(len(a), np.int16)
    for k, least in enumerate(least_matches()):
        part = slice(k * STEP, (k + 1) * STEP)
        matches += (sketches[a, part] == sketches[b, part]).sum(1, dtype=np.int16)
        alive = matches >= least
        a, b, matches = a[alive], b[alive], matches[alive]
    return a, b


def roots(n: int, a: np.ndarray, b: np.ndarray, number: np.ndarray) -> np.ndarray:
    """For each of n nodes the least ``number`` in its component."""
    order = np.argsort(number, kind="stable")
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    label = rank.copy()
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = np.minimum(new, new[order[new]])
        if (new == label).all():
            return number[order[label]]
        label = new


_TRIANGLES: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _pairs(chunk: np.ndarray, across: bool) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of a tile: of one chunk, or across two of them."""
    n = len(chunk)
    if across:
        one = chunk == chunk[0]
        a, b = np.flatnonzero(one), np.flatnonzero(~one)
        return np.repeat(a, len(b)), np.tile(b, len(a))
    if n > 64:
        return np.triu_indices(n, 1)
    if n not in _TRIANGLES:
        _TRIANGLES[n] = np.triu_indices(n, 1)
    return _TRIANGLES[n]


def _lists(column: pa.Array) -> tuple[list[bytes], np.ndarray]:
    """Values of a list column in a row, and where each list starts and ends."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.asarray(column.value_lengths().fill_null(0), np.int64)
    return column.flatten().to_pylist(), np.concatenate([[0], sizes.cumsum()])


def _bucket_forests(batches):
    """Tiles of buckets (chunk, row id and sketch of each text) to edges (child, root)."""
    for batch in batches:
        values, ends = _lists(batch.column("members"))
        if not values:
            continue
        packed = np.frombuffer(b"".join(values), np.uint8).reshape(len(values), 12 + HASHES)
        chunk = packed[:, :4].copy().view(">i4").ravel()
        ids = packed[:, 4:12].copy().view(">i8").ravel().astype(np.int64)
        sketches = np.ascontiguousarray(packed[:, 12:])
        across = np.asarray(batch.column("i")) != np.asarray(batch.column("j"))
        left, right, size = [], [], 0

        def flush():
            a, b = outlasting(sketches, np.concatenate(left), np.concatenate(right))
            used = np.unique(np.concatenate([a, b]))
            low = roots(len(used), np.searchsorted(used, a), np.searchsorted(used, b), ids[used])
            keep = low != ids[used]
            return pa.RecordBatch.from_arrays([pa.array(ids[used][keep]), pa.array(low[keep])], ["u", "v"])

        for start, end, two in zip(ends[:-1], ends[1:], across):
            if end == start:
                continue
            a, b = _pairs(chunk[start:end], two)
            left.append(a + start)
            right.append(b + start)
            size += len(a)
            if size > 400_000:
                yield flush()
                left, right, size = [], [], 0
        if size:
            yield flush()


def _tiles(rows: DataFrame, group: str) -> DataFrame:
    """``group, i, j, members``: tiles of ``item`` of ``rows``, with the chunk before each.

    ``rows`` has ``parts``, the number of chunks of its group.  Groups of one
    chunk are one tile; larger ones are dealt into chunks of bounded expected
    size, and each two chunks meet in a tile.
    """
    chunk = F.pmod(F.xxhash64("rid"), F.col("parts")).cast("int")
    chunks = (rows.withColumn("i", chunk).groupBy(group, "i", "parts")
              .agg(F.collect_list(F.concat(F.unhex(F.lpad(F.hex("i"), 8, "0")), "item")).alias("members")))
    one = chunks.where("parts = 1").select(group, "i", F.col("i").alias("j"), "members")
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    many = (chunks.where("parts > 1").withColumn("k", other)
            .select(group, F.least("i", "k").alias("i"), F.greatest("i", "k").alias("j"), "members")
            .groupBy(group, "i", "j").agg(F.flatten(F.collect_list("members")).alias("members")))
    return one.unionByName(many)


def _packed(rid, *rest):
    """Bytes of a row id (big-endian) and of what follows."""
    return F.concat(F.unhex(F.lpad(F.hex(rid), 16, "0")), *rest)


def _is_forest_of_stars(edges: DataFrame) -> bool:
    """Whether every u has one v, which is no u itself."""
    ends = edges.select(F.col("u").alias("node"), F.col("v").alias("up")).unionByName(
        edges.select(F.col("v").alias("node"), F.lit(None).cast("long").alias("up")))
    seen = ends.groupBy("node").agg(F.min("up").alias("low"), F.max("up").alias("high"),
                                    F.count("up").alias("ups"), F.count("*").alias("all"))
    return seen.where("low < high or (ups > 0 and ups < all)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """``u, v``: each node u that is not the least of its component, and that least node v.

    Alternating large-star and small-star until the edges are stars; every
    step is a written table.
    """
    def least(rows: DataFrame) -> DataFrame:
        # written, so that the join with it shuffles both sides and a hot node can be split
        return staged(rows.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("low")), "low")

    edges = staged(edges.where("u <> v").distinct(), "edges")
    while not _is_forest_of_stars(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = staged(both.join(least(both), "u").where("v > u")
                       .select(F.col("v").alias("u"), F.col("low").alias("v")), "large")
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = least(down)
        small = (down.join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v"))
                 .unionByName(low.select("u", F.col("low").alias("v"))))
        edges = staged(small.where("u <> v").distinct(), "edges")
    return edges


def _signature(text: str | None) -> tuple:
    """Key, number of shingles, sketch and bands; nulls for a text without words."""
    s = shingles(text)
    if not len(s):
        return None, 0, None, None
    m = minhashes(s)
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest(), len(s), sketch(m), bands(m).tolist()


def _sets(batches):
    """Shingle sets of the texts whose key is the one asked for, packed."""
    for b in batches:
        rows = []
        for group, rid, key, copies, text in zip(b.comp, b.rid, b.key, b.copies, b.text):
            s = shingles(text)
            if hashlib.blake2b(s.tobytes(), digest_size=16).digest() == bytes(key):
                head = np.array([rid, copies], ">i8").tobytes()
                rows.append((group, rid, len(s), head + sketch(minhashes(s)) + s.tobytes()))
        yield pd.DataFrame(rows, columns=["comp", "rid", "size", "item"])


def verified(items: list[bytes], across: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row ids of a tile, the linked documents of each, and the least id it hangs together with."""
    items = list({x[4:12]: x for x in items}.values())   # rows of one id and text come as often as they stand
    head = np.frombuffer(b"".join(x[4:20] for x in items), ">i8").reshape(-1, 2).astype(np.int64)
    ids, copies = head[:, 0].copy(), head[:, 1]
    chunk = np.frombuffer(b"".join(x[:4] for x in items), ">i4")
    sketches = np.frombuffer(b"".join(x[20:20 + HASHES] for x in items), np.uint8).reshape(-1, HASHES)
    sets = [np.frombuffer(x[20 + HASHES:], np.uint64) for x in items]
    sizes = np.array([len(s) for s in sets])
    links = np.zeros(len(ids), np.int64)
    pairs = [(np.empty(0, np.int64), np.empty(0, np.int64))]
    a, b = _pairs(chunk, across)
    # the sets' sizes alone bound the similarity
    near = 5 * np.minimum(sizes[a], sizes[b]) >= 4 * np.maximum(sizes[a], sizes[b])
    a, b = outlasting(sketches, a[near], b[near])
    order = np.argsort(a, kind="stable")
    a, b = a[order], b[order]
    bounds = np.flatnonzero(np.diff(a, prepend=-1, append=-1))
    for start, end in zip(bounds[:-1], bounds[1:]):
        one = a[start]
        for k in range(start, end, 64):
            other = b[k:min(k + 64, end)]
            cat = np.concatenate([sets[x] for x in other])
            at = np.minimum(np.searchsorted(sets[one], cat), sizes[one] - 1)
            same = np.add.reduceat((sets[one][at] == cat).astype(np.int64),
                                   np.concatenate([[0], sizes[other].cumsum()[:-1]]))
            other = other[5 * same >= 4 * (sizes[one] + sizes[other] - same)]
            links[one] += copies[other].sum()
            links[other] += copies[one]
            pairs.append((np.full(len(other), one), other))
    left, right = (np.concatenate(x) for x in zip(*pairs))
    return ids, links, roots(len(ids), left, right, ids)


def _verify(batches):
    for batch in batches:
        values, ends = _lists(batch.column("members"))
        across = np.asarray(batch.column("i")) != np.asarray(batch.column("j"))
        for start, end, two in zip(ends[:-1], ends[1:], across):
            ids, links, low = verified(values[start:end], bool(two))
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(links), pa.array(low)],
                                             ["rid", "links", "low"])


def text_classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two written tables: ``doc_id, place, key`` of each document (``place``: a
    hash of its text; ``key``: of its shingle set, null without words), and
    ``key, copies, class, n_links`` of each text that has a shingle."""
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("place"), "text")

    def sign(batches):
        for b in batches:
            rows = list(zip(*map(_signature, b.column("text").to_pylist()))) or [[]] * 4
            kinds = pa.binary(), pa.int32(), pa.binary(), pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("place"), *[pa.array(x, t) for x, t in zip(rows, kinds)]],
                ["doc_id", "place", "key", "size", "sketch", "bands"])

    signed = staged(text.mapInArrow(
        sign, "doc_id long, place long, key binary, size int, sketch binary, bands array<long>"), "signatures")
    texts = staged(signed.where("key is not null").groupBy("key").agg(
        F.count("*").alias("copies"), F.min(F.struct("doc_id", "place")).alias("one"),
        F.first("size").alias("size"), F.first("sketch").alias("sketch"), F.first("bands").alias("bands"))
        .withColumn("rid", F.monotonically_increasing_id()), "texts")

    # candidates: buckets of two and more texts
    entries = texts.select("rid", F.explode("bands").alias("band"))
    buckets = staged(entries.groupBy("band").count().where("count > 1")
                     .select("band", F.ceil(F.col("count") / TILE_TEXTS).cast("int").alias("parts")), "buckets")
    members = (entries.join(buckets, "band").join(texts.select("rid", "sketch"), "rid")
               .select("band", "rid", "parts", _packed(F.col("rid"), F.col("sketch")).alias("item")))
    forests = _tiles(members, "band").mapInArrow(_bucket_forests, "u long, v long")
    coarse = components(forests)

    # exact verification within components
    labels = coarse.select(F.col("u").alias("rid"), F.col("v").alias("comp")).unionByName(
        coarse.select(F.col("v").alias("rid"), F.col("v").alias("comp")).distinct())
    wanted = staged(labels.join(texts.select("rid", "key", "copies", "one", "size"), "rid")
                    .select("comp", "rid", "key", "copies", "size", "one.doc_id", "one.place"), "wanted")
    sizes = staged(wanted.groupBy("comp").agg(F.greatest(
        F.ceil(F.count("*") / TILE_TEXTS), F.ceil(F.sum("size") / TILE_SHINGLES)).cast("int").alias("parts")), "sizes")
    # always by merge: which texts are wanted is a share of the corpus at any size
    full = text.alias("t").join(
        wanted.hint("merge").select("comp", "rid", "key", "copies", F.col("doc_id").alias("id"), F.col("place").alias("at")),
        F.col("t.doc_id").eqNullSafe(F.col("id")) & (F.col("t.place") == F.col("at")))
    sets = staged(full.select("comp", "rid", "key", "copies", "text")
                  .mapInPandas(_sets, "comp long, rid long, size int, item binary"), "sets")
    tiles = staged(_tiles(sets.join(sizes, "comp"), "comp").mapInArrow(_verify, "rid long, links long, low long"), "links")
    links = tiles.groupBy("rid").agg(F.sum("links").alias("links"))
    final = components(tiles.where("low <> rid").select(F.col("rid").alias("u"), F.col("low").alias("v")))
    known = (texts.select("key", "copies", "rid").join(links, "rid", "left")
             .join(final.select(F.col("u").alias("rid"), F.col("v").alias("low")), "rid", "left")
             .select("key", "copies", F.coalesce("low", "rid").alias("class"),
                     (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links")))
    return signed.select("doc_id", "place", "key"), staged(known, "classes")


def jaccard_query(docs: DataFrame) -> DataFrame:
    """``doc_id, class_id, n_links, n_copies``: one row for each row of ``docs``.

    ``class_id`` is the least id of the documents that hang together by links
    (its own for a document without words); ``n_links`` counts the other
    documents linked to it, equal ones among them; ``n_copies`` those with the
    same shingles, itself included.
    """
    signed, classes = text_classes(docs)
    rows = staged(signed.where("key is not null").join(classes, "key")
                  .select("doc_id", "class", "n_links", F.col("copies").alias("n_copies")), "classed")
    first = staged(rows.groupBy("class").agg(F.min("doc_id").alias("class_id")), "first")
    return (rows.join(first, "class").select("doc_id", "class_id", "n_links", "n_copies")
            .unionByName(signed.where("key is null").select(
                "doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"),
                F.lit(1).cast("long").alias("n_copies"))))


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each class: the least (id, text hash) of it.

    Texts without words are in no class and stay.
    """
    signed, classes = text_classes(docs)
    keepers = staged(signed.where("key is not null").join(classes, "key")
                     .groupBy("class").agg(F.min(F.struct("doc_id", "place")).alias("one"))
                     .select(F.col("one.doc_id").alias("_id"), F.col("one.place").alias("_at")), "keepers")
    names = docs.columns
    column = {c.lower(): F.col("_doc")[c] for c in names}
    boxed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_doc"))
    worded = F.coalesce(column["text"].rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    kept = (boxed.where(worded).withColumn("_place", F.xxhash64(column["text"]))
            .join(keepers, column["doc_id"].eqNullSafe(F.col("_id")) & (F.col("_place") == F.col("_at")))
            .dropDuplicates(["_id", "_at"]).select("_doc"))
    return kept.unionByName(boxed.where(~worded)).select(*[F.col("_doc")[c].alias(c) for c in names])
