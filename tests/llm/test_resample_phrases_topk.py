"""Resampling, phrase mining and exact top-k search against brute force, on edge rows and on sf0.01."""

import collections
import hashlib
import math
import re
import zlib

import duckdb
import numpy as np
import pytest

from tallyho.llm import collocations, metric_tree, queries, resample

MORE = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, rank string, n string"
LONG = "word other thing, " * 20_000


@pytest.fixture(scope="module")
def edge(spark):
    """Nulls in every column, empty, blank and very long texts, repeated rows, clashing columns."""
    prose = "One two three, four five six seven eight nine ten eleven twelve; " * 3
    rows = [(1, prose, "en", "a", 5), (2, prose, "en", "a", None), (2, prose, "en", "a", None), (None, prose, None, None, None),
            (3, None, "en", "b", 0), (4, "", "en", "b", 0), (5, " \n\t ", None, "b", 4), (6, "ÀB\x00c été—x 中文 a b " * 9, "fr", None, 9),
            (7, LONG, "en", "a", len(LONG)), (8, "z" * 5000 + " y", "de", "c", 1), (2 ** 60 + 1, "x", "de", "c", 1)]
    rows += [(100 + i, f"two three w{i % 7} and four five six " * (i % 9 + 1), "en", "s", 1) for i in range(60)]
    return spark.createDataFrame([(*r, "s", "r", "n") for r in rows], SCHEMA)


@pytest.mark.parametrize("key", ["op11_resample", "op12_phrases", "op13_exact_topk"])
def test_query_equals_sql(spark, key):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{MORE}/{t}.parquet')")
    df = queries.QUERIES[key](spark, MORE)
    want = con.sql(queries.ORACLES[key])
    assert df.columns == want.columns
    assert collections.Counter(map(tuple, df.collect())) == collections.Counter(want.fetchall())


# resampling -----------------------------------------------------------------------------

def _drawn(pool, target, max_words, buckets, seed, min_words, percent):
    def words(text):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)

    def at(text):
        w = words(text)
        return [zlib.crc32(" ".join(w[i:i + n]).encode()) % buckets for n in range(1, max_words + 1) for i in range(len(w) - n + 1)]

    s = collections.Counter(b for _, t in pool for b in at(t))
    t = collections.Counter(b for _, x in target for b in at(x))
    sa, ta = sum(s.values()) + buckets, sum(t.values()) + buckets
    rows = []
    for i, text in pool:
        own = [math.floor(1000 * math.log((t[b] + 1) * sa / ((s[b] + 1) * ta))) for b in at(text)]
        weight = sum(own) // len(own) if own else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2 ** 32))), None, len(words(text))])
    able = sorted((r for r in rows if r[5] >= min_words), key=lambda r: (-r[3], -1 if r[0] is None else r[0]))
    for rank, r in enumerate(able[:percent * len(able) // 100], 1):
        r[4] = rank
    return collections.Counter(tuple(r[:5]) for r in rows)


@pytest.mark.parametrize("max_words,buckets,percent", [(1, 10_000, 10), (3, 70_000, 35), (2, 97, 100)])
def test_resampling_equals_brute_force(spark, edge, max_words, buckets, percent):
    target = [("two three four",), (None,), ("",), ("w1 and w2 été x",)]
    got = resample.resample(edge, spark.createDataFrame(target, "text string"), max_words, buckets, 7, 5, percent)
    want = _drawn([(r.doc_id, r.text) for r in edge.collect()], [(0, t) for t, in target], max_words, buckets, 7, 5, percent)
    assert collections.Counter(map(tuple, got.select("doc_id", "n_features", "weight", "score", "rank").collect())) == want


def test_offsets_lead_back_to_the_words():
    words = resample.Words(2, 100)
    for text in (LONG[:2000], "ÀB\x00c été—x 中文 A b " * 99, "", "x" * 2000 + " y" * 400):
        low = text.translate(resample._LOWER)
        found = words.words(text)
        assert [low[a:b] for _, (a, b) in found] == [w for w, _ in found]
        assert [w for w, _ in found] == re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def test_resampling_prefers_the_target_and_takes_empty_tables(spark, edge):
    docs = spark.createDataFrame([(i, ("alpha beta " if i % 2 else "gamma delta ") * 15) for i in range(400)], "doc_id long, text string")
    target = spark.createDataFrame([("alpha beta alpha",)] * 20, "text string")
    drawn = resample.resample(docs, target, percent=30).where("rank is not null").collect()
    assert len(drawn) == 120 and sum(r.doc_id % 2 for r in drawn) > 110
    assert sorted(r["rank"] for r in drawn) == list(range(1, 121))
    assert resample.resample_query(docs.limit(0), target).collect() == []
    assert resample.resample_query(edge, target.limit(0)).count() == edge.count()


# phrases --------------------------------------------------------------------------------

def _phrases(rows, max_words, min_count, top):
    f, n = collections.defaultdict(collections.Counter), collections.Counter()
    for text, lang in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            for k in range(1, max_words + 1):
                f[lang or "und"].update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    out = set()
    for lang, counts in f.items():
        cand = {p: a for p, a in counts.items() if len(p) > 1 and a >= min_count}
        rows = []
        for p, a in cand.items():
            score, cut = min((2000000 * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p)))
            if not any(len(q) > len(p) and 100 * b >= 80 * a and any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1))
                       for q, b in cand.items()):
                rows.append((-score, -a, " ".join(p).encode(), counts[p[:cut]], counts[p[cut:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(rows)[:top], 1):
            out.add((lang, rank, p.decode(), -a, left, right, n[lang], -s))
    return out


@pytest.mark.parametrize("sample,block", [(1, 1 << 21), (8, 300), (10 ** 9, 40), (3, 1)])
def test_phrases_equal_brute_force(spark, edge, monkeypatch, sample, block):
    """Whatever the sample proposes (with the last but one nothing) and however texts are cut."""
    monkeypatch.setattr(collocations, "BLOCK_BYTES", block)
    monkeypatch.setattr(collocations, "SLICE_BYTES", 64 if block < 1000 else 1 << 19)
    docs = edge.where("doc_id is null or doc_id <> 7") if block < 1000 else edge
    got = {tuple(r) for r in collocations.mine_phrases(docs, 4, 6, 12, sample).collect()}
    assert got == _phrases([(r.text, r.lang) for r in docs.collect()], 4, 6, 12)
    assert {r[0] for r in got} >= {"en", "fr"}


def test_a_narrow_filter_changes_no_count(spark, edge, monkeypatch):
    monkeypatch.setattr(collocations, "FILTER_BITS", 7)
    got = {tuple(r) for r in collocations.mine_phrases(edge, 3, 5, 50, 4).collect()}
    assert got == _phrases([(r.text, r.lang) for r in edge.collect()], 3, 5, 50)


def test_words_of_one_hash_are_told_apart(spark, edge, monkeypatch):
    monkeypatch.setattr(collocations, "_BYTES", np.full(256, 3, np.uint64))   # all words of one length alike
    got = {tuple(r) for r in collocations.mine_phrases(edge, 3, 5, 50, 4).collect()}
    assert got == _phrases([(r.text, r.lang) for r in edge.collect()], 3, 5, 50)


def test_border_failures_lead_to_further_passes(spark, edge, monkeypatch):
    passes = []
    monkeypatch.setattr(collocations, "_outside", lambda p, known, plain=collocations._outside: passes.append(1) or plain(p, known))
    collocations.mine_phrases(edge, 4, 6, 12, 10 ** 9).collect()
    assert len(passes) == 4       # words, pairs and triples failed, then no more
    passes.clear()
    collocations.mine_phrases(edge, 4, 6, 12, 1).collect()
    assert len(passes) == 1       # the sample was the whole table


def test_no_documents_no_phrases(edge):
    assert collocations.mine_phrases(edge.limit(0)).collect() == []


# exact top-k ----------------------------------------------------------------------------

def _nearest(rows, is_query, k, scale=1024):
    usable = [(i, [math.floor(scale * x) for x in v]) for i, v in rows
              if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    size = collections.Counter(len(v) for _, v in usable).most_common(1)[0][0]
    usable = [(i, np.array(v, object)) for i, v in usable if len(v) == size]
    out = set()
    for q in {i for i, _ in usable if is_query(i)}:
        best = {}
        asked = [u for j, u in usable if j == q]
        for i, v in usable:
            if i != q:
                best[i] = max([int(u @ v) for u in asked] + ([best[i]] if i in best else []))
        ranked = sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k]
        out |= {(q, r, i, s) for r, (i, s) in enumerate(ranked, 1)}
    return out


def _vectors(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, score string, rank int")


@pytest.mark.parametrize("shape", ["uniform", "clustered", "norms", "ties", "large"])
def test_topk_equals_brute_force(spark, monkeypatch, shape):
    monkeypatch.setattr(metric_tree, "PAGE", 8)
    monkeypatch.setattr(metric_tree, "TREE_ROWS", 60)
    monkeypatch.setattr(metric_tree, "QUERY_BLOCK", 3)
    monkeypatch.setattr(metric_tree.bulk_load, "__defaults__", (8,))
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 6))
    if shape == "clustered":
        x = rng.normal(size=(8, 6))[rng.integers(0, 8, 400)] * 5 + 0.01 * x
    elif shape == "norms":
        x *= np.exp(3 * rng.normal(size=(400, 1)))
    elif shape == "ties":
        x = np.round(x[rng.integers(0, 5, 400)])
    elif shape == "large":
        x *= 1e5       # scores beyond 53 bits
    rows = list(enumerate(x.tolist()))
    rows += [(5, rows[7][1]), (5, rows[7][1]), (20, rows[1][1]), (40, [0.0] * 6), (41, None), (42, [1.0, None] * 3), (None, [1.0] * 6),
             (43, [float("nan")] * 6), (44, [float("inf")] * 6), (45, [1.0] * 5), (46, [])]
    rows += [(300, rows[3][1])] * 30
    got = metric_tree.exact_nearest(_vectors(spark, rows), metric_tree.F.col("vec_id") % 20 == 0, 7)
    assert {tuple(r) for r in got.collect()} == _nearest(rows, lambda i: i % 20 == 0, 7)


def test_fewer_candidates_than_asked_and_none(spark):
    rows = [(0, [1.0, 2.0]), (100, [0.5, -2.0]), (3, [0.0, 0.0])]
    got = {tuple(r) for r in metric_tree.exact_query(_vectors(spark, rows)).collect()}
    assert got == _nearest(rows, lambda i: i % 100 == 0, 10)
    assert metric_tree.exact_query(_vectors(spark, rows[:1])).collect() == []
    assert metric_tree.exact_query(_vectors(spark, rows).limit(0)).collect() == []
    with pytest.raises(ValueError):
        metric_tree.exact_query(_vectors(spark, [(0, [1e300]), (1, [1.0])]))


def test_bounds_spare_most_products_on_clustered_rows():
    rng = np.random.default_rng(1)
    x = np.floor(1024 * (rng.normal(size=(50, 16))[rng.integers(0, 50, 4000)] + 0.01 * rng.normal(size=(4000, 16))))
    kind = metric_tree.Kind(16, int(np.abs(x).max()))
    ids = np.arange(len(x))
    rows = metric_tree.pd.DataFrame({"tree": 0, "vec_id": ids, "v": [r.astype("<i4").tobytes() for r in x]})
    tree = metric_tree.Tree(metric_tree._pages(kind)(rows), kind)
    for q in range(0, 4000, 100):
        want = sorted(((int(s), i) for i, s in enumerate((x @ x[q]).tolist()) if i != q), key=lambda r: (-r[0], r[1]))[:10]
        assert tree.search(q, x[q], 10, -math.inf) == want
    assert tree.computed < 0.3 * 40 * len(x)


def test_every_node_covers_its_rows_and_pages_are_bounded():
    rng = np.random.default_rng(2)
    x = np.vstack([rng.integers(-50, 50, (500, 4)), np.ones((700, 4), int)]).astype(float)
    nodes = metric_tree.bulk_load(np.arange(len(x)), x, 16)
    below = {}
    for n in reversed(nodes):
        below[n["node"]] = np.concatenate([[o] if c < 0 else below[c] for o, c in zip(n["objects"], n["children"])])
        for o, c, r in zip(n["objects"], n["children"], n["radii"]):
            assert c < 0 or metric_tree.distances(x[below[c]], x[o]).max() <= r
        assert len(n["objects"]) <= 16
        assert np.array_equal(n["apart"], metric_tree.distances(x[n["objects"]], x[n["router"]]))
    assert sorted(below[0]) == list(range(len(x)))
