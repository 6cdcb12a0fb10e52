"""Nearest neighbours, the n-gram join and components against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomstone.llm import components as cc
from loomstone.llm import nearest, ngram_join
from loomstone.llm.nearest import OP1_SQL, op1_nearest
from loomstone.llm.ngram_join import OP6_SQL, op6_ngram_join
from tests.oracle import assert_same

SF = "/root/testdata/sf0.001"


def test_sql(spark):
    assert assert_same(op1_nearest(spark, SF), OP1_SQL, SF) > 0
    assert assert_same(op6_ngram_join(spark, SF), OP6_SQL, SF) == 200


def test_nearest_edges(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(0, 10.0 ** (i % 3), 6)], "x") for i in range(120)]
    rows += [(200 + i, rows[40][1], "x") for i in range(30)]  # ties
    rows += [(300, None, "x"), (301, [0.0] * 6, "x"), (302, [float("nan")] * 6, "x"), (303, [1.0, None, 0.0, 0.0, 0.0, 0.0], "x"), (304, [float("inf")] * 6, "x"), (305, [], "x"), (None, rows[0][1], "x")]
    rows += [rows[5], (306, [1.0, 2.0], "x"), (310, [2.0, 1.0], "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, query_id string")
    got = {}
    for r in nearest.nearest(df, F.col("vec_id") % 10 == 0, k=7).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r["rank"], r.score))
    good = {i: v for i, v, _ in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    for q in [i for i in good if i % 10 == 0]:
        want = sorted(((-sum(np.float64(a) * np.float64(b) for a, b in zip(good[q], v, strict=True)), i) for i, v in good.items() if i != q and len(v) == len(good[q])))[:7]
        assert [g[0] for g in got.pop(q)] == [i for _, i in want]
    assert not got
    empty = df.where("false")
    assert nearest.nearest(empty, F.col("vec_id") % 10 == 0).count() == 0


def test_nearest_common_vector(spark, monkeypatch):
    """A vector that most rows share gives a query no more pairs than its k and the bounds' ties."""
    monkeypatch.setattr(nearest, "BLOCK", 16)
    seen = []
    rng = np.random.default_rng(3)
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(400)] + [(1000 + i, [float(x) for x in rng.normal(0, 1, 3)]) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    for r in nearest.nearest(df, F.col("vec_id") % 100 == 0, k=5).collect():
        seen.append((r.query_id, r["rank"], r.vec_id))
    good = {i: np.float32(v).astype(np.float64) for i, v in rows}
    want = []
    for q in [i for i in good if i % 100 == 0]:
        order = sorted((-sum(good[q] * v), i) for i, v in good.items() if i != q)[:5]
        want += [(q, k + 1, i) for k, (_, i) in enumerate(order)]
    assert sorted(seen) == sorted(want)
    empty = df.where("false")
    assert nearest.nearest(empty, F.col("vec_id") % 100 == 0).count() == 0


def brute(docs, k, num, den):
    sets = {}
    for i, text in docs:
        w = "".join(c.lower() if c.isascii() else c for c in text or "").split(" ")
        w = [x for x in w if x]
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), min(j for j in ids if find(j) == find(i))) for i in ids}


def near_copies(rng, n, words, vocabulary):
    base = [[rng.choice(vocabulary) for _ in range(words)] for _ in range(4)]
    out = []
    for i in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        out.append((i, " ".join(w if rng.random() < 0.9 else w[: rng.randint(1, 12)])))
    return out


@pytest.mark.parametrize(("k", "num", "den", "block"), [(3, 90, 100, 1024), (3, 90, 100, 3), (5, 80, 100, 1024), (5, 80, 100, 4), (1, 50, 100, 1024)])
def test_join(spark, monkeypatch, k, num, den, block):
    monkeypatch.setattr(ngram_join, "BLOCK_DOCS", block)
    rng = random.Random(k * 100 + num + block)
    docs = near_copies(rng, 70, 60, [f"w{i}" for i in range(40 if k < 5 else 400)])
    docs += [(100, None), (101, ""), (102, "   "), (103, "A b"), (104, "a B"), (105, docs[0][1]), (106, "one"), (107, "x " * 3000)]
    df = spark.createDataFrame([(i, t, "z") for i, t in docs], "doc_id long, text string, n string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_join(df, k, num, den).collect()}
    assert got == brute(docs, k, num, den)


def boilerplate_clusters(rng, clusters, size):
    """Clusters of near copies that share one line of long words, and no other."""
    line, out = " ".join(f"licence{i:020d}" for i in range(30)), []
    for c in range(clusters):
        base = [f"c{c}w{i}" for i in range(60)]
        for _ in range(size):
            w = list(base)
            w[rng.randrange(60)] = f"v{len(out)}"
            out.append((len(out), line + " " + " ".join(w)))
    return out


def test_join_shared_boilerplate(spark, monkeypatch):
    """No task of either search holds more than a block, though one line leads all clusters."""
    monkeypatch.setattr(ngram_join, "BLOCK_DOCS", 16)
    monkeypatch.setattr(ngram_join, "PILOTS", 1)
    held, links = [], ngram_join._links

    def watched(rows, *args):
        held.append(max([r["count"] for r in rows.distinct().groupBy("gkey").count().collect()], default=0))
        return links(rows, *args)

    monkeypatch.setattr(ngram_join, "_links", watched)
    docs = boilerplate_clusters(random.Random(3), 60, 4)
    random.Random(4).shuffle(docs)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_join(df, 3, 80, 100).collect()}
    assert got == brute(docs, 3, 80, 100)
    assert len(held) == 2 and max(held) <= 3 * 16


def test_tiles_meet_and_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_DOCS", 20)
    monkeypatch.setattr(ngram_join, "BLOCK_SHINGLES", 1000)
    rows = [(1, i, 0 if i < 90 else i, 0, 30) for i in range(200)] + [(2, i, i % 2, 0, 400) for i in range(12)]
    named = spark.createDataFrame(rows, "leader long, doc_id long, label long, main long, n int").withColumn("fp1", F.col("doc_id"))
    tiles = {}
    for r in ngram_join._tiles(named).collect():
        tiles.setdefault(r.gkey, []).append(r.doc_id)
    size = {1: 30, 2: 400}
    met = {(a, b) for t in tiles.values() for a in t for b in t}
    for leader in size:
        mine = [(i, label) for g, i, label, _, _ in rows if g == leader]
        assert all((a, b) in met for a, x in mine for b, y in mine if x != y)
    assert max(len(t) for t in tiles.values()) <= 3 * 20  # blocks are dealt by hash, so they vary


def test_join_odd_rows(spark):
    df = spark.createDataFrame([(1, "a b c d"), (1, "a b c d"), (None, "a b c d"), (1, "p q r s"), (2, "p q r s")], "doc_id long, text string")
    rows = ngram_join.ngram_join(df).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1) for r in rows) == [(-1, -1), (1, 1), (1, 1), (1, 1), (2, 1)]
    assert ngram_join.ngram_join(df.where("false")).count() == 0


def test_group_search_and_merge():
    rng = np.random.default_rng(5)
    for case in range(40):
        pool = rng.integers(0, 1 << 60, 60).astype(np.uint64)
        sets = [np.unique(rng.choice(pool, rng.integers(1, 50), replace=False)) for _ in range(25)]
        if case % 2:  # one large tight cluster
            sets = [np.unique(np.append(np.setdiff1d(pool, rng.choice(pool, 2)), rng.integers(0, 1 << 60, 2).astype(np.uint64))) for _ in range(90)]
        bounds = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
        links = ngram_join.search_group(np.concatenate(sets), bounds, np.arange(len(sets)), 90, 100)
        root = list(range(len(sets)))
        for a, b in links:
            both = len(np.intersect1d(sets[a], sets[b]))
            assert 100 * both >= 90 * (len(sets[a]) + len(sets[b]) - both)
            root = [root[b] if r == root[a] else r for r in root]
        for a in range(len(sets)):
            for b in range(a):
                both = len(np.intersect1d(sets[a], sets[b]))
                if 100 * both >= 90 * (len(sets[a]) + len(sets[b]) - both):
                    assert root[a] == root[b]
    pick = random.Random(2)
    for _ in range(50):
        lists = [sorted(pick.sample(range(80), pick.randint(0, 60))) for _ in range(9)]
        need = pick.randint(1, 6)
        want = [(x, n) for x in range(80) if (n := sum(x in s for s in lists)) >= need]
        assert list(ngram_join.merge_skip(lists, need)) == want


def test_components(spark):
    rng = random.Random(9)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(i, i + 1) for i in range(100, 140)] + [(200 + i, 200) for i in range(20)] + [(5, 5), (None, 3)]
    got = {r.node: r.component for r in cc.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    root = {}
    for a, b in edges:
        if a is not None and a != b:
            ra, rb = root.setdefault(a, a), root.setdefault(b, b)
            root = {k: min(ra, rb) if v in (ra, rb) else v for k, v in root.items()}
    assert got == root
    assert cc.components(spark.createDataFrame([], "u long, v long")).count() == 0
