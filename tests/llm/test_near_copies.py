"""Nearest neighbours among near copies: few pairs leave a tile, and none that counts is lost."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomstone.llm import nearest


def near_copies(rng, n, dim, noise):
    base = rng.normal(0, 1, dim)
    return (base + noise * rng.normal(0, 1, (n, dim))).astype(np.float32).astype(np.float64)


def packed(ids, x):
    codes, finer, measures = nearest._quantised(x)
    return ids.tobytes(), codes.tobytes(), finer.tobytes(), measures.tobytes()


def met(x, queries, k):
    """The pairs that leave a tile early and at its end, and the most that it held."""
    q = nearest.QueryBlock(*packed(queries, x[queries]), k)
    left, most = [], 0
    for i in range(0, len(x), nearest.BLOCK):
        ids = np.arange(i, min(len(x), i + nearest.BLOCK))
        out = q.meet(nearest.Block(*packed(ids, x[ids])))
        left += [] if out is None else [out]
        most = max(most, q.held)
    left += [] if (out := q.survivors()) is None else [out]
    return left, most


@pytest.mark.parametrize("noise", [1e-2, 1e-4, 1e-5])
def test_few_pairs_survive(noise):
    x = near_copies(np.random.default_rng(5), 100_000, 64, noise)
    queries = np.arange(0, 100_000, 500)
    left, most = met(x, queries, 20)
    assert sum(b.num_rows for b in left) <= 3 * 20 * len(queries)
    assert most <= nearest.HELD * 20 * len(queries)
    found = {}
    for b in left:
        for q, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            found.setdefault(q, set()).add(v)
    for q in queries.tolist():
        score = x @ x[q]
        score[q] = -np.inf
        assert set(np.argsort(-score, kind="stable")[:20].tolist()) <= found[q]


def test_bounds_hold():
    rng = np.random.default_rng(6)
    x = rng.normal(0, 1, (300, 24)) * 10.0 ** rng.integers(-12, 12, (300, 1)) * 10.0 ** rng.integers(-5, 5, (300, 24))
    x[:40] = rng.integers(-3, 4, (40, 24))
    x[0], x[1] = 1.0, -1.0
    c, q = nearest.Block(*packed(np.arange(300), x)), nearest.QueryBlock(*packed(np.arange(300), x), 3)
    row, col = (a.ravel() for a in np.indices((300, 300)))
    low, high = q._again(c, row, col)
    exact = np.zeros((300, 300))
    for i in range(24):  # from the first component on
        exact += x[:, i][:, None] * x[:, i][None, :]
    assert (low <= exact[row, col]).all() and (exact[row, col] <= high).all()
    few = rng.permutation(300 * 300)[:500]
    for mine, all_ in zip(q._again(c, row[few], col[few]), (low, high), strict=True):
        np.testing.assert_allclose(mine, all_[few], rtol=1e-9, atol=1e-9 * np.abs(exact).max())


def test_tile_is_bounded(monkeypatch):
    """Copies closer than any code can tell leave the tile as they come, and all of them do."""
    monkeypatch.setattr(nearest, "BLOCK", 64)
    x = near_copies(np.random.default_rng(7), 4000, 16, 0.0)
    x += 1e-15 * np.arange(4000)[:, None]
    queries = np.arange(0, 4000, 400)
    left, most = met(x, queries, 5)
    assert most <= nearest.HELD * 5 * len(queries)
    assert len(left) > 10 and sum(b.num_rows for b in left) > 3900 * len(queries)


@pytest.mark.parametrize("held", [8, 0])
def test_whole(spark, monkeypatch, held):
    monkeypatch.setattr(nearest, "BLOCK", 32)
    monkeypatch.setattr(nearest, "HELD", held)
    rng = np.random.default_rng(8)
    x = np.concatenate([near_copies(rng, 300, 8, 1e-4), near_copies(rng, 150, 8, 1e-7), near_copies(rng, 100, 8, 0.0), rng.normal(0, 1, (100, 8)).astype(np.float32)]).astype(np.float64)
    order = rng.permutation(len(x))
    df = spark.createDataFrame([(i, x[j].tolist()) for i, j in enumerate(order)], "vec_id long, embedding array<float>")
    got = {}
    for r in nearest.nearest(df, F.col("vec_id") % 20 == 0, k=6).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    for q in range(0, len(x), 20):
        score = np.zeros(len(x))
        for i in range(8):  # from the first component on
            score += x[order[q], i] * x[order, i]
        want = sorted((-s, i) for i, s in enumerate(score) if i != q)[:6]
        assert got.pop(q) == [i for _, i in want]
    assert not got


def test_members_meet_their_group_once(spark, monkeypatch):
    """What a second search asks of its groups comes from one join, however many classes they have."""
    from loomstone.llm import ngram_join as module

    plans, plain = [], module.checkpoint

    def checkpoint(df):
        if {"leader", "main", "blocks"} <= set(df.columns):
            plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return plain(df)

    monkeypatch.setattr(module, "checkpoint", checkpoint)
    words = [f"w{i}" for i in range(60)]
    texts = [(j, " ".join([*words[: j % 50], f"x{j}", f"y{j}", *words[j % 50 + 2 :]])) for j in range(120)]
    assert module.ngram_join(spark.createDataFrame(texts, "doc_id bigint, text string"), k=3, num=90, den=100).count() == 120
    assert plans and all(sum("Join Inner, (leader" in line for line in p.splitlines()) <= 1 for p in plans)
