import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from loomstone.functions import records, similarity
from loomstone.operators import confusion

LIST = "array<struct<label:string,on:string>>"


@pytest.mark.parametrize(
    ("gt", "pred", "mismatch", "want"),
    [
        ("", "", "fp", (0, 0, 0, 1)),
        (None, None, "fp", (0, 0, 0, 1)),
        ("x", "", "fp", (0, 0, 1, 0)),
        ("x", "y", "fp", (0, 1, 0, 0)),
        ("x", "y", "fn", (0, 0, 1, 0)),
        ("", "y", "fp", (0, 1, 0, 0)),
        (" Soil ", "soil", "fp", (1, 0, 0, 0)),
        (" ", "\t", "fp", (1, 0, 0, 0)),
    ],
)
def test_roles(spark, gt, pred, mismatch, want):
    row = spark.createDataFrame([(gt, pred)], "g string, p string").select(confusion.text_confusion(F.col("g"), F.col("p"), mismatch).alias("c")).first().c
    assert tuple(row) == want


def brute(gt, pred):
    """The greedy matcher with plain loops."""
    if not gt:
        return (0, 1, 0, 0) if pred else (0, 0, 0, 1)
    if not pred:
        return 0, 0, 1, 0
    eq = lambda a, b: float(bool(a) and bool(b) and a.lower().strip() == b.lower().strip())
    sim = {(i, j): (eq(g[0], p[0]) + eq(g[1], p[1])) / 2 for i, g in enumerate(gt) for j, p in enumerate(pred)}
    n, tp, fp, used_g, used_p = len(gt), 0.0, 0.0, set(), set()
    while len(used_g) < n and len(used_p) < len(pred):
        i, j = max(((i, j) for i, j in sim if i not in used_g and j not in used_p), key=lambda x: (sim[x], -x[0], -x[1]))
        used_g.add(i)
        used_p.add(j)
        for a, b in zip(gt[i], pred[j], strict=True):
            if eq(a, b) >= 1:
                tp += 1 / (2 * n)
            else:
                fp += 1 / (2 * n)
    fp += (len(pred) - len(used_p)) / n
    fn = (n - len(used_g)) / n
    scale = max(1, tp + fp + fn)
    return tp / scale, fp / scale, fn / scale, 0


def test_matcher_against_loops(spark):
    rng = random.Random(3)
    make = lambda: [(rng.choice("aab c"), rng.choice(["x", "X ", "y", ""])) for _ in range(rng.randint(0, 4))]
    rows = [(i, make(), make()) for i in range(150)]
    df = spark.createDataFrame(rows, f"i int, g {LIST}, p {LIST}").select("i", confusion.match_constraints(F.col("g"), F.col("p")).alias("c"))
    got = {r.i: tuple(r.c) for r in df.collect()}
    for i, g, p in rows:
        assert got[i] == pytest.approx(brute(g, p)), (g, p)
        if g:
            assert sum(got[i]) == pytest.approx(1)


@pytest.mark.parametrize(
    ("gt", "pred", "want"),
    [
        ([("a", "x"), ("b", "y")], [("a", "x")], (0.5, 0, 0.5, 0)),
        ([("a", "x")], [("a", "x"), ("q", "r")], (0.5, 0.5, 0, 0)),
        ([], [("a", "x")], (0, 1, 0, 0)),
        ([("a", "x"), ("b", "y")], [("b", "y"), ("a", "x")], (1, 0, 0, 0)),
    ],
)
def test_matcher_cases(spark, gt, pred, want):
    df = spark.createDataFrame([(gt, pred)], f"g {LIST}, p {LIST}")
    assert tuple(df.select(confusion.match_constraints(F.col("g"), F.col("p")).alias("c")).first().c) == pytest.approx(want)


def test_in_turn_takes_any_positive_likeness(spark):
    df = spark.createDataFrame([([("a", "x"), ("b", "y")], [("b", "x"), ("b", "y")])], f"g {LIST}, p {LIST}")
    c = df.select(confusion.match_in_turn(F.col("g"), F.col("p")).alias("c")).first().c
    assert tuple(c) == pytest.approx((0.5, 0.5, 0, 0))


def test_normalised_targets(spark):
    df = spark.createDataFrame([([("A  b", "hasMatrix: soil")], [("a b", "soil")])], f"g {LIST}, p {LIST}")
    g, p = (records.normal_constraints(F.col(c)) for c in "gp")
    assert df.select(confusion.match_constraints(g, p).alias("c")).first().c.tp == 1


def test_ratios(spark):
    df = spark.createDataFrame([("Kitten", "sitting"), ("", ""), ("same", " SAME ")], "a string, b string")
    got = df.select(similarity.fuzzy_ratio("a", "b").alias("f"), similarity.matcher_ratio("a", "b").alias("m")).collect()
    assert got[0].f == pytest.approx(8 / 13) and got[0].m == SequenceMatcher(None, "kitten", "sitting").ratio()
    assert (got[1].f, got[1].m, got[2].f, got[2].m) == (1, 0, 1, 1)
    sets = spark.createDataFrame([([], []), (["a"], ["a", "b"])], "a array<string>, b array<string>")
    assert [r.j for r in sets.select(similarity.jaccard(F.col("a"), F.col("b")).alias("j")).collect()] == [1.0, 0.5]


def test_fuzzy_ratio_by_brute_force(spark):
    def common(a, b):
        row = [0] * (len(a) + 1)
        for y in b:
            new = [0]
            for i, x in enumerate(a):
                new.append(row[i] + 1 if x == y else max(row[i + 1], new[i]))
            row = new
        return row[-1]

    rng = random.Random(0)
    text = lambda n, letters: "".join(rng.choice(letters) for _ in range(n))
    sizes = [(0, 5), (5, 0), (0, 0), (60, 60), (59, 61), (61, 200), (120, 121), (180, 40)]
    rows = [(text(n, s), text(m, s)) for n, m in sizes for s in ("ab", "abcé日\U0001f600 X")] + [("x" * 2000, "xy" * 1000), (text(2000, "abcd"), text(2000, "abcd")), (None, ""), (None, "a"), ("  A b", "a B \t")]
    got = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "k int, a string, b string").select("k", similarity.fuzzy_ratio("a", "b").alias("f"))
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()
    for r in got.collect():
        a, b = ((x or "").lower().strip() for x in rows[r.k])
        assert r.f == pytest.approx(2 * common(a, b) / (len(a) + len(b)) if a or b else 1.0)
