"""Whole-record scoring against plain loops over mixed shapes."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from loomstone.functions.text import ROLES
from loomstone.operators import scoring
from loomstone.plans import summary

WORDS = ["Snow", "snow ", "soil", "Deep  soil", "rain", " ", ""]


def value(rng, depth=0):
    w = lambda: rng.choice(WORDS)
    kinds = [lambda: w()] * 5 + [lambda: {"AsymmetricSystem": w(), "hasSource": w(), "hasTarget": w()}, lambda: {"SymmetricSystem": w(), "hasPart": [w() for _ in range(rng.randint(0, 3))]}]
    kinds += [lambda: {"SymmetricSystem": w()}, lambda: {"label": w()}, lambda: [w(), w()], lambda: None, lambda: [], lambda: {}, lambda: rng.choice([0, 3, False, True]), lambda: {"AsymmetricSystem": w(), "hasNumerator": w(), "hasTarget": w()}]
    return rng.choice(kinds)()


def record(rng):
    out = {r: value(rng) for r in ROLES if r != "hasConstraint" and rng.random() < 0.8}
    items = [rng.choice([{"label": rng.choice(WORDS), "on": rng.choice([*WORDS, "hasMatrix: soil"])}, {"label": rng.choice(WORDS)}]) for _ in range(rng.randint(0, 4))]
    out["hasConstraint"] = rng.choice([items, items, items, "none", None])
    return out


def text_of(v):
    return v if isinstance(v, str) else json.dumps(v, separators=(",", ":"), sort_keys=True)


def plain_scores(gt, pred, cosines=None, version="labels"):
    least = 1.0 if cosines is None else 0.8

    def sim(a, b):
        a, b = ("" if x is None else x if isinstance(x, str) else text_of(x) for x in (a, b))
        if not a or not b:
            return 0.0
        x, y = a.lower().strip(), b.lower().strip()
        return 1.0 if x == y else (cosines or {}).get((x, y), 0.0)

    def score(g, p):
        q = p if isinstance(p, dict) else {}
        if isinstance(g, dict) and "AsymmetricSystem" in g:
            if version == "labels":
                return sum(sim(g.get(k), q.get(k)) for k in ("AsymmetricSystem", "hasSource", "hasTarget")) / 3
            ends = lambda x: (x.get("hasNumerator") or x.get("hasSource"), x.get("hasDenominator") or x.get("hasTarget"))
            return sum(sim(a, b) for a, b in zip(ends(g), ends(q), strict=True)) / 2
        if isinstance(g, dict) and "SymmetricSystem" in g:
            label = lambda x: x["SymmetricSystem"] if "SymmetricSystem" in x and "hasPart" in x else ""
            parts = lambda x: set(x.get("hasPart", []))
            if not (label(g) or label(q)):
                return 0.0
            both = parts(g) | parts(q)
            return (sim(label(g), label(q)) + (len(parts(g) & parts(q)) / len(both) if both else 1.0)) / 2
        return sim(g, p)

    squeeze = lambda s: re.sub(r"\s+", " ", (s or "").strip().lower())
    bare = lambda s: re.sub(rf"^\s*({'|'.join(ROLES)})\s*:", "", s or "").strip()

    def listed(x):
        return [(squeeze(c.get("label")), squeeze(bare(c.get("on")))) if isinstance(c, dict) else ("", "") for c in x] if isinstance(x, list) else []

    def matched(g, p):
        if not g:
            return (0, 1, 0, 0) if p else (0, 0, 0, 1)
        if not p:
            return (0, 0, 1, 0)
        pairs = sorted((-(sim(a[0], b[0]) + sim(a[1], b[1])) / 2, i, j) for i, a in enumerate(g) for j, b in enumerate(p))
        used_g, used_p, tp, fp = set(), set(), 0.0, 0.0
        for _, i, j in pairs:
            if i not in used_g and j not in used_p:
                used_g.add(i)
                used_p.add(j)
                for a, b in zip(g[i], p[j], strict=True):
                    tp, fp = (tp + 1, fp) if sim(a, b) >= least else (tp, fp + 1)
        tp, fp, fn = tp / (2 * len(g)), fp / (2 * len(g)) + (len(p) - len(used_p)) / len(g), (len(g) - len(used_g)) / len(g)
        z = max(1, tp + fp + fn)
        return tp / z, fp / z, fn / z, 0

    out = {}
    for r in ROLES:
        g, p = gt.get(r), pred.get(r)
        if r == "hasConstraint":
            out[r] = matched(listed(g), listed(p))
        elif not g:
            out[r] = (0, 1, 0, 0) if p else (0, 0, 0, 1)
        else:
            out[r] = (0, 0, 1, 0) if not p else (1, 0, 0, 0) if score(g, p) >= least else (0, 1, 0, 0)
    return out


@pytest.mark.parametrize(("version", "close"), [("labels", False), ("parts", False), ("labels", True)])
def test_records_against_loops(spark, version, close):
    rng = random.Random(12)
    rows = []
    for i in range(120):
        gt = record(rng)
        pred = dict(gt) if rng.random() < 0.3 else record(rng)
        rows.append((i, json.dumps(gt), json.dumps(pred)))
    rows += [(500, '{"hasProperty":"x"}', "no json"), (501, None, '{"hasProperty":"x"}'), (502, "{}", None), (503, rows[0][1], rows[0][2])]
    vectors = cosines = None
    if close:
        points = {"snow": [1.0, 0.0], "soil": [0.9, 0.3], "deep  soil": [0.8, 0.4], "deep soil": [0.8, 0.5], "rain": [0.0, 1.0]}
        vectors = spark.createDataFrame([*points.items(), ("snow", [1.0, 0.0])], "text string, vector array<double>")
        length = lambda v: sum(x * x for x in v) ** 0.5
        cosines = {(a, b): sum(x * y for x, y in zip(v, w, strict=True)) / length(v) / length(w) for a, v in points.items() for b, w in points.items()}
    df = spark.createDataFrame(rows, "i int, gt string, pred string").withColumn("tp", F.lit("old"))
    got = {r.i: r for r in scoring.score_records(df, "gt", "pred", vectors, version).collect()}
    assert len(got) == len(rows)
    for i, gt, pred in rows:
        read = lambda x: json.loads(x) if x and x.startswith("{") else {}
        want = plain_scores(read(gt), read(pred), cosines, version)
        for r in got[i].roles:
            assert (r.tp, r.fp, r.fn, r.tn) == pytest.approx(want[r.role]), (i, r.role, gt, pred)
        assert (got[i].tp, got[i].fp, got[i].fn, got[i].tn) == pytest.approx(tuple(map(sum, zip(*want.values(), strict=True))))
    assert scoring.score_records(df.where("false"), "gt", "pred").count() == 0


def test_micro_and_macro_of_records(spark):
    df = spark.createDataFrame([("a", '{"hasProperty":"x"}', '{"hasProperty":"X"}'), ("a", '{"hasProperty":"x"}', '{"hasProperty":"y"}'), ("b", '{"hasProperty":"x"}', "{}")], "m string, gt string, pred string")
    scored = scoring.score_records(df, "gt", "pred")
    micro = {r.m: (r.P, r.R, r.F) for r in summary.micro(scored, ["m"]).collect()}
    assert micro == {"a": (0.5, 1.0, 0.667), "b": (0.0, 0.0, 0.0)}
    assert summary.macro(scoring.by_role(scored, ["m"]), ["m", "role"], ["m"]).count() == 2


def test_reuse(spark):
    tasks = spark.createDataFrame([("k1", "ef"), ("k1", "mcp"), ("k2", "ef"), ("k3", "naive")], "key string, approach string")
    answers = spark.createDataFrame([("k1", "x"), ("k1", "x"), ("k3", "z")], "key string, answer string")
    got = sorted((r.key, r.approach, r.answer, r.reused) for r in scoring.reuse(tasks, answers, ["key"], "approach").collect())
    assert got == [("k1", "ef", "x", False), ("k1", "mcp", "x", True), ("k2", "ef", None, False), ("k3", "naive", "z", False)]
