"""Confusion counts: role against role, constraint lists, and what follows from them.

Counts are structs<tp, fp, fn, tn> of doubles. The constraint matchers fold over
the sorted pairs of one row with array functions; pairs never become rows.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomstone.functions.similarity import exact, fold, same
from loomstone.functions.text import canonical_target, is_falsy

CLOSE, EXACT = 0.80, 1.0  # fixed values: score thresholds, both inclusive


def counts(tp, fp, fn, tn) -> Column:
    named = zip((tp, fp, fn, tn), ("tp", "fp", "fn", "tn"), strict=True)
    return F.struct(*[(c if isinstance(c, Column) else F.lit(float(c))).cast("double").alias(n) for c, n in named])


def role_confusion(gt_empty: Column, pred_empty: Column, score: Column, threshold: float = EXACT, mismatch: str = "fp") -> Column:
    """Both empty: TN. Only the truth set: FN; only the prediction: FP. Both set:
    TP from the threshold on, below it FP, or FN with ``mismatch="fn"``."""
    wrong = counts(0, 1, 0, 0) if mismatch == "fp" else counts(0, 0, 1, 0)
    return (
        F.when(gt_empty & pred_empty, counts(0, 0, 0, 1))
        .when(gt_empty, counts(0, 1, 0, 0))
        .when(pred_empty, counts(0, 0, 1, 0))
        .when(score >= threshold, counts(1, 0, 0, 0))
        .otherwise(wrong)
    )


def text_confusion(gt: Column, pred: Column, mismatch: str = "fp") -> Column:
    """``role_confusion`` of two plain strings in exact mode."""
    return role_confusion(is_falsy(gt), is_falsy(pred), exact(gt, pred), EXACT, mismatch)


def list_text(values: Column) -> Column:
    """A list as the prototypes compare it: joined by comma and space."""
    return F.array_join(values, ", ")


def _prepared(items: Column, target) -> Column:
    """Constraints with both texts folded, each once before any pairing."""
    return F.transform(items, lambda c: F.struct(fold(c["label"]).alias("label"), fold(target(c["on"])).alias("on")))


def _bound(gt: Column, pred: Column, target, body) -> Column:
    """``body`` over both prepared lists, which a lambda's variable holds so that they are made once."""
    both = F.array(F.struct(_prepared(gt, target).alias("g"), _prepared(pred, target).alias("p")))
    return F.element_at(F.transform(both, lambda x: body(x["g"], x["p"])), 1)


def _pairs(gt: Column, pred: Column, sim) -> Column:
    """All pairs of two prepared lists of one row, best first; ties by place in the truth, then in the prediction."""

    def pair(g: Column, p: Column, i: Column, j: Column) -> Column:
        scores = F.array(F.struct(sim(g["label"], p["label"]).alias("l"), sim(g["on"], p["on"]).alias("o")))
        return F.element_at(F.transform(scores, lambda x: F.struct((-(x["l"] + x["o"]) / 2).alias("s"), i.alias("i"), j.alias("j"), x["l"].alias("l"), x["o"].alias("o"))), 1)

    return F.array_sort(F.flatten(F.transform(gt, lambda g, i: F.transform(pred, lambda p, j: pair(g, p, i, j)))))


def greedy_matches(pairs: Column) -> Column:
    """Pairs in order, each taken where neither side is used yet."""
    unit = "array<struct<s:double,i:int,j:int,l:double,o:double>>"

    def take(acc: Column, p: Column) -> Column:
        used = F.exists(acc, lambda a: (a["i"] == p["i"]) | (a["j"] == p["j"]))
        return F.when(used, acc).otherwise(F.concat(acc, F.array(p)))

    return F.aggregate(pairs, F.expr(f"cast(array() as {unit})"), take)


def match_constraints(gt: Column, pred: Column, threshold: float = EXACT, sim=same) -> Column:
    """Greedy matching with half units for label and target.

    Empty truth: TN, or FP 1 where anything is predicted; empty prediction: FN 1.
    Otherwise pairs are matched best first. Each side of a matched pair is worth
    1 / 2n of a TP from the threshold on, else of an FP; unmatched truths are FN
    and unmatched predictions FP of 1 / n. Where the total passes 1, all are
    scaled down. Give normalised lists for the normalised version. ``sim``
    compares folded texts.
    """
    n = F.size(gt)

    def total(matched: Column) -> Column:
        half = 1.0 / (2 * n)
        good = F.aggregate(matched, F.lit(0), lambda a, m: a + (m["l"] >= threshold).cast("int") + (m["o"] >= threshold).cast("int"))
        tp = good * half
        fp = (2 * F.size(matched) - good) * half + F.greatest(F.size(pred) - F.size(matched), F.lit(0)) / n
        fn = F.greatest(n - F.size(matched), F.lit(0)) / n
        scale = F.greatest(F.lit(1.0), tp + fp + fn)
        return counts(tp / scale, fp / scale, fn / scale, F.lit(0.0))

    matched = _bound(gt, pred, canonical_target, lambda g, p: greedy_matches(_pairs(g, p, sim)))
    body = F.element_at(F.transform(F.array(matched), total), 1)
    return (
        F.when((n == 0) & (F.size(pred) == 0), counts(0, 0, 0, 1))
        .when(n == 0, counts(0, 1, 0, 0))
        .when(F.size(pred) == 0, counts(0, 0, 1, 0))
        .otherwise(body)
    )


def match_in_turn(gt: Column, pred: Column, threshold: float = EXACT, sim=same) -> Column:
    """The oldest matcher: each truth in turn takes its best unused prediction, whole constraints count 1 / n.

    A truth whose best is not positive is FN; a taken one under the threshold is
    FP. Predictions left over change nothing in total.
    """
    n = F.size(gt)
    state = "struct<used:array<int>,tp:double,fp:double,fn:double>"

    def folded(truths: Column, guesses: Column) -> Column:
        def step(acc: Column, g: Column) -> Column:
            scored = F.transform(guesses, lambda p, j: F.struct(((sim(g["label"], p["label"]) + sim(g["on"], p["on"])) / 2).alias("s"), (-j).alias("j")))
            free = F.filter(scored, lambda x: ~F.array_contains(acc["used"], -x["j"]) & (x["s"] > 0))
            return F.element_at(F.transform(F.array(F.try_element_at(F.sort_array(free, asc=False), F.lit(1))), lambda best: taken(acc, best)), 1)

        def taken(acc: Column, best: Column) -> Column:
            unit, hit, any_ = 1.0 / n, best["s"] >= threshold, best.isNotNull()
            return F.struct(
                F.when(any_, F.concat(acc["used"], F.array(-best["j"]))).otherwise(acc["used"]).alias("used"),
                (acc["tp"] + F.when(any_ & hit, unit).otherwise(0.0)).alias("tp"),
                (acc["fp"] + F.when(any_ & ~hit, unit).otherwise(0.0)).alias("fp"),
                (acc["fn"] + F.when(any_, 0.0).otherwise(unit)).alias("fn"),
            )

        start = F.expr(f"cast(named_struct('used', cast(array() as array<int>), 'tp', 0D, 'fp', 0D, 'fn', 0D) as {state})")
        return F.aggregate(truths, start, step, lambda a: counts(a["tp"], a["fp"], a["fn"], F.lit(0.0)))

    return (
        F.when((n == 0) & (F.size(pred) == 0), counts(0, 0, 0, 1))
        .when(n == 0, counts(0, 1, 0, 0))
        .when(F.size(pred) == 0, counts(0, 0, 1, 0))
        .otherwise(_bound(gt, pred, lambda x: x, folded))
    )


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def precision(tp: Column, fp: Column) -> Column:
    return ratio(tp, tp + fp)


def recall(tp: Column, fn: Column) -> Column:
    return ratio(tp, tp + fn)


def f1(p: Column, r: Column) -> Column:
    return ratio(2 * p * r, p + r)


def prf(tp: Column, fp: Column, fn: Column, digits: int = 3) -> list[Column]:
    """Rounded precision, recall and F1, aliased P, R and F; F1 comes from the unrounded two."""
    p, r = precision(tp, fp), recall(tp, fn)
    return [F.round(p, digits).alias("P"), F.round(r, digits).alias("R"), F.round(f1(p, r), digits).alias("F")]
