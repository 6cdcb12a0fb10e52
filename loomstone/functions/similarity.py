"""Similarities of strings, vectors, sets and systems."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from loomstone.functions.records import let
from loomstone.functions.text import is_falsy, strip


def exact(a: Column, b: Column) -> Column:
    """1 where both are set and equal after lower case and trimming, else 0; blanks that are not empty are equal."""
    same = strip(F.lower(a)) == strip(F.lower(b))
    return F.when(is_falsy(a) | is_falsy(b), 0.0).when(same, 1.0).otherwise(0.0)


def close(a: Column, b: Column, cosine_of: Column) -> Column:
    """As ``exact``, but the given cosine where the strings differ."""
    return F.when(is_falsy(a) | is_falsy(b), 0.0).when(exact(a, b) == 1.0, 1.0).otherwise(F.coalesce(cosine_of, F.lit(0.0)))


def fold(x: Column) -> Column:
    """A text with the form in which it is compared, made once for many comparisons."""
    return F.struct(x.alias("raw"), strip(F.lower(x)).alias("key"))


def same(a: Column, b: Column) -> Column:
    """``exact`` of two folded texts."""
    return F.when(is_falsy(a["raw"]) | is_falsy(b["raw"]), 0.0).when(a["key"] == b["key"], 1.0).otherwise(0.0)


def near(cosines: Column):
    """``close`` of two folded texts, with a map from ``pair_key`` to cosines; a pair without one scores 0."""

    def sim(a: Column, b: Column) -> Column:
        return F.when(is_falsy(a["raw"]) | is_falsy(b["raw"]), 0.0).when(a["key"] == b["key"], 1.0).otherwise(F.coalesce(F.try_element_at(cosines, pair_key(a["key"], b["key"])), F.lit(0.0)))

    return sim


def pair_key(a: Column, b: Column) -> Column:
    return F.concat(a, F.lit("\x1f"), b)


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision; null where a vector has no length."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def jaccard(a: Column, b: Column) -> Column:
    """Intersection over union of two arrays as sets, 1 where both are empty."""
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(both, F.lit(1)))


BITS = 60  # of a long that stand for characters; a sum of two such words and a carry fits


def _place_bits(chars: Column) -> Column:
    """For each character of an array the words of bits that say where it stands."""
    words = F.sequence(F.lit(0), F.greatest(F.ceil(F.size(chars) / BITS).cast("int"), F.lit(1)) - 1)
    distinct = F.array_distinct(chars)
    one = lambda c, w: F.aggregate(F.transform(F.slice(chars, w * BITS + 1, F.lit(BITS)), lambda x, i: F.when(x == c, F.call_function("shiftleft", F.lit(1).cast("bigint"), i)).otherwise(F.lit(0).cast("bigint"))), F.lit(0).cast("bigint"), lambda a, x: a + x)
    return F.map_from_arrays(distinct, F.transform(distinct, lambda c: F.transform(words, lambda w: one(c, w))))


def common_subsequence(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence of two arrays of characters.

    A bit for each character of ``a``, in words of ``BITS``, tells where the
    length does not grow yet; a character of ``b`` is one addition with carries
    over the words. Time is the product of the lengths over ``BITS``, space that
    of ``a``'s distinct characters times the words.
    """
    full = F.lit((1 << BITS) - 1).cast("bigint")
    zero = F.lit(0).cast("bigint")

    def taken(free: Column, hits: Column) -> Column:
        def word(s: Column, i: Column) -> Column:
            v, hit = F.get(free, i), F.get(free, i).bitwiseAND(F.get(hits, i))
            total = v + hit + s["carry"]
            return F.struct(F.call_function("shiftright", total, F.lit(BITS)).alias("carry"), F.concat(s["out"], F.array(total.bitwiseAND(full).bitwiseOR(v - hit))).alias("out"))

        start = F.struct(zero.alias("carry"), F.expr("cast(array() as array<bigint>)").alias("out"))
        return F.aggregate(F.sequence(F.lit(0), F.size(free) - 1), start, word)["out"]

    def fold(places: Column) -> Column:
        count = F.greatest(F.ceil(F.size(a) / BITS).cast("int"), F.lit(1))
        start = F.transform(F.sequence(F.lit(0), count - 1), lambda _: full)
        end = F.aggregate(b, start, lambda free, y: let(F.try_element_at(places, y), lambda hits: F.when(hits.isNull(), free).otherwise(taken(free, hits))))
        return F.aggregate(F.transform(end, lambda w: F.lit(BITS).cast("bigint") - F.bit_count(w)), zero, lambda n, x: n + x)

    return F.when((F.size(a) == 0) | (F.size(b) == 0), zero).otherwise(let(_place_bits(a), fold))


def fuzzy_ratio(a: str | Column, b: str | Column) -> Column:
    """Indel ratio: twice the longest common subsequence over both lengths, on trimmed lower case; 1 where both are empty."""
    chars = lambda x: let(strip(F.lower(F.coalesce(F.col(x) if isinstance(x, str) else x, F.lit("")))), lambda t: F.when(t == "", F.expr("cast(array() as array<string>)")).otherwise(F.split(t, "")))

    def ratio(pair: Column) -> Column:
        x, y = pair["x"], pair["y"]
        n = F.size(x) + F.size(y)
        return F.when(n == 0, 1.0).otherwise(2.0 * common_subsequence(x, y) / F.greatest(n, F.lit(1)))

    return let(F.struct(chars(a).alias("x"), chars(b).alias("y")), ratio)


def sequence_ratio(a: str | None, b: str | None) -> float:
    """difflib's ratio on collapsed lower case, 0 where either is blank."""
    x, y = (" ".join(str(s or "").lower().split()) for s in (a, b))
    return SequenceMatcher(None, x, y).ratio() if x and y else 0.0


@F.pandas_udf(DoubleType())
def matcher_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([sequence_ratio(x, y) for x, y in zip(a, b, strict=True)])


def asymmetric(gt: Column, pred: Column, version: str = "parts", sim=exact) -> Column:
    """Similarity of two systems with a source and a target.

    ``labels``: the mean over system, source and target, 0 unless both are
    systems. ``parts``: the system's id is ignored, numerator and denominator
    stand in for source and target, 0 where all four are empty. ``sim`` compares
    two texts of the structs.
    """
    if version == "labels":
        each = [sim(gt[f], pred[f]) for f in ("system", "source", "target")]
        return F.when(gt.isNull() | pred.isNull(), 0.0).otherwise((each[0] + each[1] + each[2]) / 3)
    first = lambda x: F.coalesce(F.nullif(x["numerator"], F.lit("")), x["source"])
    second = lambda x: F.coalesce(F.nullif(x["denominator"], F.lit("")), x["target"])
    bare = is_falsy(first(gt)) & is_falsy(first(pred)) & is_falsy(second(gt)) & is_falsy(second(pred))
    return F.when(bare, 0.0).otherwise((sim(first(gt), first(pred)) + sim(second(gt), second(pred))) / 2)


def symmetric(gt: Column, pred: Column, sim=exact) -> Column:
    """Mean of the label's similarity and the parts' Jaccard; 0 where neither has a label."""
    parts = lambda x: F.coalesce(x["parts"], F.expr("cast(array() as array<string>)"))
    score = (sim(gt["system"], pred["system"]) + jaccard(parts(gt), parts(pred))) / 2
    return F.when(is_falsy(gt["system"]) & is_falsy(pred["system"]), 0.0).otherwise(score)
