"""Scoring whole records: every role of a truth against a prediction, and what sums from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstone.functions.records import CONSTRAINTS, let, normal_constraints, parsed, unnest
from loomstone.functions.similarity import asymmetric, cosine, fold, near, pair_key, same, symmetric
from loomstone.functions.text import ROLES
from loomstone.operators.confusion import CLOSE, EXACT, match_constraints, role_confusion

COUNTS = ("tp", "fp", "fn", "tn")
PLAIN_ROLES = tuple(r for r in ROLES if r != "hasConstraint")
NOTHING = ("null", '""', "[]", "{}", "0", "0.0", "false")  # JSON texts that count as not set
_TEXTS = {"system": "AsymmetricSystem", "label": "SymmetricSystem", "source": "hasSource", "target": "hasTarget", "numerator": "hasNumerator", "denominator": "hasDenominator"}


def role_side(doc: Column, role: str) -> Column:
    """One side of a role: whether it is set, its kind, and every text by which it may be compared.

    The role's value is looked up once, its shape and its JSON are worked out once,
    and the fields of a system are looked for in objects alone.
    """
    look = lambda value: F.struct(value.alias("value"), F.schema_of_variant(value).alias("shape"), F.to_json(value).alias("shown"))
    return let(F.try_variant_get(doc, f"$.{role}", "variant"), lambda value: let(look(value), _side))


def _side(x: Column) -> Column:
    value, shown = x["value"], x["shown"]
    at = lambda path, kind: F.try_variant_get(value, f"${path}", kind)
    folded = lambda text: let(text, fold)
    text = F.when(x["shape"] == "STRING", at("", "string")).otherwise(shown)

    def system() -> Column:
        fields = {k: at(f".{name}", "string") for k, name in _TEXTS.items()}
        fields["label"] = F.when(at(".hasPart", "variant").isNotNull(), fields["label"])  # a symmetric system without parts is none
        kind = F.when(at(".AsymmetricSystem", "variant").isNotNull(), "asym").when(at(".SymmetricSystem", "variant").isNotNull(), "sym").otherwise("text")
        parts = F.coalesce(at(".hasPart", "array<string>"), F.expr("cast(array() as array<string>)"))
        return F.struct(kind.alias("kind"), *[folded(v).alias(k) for k, v in fields.items()], parts.alias("parts"))

    bare = F.struct(F.lit("text").alias("kind"), *[fold(F.lit(None).cast("string")).alias(k) for k in _TEXTS], F.expr("cast(array() as array<string>)").alias("parts"))
    seen = lambda y: F.struct((value.isNull() | shown.isin(*NOTHING)).alias("empty"), y["kind"].alias("kind"), folded(text).alias("text"), *[y[k].alias(k) for k in (*_TEXTS, "parts")])
    return let(F.when(x["shape"].startswith("OBJECT"), system()).otherwise(bare), seen)


def constraint_items(doc: Column) -> Column:
    """The constraints with blank texts for items that are no objects; anything but a list counts as empty."""
    items = F.try_variant_get(doc, "$.hasConstraint", "array<variant>")
    text = lambda x, f: F.coalesce(F.try_variant_get(x, f"$.{f}", "string"), F.lit("")).alias(f)
    return F.coalesce(F.transform(items, lambda x: F.struct(text(x, "label"), text(x, "on"))), F.expr(f"cast(array() as {CONSTRAINTS})"))


def _system(x: Column, version: str) -> dict[str, Column]:
    """The texts of an asymmetric system as ``asymmetric`` takes them."""
    if version == "labels":
        return {f: x[f] for f in ("system", "source", "target")}
    either = lambda a, b: F.when(F.length(F.coalesce(x[a]["raw"], F.lit(""))) > 0, x[a]).otherwise(x[b])
    return {"first": either("numerator", "source"), "second": either("denominator", "target")}


def role_score(gt: Column, pred: Column, version: str, sim) -> Column:
    """Similarity of two sides; the truth's kind decides how."""
    g, p = _system(gt, version), _system(pred, version)
    each = [sim(g[f], p[f]) for f in g]
    system = sum(each[1:], each[0]) / len(each)
    plain = lambda x: F.struct(x["label"]["raw"].alias("system"), x["label"].alias("folded"), x["parts"].alias("parts"))
    label = sim(gt["label"], pred["label"])
    parts = symmetric(plain(gt), plain(pred), lambda a, b: label)
    return F.when(gt["kind"] == "asym", system).when(gt["kind"] == "sym", parts).otherwise(sim(gt["text"], pred["text"]))


def _wanted(x: Column, version: str) -> Column:
    """Pairs of folded texts of a row that differ, whose cosine the close mode needs."""
    pairs = []
    for r in PLAIN_ROLES:
        g, p = x["gt"][r], x["pred"][r]
        a, b = _system(g, version), _system(p, version)
        pairs += [(g["text"], p["text"]), (g["label"], p["label"]), *((a[f], b[f]) for f in a)]
    plain = F.array(*[F.struct(a["key"].alias("a"), b["key"].alias("b")) for a, b in pairs])
    rules = lambda side, f: F.transform(x[side]["hasConstraint"], lambda c: fold(c[f])["key"])
    crossed = lambda one, two: F.flatten(F.transform(one, lambda a: F.transform(two, lambda b: F.struct(a.alias("a"), b.alias("b")))))
    listed = [crossed(rules("gt", f), rules("pred", f)) for f in ("label", "on")]
    return F.filter(F.array_distinct(F.concat(plain, *listed)), lambda x: (x["a"] != x["b"]) & (x["a"] != "") & (x["b"] != ""))


def _with_cosines(rows: DataFrame, vectors: DataFrame, version: str) -> DataFrame:
    """Append ``scored_cosines``, a map for ``near``; rows with the same texts share the work."""
    digest = F.sha2(F.to_json("scored"), 256)
    rows = rows.withColumn("scored_digest", digest)
    pairs = rows.select("scored_digest", F.explode(F.element_at(F.transform("scored", lambda x: _wanted(x, version)), 1)).alias("x")).select("scored_digest", "x.a", "x.b").distinct()
    known = vectors.select(F.col("text"), F.col("vector")).dropDuplicates(["text"])
    # vectors meet each distinct pair once, whatever the number of rows that have it; rows get one number back
    once = pairs.select("a", "b").distinct().join(known.withColumnsRenamed({"text": "a", "vector": "va"}), "a").join(known.withColumnsRenamed({"text": "b", "vector": "vb"}), "b")
    found = pairs.join(once.select("a", "b", cosine(F.col("va"), F.col("vb")).alias("cosine")), ["a", "b"])
    found = found.select("scored_digest", F.struct(pair_key(F.col("a"), F.col("b")), F.col("cosine")).alias("entry"))
    maps = found.groupBy("scored_digest").agg(F.map_from_entries(F.collect_list("entry")).alias("scored_cosines"))
    return rows.join(maps, "scored_digest", "left").drop("scored_digest")


def score_records(df: DataFrame, gt: str, pred: str, vectors: DataFrame | None = None, version: str = "labels", threshold: float | None = None, mismatch: str = "fp") -> DataFrame:
    """Append ``roles``, an array of (role, tp, fp, fn, tn), and the sums tp, fp, fn and tn over the six roles.

    ``gt`` and ``pred`` name columns of JSON texts; one that is null or no JSON
    counts as a record without roles. The truth's kind decides how a role is
    compared: asymmetric and symmetric systems by their fields, constraints by
    the normalised matcher, all else as text, objects and lists by their JSON.
    A role is not set where its value is absent, null, blank-free empty, 0 or
    false. With ``vectors`` (text, vector; lower case, trimmed) texts that
    differ score their cosine and the threshold is 0.80, else 1.0. Each text is
    parsed and folded once. Columns of ``df`` called like an added one, or
    beginning with ``scored``, are replaced.
    """
    base = df.drop("roles", *COUNTS)
    base = base.withColumns({"scored_gt": parsed(F.col(gt)), "scored_pred": parsed(F.col(pred))})
    # one lambda variable holds all texts of a row: as plain columns they would be inlined, and worked out anew, in every use
    rows = base.withColumn("scored", F.transform(F.array(F.struct(F.col("scored_gt").alias("gt"), F.col("scored_pred").alias("pred"))), _sides)).drop("scored_gt", "scored_pred")
    if vectors is not None:
        rows = _with_cosines(rows, vectors, version)
    least = threshold if threshold is not None else CLOSE if vectors is not None else EXACT
    sim = same if vectors is None else near(F.col("scored_cosines"))

    def confusion(x: Column, r: str) -> Column:
        g, p = x["gt"][r], x["pred"][r]
        if r == "hasConstraint":
            return match_constraints(g, p, least, sim)
        score = F.element_at(F.transform(F.array(F.struct(g.alias("g"), p.alias("p"))), lambda y: role_score(y["g"], y["p"], version, sim)), 1)
        return role_confusion(g["empty"], p["empty"], score, least, mismatch)

    def shown(x: Column) -> Column:
        one = lambda c, r: F.struct(F.lit(r).alias("role"), *[c[n].alias(n) for n in COUNTS])
        return F.array(*[F.element_at(F.transform(F.array(confusion(x, r)), _named(one, r)), 1) for r in ROLES])

    rows = rows.withColumn("roles", F.element_at(F.transform("scored", shown), 1)).drop("scored", "scored_cosines")
    total = lambda n: F.aggregate("roles", F.lit(0.0), lambda a, x: a + x[n])
    return rows.withColumns({n: total(n) for n in COUNTS})


def _named(one, role: str):
    return lambda c: one(c, role)


def _sides(x: Column) -> Column:
    side = lambda doc: F.struct(*[role_side(doc, r).alias(r) for r in PLAIN_ROLES], normal_constraints(constraint_items(doc)).alias("hasConstraint"))
    return F.struct(side(x["gt"]).alias("gt"), side(x["pred"]).alias("pred"))


def by_role(scored: DataFrame, keys: list[str]) -> DataFrame:
    """One row (keys, role, tp, fp, fn, tn) for each role of each scored record."""
    return unnest(scored, "roles", *keys, name="r").select(*keys, "r.*")


def reuse(tasks: DataFrame, answers: DataFrame, key: list[str], approach: str) -> DataFrame:
    """Give each task the one answer of its key, whatever its linking approach, and say whether it was reused.

    ``answers`` that repeat a key count once, in no particular choice. The first
    approach of a key, in text order, asks (``reused`` false), the others reuse;
    a key without an answer gets nulls and is never a reuse.
    """
    once = answers.dropDuplicates(key)
    first = tasks.groupBy(*key).agg(F.min(approach).alias("asks"))
    joined = tasks.join(once.withColumn("answered", F.lit(True)), key, "left").join(first, key)
    return joined.withColumn("reused", F.coalesce("answered", F.lit(False)) & (F.col(approach) > F.col("asks"))).drop("answered", "asks")
