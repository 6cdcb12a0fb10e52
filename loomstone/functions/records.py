"""Loosely typed JSON records as columns: roles, constraints, keys."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstone.functions.text import ROLES, canonical_target, is_blank, normalise

ENTITY = "struct<kind:string,text:string,system:string,source:string,target:string,numerator:string,denominator:string,parts:array<string>>"
CONSTRAINTS = "array<struct<label:string,on:string>>"
LEAVES = "array<struct<path:string,text:string>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once; null where the value is."""
    return F.element_at(F.transform(F.array(value), body), 1)


def unnest(rows: DataFrame, items: Column | str, *keep: Column | str, name: str = "x") -> DataFrame:
    """``keep`` and each element of an array in a column ``name``, as ``explode`` gives them.

    Before a plain explode Spark tests the array's size and whether it is null, and
    works the array out anew for each test; here it is worked out once.
    """
    return rows.select(*keep, F.posexplode_outer(items).alias("_place", name)).where("_place is not null").drop("_place")


def parsed(text: Column) -> Column:
    """The JSON value, null for text that is none or that goes on after it."""
    whole = text.rlike(r"(?s)^\s*[\[{].*[\]}]\s*$")
    return F.when(whole, F.try_parse_json(text))


def kind_of(doc: Column, key: str) -> Column:
    """absent, null, empty, string, asym, sym, object, list or scalar: what a role's value is."""
    value = F.try_variant_get(doc, f"$.{key}", "variant")
    shape = F.schema_of_variant(value)
    text = F.try_variant_get(doc, f"$.{key}", "string")
    has = lambda field: F.try_variant_get(doc, f"$.{key}.{field}", "variant").isNotNull()
    return (
        F.when(value.isNull(), "absent")
        .when(F.is_variant_null(value), "null")
        .when(shape.startswith("ARRAY"), "list")
        .when(shape.startswith("OBJECT") & has("AsymmetricSystem"), "asym")
        .when(shape.startswith("OBJECT") & has("SymmetricSystem"), "sym")
        .when(shape.startswith("OBJECT"), "object")
        .when((shape == "STRING") & (text == ""), "empty")
        .when(shape == "STRING", "string")
        .otherwise("scalar")
    )


def entity(doc: Column, key: str) -> Column:
    """A role's value as one struct, whatever form it has."""
    at = lambda path, kind="string": F.try_variant_get(doc, f"$.{key}{path}", kind)
    kind = kind_of(doc, key)
    return F.struct(
        kind.alias("kind"),
        F.when(kind.isin("absent", "null"), None).when(kind.isin("string", "empty", "scalar"), at("")).otherwise(F.to_json(F.try_variant_get(doc, f"$.{key}", "variant"))).alias("text"),
        F.coalesce(at(".AsymmetricSystem"), at(".SymmetricSystem")).alias("system"),
        at(".hasSource").alias("source"),
        at(".hasTarget").alias("target"),
        at(".hasNumerator").alias("numerator"),
        at(".hasDenominator").alias("denominator"),
        at(".hasPart", "array<string>").alias("parts"),
    )


def constraints(doc: Column, key: str = "hasConstraint") -> Column:
    """The constraint list; anything but a list of objects counts as empty."""
    return F.coalesce(F.try_variant_get(doc, f"$.{key}", CONSTRAINTS), F.expr(f"cast(array() as {CONSTRAINTS})"))


def normal_constraints(items: Column) -> Column:
    """Labels normalised, targets without a role prefix and normalised."""
    return F.transform(items, lambda c: F.struct(normalise(c["label"]).alias("label"), normalise(canonical_target(c["on"])).alias("on")))


def with_defaults(doc: Column) -> Column:
    """The six roles as a map of JSON texts, missing ones as an empty string or list."""
    pairs = []
    for role in ROLES:
        value = F.to_json(F.try_variant_get(doc, f"$.{role}", "variant"))
        default = "[]" if role == "hasConstraint" else '""'
        fit = F.when(value.startswith("["), value) if role == "hasConstraint" else F.nullif(value, F.lit("null"))
        pairs += [F.lit(role), F.coalesce(fit, F.lit(default))]
    return F.create_map(*pairs)


def key_audit(json_text: Column, allowed: tuple[str, ...], required: tuple[str, ...] = ROLES) -> Column:
    """Missing and extra top-level keys of a JSON object."""
    keys = F.coalesce(F.json_object_keys(json_text), F.expr("cast(array() as array<string>)"))
    return F.struct(F.array_except(F.array(*map(F.lit, required)), keys).alias("missing_keys"), F.array_except(keys, F.array(*map(F.lit, allowed))).alias("extra_keys"))


def overwritten(pred: Column, gt: Column) -> tuple[Column, Column]:
    """The label to keep (the ground truth's), and whether the prediction had another."""
    return gt, ~pred.eqNullSafe(gt)


def canonical_json(text: Column) -> Column:
    """Compact text with sorted keys, null for text that is no JSON."""
    return F.to_json(parsed(text))


def json_equal(a: Column, b: Column) -> Column:
    """Equal as values; two texts that are no JSON count as equal."""
    return canonical_json(a).eqNullSafe(canonical_json(b))


def value_is_empty(json_value: Column) -> Column:
    """Null, a blank string or an empty container, given as JSON text; 0 and false are not empty."""
    bare = F.regexp_replace(json_value, r'^"((?s:.*))"$', "$1")
    return json_value.isNull() | json_value.isin("null", "[]", "{}") | (json_value.startswith('"') & is_blank(bare))


def atoms(prop: Column, modifier: Column, obj: Column, items: Column, mode: str = "both") -> Column:
    """The set of a record's texts: concepts, constraint texts or both; empty ones are left out."""
    concept = F.array(prop, modifier, obj)
    text = F.concat(F.transform(items, lambda c: c["label"]), F.transform(items, lambda c: canonical_target(c["on"])))
    chosen = {"concept": concept, "text": text, "both": F.concat(concept, text)}[mode]
    return F.array_distinct(F.filter(chosen, lambda x: x.isNotNull() & (x != "")))


_NODE = "struct<path:string,node:variant,raw:string,text:string>"


def depth(json_text: Column) -> Column:
    """How deep objects and lists are nested in a JSON text."""
    marks = F.regexp_extract_all(F.regexp_replace(json_text, r'"(?:[^"\\]|\\.)*+"', ""), F.lit(r"[\[\]{}]"), 0)
    count = lambda s, m: let(s["now"] + F.when(m.isin("[", "{"), 1).otherwise(-1), lambda now: F.struct(now.alias("now"), F.greatest(s["most"], now).alias("most")))
    return F.aggregate(marks, F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")), count)["most"]


def string_leaves(doc: Column) -> Column:
    """(path, text) of every string in a JSON text, in document order; text that is no JSON has none.

    Objects and lists of any depth are opened level by level, as many levels as
    the text is deep (``a.b[0].c``). Numbers, booleans and nulls are no strings.
    An object that names a key twice is no JSON here.
    """
    whole = doc.rlike(r'(?s)^\s*([\[{].*[\]}]|"(?:[^"\\]|\\.)*+")\s*$')
    members = lambda x: x.try_cast("map<string,variant>")
    items = lambda x: x.try_cast("array<variant>")
    leaf = lambda x: members(x).isNull() & items(x).isNull()
    said = lambda x: F.when(leaf(x) & (F.schema_of_variant(x) == "STRING"), F.try_variant_get(x, "$", "string"))
    node = lambda path, x, raw: F.struct(path.alias("path"), x.alias("node"), raw.alias("raw"), said(x).alias("text"))
    none = F.expr(f"cast(array() as array<{_NODE}>)")

    def opened(x: Column) -> Column:
        """What is in a container; a string stays, other scalars go. Variants know types, the raw text the order of keys."""
        below = lambda key: F.when(x["path"] == "", key).otherwise(F.concat(x["path"], F.lit("."), key))
        entries = F.map_entries(F.from_json(x["raw"], "map<string,string>"))
        in_object = let(members(x["node"]), lambda m: F.transform(entries, lambda e: node(below(e["key"]), F.try_element_at(m, e["key"]), e["value"])))
        raws = F.from_json(x["raw"], "array<string>")
        in_list = let(raws, lambda rs: F.transform(items(x["node"]), lambda v, i: node(F.concat(x["path"], F.lit("["), i.cast("string"), F.lit("]")), v, F.get(rs, i))))
        return F.when(x["text"].isNotNull(), F.array(x)).when(members(x["node"]).isNotNull(), in_object).when(items(x["node"]).isNotNull(), in_list).otherwise(none)

    root = F.when(whole, F.try_parse_json(doc))
    levels = let(F.when(root.isNotNull(), depth(doc)), lambda d: F.when(d > 0, F.sequence(F.lit(1), d)).otherwise(F.expr("cast(array() as array<int>)")))
    all_nodes = F.aggregate(levels, F.array(node(F.lit(""), root, doc)).cast(f"array<{_NODE}>"), lambda nodes, _: F.flatten(F.transform(nodes, opened)))
    told = F.transform(F.filter(all_nodes, lambda x: x["text"].isNotNull()), lambda x: F.struct(x["path"].alias("path"), x["text"].alias("text")))
    return F.when(root.isNotNull(), told).otherwise(F.expr(f"cast(array() as {LEAVES})"))


def coerced(json_text: Column, allowed: tuple[str, ...] = ("label", "comment", *ROLES)) -> Column:
    """A record rewritten for evaluation, and what was done to it: struct<record, audit>.

    Missing roles become an empty string, or an empty list for the constraints; a
    property that is an object gives its label (empty where it has none), and the
    audit keeps the object. All other values stay as they are, in the order of
    the text, the added roles last. ``audit`` has missing_keys, extra_keys,
    coerced_property and orig_property. Null where the text is no JSON object.
    """
    doc = parsed(json_text)
    fields = F.from_json(json_text, "map<string,string>")
    keys = F.map_keys(fields)
    kind = kind_of(doc, "hasProperty")
    node = lambda key: F.try_element_at(doc.try_cast("map<string,variant>"), key)
    holds = lambda x: x.try_cast("map<string,variant>").isNotNull() | x.try_cast("array<variant>").isNotNull()
    value = lambda key: F.when(holds(node(key)), F.try_element_at(fields, key)).otherwise(F.coalesce(F.to_json(node(key)), F.lit("null")))
    label = F.coalesce(F.to_json(F.try_variant_get(doc, "$.hasProperty.label", "variant")), F.lit('""'))
    is_object = kind.isin("object", "asym", "sym")
    pair = lambda key, said: F.concat(F.to_json(F.array(key)).substr(F.lit(2), F.length(F.to_json(F.array(key))) - 2), F.lit(":"), said)
    given = F.transform(keys, lambda k: pair(k, F.when((k == "hasProperty") & is_object, label).otherwise(value(k))))
    missing = F.array_except(F.array(*map(F.lit, ROLES)), keys)
    added = F.transform(missing, lambda k: pair(k, F.when(k == "hasConstraint", "[]").otherwise('""')))
    record = F.concat(F.lit("{"), F.array_join(F.concat(given, added), ","), F.lit("}"))
    audit = F.struct(
        missing.alias("missing_keys"),
        F.array_except(keys, F.array(*map(F.lit, allowed))).alias("extra_keys"),
        is_object.alias("coerced_property"),
        F.when(is_object, value(F.lit("hasProperty"))).alias("orig_property"),
    )
    whole = F.struct(record.alias("record"), audit.alias("audit"))
    return F.when(doc.try_cast("map<string,variant>").isNotNull(), whole)
