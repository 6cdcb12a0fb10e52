"""Triples as a table (graph_id, s, p, o, o_kind): records, mappings and shape checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstone.functions.text import after_colon, local_name

RDF_TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
XSD = "http://www.w3.org/2001/XMLSchema#"


def template(pattern: str, *cols: Column) -> Column:
    """A subject or object from columns; null where any is null."""
    return F.when(reduce(lambda a, b: a & b, [c.isNotNull() for c in cols], F.lit(True)), F.format_string(pattern, *cols))


def numbered(rows: DataFrame, keys: list[str]) -> DataFrame:
    """A hash of join keys as ``number``, to go first among them: IRIs begin alike, and numbers sort faster than they do."""
    return rows.withColumn("number", F.xxhash64(*keys))


def map_rows(rows: DataFrame, graph_id: str, subject: Column, predicates: list[tuple[str, Column, str]]) -> DataFrame:
    """Triples of a declarative mapping: (predicate, object, kind) for each row; null subjects and objects give none.

    One scan and one explode, however many predicates there are.
    """
    each = F.array(*[F.struct(F.lit(p).alias("p"), o.cast("string").alias("o"), F.lit(kind).alias("o_kind")) for p, o, kind in predicates])
    out = rows.select(F.lit(graph_id).alias("graph_id"), subject.alias("s"), F.explode(each).alias("t"))
    return out.select("graph_id", "s", "t.p", "t.o", "t.o_kind").where("s is not null and o is not null")


def reference_join(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str, child_subject: Column, predicate: str, parent_subject: Column, graph_id: str) -> DataFrame:
    """Triples that point from a child row to the parent rows with an equal key."""
    left = child.select(F.col(child_key).alias("_key"), child_subject.alias("s"))
    right = parent.select(F.col(parent_key).alias("_key"), parent_subject.alias("o"))
    return left.join(right, "_key").select(F.lit(graph_id).alias("graph_id"), "s", F.lit(predicate).alias("p"), "o", F.lit("iri").alias("o_kind"))


def n_triples(triples: DataFrame) -> DataFrame:
    """One line of N-Triples for each row, in a column ``value``; datatypes and languages are written where the rows have them."""
    escaped = F.col("o")
    for sign, said in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r")):
        escaped = F.replace(escaped, F.lit(sign), F.lit(said))
    kind = F.lit("")
    if {"datatype", "lang"} <= set(triples.columns):
        typed = F.col("datatype").isNotNull() & (F.col("datatype") != XSD + "string")
        kind = F.when(F.col("lang").isNotNull(), F.concat(F.lit("@"), F.col("lang"))).when(typed, F.concat(F.lit("^^<"), F.col("datatype"), F.lit(">"))).otherwise("")
    quoted = F.concat(F.lit('"'), escaped, F.lit('"'), kind)
    node = lambda c: F.when(c.startswith("_:"), c).otherwise(F.concat(F.lit("<"), c, F.lit(">")))
    obj = F.when(F.col("o_kind") == "literal", quoted).otherwise(node(F.col("o")))
    return triples.select(F.concat_ws(" ", node(F.col("s")), F.concat(F.lit("<"), F.col("p"), F.lit(">")), obj, F.lit(".")).alias("value"))


def pattern_join(triples: DataFrame, type_iri: str, predicate: str) -> DataFrame:
    """(graph_id, value): the smallest object that an instance of the type has for a predicate."""
    typed = triples.where((F.col("p") == RDF_TYPE) & (F.col("o") == type_iri)).select("graph_id", "s")
    return triples.where(F.col("p") == predicate).join(typed, ["graph_id", "s"]).groupBy("graph_id").agg(F.min("o").alias("value"))


def roots(triples: DataFrame, type_iri: str) -> DataFrame:
    """(graph_id, root): an instance of the type, else of a type whose name ends alike, else a labelled node with a definition or comment; the smallest of the best kind."""
    facts = triples.groupBy("graph_id", "s").agg(
        F.max((F.col("p") == RDF_TYPE) & (F.col("o") == type_iri)).alias("exact"),
        F.max((F.col("p") == RDF_TYPE) & F.col("o").endswith(local_name(F.lit(type_iri)))).alias("alike"),
        F.max(F.col("p") == RDFS + "label").alias("label"),
        F.max(F.col("p").endswith("definition") | (F.col("p") == RDFS + "comment")).alias("described"),
    )
    rank = F.when(F.col("exact"), 0).when(F.col("alike"), 1).when(F.col("label") & F.col("described"), 2)
    return facts.withColumn("rank", rank).where("rank is not null").groupBy("graph_id").agg(F.min_by("s", F.struct("rank", "s")).alias("root"))


def record_fields(triples: DataFrame, predicates: dict[str, str]) -> DataFrame:
    """One row per (graph_id, s) with a column per named predicate: null, one value, or several as a JSON list."""
    wanted = triples.where(F.col("p").isin(list(predicates.values())))
    cols = [F.array_sort(F.collect_set(F.when(F.col("p") == p, F.col("o")))).alias(n) for n, p in predicates.items()]
    out = wanted.groupBy("graph_id", "s").agg(*cols)
    one = lambda n: F.when(F.size(n) == 0, None).when(F.size(n) == 1, F.element_at(n, 1)).otherwise(F.to_json(n)).alias(n)
    return out.select("graph_id", "s", *[one(n) for n in predicates])


def systems(triples: DataFrame, source: str, target: str, part: str, numerator: str, denominator: str) -> DataFrame:
    """Asymmetric and symmetric systems: source and target fall back to numerator and
    denominator; one node in both places makes a symmetric system of one part."""
    fields = record_fields(triples, {"a": source, "b": target, "n": numerator, "d": denominator})
    parts = triples.where(F.col("p") == part).groupBy("graph_id", "s").agg(F.array_sort(F.collect_set("o")).alias("parts"))
    both = fields.join(parts, ["graph_id", "s"], "full")
    first, second = F.coalesce("a", "n"), F.coalesce("b", "d")
    same = first.isNotNull() & (first == second)
    kind = F.when(same, "sym").when(first.isNotNull() | second.isNotNull(), "asym").otherwise("sym")
    return both.select("graph_id", "s", kind.alias("kind"), F.when(~F.coalesce(same, F.lit(False)), first).alias("source"), F.when(~F.coalesce(same, F.lit(False)), second).alias("target"), F.when(same, F.array(first)).otherwise(F.col("parts")).alias("parts"))


def constraint_labels(label: Column, *targets: Column) -> list[Column]:
    """A constraint's cleaned label and its target: the first given of explicit, modifier, object, property, matrix, root."""
    return [after_colon(label).alias("label"), F.coalesce(*targets).alias("on")]


def cardinality(triples: DataFrame, type_iri: str, predicate: str, low: int = 0, high: int | None = None, min_length: int = 0) -> DataFrame:
    """(graph_id, s, n) of instances whose number of values is out of bounds; values under ``min_length`` do not count."""
    typed = triples.where((F.col("p") == RDF_TYPE) & (F.col("o") == type_iri)).select("graph_id", "s").distinct()
    values = triples.where((F.col("p") == predicate) & (F.length("o") >= min_length)).groupBy("graph_id", "s").agg(F.count("*").alias("n"))
    counted = typed.join(values, ["graph_id", "s"], "left").select("graph_id", "s", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))
    return counted.where((F.col("n") < low) | (F.col("n") > high if high is not None else F.lit(False)))


def target_class(triples: DataFrame, predicate: str, classes: list[str]) -> DataFrame:
    """(graph_id, s, o) of links whose object is an instance of none of the classes."""
    typed = triples.where((F.col("p") == RDF_TYPE) & F.col("o").isin(classes)).select("graph_id", F.col("s").alias("o"))
    return triples.where((F.col("p") == predicate) & (F.col("o_kind") != "literal")).select("graph_id", "s", "o").join(typed, ["graph_id", "o"], "left_anti").select("graph_id", "s", "o")


def linked_from(triples: DataFrame, type_iri: str, predicate: str) -> DataFrame:
    """(graph_id, s) of instances that nothing points to with the predicate."""
    typed = triples.where((F.col("p") == RDF_TYPE) & (F.col("o") == type_iri)).select("graph_id", "s").distinct()
    return typed.join(triples.where(F.col("p") == predicate).select("graph_id", F.col("o").alias("s")), ["graph_id", "s"], "left_anti")


def asymmetric_complete(triples: DataFrame, type_iri: str, first: list[str], second: list[str]) -> DataFrame:
    """(graph_id, s) of asymmetric systems that lack either end; each end may come by any of its predicates."""
    typed = triples.where((F.col("p") == RDF_TYPE) & (F.col("o") == type_iri)).select("graph_id", "s").distinct()
    ends = triples.groupBy("graph_id", "s").agg(F.max(F.col("p").isin(first)).alias("one"), F.max(F.col("p").isin(second)).alias("two"))
    return typed.join(ends, ["graph_id", "s"], "left").where("not (coalesce(one, false) and coalesce(two, false))").select("graph_id", "s")
