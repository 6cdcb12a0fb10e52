"""Error metrics on pairs of JSON records: overlap, hallucination, grounding, location, conformance."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstone.functions.records import constraints, entity, kind_of, parsed, string_leaves, unnest, value_is_empty
from loomstone.functions.similarity import sequence_ratio
from loomstone.functions.text import ROLES, contains_folded


def _once(values: list[Column], body):
    """``body`` over values that a lambda's variable holds, so that each is worked out once."""
    named = F.struct(*[v.alias(f"v{i}") for i, v in enumerate(values)])
    return F.element_at(F.transform(F.array(named), lambda x: body(*[x[f"v{i}"] for i in range(len(values))])), 1)


def _entries(json_text: Column) -> Column:
    """(key, empty) of each top-level key of a JSON object, told by the typed value; null for anything else."""
    fields = F.try_variant_get(parsed(json_text), "$", "map<string,variant>")
    return F.transform_values(fields, lambda k, v: value_is_empty(F.to_json(v)))


def structural_overlap(gt: Column, pred: Column) -> Column:
    """Share of the truth's keys for which both sides are set or both are empty; a key that the prediction lacks never counts.

    Null, a blank string and an empty container are empty; texts that look like
    containers, 0 and false are not. Null where the truth is no object or has no keys.
    """
    none = F.expr("cast(map() as map<string,boolean>)")

    def share(mine: Column, theirs: Column) -> Column:
        keys = F.map_keys(mine)
        same = F.filter(keys, lambda k: F.coalesce(F.try_element_at(mine, k) == F.try_element_at(theirs, k), F.lit(False)))
        return F.try_divide(F.size(same), F.size(keys))

    return _once([F.coalesce(_entries(gt), none), F.coalesce(_entries(pred), none)], share)


def mean_overlap(rows: DataFrame, overlap: str, divisor: int | None = None) -> DataFrame:
    """(mean): the sum of a share over ``divisor``, or over the number of rows where none is given."""
    return rows.agg((F.coalesce(F.sum(overlap), F.lit(0.0)) / (F.lit(divisor) if divisor else F.greatest(F.count("*"), F.lit(1)))).alias("mean"))


def hallucinations(gt: Column, pred: Column, constraint_key: str = "hasConstraint") -> list[Column]:
    """For each role 1 where the truth is absent or empty and the prediction is not.

    ``gt`` and ``pred`` are parsed records. ``constraint_key="hasConstraints"``
    gives the historical column, which no record has and which so is always 0.
    """
    out = []
    for role in (*ROLES[:-1], constraint_key):
        g, p = (F.to_json(F.try_variant_get(side, f"$.{role}", "variant")) for side in (gt, pred))
        out.append(F.when(value_is_empty(g) & ~value_is_empty(p), 1).otherwise(0).alias(role))
    return out


def grounding(doc: Column, definition: Column) -> list[Column]:
    """Whether property, object, matrix (source and target) and all constraint labels of a parsed record stand in the definition.

    A property or object that is no string is not grounded; an absent matrix and
    an empty constraint list are.
    """
    plain = lambda key: kind_of(doc, key).isin("string", "empty") & contains_folded(definition, entity(doc, key)["text"])
    matrix, kind = entity(doc, "hasMatrix"), kind_of(doc, "hasMatrix")
    ends = contains_folded(definition, matrix["source"]) & contains_folded(definition, matrix["target"])
    in_matrix = F.when(kind.isin("absent", "null"), True).when(kind.isin("string", "empty"), contains_folded(definition, matrix["text"])).otherwise(ends)
    labels = F.forall(constraints(doc), lambda c: contains_folded(definition, c["label"]))
    flags = (plain("hasProperty"), plain("hasObjectOfInterest"), in_matrix, labels)
    names = ("property", "object_of_interest", "matrix_sources", "constraints")
    return [F.coalesce(f, F.lit(False)).cast("int").alias(f"{n}_grounded") for f, n in zip(flags, names, strict=True)]


def locate(needle: Column, doc: Column) -> Column:
    """Tags of the places where a text stands in a parsed record: property, object, matrix source, constraint labels."""
    obj, matrix = entity(doc, "hasObjectOfInterest"), entity(doc, "hasMatrix")
    in_parts = F.coalesce(F.array_contains(obj["parts"], needle), F.lit(False))
    hits = [
        (entity(doc, "hasProperty")["text"] == needle, "hasProperty"),
        ((obj["text"] == needle) | (obj["source"] == needle) | (obj["target"] == needle) | (obj["system"] == needle) | in_parts, "hasObjectOfInterest"),
        (matrix["source"] == needle, "hasMatrix.hasSource"),
        (F.exists(constraints(doc), lambda c: c["label"] == needle), "hasConstraint.label"),
    ]
    return F.filter(F.array(*[F.when(F.coalesce(h, F.lit(False)), tag) for h, tag in hits]), lambda x: x.isNotNull())


def locate_constraints(gt: Column, pred: Column) -> Column:
    """For each constraint label of the truth, where the prediction has it; both are parsed records."""
    return F.transform(constraints(gt), lambda c: F.struct(c["label"].alias("label"), locate(c["label"], pred).alias("found_in")))


def value_paths(needle: Column, record: Column) -> Column:
    """Paths of every string of a JSON text, at any depth and in lists, that equals the needle."""
    return F.transform(F.filter(string_leaves(record), lambda x: x["text"] == needle), lambda x: x["path"])


def location_counts(rows: DataFrame, found_in: str = "found_in") -> DataFrame:
    """(location, n): how often each place occurs."""
    return unnest(rows, found_in, name="location").groupBy("location").agg(F.count("*").alias("n"))


def best_matches(pairs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """The prediction's string leaf that is most like the truth's text, where the ratio is over ``threshold``.

    ``pairs`` has row_id, gt and leaves (array<struct<path, text>>). First leaf
    wins ties. Ratios are computed in Arrow batches on the workers.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for row_id, gt, leaves in zip(batch["row_id"], batch["gt"], batch["leaves"], strict=True):
                best = (None, None, 0.0)
                for leaf in leaves if leaves is not None else []:
                    score = sequence_ratio(gt, leaf["text"])
                    if score > best[2]:
                        best = (leaf["path"], leaf["text"], score)
                rows.append((row_id, gt, *best))
            yield pd.DataFrame(rows, columns=["row_id", "gt", "path", "best", "score"])

    schema = "row_id bigint, gt string, path string, best string, score double"
    return pairs.select("row_id", "gt", "leaves").mapInPandas(run, schema).where(F.col("score") > threshold)
