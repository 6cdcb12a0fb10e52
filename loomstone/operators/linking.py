"""Entity links: choosing candidates, assertions and their comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstone.functions.records import kind_of
from loomstone.functions.text import canonical_uri, is_blank

APPROACHES = ("none", "naive", "embedding", "cross-encoder", "ef", "mcp")


def link(candidates: DataFrame, approach: str, threshold: float = 0.0) -> DataFrame:
    """(term, id) of each term from its candidates (term, pos, id, label, score).

    ``naive`` takes the first hit, ``embedding`` the best score, ``cross-encoder``
    the best score if it is over the threshold, ``ef`` the first whose label is
    the term, else the best score; ``mcp`` takes what its provider put first.
    The first wins ties. ``none`` links nothing; another name is an error.
    """
    linked = link_all(candidates, (approach,), threshold).withColumnRenamed(approach, "id")
    return linked.where(F.lit(approach != "none"))


def link_all(candidates: DataFrame, approaches: tuple[str, ...], threshold: float = 0.0) -> DataFrame:
    """(term, one id column for each approach), from one grouping of the candidates."""
    if unknown := set(approaches) - set(APPROACHES):
        raise ValueError(f"unknown approach {sorted(unknown)}")
    first, scored = F.struct(-F.col("pos")), F.struct(F.col("score"), -F.col("pos"))
    named = lambda e, s: F.struct(F.lit(e).alias("e"), s.alias("s"), (-F.col("pos")).alias("p"))
    order = {"none": first, "naive": first, "mcp": first, "embedding": scored, "cross-encoder": scored, "ef": F.when(F.col("label") == F.col("term"), named(1, F.lit(0.0))).otherwise(named(0, F.col("score")))}
    best = candidates.groupBy("term").agg(*[F.max_by(F.struct("id", "score"), order[a]).alias(a) for a in approaches])
    chosen = {"none": lambda c: F.lit(None).cast("string"), "cross-encoder": lambda c: F.when(c["score"] > threshold, c["id"])}
    return best.select("term", *[chosen.get(a, lambda c: c["id"])(F.col(f"`{a}`")).alias(a) for a in approaches])


def enrich(labels: DataFrame, links: DataFrame, label_col: str = "label") -> DataFrame:
    """Join links to labels (pair_id, path, label); each distinct label is linked once. Unlinked ones stay with a null uri."""
    named = links.select(F.col("term").alias(label_col), F.concat(F.lit("https://www.wikidata.org/wiki/"), F.col("id")).alias("uri"))
    return labels.join(named, label_col, "left")


# fixed values: the fields that carry labels and links
PLAIN = ("hasProperty", "hasMatrix", "hasObjectOfInterest", "hasContextObject")
NESTED = ("hasMatrix", "hasObjectOfInterest", "hasContextObject")
MEMBERS = ("AsymmetricSystem", "SymmetricSystem", "hasSource", "hasTarget")

_PATHS = "array<struct<path:string,pos:int,label:string>>"


def label_paths(doc: Column) -> Column:
    """(path, pos, label) of every text of a record that can be linked.

    Plain roles give their text; systems give their members and, by position,
    their parts. A role with a system has no label of its own.
    """
    at = lambda path, kind="string": F.try_variant_get(doc, f"$.{path}", kind)
    one = lambda path, label: F.struct(F.lit(path).alias("path"), F.lit(-1).alias("pos"), label.alias("label"))
    plain = [one(p, F.when(kind_of(doc, p) == "string", at(p))) for p in PLAIN]
    inner = [one(f"{r}.{m}", at(f"{r}.{m}")) for r in NESTED for m in MEMBERS]
    of = lambda r: F.transform(at(f"{r}.hasPart", "array<string>"), lambda x, i: F.struct(F.lit(f"{r}.hasPart").alias("path"), i.alias("pos"), x.alias("label")))
    parts = [of(r) for r in NESTED]
    every = F.concat(F.array(*plain, *inner), *[F.coalesce(p, F.expr(f"cast(array() as {_PATHS})")) for p in parts])
    return F.filter(every, lambda x: ~is_blank(x["label"]) | (x["pos"] >= 0))


def enriched(records: DataFrame, links: DataFrame, key: str, doc: str = "doc") -> DataFrame:
    """(key, uris): a map from URI path to URI of each record.

    Labels explode, each distinct one is linked once, and the links come back by
    a join. Lists of part URIs keep their nulls and go where all are null; they
    are given as JSON text.
    """
    rows = records.select(key, F.explode(label_paths(F.col(doc))).alias("l")).select(key, "l.*")
    rows = enrich(rows, links)
    lists = F.array_sort(F.collect_list(F.struct("pos", "uri")))
    cells = rows.groupBy(key, "path").agg(F.max("pos").alias("last"), F.max("uri").alias("uri"), lists.alias("all"))
    text = F.concat(F.lit("["), F.array_join(F.transform("all", lambda x: F.coalesce(F.concat(F.lit('"'), x["uri"], F.lit('"')), F.lit("null"))), ","), F.lit("]"))
    cells = cells.where("uri is not null").select(key, F.when(F.col("last") < 0, F.concat("path", F.lit("URI"))).otherwise(F.concat("path", F.lit("URIs"))).alias("path"), F.when(F.col("last") < 0, F.col("uri")).otherwise(text).alias("uri"))
    found = cells.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("path", "uri"))).alias("uris"))
    return records.select(key).join(found, key, "left")


def uri_assertions(doc: Column) -> Column:
    """(path, expected) of the URIs that a ground-truth record asserts; the modifier's is not asserted. Part lists are JSON text."""
    at = lambda path: F.nullif(F.try_variant_get(doc, f"$.{path}", "string"), F.lit(""))
    cell = lambda path, value: F.struct(F.lit(path).alias("path"), value.alias("expected"))
    plain = [cell(f"{p}URI", at(f"{p}URI")) for p in PLAIN]
    inner = [cell(f"{r}.{m}URI", at(f"{r}.{m}URI")) for r in NESTED for m in MEMBERS]
    parts = [cell(f"{r}.hasPartURIs", F.to_json(F.try_variant_get(doc, f"$.{r}.hasPartURIs", "array<string>"))) for r in NESTED]
    return F.filter(F.array(*plain, *inner, *parts), lambda x: x["expected"].isNotNull())


def rerank_query(query: Column, prefix: str, instruction: str) -> Column:
    """A reranker's query in a chat template that begins with ``prefix``."""
    return F.format_string("%s<Instruct>: %s\n<Query>: %s\n", F.lit(prefix), F.lit(instruction), query)


def rerank_document(document: Column, suffix: str) -> Column:
    return F.format_string("<Document>: %s%s", document, F.lit(suffix))


def same_uri(a: Column, b: Column) -> Column:
    return F.coalesce(canonical_uri(a) == canonical_uri(b), F.lit(False))


def same_uri_list(a: Column, b: Column) -> Column:
    """Same length, order and entities; nulls equal nulls only."""
    pairs = F.zip_with(a, b, lambda x, y: canonical_uri(x).eqNullSafe(canonical_uri(y)))
    return F.coalesce((F.size(a) == F.size(b)) & F.forall(pairs, lambda ok: ok), F.lit(False))


def uri_scores(assertions: DataFrame, keys: list[str]) -> DataFrame:
    """Totals, accuracy and coverage by ``keys`` of (expected, predicted); both are 1 where nothing is asserted."""
    asserted = F.col("expected").isNotNull()
    given = asserted & F.col("predicted").isNotNull() & (F.col("predicted") != "")
    right = asserted & same_uri(F.col("expected"), F.col("predicted"))
    out = assertions.groupBy(*keys).agg(F.count_if(asserted).alias("total"), F.count_if(right).alias("correct"), F.count_if(given).alias("predicted"))
    share = lambda c: F.round(F.coalesce(F.try_divide(F.col(c), F.col("total")), F.lit(1.0)), 3)
    return out.withColumn("accuracy", share("correct")).withColumn("coverage", share("predicted"))
