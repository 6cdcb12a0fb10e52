"""Declarative mapping documents (YAML) planned as DataFrame work.

A document names sources, and for each mapping a subject, its predicates and
objects, and references to other mappings under conditions of equality. The
plan has one scan and one explode for each source, whatever the number of
mappings on it, and one join for all conditioned references: children and
parents of every reference are exploded with the number of what they refer to,
reduced to distinct keys, and meet on that number and the keys. Until they are
distinct, triples have a number for what many have in common.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from loomstone.functions.records import unnest
from loomstone.operators.graphs import RDF_TYPE, XSD, numbered

RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"

_REF = re.compile(r"\$\(([^()]*)\)")
_NAMES = {"s": "s", "subject": "s", "subjects": "s", "po": "po", "predicateobjects": "po", "sources": "sources", "p": "p", "predicate": "p", "predicates": "p", "o": "o", "object": "o", "objects": "o"}


@dataclass(frozen=True)
class Object:
    """A value of a predicate: a template with its kind, or a reference to a mapping."""

    template: str | None = None
    kind: str = "literal"
    datatype: str | None = None
    lang: str | None = None
    mapping: str | None = None
    equal: tuple[tuple[str, str], ...] = ()  # (own template, template of the other mapping) pairs


@dataclass(frozen=True)
class Mapping:
    name: str
    sources: tuple[str, ...]
    subjects: tuple[str, ...]
    values: tuple[tuple[str, Object], ...]  # (predicate template, object)


def _list(x) -> list:
    return x if isinstance(x, list) else [] if x is None else [x]


def _keys(said: dict, allowed: set[str], where: str) -> dict:
    out = {}
    for key, value in said.items():
        name = _NAMES.get(key, key)
        if name not in allowed:
            raise ValueError(f"{where}: {key!r} is not understood")
        out[name] = value
    return out


class _Document:
    def __init__(self, said: dict):
        if unknown := set(said) - {"prefixes", "mappings", "sources", "base", "authors"}:
            raise ValueError(f"mapping document: {min(unknown)!r} is not understood")
        self.prefixes = {"rdf": RDF, "xsd": XSD} | (said.get("prefixes") or {})
        self.named = {name: self.source(s) for name, s in (said.get("sources") or {}).items()}

    def source(self, s) -> str:
        """The path of a source, without its format."""
        if isinstance(s, dict):
            s = s["access"]
        s = s[0] if isinstance(s, list) else s
        return self.named[s] if s in getattr(self, "named", {}) else str(s).rpartition("~")[0] or str(s)

    def name(self, said: str) -> str:
        """A full IRI for a prefixed name; anything else as it is."""
        prefix, colon, local = said.partition(":")
        return self.prefixes[prefix] + local if colon and prefix in self.prefixes and not local.startswith("//") else said

    def predicate(self, said: str) -> str:
        return RDF_TYPE if said == "a" else self.name(said.removesuffix("~iri"))

    def value(self, said, kind: str | None, typed: bool) -> Object:
        """A value with the name of its datatype, or of its language as ``en~lang``."""
        text, iri = str(said), typed
        if text.endswith("~iri"):
            text, iri = text.removesuffix("~iri"), True
        if kind and kind.endswith("~lang"):
            return Object(text, "literal", RDF + "langString", kind.removesuffix("~lang").lower())
        if iri:
            return Object(self.name(text), "iri")
        return Object(text, "literal", self.name(kind) if kind else XSD + "string")

    def object(self, said, typed: bool) -> Object:
        if not isinstance(said, dict):
            parts = _list(said)
            return self.value(parts[0], parts[1] if len(parts) > 1 else None, typed)
        if "mapping" in said:
            said = _keys(said, {"mapping", "condition"}, "object")
            return Object(mapping=said["mapping"], equal=tuple(self.equal(c) for c in _list(said.get("condition"))))
        said = _keys(said, {"value", "datatype", "language", "type"}, "object")
        kind = f"{said['language']}~lang" if "language" in said else said.get("datatype")
        return self.value(said["value"], kind, typed or said.get("type") == "iri")

    def equal(self, said: dict) -> tuple[str, str]:
        if said.get("function") not in ("equal", "idlab-fn:equal"):
            raise ValueError(f"condition: the function {said.get('function')!r} is not understood")
        sides = {}
        for i, p in enumerate(said["parameters"]):
            sides[p[2] if len(p) > 2 else "so"[i]] = str(p[1])
        if set(sides) != {"s", "o"}:
            raise ValueError("condition: equal takes one value of the subject (s) and one of the object (o)")
        return sides["s"], sides["o"]

    def values(self, items: list) -> Iterator[tuple[str, Object]]:
        for item in items:
            if isinstance(item, dict):
                said = _keys(item, {"p", "o"}, "predicates and objects")
                predicates, objects = _list(said["p"]), _list(said["o"])
                last = None
            else:
                predicates, objects = _list(item[0]), _list(item[1])
                last = item[2] if len(item) > 2 else None
            for p in map(self.predicate, predicates):
                for o in objects:
                    yield p, self.object([o, last] if last is not None else o, p == RDF_TYPE)

    def mapping(self, name: str, said: dict) -> Mapping:
        said = _keys(said, {"sources", "s", "po"}, name)
        subjects = tuple(self.name(str(s).removesuffix("~iri")) for s in _list(said["s"]))
        return Mapping(name, tuple(self.source(s) for s in _list(said["sources"])), subjects, tuple(self.values(said.get("po") or [])))


def read_mappings(document: str | dict) -> dict[str, Mapping]:
    """The mappings of a document, as YAML or as what YAML gives; parts that are not understood raise ``ValueError``."""
    if isinstance(document, str):
        import yaml  # only documents as text need it

        document = yaml.safe_load(document)
    read = _Document(document)
    found = {name: read.mapping(name, said) for name, said in document["mappings"].items()}
    for m in found.values():
        for _, o in m.values:
            if o.mapping is not None and o.mapping not in found:
                raise ValueError(f"{m.name}: no mapping {o.mapping!r}")
            if o.mapping is not None and not o.equal and set(found[o.mapping].sources) != set(m.sources):
                raise ValueError(f"{m.name}: a reference to {o.mapping!r}, which has another source, needs a condition")
    return found


def _text(template: str, encode: bool, numbers: frozenset[str] = frozenset()) -> Column:
    """A template's text; null where a cell it names is null or blank. Cells inside a longer IRI are percent-encoded, but for whole ``numbers``."""

    def cell(name: str) -> Column:
        said = F.col(f"`{name}`").cast("string")
        return said if name in numbers else F.nullif(said, F.lit(""))

    if whole := _REF.fullmatch(template):
        return cell(whole[1])
    parts = _REF.split(template)
    safe = lambda name: F.replace(F.url_encode(cell(name)), F.lit("+"), F.lit("%20")) if encode and name not in numbers else cell(name)
    return F.concat(*[safe(x) if i % 2 else F.lit(x) for i, x in enumerate(parts) if i % 2 or x]) if len(parts) > 1 else F.lit(template)


class _Items:
    """What each row of a source makes, over the texts of templates, each of which is worked out once for a row."""

    def __init__(self, rows: DataFrame):
        self.rows, self.names, self.items = rows, {}, []
        self.numbers = frozenset(f.name for f in rows.schema if isinstance(f.dataType, IntegralType))

    def text(self, template: str, encode: bool) -> Column:
        if not _REF.search(template):
            return F.lit(template)
        return F.col(self.names.setdefault((template, encode), f"text{len(self.names)}"))

    def put(self, known: list[Column], *columns: Column) -> None:
        """An item, but none where one of ``known`` is null."""
        self.items.append(F.when(reduce(lambda a, b: a & b, [c.isNotNull() for c in known]), F.struct(*columns)))

    def opened(self) -> DataFrame:
        texts = [_text(template, encode, self.numbers).alias(name) for (template, encode), name in self.names.items()]
        return unnest(self.rows.select(*texts), F.array(*self.items)).where("x is not null").select("x.*")


class _Forms:
    """What triples have in common (predicate, kind, datatype, language), by number; a predicate that cells make stands in the rows."""

    def __init__(self, constant: bool):
        self.constant, self.numbers = constant, {}

    def columns(self, p: str, predicate: Column, kind: str, datatype: str | None, lang: str | None) -> list[Column]:
        form = self.numbers.setdefault((p if self.constant else None, kind, datatype, lang), len(self.numbers))
        return [F.lit(form).alias("form")] + ([] if self.constant else [predicate.alias("p")])

    def told(self, rows: DataFrame, graph_id: str | None) -> DataFrame:
        text = lambda v: F.lit(v).cast("string")
        fields = ("p", "o_kind", "datatype", "lang")
        form = F.get(F.array(*[F.struct(*[text(v).alias(n) for n, v in zip(fields, f)]) for f in self.numbers]), F.col("form"))
        p = form["p"] if self.constant else F.col("p")
        return rows.select(text(graph_id).alias("graph_id"), "s", p.alias("p"), "o", *[form[n].alias(n) for n in fields[1:]])


def run_mappings(document: str | dict, sources: dict[str, DataFrame], graph_id: str | None = None, by_subject: bool = False) -> DataFrame:
    """(graph_id, s, p, o, o_kind, datatype, lang): the distinct triples that a mapping document makes of its sources.

    ``sources`` has a table for each path that the document names. Null and blank
    cells make no triple and meet no key; a reference without a condition points
    at the subject of the same row. A source without rows, and a mapping without
    predicates, make none. Cells are taken as their text. ``by_subject`` is for tables
    that are read by predicate or grouped by subject: all triples of a subject, few for
    each, are in one part, and those of a predicate side by side in it.
    """
    found = read_mappings(document)
    paths = sorted({s for m in found.values() for s in m.sources})
    groups: dict[tuple[str, tuple[str, ...]], int] = {}  # what references point at: a mapping by some of its cells
    for m in found.values():
        for _, o in m.values:
            if o.mapping is not None and o.equal:
                groups.setdefault((o.mapping, tuple(theirs for _, theirs in o.equal)), len(groups))
    forms = _Forms(not any(_REF.search(p) for m in found.values() for p, _ in m.values))
    plain, children, parents = [], [], []

    def triple(into: _Items, s: str, p: str, o: str, kind: str, datatype: str | None, lang: str | None) -> None:
        subject, predicate, value = into.text(s, True), into.text(p, True), into.text(o, kind == "iri")
        into.put([subject, predicate, value], *forms.columns(p, predicate, kind, datatype, lang), subject.alias("s"), value.alias("o"))

    for path in paths:
        own, child, parent = (_Items(sources[path]) for _ in range(3))
        for m in (m for m in found.values() if path in m.sources):
            for s in m.subjects:
                for p, o in m.values:
                    if o.mapping is None:
                        triple(own, s, p, o.template, o.kind, o.datatype, o.lang)
                    elif not o.equal:
                        for other in found[o.mapping].subjects:
                            triple(own, s, p, other, "iri", None, None)
                    else:
                        group = groups[o.mapping, tuple(theirs for _, theirs in o.equal)]
                        subject, predicate, keys = child.text(s, True), child.text(p, True), [child.text(mine, False) for mine, _ in o.equal]
                        child.put([subject, predicate, *keys], F.lit(group).alias("group"), F.array(*keys).alias("keys"), *forms.columns(p, predicate, "iri", None, None), subject.alias("s"))
                for (name, theirs), group in groups.items():
                    if name == m.name:
                        node, keys = parent.text(s, True), [parent.text(t, False) for t in theirs]
                        parent.put([node, *keys], F.lit(group).alias("group"), F.array(*keys).alias("keys"), node.alias("o"))
        for items, into in ((own, plain), (child, children), (parent, parents)):
            if items.items:
                into.append(items.opened())
    if children and parents:
        on = ["group", "keys"]
        union = lambda parts: numbered(reduce(DataFrame.unionByName, parts).distinct(), on)
        plain.append(union(children).join(union(parents), ["number", *on]).drop("number", *on))
    if not plain:
        raise ValueError("a mapping document without triples")
    rows = reduce(DataFrame.unionByName, plain)
    if by_subject:
        return forms.told(rows.repartition("s").distinct().sortWithinPartitions("form"), graph_id)
    return forms.told(rows.distinct(), graph_id)


def mapped_folder(spark: SparkSession, document: str | dict, base: str, graph_id: str | None = None) -> DataFrame:
    """The triples of a document whose sources are CSV files with headers below ``base``."""
    paths = {s for m in read_mappings(document).values() for s in m.sources}
    read = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    return run_mappings(document, {p: read.csv(f"{base.rstrip('/')}/{p}") for p in paths}, graph_id)
