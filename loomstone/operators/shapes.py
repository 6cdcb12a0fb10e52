"""Shapes documents (SHACL) compiled into a plan over triples.

A document of shapes is read as triples and becomes one grouped pass: every used
path of every node is an edge; tests of single values are columns of the edge;
counts, and counts of values that fail a test, are partial sums by node; whether
a node conforms is an expression over those sums. Values that fail give a row
each before the grouping, so no node gathers its values. A shape that a value
must conform to itself is first evaluated for all nodes in the same way and
joined to the edges.

Understood: targets by class, by subject and by object of a predicate; paths that
are a predicate or an inverse one; minCount, maxCount, hasValue, class, datatype,
nodeKind, minLength, maxLength, pattern with flags, in, minInclusive,
maxInclusive, minExclusive, maxExclusive, node, property, closed with
ignoredProperties, and, or, xone and not, nested to any depth. Anything else in
the SHACL namespace raises ``ValueError``. Classes are the stated ones; no
subclass is inferred.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstone.functions.records import unnest
from loomstone.operators.graphs import RDF_TYPE, XSD, numbered

SH = "http://www.w3.org/ns/shacl#"
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
MOST_TRIPLES = 100_000  # of a shapes document, which the driver reads

_VALUE_RULES = ("class", "datatype", "nodeKind", "minLength", "maxLength", "pattern", "in", "minInclusive", "maxInclusive", "minExclusive", "maxExclusive")
_LOGIC = ("and", "or", "xone", "not", "node")
_KNOWN = {*_VALUE_RULES, *_LOGIC, "path", "property", "minCount", "maxCount", "hasValue", "closed", "ignoredProperties", "flags", "message", "severity", "name", "description", "order", "group", "deactivated", "targetClass", "targetSubjectsOf", "targetObjectsOf"}
_LEXICAL = {"integer": r"^[+-]?[0-9]+$", "decimal": r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)$", "boolean": "^(true|false|1|0)$", "date": r"^-?[0-9]{4,}-[0-9]{2}-[0-9]{2}(Z|[+-][0-9]{2}:[0-9]{2})?$"}


@dataclass
class Shape:
    """One node or property shape; ``path`` is a predicate, an inverse one as ``^predicate``, or None."""

    name: str
    path: str | None
    params: dict[str, list[str]]
    properties: list[Shape] = field(default_factory=list)
    logic: list[tuple[str, list[Shape]]] = field(default_factory=list)
    message: str | None = None

    def one(self, rule: str) -> str | None:
        values = self.params.get(rule, [])
        if len(values) > 1:
            raise ValueError(f"{self.name}: sh:{rule} stands {len(values)} times")
        return values[0] if values else None


def read_shapes(shapes: DataFrame) -> list[Shape]:
    """The node shapes with a target, from the triples (s, p, o, ...) of a shapes document."""
    rows = shapes.select("s", "p", "o").limit(MOST_TRIPLES + 1).collect()
    if len(rows) > MOST_TRIPLES:
        raise ValueError(f"a shapes document of more than {MOST_TRIPLES} triples")
    facts: dict[str, dict[str, list[str]]] = {}
    for s, p, o in rows:
        facts.setdefault(s, {}).setdefault(p, []).append(o)

    def items(node: str) -> list[str]:
        out = []
        while node != RDF + "nil":
            out.append(facts[node][RDF + "first"][0])
            node = facts[node][RDF + "rest"][0]
        return out

    def shape(node: str, above: tuple[str, ...] = ()) -> Shape:
        if node in above:
            raise ValueError(f"{node}: a shape inside itself")
        said = {p.removeprefix(SH): vs for p, vs in facts.get(node, {}).items() if p.startswith(SH)}
        if unknown := set(said) - _KNOWN:
            raise ValueError(f"{node}: sh:{min(unknown)} is not understood")
        inner = lambda n: shape(n, (*above, node))
        path = None
        if "path" in said:
            path = said["path"][0]
            if inverse := facts.get(path, {}).get(SH + "inversePath"):
                path = f"^{inverse[0]}"
            elif path.startswith("_:"):
                raise ValueError(f"{node}: only predicates and inverse predicates are understood as paths")
        logic = [(rule, [inner(v)] if rule in ("not", "node") else [inner(x) for x in items(v)]) for rule in _LOGIC for v in said.get(rule, [])]
        params = {rule: [x for v in values for x in (items(v) if rule in ("in", "ignoredProperties") else [v])] for rule, values in said.items() if rule not in _LOGIC}
        return Shape(node, path, params, [inner(v) for v in said.get("property", [])], logic, " ".join(sorted(said.get("message", []))) or None)

    targets = ("targetClass", "targetSubjectsOf", "targetObjectsOf")
    found = sorted({s for s, ps in facts.items() if any(SH + t in ps for t in targets)})
    return [x for x in map(shape, found) if x.params.get("deactivated") != ["true"]]


@dataclass
class _Node:
    """A value or a focus node as columns."""

    value: Column
    kind: Column
    datatype: Column
    is_a: Callable[[str], Column]
    conforms: Callable[[Shape], Column]  # to a shape that looks at the node's own edges


def _kind_of(node: Column) -> Column:
    return F.when(node.startswith("_:"), "blank").otherwise("iri")


def _all(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def _tests(shape: Shape, x: _Node) -> list[tuple[str, Column]]:
    """(rule, whether it holds) of the constraints on a node by itself."""
    literal, blank = x.kind == "literal", x.kind == "blank"
    number = x.value.try_cast("double")
    bound = lambda rule, holds: [(rule, literal & F.coalesce(holds(float(v)), F.lit(False))) for v in shape.params.get(rule, [])]
    kinds = {"IRI": x.kind == "iri", "BlankNode": blank, "Literal": literal, "BlankNodeOrIRI": ~literal, "BlankNodeOrLiteral": x.kind != "iri", "IRIOrLiteral": ~blank}

    def of_type(datatype: str) -> Column:
        lexical = _LEXICAL.get(datatype.removeprefix(XSD)) if datatype.startswith(XSD) else None
        return literal & (x.datatype == datatype) & (x.value.rlike(lexical) if lexical else F.lit(True))

    flags = "".join(shape.params.get("flags", []))
    out = [("class", ~literal & x.is_a(v)) for v in shape.params.get("class", [])]
    out += [("datatype", of_type(v)) for v in shape.params.get("datatype", [])]
    out += [("nodeKind", kinds[v.removeprefix(SH)]) for v in shape.params.get("nodeKind", [])]
    out += [("minLength", ~blank & (F.length(x.value) >= int(v))) for v in shape.params.get("minLength", [])]
    out += [("maxLength", ~blank & (F.length(x.value) <= int(v))) for v in shape.params.get("maxLength", [])]
    out += [("pattern", ~blank & x.value.rlike(f"(?{flags}){v}" if flags else v)) for v in shape.params.get("pattern", [])]
    out += [("in", x.value.isin(shape.params["in"]))] if "in" in shape.params else []
    out += [("hasValue", x.value == v) for v in shape.params.get("hasValue", [])] if shape.path is None else []
    out += bound("minInclusive", lambda v: number >= v) + bound("maxInclusive", lambda v: number <= v) + bound("minExclusive", lambda v: number > v) + bound("maxExclusive", lambda v: number < v)
    return out + [(rule, _combine(rule, [_value_conforms(s, x) for s in members])) for rule, members in shape.logic]


def _combine(rule: str, each: list[Column]) -> Column:
    if rule in ("and", "node"):
        return _all(each)
    if rule == "or":
        return reduce(lambda a, b: a | b, each, F.lit(False))
    if rule == "not":
        return ~each[0]
    return reduce(lambda a, b: a + b, [c.cast("int") for c in each], F.lit(0)) == 1


def _looks_at_edges(shape: Shape) -> bool:
    return shape.path is not None or bool(shape.properties) or shape.one("closed") == "true"


def _value_conforms(shape: Shape, x: _Node) -> Column:
    if _looks_at_edges(shape):
        return x.conforms(shape)
    return _all([holds for _, holds in _tests(shape, x)])


def _inside(shape: Shape) -> list[Shape]:
    """The shapes that values of a property shape, or a node itself, have to be evaluated against through their own edges."""
    out = list(shape.properties) if shape.path is not None else []
    for _, members in shape.logic:
        for s in members:
            out += [s] if _looks_at_edges(s) else _inside(s)
    return out


def _classes(shape: Shape) -> set[str]:
    """The classes that a value's own tests ask for."""
    return set(shape.params.get("class", [])).union(*(_classes(s) for _, members in shape.logic for s in members if not _looks_at_edges(s)))


def _targets(shape: Shape) -> list[tuple[str, str | None]]:
    """(path, value) of the edges that make a node one the shape is for; None stands for any value."""
    said = lambda rule: shape.params.get(rule, [])
    return [(RDF_TYPE, c) for c in said("targetClass")] + [(p, None) for p in said("targetSubjectsOf")] + [(f"^{p}", None) for p in said("targetObjectsOf")]


class _Plan:
    """The edges, sums and conformity of one set of shapes that are evaluated on the same nodes."""

    def __init__(self, triples: DataFrame, shapes: list[Shape], repeats: bool):
        self.triples, self.shapes, self.repeats = triples, shapes, repeats
        self.names: dict[tuple, str] = {}
        self.sums: dict[str, Column] = {}  # partial sums over a node's edges, by name
        self.paths: set[str | None] = set()  # that the sums look at; None: all predicates
        self.deep = False  # whether the sums ask for classes or flags of values
        local = [s for top in shapes for s in self._walk(top) if s.path is not None]
        self.classes = sorted(set().union(*map(_classes, local)))
        self.inner = [inner for s in local for inner in _inside(s)]
        self.flags = {id(shape): f"flag{i}" for i, shape in enumerate(self.inner)}  # columns that say whether a value conforms to an inner shape
        self.known = {s.path for s in local if _classes(s) or _inside(s)}  # paths whose values have to be looked up

    def _walk(self, shape: Shape):
        """The shape and those evaluated on the same focus node."""
        yield shape
        if shape.path is None:
            for child in [*shape.properties, *(s for _, members in shape.logic for s in members)]:
                yield from self._walk(child)

    def edges(self, paths: set[str | None], repeats: bool = False) -> DataFrame:
        """(graph_id, focus, path, value, kind, datatype) on some paths, None being all predicates; with ``repeats`` where repeated ones do no harm."""
        t = self.triples
        datatype = F.coalesce("datatype", F.lit(XSD + "string")) if "datatype" in t.columns else F.lit(XSD + "string")
        ahead = [p for p in sorted(paths - {None}) if p[0] != "^"]
        back = [p[1:] for p in sorted(paths - {None}) if p[0] == "^"]
        parts = []
        if ahead or None in paths:
            rows = t if None in paths else t.where(F.col("p").isin(ahead))
            parts.append(rows.select("graph_id", F.col("s").alias("focus"), F.col("p").alias("path"), F.col("o").alias("value"), F.col("o_kind").alias("kind"), datatype.alias("datatype")))
        if back:
            rows = t.where(F.col("p").isin(back) & (F.col("o_kind") != "literal"))
            parts.append(rows.select("graph_id", F.col("o").alias("focus"), F.concat(F.lit("^"), F.col("p")).alias("path"), F.col("s").alias("value"), _kind_of(F.col("s")).alias("kind"), F.lit(None).cast("string").alias("datatype")))
        rows = reduce(DataFrame.unionByName, parts)
        return rows if repeats or not self.repeats else rows.distinct()

    def looked_up(self, paths: set[str | None]) -> DataFrame:
        """The distinct edges on some paths with classes and flags of their values. Only values on paths that ask for them are looked up, no literals."""
        every, asked = None in paths, paths & self.known
        if not self.known or not (every or asked):
            return self.edges(paths)
        wanted = F.coalesce(F.col("path").isin(sorted(self.known)), F.lit(False)) & ~F.coalesce(F.col("kind") == "literal", F.lit(False))
        no = F.lit(None).cast("boolean")
        classes = {f"class{i}": c for i, c in enumerate(self.classes)}
        parts = []
        if classes:
            typed = self.triples.where((F.col("p") == RDF_TYPE) & F.col("o").isin(self.classes))
            parts.append(typed.select("graph_id", F.col("s").alias("value"), *[(F.col("o") == c).alias(n) for n, c in classes.items()], *[no.alias(f) for f in self.flags.values()]))
        for shape in self.inner:
            own = _Plan(self.triples, [shape], self.repeats)
            holds = own.conforms(shape)
            flags = [(holds if f == self.flags[id(shape)] else no).alias(f) for f in self.flags.values()]
            if own.sums:  # else it does not depend on edges
                parts.append(own.facts().select("graph_id", F.col("focus").alias("value"), *[no.alias(n) for n in classes], *flags))
        names = [*classes, *self.flags.values()]
        found = self.edges(paths if every else asked).where(wanted)
        if parts:
            on = ["graph_id", "value"]
            about = numbered(reduce(DataFrame.unionByName, parts), on).groupBy("number", *on).agg(*[F.max(n).alias(n) for n in names])
            found = numbered(found, on).join(about, ["number", *on], "left").drop("number")
        else:
            found = found.select("*", *[no.alias(n) for n in names])
        if others := paths - {p for p in self.known if p[0] == "^"}:  # what an inverse path leads to is no literal
            found = found.unionByName(self.edges(others).where(~wanted).select("*", *[no.alias(n) for n in names]))
        told = {f: F.coalesce(f, _of_nothing(shape)) for shape in self.inner for f in [self.flags[id(shape)]]}
        return found.withColumns({f: F.when(F.col("path").isin(sorted(self.known)), c) for f, c in told.items()})

    def value(self) -> _Node:
        """The value of an edge."""
        flag = lambda shape: F.col(self.flags[id(shape)])
        return _Node(F.col("value"), F.col("kind"), F.coalesce("datatype", F.lit("")), lambda c: F.coalesce(F.col(f"class{self.classes.index(c)}"), F.lit(False)), flag)

    def focus(self) -> _Node:
        """The node itself, over its sums."""
        is_a = lambda c: self._has(RDF_TYPE, c) > 0
        return _Node(F.col("focus"), _kind_of(F.col("focus")), F.lit(""), is_a, self.conforms)

    def _sum(self, key: tuple, path: str | None, test: Column) -> Column:
        """The number of a node's edges on a path that pass a test, as a column of ``facts``; equal keys stand for equal tests."""
        self.paths.add(path)
        name = self.names.setdefault(key, f"sum{len(self.names)}")
        self.sums[name] = F.count_if(F.coalesce(test, F.lit(False))).alias(name)
        return F.col(name)

    def _has(self, path: str, value: str | None = None) -> Column:
        """The number of values a node has on a path, or of those equal to one."""
        on = F.col("path") == path
        return self._sum((path, value), path, on if value is None else on & (F.col("value") == value))

    def count_rules(self, shape: Shape) -> list[tuple[str, Column, Column]]:
        """(rule, whether it holds, the number found) of a property shape's constraints on all its values."""
        n = lambda: self._has(shape.path)
        out = [("minCount", n() >= int(v), n()) for v in shape.params.get("minCount", [])] + [("maxCount", n() <= int(v), n()) for v in shape.params.get("maxCount", [])]
        return out + [("hasValue", self._has(shape.path, v) > 0, self._has(shape.path, v)) for v in shape.params.get("hasValue", [])]

    def conforms(self, shape: Shape) -> Column:
        """Whether a node conforms, over its sums."""
        if shape.path is not None:
            self.deep |= bool(_classes(shape) or _inside(shape))
            bad = [self._sum((id(shape), i), shape.path, (F.col("path") == shape.path) & ~F.coalesce(holds, F.lit(False))) == 0 for i, (_, holds) in enumerate(self.value_rules(shape))]
            return _all([holds for _, holds, _ in self.count_rules(shape)] + bad)
        return _all([holds for _, _, holds in self.node_rules(shape)] + [self.conforms(p) for p in shape.properties])

    def value_rules(self, shape: Shape) -> list[tuple[str, Column]]:
        """(rule, whether an edge's value passes) of a property shape."""
        return _tests(shape, self.value()) + [("property", self.value().conforms(p)) for p in shape.properties]

    def node_rules(self, shape: Shape) -> list[tuple[str, Column, Column]]:
        """(rule, offending value, whether it holds) of a node shape's constraints on the node itself."""
        out = [(rule, F.col("focus"), holds) for rule, holds in _tests(shape, self.focus())]
        if shape.one("closed") == "true":
            out.append(("closed", F.col("focus"), self._sum((id(shape), "stray"), None, self.stray(shape)) == 0))
        return out

    def stray(self, shape: Shape) -> Column:
        """Whether an edge has a predicate that a closed shape does not name."""
        allowed = [p.path for p in shape.properties if p.path and p.path[0] != "^"] + shape.params.get("ignoredProperties", [])
        return ~F.col("path").startswith("^") & ~F.col("path").isin(allowed)

    def target(self, shape: Shape) -> Column:
        """Whether a node is one the shape is for."""
        return reduce(lambda a, b: a | b, [self._has(path, value) > 0 for path, value in _targets(shape)])

    def facts(self) -> DataFrame:
        """One row per (graph_id, focus) that has edges on the paths of the sums asked for so far, with these sums."""
        edges = self.looked_up(self.paths) if self.deep else self.edges(self.paths)
        return edges.groupBy("graph_id", "focus").agg(*self.sums.values())


def _of_nothing(shape: Shape) -> Column:
    """Whether a node without any edge of its own conforms; it has no class and no values."""
    if shape.path is not None:
        return F.lit(all(int(v) == 0 for v in shape.params.get("minCount", [])) and "hasValue" not in shape.params)
    nothing = lambda _: F.lit(False)
    x = _Node(F.col("value"), F.col("kind"), F.coalesce("datatype", F.lit("")), nothing, _of_nothing)
    return _all([holds for _, holds in _tests(shape, x)] + [_of_nothing(p) for p in shape.properties])


def check(triples: DataFrame, shapes: DataFrame, repeats: bool = True) -> DataFrame:
    """(graph_id, shape, focus, path, rule, value, message) of everything in ``triples`` that breaks a shape.

    ``triples`` has graph_id, s, p, o, o_kind and may have datatype (missing or
    null: xsd:string); ``shapes`` are the triples of a shapes document, of at most
    ``MOST_TRIPLES``. Values that fail a rule give a row each; counts give one with
    the number found; rules on a node give one with the node; a closed shape gives
    one for each value of a stray predicate. Repeated triples count once; whoever knows that
    there are none, languages left aside, says so by ``repeats``. Graphs are checked
    apart. Documents without targets, and tables without triples, give no rows.
    """
    tops = read_shapes(shapes)
    schema = "graph_id string, shape string, focus string, path string, rule string, value string, message string"
    if not tops:
        return triples.sparkSession.createDataFrame([], schema)
    plan = _Plan(triples, tops, repeats)

    def told(shape: Shape, path: str | Column | None, rule: str, value: Column, message: str | None) -> Column:
        text = lambda v: F.lit(v).cast("string")
        return F.struct(F.lit(shape.name).alias("shape"), (path if isinstance(path, Column) else text(path)).alias("path"), F.lit(rule).alias("rule"), value.cast("string").alias("value"), text(message).alias("message"))

    def some(rows: DataFrame, cases: list[tuple[Column, Column]]) -> DataFrame:
        """A row for each case that is true, of the rows that have one."""
        hit = rows.where(reduce(lambda a, b: a | b, [holds for holds, _ in cases]))
        return unnest(hit, F.array(*[F.when(holds, said) for holds, said in cases]), "graph_id", "focus", name="r").where("r is not null")

    breaks = lambda holds: ~F.coalesce(holds, F.lit(False))
    by_edge, by_node, paths = [], [], set()
    for top in tops:
        for p in top.properties:
            rules = plan.value_rules(p)
            by_edge += [((F.col("path") == p.path) & breaks(holds), told(top, p.path, rule, F.col("value"), p.message)) for rule, holds in rules]
            paths |= {p.path} if rules else set()
        if top.one("closed") == "true":
            by_edge.append((F.coalesce(plan.stray(top), F.lit(True)), told(top, F.col("path"), "closed", F.col("value"), top.message)))
            paths.add(None)
    for top in tops:
        broken = [(holds, told(top, p.path, rule, found, p.message)) for p in top.properties for rule, holds, found in plan.count_rules(p)]
        broken += [(holds, told(top, None, rule, value, top.message or " ".join(sorted({s.message for r, members in top.logic if r == rule for s in members if s.message})) or None)) for rule, value, holds in plan.node_rules(top) if rule != "closed"]
        by_node += [(plan.target(top) & breaks(holds), row) for holds, row in broken]
    parts = []
    if by_node:
        parts.append(some(plan.facts(), by_node).select("graph_id", "focus", "r.*"))
    if by_edge:
        failing = some(plan.looked_up(paths), by_edge).select("graph_id", "focus", "r.*")
        aims = [(path, value, top) for top in tops for path, value in _targets(top)]
        ends = [((F.col("path") == path) & (F.lit(True) if value is None else F.col("value") == value), F.lit(top.name)) for path, value, top in aims]
        aimed = some(plan.edges({path for path, _, _ in aims}, repeats=True), ends).select("graph_id", "focus", F.col("r").alias("shape"))
        on = ["graph_id", "focus", "shape"]
        parts.append(numbered(failing, on).join(numbered(aimed, on), ["number", *on], "left_semi"))
    columns = [c.split()[0] for c in schema.split(", ")]
    return reduce(DataFrame.unionByName, [p.select(columns) for p in parts]) if parts else triples.sparkSession.createDataFrame([], schema)
