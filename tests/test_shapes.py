"""The compiler of shapes documents: each constraint, nesting, targets, counts."""

import pytest

from loomstone.operators import shapes
from loomstone.sources.turtle import turtle_frame

HEAD = "@prefix sh: <http://www.w3.org/ns/shacl#> . @prefix xsd: <http://www.w3.org/2001/XMLSchema#> . @prefix e: <http://e/> .\n"
DATA = HEAD + """
e:a a e:T ; e:p "x", "long text" ; e:n 5 ; e:to e:b .
e:b a e:T, e:U ; e:n 12, "no number" ; e:to e:c, _:k , "text" .
e:c a e:U ; e:d "2024-01-02"^^xsd:date, "soon"^^xsd:date, "2024-01-02" ; e:say "hi"@en .
_:k a e:T ; e:p "x" ; e:q e:a .
e:lone a e:V .
"""


def broken(spark, doc, data=DATA, graph="g"):
    found = shapes.check(turtle_frame(spark, data, graph), turtle_frame(spark, HEAD + doc))
    assert found.columns == ["graph_id", "shape", "focus", "path", "rule", "value", "message"]
    short = lambda x: x and x.replace("http://e/", "")
    return sorted((short(r.focus), short(r.path), r.rule, short(r.value)) for r in found.collect())


def on(path, rule):
    return f"e:S sh:targetClass e:T ; sh:property [ sh:path {path} ; {rule} ] ."


CASES = {
    "min": (on("e:p", "sh:minCount 1"), [("b", "p", "minCount", "0")]),
    "max": (on("e:p", "sh:maxCount 1"), [("a", "p", "maxCount", "2")]),
    "has": (on("e:p", 'sh:hasValue "x"'), [("b", "p", "hasValue", "0")]),
    "inverse": (on("[ sh:inversePath e:to ]", "sh:minCount 1"), [("a", "^to", "minCount", "0")]),
    "class": (on("e:to", "sh:class e:U"), [("b", "to", "class", "_:k"), ("b", "to", "class", "text")]),
    "kind": (on("e:to", "sh:nodeKind sh:IRI"), [("b", "to", "nodeKind", "_:k"), ("b", "to", "nodeKind", "text")]),
    "blank or iri": (on("e:to", "sh:nodeKind sh:BlankNodeOrIRI"), [("b", "to", "nodeKind", "text")]),
    "lengths": (on("e:p", "sh:minLength 2 ; sh:maxLength 5"), [("_:k", "p", "minLength", "x"), ("a", "p", "maxLength", "long text"), ("a", "p", "minLength", "x")]),
    "pattern": (on("e:p", 'sh:pattern "^LONG" ; sh:flags "i"'), [("_:k", "p", "pattern", "x"), ("a", "p", "pattern", "x")]),
    "in": (on("e:n", "sh:in ( 5 6 )"), [("b", "n", "in", "12"), ("b", "n", "in", "no number")]),
    "numbers": (on("e:n", "sh:minInclusive 5 ; sh:maxExclusive 12"), [("b", "n", "maxExclusive", "12"), ("b", "n", "maxExclusive", "no number"), ("b", "n", "minInclusive", "no number")]),
    "datatype": ("e:S sh:targetClass e:U ; sh:property [ sh:path e:d ; sh:datatype xsd:date ], [ sh:path e:say ; sh:datatype xsd:string ] .", [("c", "d", "datatype", "2024-01-02"), ("c", "d", "datatype", "soon"), ("c", "say", "datatype", "hi")]),
    "subjects": ("e:S sh:targetSubjectsOf e:q ; sh:property [ sh:path e:n ; sh:minCount 1 ] .", [("_:k", "n", "minCount", "0")]),
    "objects": ("e:S sh:targetObjectsOf e:q ; sh:property [ sh:path e:n ; sh:minCount 2 ] .", [("a", "n", "minCount", "1")]),
    "closed": ("e:S sh:targetClass e:T ; sh:closed true ; sh:ignoredProperties ( <http://www.w3.org/1999/02/22-rdf-syntax-ns#type> ) ; sh:property [ sh:path e:p ] , [ sh:path e:n ] .", [("_:k", "q", "closed", "a"), ("a", "to", "closed", "b"), ("b", "to", "closed", "_:k"), ("b", "to", "closed", "c"), ("b", "to", "closed", "text")]),
    "or of values": (on("e:to", "sh:or ( [ sh:class e:U ] [ sh:nodeKind sh:Literal ] )"), [("b", "to", "or", "_:k")]),
    "not": (on("e:to", "sh:not [ sh:class e:U ]"), [("a", "to", "not", "b"), ("b", "to", "not", "c")]),
    "xone": (on("e:to", "sh:xone ( [ sh:class e:T ] [ sh:class e:U ] )"), [("a", "to", "xone", "b"), ("b", "to", "xone", "text")]),
    "or of nodes": ("e:S sh:targetClass e:T, e:V ; sh:or ( [ sh:path e:p ; sh:minCount 1 ] [ sh:path e:n ; sh:maxCount 1 ; sh:minCount 1 ] ) .", [("b", None, "or", "b"), ("lone", None, "or", "lone")]),
    "nested": ("e:S sh:targetClass e:T ; sh:and ( [ sh:or ( [ sh:path e:p ; sh:minCount 1 ] [ sh:and ( [ sh:path e:n ; sh:minCount 2 ] [ sh:not [ sh:class e:U ] ] ) ] ) ] [ sh:or ( [ sh:path e:q ; sh:minCount 1 ] [ sh:nodeKind sh:IRI ] ) ] ) .", [("b", None, "and", "b")]),
    "node of values": (on("e:to", "sh:node [ sh:property [ sh:path e:n ; sh:minCount 1 ] ]"), [("b", "to", "node", "_:k"), ("b", "to", "node", "c"), ("b", "to", "node", "text")]),
    "deep": (on("e:q", "sh:node [ sh:property [ sh:path e:to ; sh:or ( [ sh:property [ sh:path e:n ; sh:maxCount 1 ; sh:nodeKind sh:Literal ] ] [ sh:class e:W ] ) ] ]"), [("_:k", "q", "node", "a")]),
    "property below a path": (on("e:q", "sh:property [ sh:path e:p ; sh:maxCount 1 ]"), [("_:k", "q", "property", "a")]),
    "one node": ('e:S sh:targetClass e:V ; sh:hasValue e:other ; sh:pattern "lone$" .', [("lone", None, "hasValue", "lone")]),
    "off": ("e:S sh:targetClass e:T ; sh:deactivated true ; sh:property [ sh:path e:p ; sh:minCount 9 ] .", []),
    "no target": ("e:S a sh:NodeShape ; sh:property [ sh:path e:p ; sh:minCount 9 ] .", []),
}


@pytest.mark.parametrize("name", CASES)
def test_constraint(spark, name):
    doc, want = CASES[name]
    assert broken(spark, doc) == sorted(want, key=lambda r: r)


def test_message_graphs_and_repeats(spark):
    doc = HEAD + 'e:S sh:targetClass e:T ; sh:property [ sh:path e:p ; sh:maxCount 1 ; sh:message "one at most" ] .'
    one = turtle_frame(spark, "@prefix e: <http://e/> . e:a a e:T ; e:p 1 .", "g1")
    two = turtle_frame(spark, "@prefix e: <http://e/> . e:a a e:T ; e:p 2, 3 .", "g2")
    rows = shapes.check(one.union(one).union(two).drop("datatype", "lang"), turtle_frame(spark, doc)).collect()
    assert [(r.graph_id, r.value, r.message) for r in rows] == [("g2", "2", "one at most")]
    assert shapes.check(one.where("false"), turtle_frame(spark, doc)).count() == 0


@pytest.mark.parametrize("bad", ["sh:property [ sh:path ( e:p e:q ) ]", "sh:lessThan e:p", "sh:property [ sh:path e:p ; sh:uniqueLang true ]", "sh:property [ sh:path [ sh:zeroOrMorePath e:p ] ]"])
def test_unknown_parts_fail_loudly(spark, bad):
    with pytest.raises(ValueError, match="understood"):
        broken(spark, f"e:S sh:targetClass e:T ; {bad} .")


@pytest.mark.parametrize("name", ["class", "closed", "deep", "node of values", "nested", "or of values"])
def test_triples_known_to_be_distinct_give_the_same(spark, name):
    data, doc = turtle_frame(spark, DATA, "g").distinct(), turtle_frame(spark, HEAD + CASES[name][0])
    assert sorted(map(str, shapes.check(data, doc, repeats=False).collect())) == sorted(map(str, shapes.check(data, doc).collect())) != []


def test_an_inner_shape_without_rules_holds(spark):
    inner = "e:S sh:targetClass e:T ; sh:property [ sh:path e:to ; sh:node [ sh:property [ sh:path e:p ] ] ; sh:property [ sh:path e:n ] ; {rule} ] ."
    assert broken(spark, inner.format(rule="")) == []
    assert broken(spark, inner.format(rule="sh:class e:U")) == broken(spark, CASES["class"][0])
