import json

import pytest
from pyspark.sql import functions as F

from loomstone.functions import records, text
from loomstone.operators import linking, metrics
from loomstone.plans import summary
from loomstone.sources import scans
from loomstone.streaming import audit


def one(spark, col, **values):
    names = list(values) or ["none"]
    row = tuple(values.values()) or (0,)
    schema = ", ".join(f"{n} {'string' if v is None or isinstance(v, str) else 'int'}" for n, v in zip(names, row, strict=True))
    return spark.createDataFrame([row], schema).select(col.alias("x")).first().x


def test_text(spark):
    c = F.col("c")
    said = "Here:\n```json\n{\"a\": 1}\n```\nbye"
    assert one(spark, text.json_block(text.strip_fences(c)), c=said) == '{"a": 1}'
    assert one(spark, text.json_block(c), c="none") is None
    assert one(spark, text.noise_before(c), c='Well {"a":1} ok') == "Well"
    assert one(spark, text.noise_after(c), c='Well {"a":1} ok') == "ok"
    assert one(spark, text.canonical_target(c), c="hasMatrix: soil") == "soil"
    assert one(spark, text.canonical_target(c), c="hasmatrix: soil") == "hasmatrix: soil"
    assert one(spark, text.strip(c), c="\t a ") == "a"
    assert one(spark, text.is_blank(c), c=" ") and not one(spark, text.is_falsy(c), c=" ")
    assert one(spark, text.after_colon(c), c="limit: above 2 m") == "above 2 m"
    assert one(spark, text.contains_folded(c, F.lit("")), c="abc")
    assert one(spark, text.is_html(c), c=" <html>") and not one(spark, text.is_html(c), c="<HTML>")
    uris = ["http://www.wikidata.org/entity/Q42", "https://www.wikidata.org/wiki/Q42"]
    assert len({one(spark, text.canonical_uri(c), c=u) for u in uris}) == 1
    once = one(spark, text.canonical_uri(c), c="http://a.b/c/")
    assert once == "https://a.b/c" == one(spark, text.canonical_uri(c), c=once)
    assert one(spark, text.canonical_uri(c), c=None) is None


@pytest.mark.parametrize(
    ("record", "kind"),
    [
        ({}, "absent"),
        ({"hasMatrix": None}, "null"),
        ({"hasMatrix": ""}, "empty"),
        ({"hasMatrix": "soil"}, "string"),
        ({"hasMatrix": {"AsymmetricSystem": "s", "hasSource": "a", "hasTarget": "b"}}, "asym"),
        ({"hasMatrix": {"SymmetricSystem": "s", "hasPart": ["a"]}}, "sym"),
        ({"hasMatrix": {"label": "x"}}, "object"),
        ({"hasMatrix": ["a"]}, "list"),
        ({"hasMatrix": 3}, "scalar"),
    ],
)
def test_kinds(spark, record, kind):
    assert one(spark, records.kind_of(records.parsed(F.col("c")), "hasMatrix"), c=json.dumps(record)) == kind


def test_json(spark):
    equal = records.json_equal(F.col("a"), F.col("b"))
    assert one(spark, equal, a='{"x": 1, "y": [2]}', b='{"y":[2],"x":1.0}')
    assert one(spark, equal, a="oops", b=None) and not one(spark, equal, a='{"x":1}', b="oops")
    audit_of = one(spark, records.key_audit(F.col("c"), (*text.ROLES, "label")), c='{"label": "x", "other": 1, "hasProperty": ""}')
    assert audit_of.extra_keys == ["other"] and "hasMatrix" in audit_of.missing_keys and "hasProperty" not in audit_of.missing_keys
    filled = one(spark, records.with_defaults(records.parsed(F.col("c"))), c='{"hasConstraint": "no list", "hasProperty": null}')
    assert filled["hasConstraint"] == "[]" and filled["hasProperty"] == '""'
    leaves = one(spark, records.string_leaves(F.col("c")), c='{"a": {"b": "x"}, "c": "y"}')
    assert [(x.path, x.text) for x in leaves] == [("a.b", "x"), ("c", "y")]


def strings(value, path=""):
    if isinstance(value, dict):
        return [x for k, v in value.items() for x in strings(v, f"{path}.{k}" if path else k)]
    if isinstance(value, list):
        return [x for i, v in enumerate(value) for x in strings(v, f"{path}[{i}]")]
    return [(path, value)] if isinstance(value, str) else []


def test_string_leaves_of_lists_and_deep_records(spark):
    deep = "s"
    for i in range(12):
        deep = {"k": deep} if i % 2 else [1, deep]
    record = {"z": "last first", "hasConstraint": [{"label": "l", "on": "o"}, {"label": "m", "on": None}], "hasPart": ["p", ["q", 3, True]], "n": 4, "b": False, "deep": deep, "text": "[1]", "e": ""}
    cases = [json.dumps(record), "[\"a\", {\"b\": \"c\"}]", "\"root\"", "7", "no json", "", None, "{}"]
    rows = spark.createDataFrame(list(enumerate(cases)), "k int, c string").select("k", records.string_leaves(F.col("c")).alias("x")).collect()
    want = [strings(json.loads(c)) if c and c != "no json" else [] for c in cases]
    assert [[(x.path, x.text) for x in r.x] for r in sorted(rows)] == want


def test_string_leaves_fifty_deep(spark):
    deep = {"s": "in", "n": 1}
    for i in range(50):
        deep = {'a "b"': deep, "x": f"at {i}"} if i % 2 else [deep, f"[{i}", "{"]
    cases = [json.dumps(deep), '["' + "[" * 90 + '", {"k": "v"}]', '{"a": 1, "a": "twice"}', '["x"] y', json.dumps([{"k%d" % i: "v"} for i in range(300)])]
    rows = spark.createDataFrame(list(enumerate(cases)), "k int, c string").select("k", records.string_leaves(F.col("c")).alias("x"))
    assert "Python" not in rows._jdf.queryExecution().executedPlan().toString()
    want = [strings(json.loads(c)) if i not in (2, 3) else [] for i, c in enumerate(cases)]
    assert [[(x.path, x.text) for x in r.x] for r in sorted(rows.collect())] == want


def test_conformance_by_brute_force(spark):
    from difflib import SequenceMatcher

    from loomstone.plans.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    got = {r.row_id: (r.path, r.best, round(r.score, 6)) for r in QUERIES["q_conformance"](spark, sf).collect()}
    parts = spark.read.parquet(f"{sf}/part.parquet").collect()
    for r in parts:
        listed = r.p_partkey % 3 == 0
        path = "d.x.y.z.hasPart[1]" if listed else "a.label"
        ratio = SequenceMatcher(None, r.p_name.lower(), r.p_name.upper().lower()).ratio()
        assert got[r.p_partkey] == (path, r.p_name.upper(), round(ratio, 6))
    assert len(got) == len(parts)


def test_metrics(spark):
    flags = metrics.hallucinations(records.parsed(F.col("a")), records.parsed(F.col("b")))
    row = spark.createDataFrame([('{"hasProperty":"p","hasMatrix":" "}', '{"hasProperty":"q","hasMatrix":"m","hasConstraint":[]}')], "a string, b string").select(*flags).first()
    assert (row.hasProperty, row.hasMatrix, row.hasConstraint) == (0, 1, 0)
    tags = one(spark, metrics.locate(F.lit("w"), records.parsed(F.col("c"))), c='{"hasProperty":"w","hasObjectOfInterest":{"SymmetricSystem":"s","hasPart":["v","w"]}}')
    assert tags == ["hasProperty", "hasObjectOfInterest"]
    row = spark.createDataFrame([('{"hasProperty":"Depth","hasObjectOfInterest":{"label":"x"},"hasConstraint":[{"label":"zz","on":"x"}]}',)], "a string").select(*metrics.grounding(records.parsed(F.col("a")), F.lit("the depth of snow"))).first()
    assert tuple(row) == (1, 0, 1, 0)


def test_overlap_of_typed_values(spark):
    overlap = metrics.structural_overlap(F.col("a"), F.col("b"))
    assert one(spark, overlap, a='{"x":"[]","y":""}', b='{"x":"t","y":"  "}') == 1.0
    assert one(spark, overlap, a='{"x":[],"y":{},"z":0,"n":null}', b='{"x":"","y":"t","z":false}') == 0.5
    assert one(spark, overlap, a="{}", b="{}") is None and one(spark, overlap, a="oops", b=None) is None


def test_links(spark):
    rows = [("a", 0, "Q1", "x", 0.2), ("a", 1, "Q2", "a", 0.1), ("a", 2, "Q3", "y", 0.9), ("b", 0, "Q4", "z", 0.3), ("b", 1, "Q5", "z", 0.3)]
    c = spark.createDataFrame(rows, "term string, pos int, id string, label string, score double")
    got = {a: {r.term: r.id for r in linking.link(c, a, 0.5).collect()} for a in ("naive", "embedding", "cross-encoder", "ef", "none")}
    assert got == {"naive": {"a": "Q1", "b": "Q4"}, "embedding": {"a": "Q3", "b": "Q4"}, "cross-encoder": {"a": "Q3", "b": None}, "ef": {"a": "Q2", "b": "Q4"}, "none": {}}
    with pytest.raises(ValueError):
        linking.link(c, "other")
    empty = spark.createDataFrame([("k", None, None)], "k string, expected string, predicted string")
    assert (linking.uri_scores(empty, ["k"]).first().accuracy, linking.uri_scores(empty, ["k"]).first().coverage) == (1, 1)


def test_enrichment(spark):
    doc = {"hasProperty": "depth", "hasMatrix": {"SymmetricSystem": "s1", "hasPart": ["a", "", "b"]}, "hasObjectOfInterest": {"AsymmetricSystem": "s2", "hasSource": "snow"}}
    rows = spark.createDataFrame([(1, json.dumps(doc)), (2, "{}")], "k int, raw string").withColumn("doc", records.parsed(F.col("raw")))
    links = spark.createDataFrame([("depth", "Q1"), ("b", "Q2"), ("snow", "Q3")], "term string, id string")
    wiki = "https://www.wikidata.org/wiki/"
    got = {r.k: r.uris for r in linking.enriched(rows, links, "k").collect()}
    assert got == {1: {"hasPropertyURI": wiki + "Q1", "hasMatrix.hasPartURIs": f'[null,null,"{wiki}Q2"]', "hasObjectOfInterest.hasSourceURI": wiki + "Q3"}, 2: None}
    truth = {"hasPropertyURI": "u", "hasStatisticalModifierURI": "m", "hasMatrixURI": "", "hasMatrix": {"hasPartURIs": ["p", None], "hasTargetURI": "t"}}
    found = one(spark, linking.uri_assertions(records.parsed(F.col("c"))), c=json.dumps(truth))
    assert [(x.path, x.expected) for x in found] == [("hasPropertyURI", "u"), ("hasMatrix.hasTargetURI", "t"), ("hasMatrix.hasPartURIs", '["p",null]')]
    assert one(spark, linking.rerank_document(F.col("c"), "!"), c="d") == "<Document>: d!"


def test_turtle(spark, tmp_path):
    (tmp_path / "g.ttl").write_text('@prefix ex: <http://e/> . # c\nex:a a ex:T ; ex:p "x;y"@en , """long "q" text""" ; ex:q [ ex:r ex:b ] .\n<http://e/c> ex:p 5 .\n')
    got = {(r.s, r.p, r.o) for r in scans.turtle(spark, str(tmp_path)).collect()}
    assert ("http://e/a", "http://e/p", "x;y") in got and ("http://e/a", "http://e/p", 'long "q" text') in got
    assert ("http://e/c", "http://e/p", "5") in got and any(s.startswith("_:") and (p, o) == ("http://e/r", "http://e/b") for s, p, o in got) and len(got) == 6


def test_scans_and_stream(spark, tmp_path):
    (tmp_path / "b.json").write_text('{"label": "x"}')
    (tmp_path / "c.json").write_text("no json")
    assert [r.name for r in scans.json_files(spark, str(tmp_path), on_bad="skip").collect()] == ["b.json"]
    with pytest.raises(Exception, match="not JSON"):
        scans.json_files(spark, str(tmp_path)).collect()
    log = tmp_path / "logs"
    log.mkdir()
    (log / "a.log").write_text('{"model":"m","flag":true}\n\n{"model":"m","flag":false}\n==== end ====\n')
    batch = scans.json_lines(spark, str(log), "model string, flag boolean")
    assert summary.audit_counters(batch, ["flag"], []).first().asDict() == {"rows": 2, "flag": 1}
    stream = audit.running_counters(audit.stream_events(spark, str(log), "model string, flag boolean"), ["flag"])
    run = stream.writeStream.format("memory").queryName("audit").outputMode("complete").trigger(availableNow=True).start()
    run.awaitTermination()
    assert spark.table("audit").first().asDict() == {"model": "m", "rows": 2, "flag": 1}


def coerced_plainly(said):
    record = json.loads(said)
    missing = [k for k in text.ROLES if k not in record]
    extra = [k for k in record if k not in {"label", "comment", *text.ROLES}]
    record |= {k: [] if k == "hasConstraint" else "" for k in missing}
    prop = record["hasProperty"]
    if isinstance(prop, dict):
        record["hasProperty"] = prop.get("label", "")
    return record, missing, extra, prop if isinstance(prop, dict) else None


def test_coercion_of_whole_records(spark):
    cases = [
        {},
        {"hasProperty": {"z": 1, "label": "L", "a": {"y": 2, "b": 1}}, "label": "x", "odd \"key\"": [1, {"q": None}]},
        {"hasProperty": {"no": "label"}, "hasConstraint": "no list", "hasMatrix": {"SymmetricSystem": "s", "hasPart": ["b", "a"]}},
        {"hasProperty": {"AsymmetricSystem": "s", "label": "t"}, "comment": None, "n": 1.5, "f": False},
        {"hasProperty": None, "hasObjectOfInterest": "\u00e9\n\t\\"},
        {"hasProperty": ["a"], "hasContextObject": {}},
    ]
    said = [json.dumps(c, ensure_ascii=i % 2 == 0) for i, c in enumerate(cases)] + ["[1]", "none", None, ""]
    rows = spark.createDataFrame(list(enumerate(said)), "k int, c string").select("k", records.coerced(F.col("c")).alias("x")).orderBy("k").collect()
    for r, case in zip(rows, said, strict=True):
        if not case or case[0] != "{":
            assert r.x is None
            continue
        record, missing, extra, prop = coerced_plainly(case)
        assert list(json.loads(r.x.record).items()) == list(record.items())
        a = r.x.audit
        assert (a.missing_keys, a.extra_keys, a.coerced_property) == (missing, extra, prop is not None) and (a.orig_property and json.loads(a.orig_property)) == prop
