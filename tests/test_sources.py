"""Scans, sinks and the Turtle reader."""

import json

import pytest
from pyspark.sql import functions as F

from loomstone.operators import graphs
from loomstone.sources import scans

RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"


def test_turtle_forms():
    doc = r"""@prefix ex: <http://e/> . @base <http://b/x/> . # note
ex:a ex:p ( ex:b 'it' [ ex:q 1.5 ; ex:r "qé\n"@en , '''long 'x' '''^^ex:t ] ) ; a ex:C .
_:b1 ex:p <rel>, <#f>, true . [] ex:p () . [ ex:only ex:me ] . ex:z ex:p _:b1 ; .
PREFIX f: <http://f/>
BASE <http://c/>
f:x.y f:p -3, <d> ."""
    triples = scans.turtle_triples(doc)
    by = {}
    for s, p, o, kind in triples:
        by.setdefault((s, p), []).append((o, kind))
    node, items = by["http://e/a", "http://e/p"][0][0], []
    while node != RDF + "nil":
        items.append(by[node, RDF + "first"][0])
        node = by[node, RDF + "rest"][0][0]
    inner = items[2][0]
    assert items[:2] == [("http://e/b", "iri"), ("it", "literal")] and items[2][1] == "blank"
    assert by[inner, "http://e/q"] == [("1.5", "literal")]
    assert by[inner, "http://e/r"] == [("qé\n", "literal"), ("long 'x' ", "literal")]
    assert by["_:b1", "http://e/p"] == [("http://b/x/rel", "iri"), ("http://b/x/#f", "iri"), ("true", "literal")]
    assert by["http://f/x.y", "http://f/p"] == [("-3", "literal"), ("http://c/d", "iri")]
    assert by["http://e/a", RDF + "type"] == [("http://e/C", "iri")] and by["http://e/z", "http://e/p"] == [("_:b1", "blank")]
    blanks = {s for s, _, _, _ in triples if s.startswith("_:")}
    assert "_:b1" in blanks and len(blanks) == 7  # the written one, an inner one, three list cells and two on their own
    assert scans.turtle_triples(None) == [] == scans.turtle_triples(" # only a note")


@pytest.mark.parametrize("bad", ["ex:a ex:p ex:b .", '@prefix e: <x:> . e:a "p" e:c .', "@prefix e: <x:> . e:a e:b", "{}", "@prefix e: <x:> . e:a e:b e:c d .", "@prefix e: <x:> . e:a e:b ( e:c ", "@prefix e: <x:> . e:a e:b 'open ."])
def test_turtle_fails_loudly(bad):
    with pytest.raises(ValueError, match="not Turtle"):
        scans.turtle_triples(bad)


def test_json_folder(spark, tmp_path):
    for name, said in (("b.json", '{"label":"B"}'), ("a.json", '{"label":"A"}'), ("c.json", "oops"), ("d.txt", "{}")):
        (tmp_path / name).write_text(said)
    rows = scans.json_files(spark, str(tmp_path), on_bad="skip").orderBy("name").collect()
    assert [r.name for r in rows] == ["a.json", "b.json"]
    label = F.try_variant_get("doc", "$.label", "string")
    assert [r.l for r in scans.json_files(spark, str(tmp_path), "skip").orderBy("name").select(label.alias("l"), scans.relative_path(F.col("path"), tmp_path.name).alias("p")).collect()] == ["A", "B"]
    with pytest.raises(Exception, match="not JSON"):
        scans.json_files(spark, str(tmp_path)).collect()
    (tmp_path / "c.json").unlink()
    assert [r.name for r in scans.examples(spark, str(tmp_path), 1).collect()] == ["a.json"]
    with pytest.raises(ValueError, match="no example set"):
        scans.examples(spark, str(tmp_path), 2)


def test_templates_and_lines(spark, tmp_path):
    (tmp_path / "strict_minimal.txt").write_text("spare")
    (tmp_path / "long.txt").write_text("own")
    got = {r.wanted: r.template for r in scans.prompt_templates(spark, str(tmp_path), ["long", "gone"]).collect()}
    assert got == {"long": "own", "gone": "spare"}
    log = tmp_path / "log"
    log.mkdir()
    (log / "x.log").write_text('{"model":"m","retry_count":2}\n\nnot json\n===== total 3\n{"model":"n"}\n')
    rows = scans.json_lines(spark, str(log), "model string, retry_count int").collect()
    assert sorted((r.model, r.retry_count) for r in rows) == [("m", 2), ("n", None)]
    with pytest.raises(RuntimeError, match="no templates"):
        scans.prompt_templates(spark, str(log), ["x"])


def test_csv_places(spark, tmp_path):
    (tmp_path / "a.csv").write_text('k,v\n1,"two\nlines"\n2,\n')
    (tmp_path / "b.csv").write_text('k,v\n3,"say ""x"""\n')
    rows = scans.csv_rows(spark, str(tmp_path))
    assert sorted((r.k, r.v, r.pos) for r in rows.collect()) == [("1", "two\nlines", 0), ("2", None, 1), ("3", 'say "x"', 0)]
    filled = scans.forward_fill(rows.withColumn("v", F.coalesce("v", F.lit(""))), "v", "pos", ["path"])
    assert {r.k: r.v for r in filled.collect()}["2"] == "two\nlines"


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(2, "b", None), (1, "a", 0.5), (3, "a", 1.0)], "id int, kind string, x double")
    lines = [r.value for r in scans.json_array(df, "id").collect()]
    assert json.loads("".join(lines)) == [{"id": 1, "kind": "a", "x": 0.5}, {"id": 2, "kind": "b"}, {"id": 3, "kind": "a", "x": 1.0}]
    assert scans.json_array(df.where("false"), "id").count() == 0
    tied = spark.createDataFrame([(1, "b"), (1, "a"), (2, "c"), (2, "c"), (None, "n"), (None, "n")], "id int, v string")
    assert json.loads("".join(r.value for r in scans.json_array(tied, "id").collect())) == [{"v": "n"}, {"v": "n"}, {"id": 1, "v": "a"}, {"id": 1, "v": "b"}, {"id": 2, "v": "c"}, {"id": 2, "v": "c"}]
    scans.write_one_per_key(df, "kind", f"{tmp_path}/keys")
    assert sorted(p.parent.name for p in (tmp_path / "keys").rglob("*.json")) == ["kind=a", "kind=b"]
    scans.write_records(df, f"{tmp_path}/records")
    assert sorted(spark.read.json(f"{tmp_path}/records").columns) == ["id", "kind", "x"]
    scans.write_flags(df.select("id"), f"{tmp_path}/flags")
    assert spark.read.option("header", True).csv(f"{tmp_path}/flags").count() == 3
    for run in ("r1", "r2"):
        scans.write_tables({"metrics": df, "matrix": df.select("id")}, f"{tmp_path}/history", run_id=run)
    assert spark.read.parquet(f"{tmp_path}/history/metrics").groupBy("run_id").count().count() == 2
    for book in ("one", "two"):
        scans.write_tables({"outputs": df}, f"{tmp_path}/{book}")
    both = scans.workbook(spark, [f"{tmp_path}/one", f"{tmp_path}/two"], "outputs")
    assert sorted((r.workbook, r["count"]) for r in both.groupBy("workbook").count().collect()) == [("one", 3), ("two", 3)]


def test_graph_from_turtle_to_lines(spark, tmp_path):
    (tmp_path / "g.ttl").write_text('@prefix e: <http://e/> . e:v a e:Variable ; e:label "say \\"x\\"" . e:w a e:Variable .')
    triples = scans.turtle(spark, str(tmp_path))
    assert graphs.roots(triples, "http://e/Variable").first().root == "http://e/v"
    scans.write_lines(graphs.n_triples(triples), f"{tmp_path}/out")
    back = spark.read.text(f"{tmp_path}/out")
    assert '<http://e/v> <http://e/label> "say \\"x\\"" .' in [r.value for r in back.collect()]
    (tmp_path / "bad.ttl").write_text("{ no turtle }")
    with pytest.raises(Exception, match="not Turtle"):
        scans.turtle(spark, str(tmp_path)).collect()
