"""The streaming Turtle reader, its data source, typed literals."""

import random
import tracemalloc

import pytest
from pyspark.sql import functions as F

from loomstone.operators import graphs
from loomstone.sources import turtle

DOC = r"""@prefix ex: <http://e/> . @prefix xsd: <http://www.w3.org/2001/XMLSchema#> . # note . here
@base <http://b/x/> .
ex:a ex:p "plain", 'x "y"'@EN-gb, '''long "q". ; text''', "2024-09-22"^^xsd:date, "7"^^<http://t/own>, "" ;
  ex:n 1, -2.5, 3e4, .5E-1, true, false ; ex:e "tab\tq\"é" .
_:b1 ex:p <rel>, ( 1 [ ex:q ( ) ] "x"@de ) . _:new1 ex:p [] . [ ex:only ex:me ] .
PREFIX f: <http://f/>
BASE <http://c/>
f:x.y f:p <d>, ex:a.b.c ; .
"""


def test_chunks_do_not_matter():
    whole = list(turtle.statements([DOC]))
    rng = random.Random(1)
    for size in (1, 2, 7, 60, 500):
        assert list(turtle.statements(DOC[i : i + size] for i in range(0, len(DOC), size))) == whole
    for _ in range(30):
        cuts = sorted(rng.sample(range(len(DOC)), 9))
        assert list(turtle.statements(DOC[a:b] for a, b in zip([0, *cuts], [*cuts, len(DOC)], strict=True))) == whole


def test_literals_keep_datatype_and_language():
    xsd = turtle.XSD
    said = {(o, d, lang) for s, p, o, kind, d, lang in turtle.statements([DOC]) if kind == "literal"}
    assert {("plain", xsd + "string", None), ('x "y"', turtle.RDF + "langString", "en-gb"), ("2024-09-22", xsd + "date", None), ("7", "http://t/own", None)} <= said
    assert {("1", xsd + "integer", None), ("-2.5", xsd + "decimal", None), ("3e4", xsd + "double", None), (".5E-1", xsd + "double", None), ("true", xsd + "boolean", None)} <= said
    assert ('tab\tq"é', xsd + "string", None) in said and ('long "q". ; text', xsd + "string", None) in said and ("", xsd + "string", None) in said
    assert all(d is None and lang is None for *_, kind, d, lang in turtle.statements([DOC]) if kind != "literal")
    assert {s for s, *_ in turtle.statements([DOC]) if s.startswith("_:")} >= {"_:b1", "_:new_1"}


def test_no_written_node_is_taken_for_a_fresh_one():
    rows = list(turtle.statements(["@prefix e: <x:> . _:new1 e:p [ e:q _:new_1 ] . _:new e:p 1 ."]))
    assert len({s for s, *_ in rows} | {o for _, _, o, kind, *_ in rows if kind == "blank"}) == 4


def test_large_documents_take_bounded_memory():
    def chunks():
        yield "@prefix e: <http://e/> .\n"
        line = 'e:s%d e:p "text of some length, %s" ; e:q [ e:r e:o%d ] .\n'
        for i in range(0, 20_000, 500):
            yield "".join(line % (k, "x" * 200, k) for k in range(i, i + 500))

    tracemalloc.start()
    n = sum(1 for _ in turtle.statements(chunks()))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 60_000 and peak < 12 << 20
    with pytest.raises(ValueError, match="no token"):
        list(turtle.statements(["@prefix e: <x:> . e:a e:b <" + "x" * 1024] + ["y" * (1 << 20)] * 40))


def files(folder):
    (folder / "in").mkdir()
    for k in range(3):
        (folder / f"g{k}.ttl" if k else folder / "in" / "g0.ttl").write_text("@prefix e: <http://e/> .\n" + "".join(f'e:s{i} a e:T ;\n  e:p """{"w " * 40}{i}\nnext"""@en ;\n  e:d "2024-01-{i % 28 + 1:02}"^^<{turtle.XSD}date> .\n' for i in range(400)))
    (folder / "empty.ttl").write_text("")
    (folder / "other.txt").write_text("{")


def test_lines_and_data_source_agree(spark, tmp_path):
    files(tmp_path)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")  # each file in several splits
    try:
        rows = sorted(turtle.turtle(spark, str(tmp_path)).collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(rows) == 3600 and {r.graph_id for r in rows} == {"g0.ttl", "g1.ttl", "g2.ttl"}
    turtle.register(spark)
    source = spark.read.format("turtle").load(str(tmp_path))
    assert sorted(source.collect()) == rows and source.rdd.getNumPartitions() == 4
    assert sorted(spark.read.format("turtle").load(f"{tmp_path}/g1.ttl").collect()) == [r for r in rows if r.graph_id == "g1.ttl"]
    (tmp_path / "none").mkdir()
    assert spark.read.format("turtle").load(f"{tmp_path}/none").count() == 0
    assert graphs.roots(source, "http://e/T").count() == 3


def test_filters_on_predicates_reach_the_reader(spark, tmp_path):
    files(tmp_path)
    turtle.register(spark)
    source = spark.read.format("turtle").load(str(tmp_path))
    one = source.where(F.col("p") == "http://e/d")
    assert "http://e/d" not in "".join(x for x in one._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Filter" in x and "isnotnull" not in x.lower())
    assert one.count() == 1200 and source.where(F.col("p").isin("http://e/d", "http://e/p") & (F.col("s") == "http://e/s7")).count() == 6
    assert source.where((F.col("p") == "http://e/d") & (F.col("p") == "http://e/p")).count() == 0


def test_typed_lines(spark):
    rows = turtle.turtle_frame(spark, DOC, "g")
    lines = {r.value for r in graphs.n_triples(rows).collect()}
    assert f'<http://e/a> <http://e/p> "2024-09-22"^^<{turtle.XSD}date> .' in lines
    assert '<http://e/a> <http://e/p> "x \\"y\\""@en-gb .' in lines and '<http://e/a> <http://e/p> "plain" .' in lines
    back = turtle.turtle_frame(spark, "\n".join(lines), "g")
    named = F.expr("s not like '_:%' and o not like '_:%'")
    assert sorted(map(str, back.where(named).collect())) == sorted(map(str, rows.where(named).collect()))
