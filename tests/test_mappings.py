"""The planner of mapping documents, and dates of typed literals."""

import datetime

import pytest
from pyspark.sql import functions as F

from loomstone.functions import dates
from loomstone.operators import mappings

XSD = "http://www.w3.org/2001/XMLSchema#"

DOC = """
prefixes:
  ex: http://e/
  dct: http://purl.org/dc/terms/
sources:
  people: [people.csv~csv]
mappings:
  place:
    sources:
      - [places.csv~csv]
    s: $(uri)
    po:
      - [a, ex:Place,]
      - [ex:name, $(name), en~lang]
  person:
    sources: [people]
    subjects: http://p.org/$(full name)
    po:
      - [a, [ex:Person, ex:Agent]]
      - [ex:label, "$(full name) of $(town)"]
      - [ex:page, http://w.org/$(id)~iri]
      - [dct:created, "2024-09-22", xsd:date]
      - [ex:born, $(born), xsd:date]
      - predicates: ex:lives   ## a join over two sources
        objects:
        - mapping: place
          condition:
            function: equal
            parameters:
              - [str1, $(town), s]
              - [str2, $(name), o]
      - p: ex:knows
        o:
        - mapping: person
          condition:
            - function: equal
              parameters: [[str1, $(friend), s], [str2, $(id), o]]
            - function: equal
              parameters: [[str1, $(town), s], [str2, $(town), o]]
      - p: ex:self
        o:
        - mapping: nick
        - {value: $(id), datatype: xsd:integer}
  nick:
    sources: [people]
    s: ex:nick/$(id)
    po: []
"""


def tables(spark):
    people = [("1", "Ann Lee", "Bonn", "2", "2001-02-03"), ("2", "Bo/b", "Bonn", "3", ""), ("3", "Cy", "Ulm", "", None), ("4", None, "Ulm", "3", "2000-01-01"), ("1", "Ann Lee", "Bonn", "2", "2001-02-03")]
    places = [("http://t/bonn", "Bonn"), ("http://t/bonn2", "Bonn"), (None, "Ulm"), ("http://t/none", "")]
    return {"people.csv": spark.createDataFrame(people, "id string, `full name` string, town string, friend string, born string"), "places.csv": spark.createDataFrame(places, "uri string, name string")}


def test_document(spark):
    rows = mappings.run_mappings(DOC, tables(spark), "g").collect()
    got = {tuple(r)[1:] for r in rows}
    assert len(got) == len(rows) and {r.graph_id for r in rows} == {"g"}
    iri = lambda s, p, o: (s, p, o, "iri", None, None)
    text = lambda s, p, o, d="string", lang=None: (s, p, o, "literal", d if "#" in d else XSD + d, lang)
    ann, bob, cy, e, t = "http://p.org/Ann%20Lee", "http://p.org/Bo%2Fb", "http://p.org/Cy", "http://e/", mappings.RDF_TYPE
    want = {iri(x, t, e + c) for x in (ann, bob, cy) for c in ("Person", "Agent")}
    want |= {text(ann, e + "label", "Ann Lee of Bonn"), text(bob, e + "label", "Bo/b of Bonn"), text(cy, e + "label", "Cy of Ulm")}
    want |= {iri(x, e + "page", f"http://w.org/{i}") for i, x in enumerate((ann, bob, cy), 1)}
    want |= {text(x, "http://purl.org/dc/terms/created", "2024-09-22", "date") for x in (ann, bob, cy)}
    want |= {text(ann, e + "born", "2001-02-03", "date")}
    want |= {iri(x, e + "lives", o) for x in (ann, bob) for o in ("http://t/bonn", "http://t/bonn2")}
    want |= {iri(ann, e + "knows", bob)}
    want |= {iri(x, e + "self", f"{e}nick/{i}") for i, x in enumerate((ann, bob, cy), 1)} | {text(x, e + "self", str(i), "integer") for i, x in enumerate((ann, bob, cy), 1)}
    want |= {iri(o, t, e + "Place") for o in ("http://t/bonn", "http://t/bonn2", "http://t/none")}
    want |= {text(o, e + "name", "Bonn", mappings.RDF + "langString", "en") for o in ("http://t/bonn", "http://t/bonn2")}
    assert got == want


def test_one_scan_a_source_and_one_join(spark):
    plan = mappings.run_mappings(DOC, tables(spark))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join Inner") == 1


def test_sources_from_a_folder(spark, tmp_path):
    for name, df in tables(spark).items():
        df.toPandas().to_csv(tmp_path / name, index=False)
    from_folder = mappings.mapped_folder(spark, DOC, str(tmp_path), "g")
    assert {tuple(r) for r in from_folder.collect()} == {tuple(r) for r in mappings.run_mappings(DOC, tables(spark), "g").collect()}
    none = {k: v.where("false") for k, v in tables(spark).items()}
    assert mappings.run_mappings(DOC, none).count() == 0


@pytest.mark.parametrize(
    "bad",
    [
        {"mappings": {"m": {"sources": [["a~csv"]], "s": "$(x)", "graphs": "g"}}},
        {"mappings": {"m": {"sources": [["a~csv"]], "s": "$(x)", "po": [{"p": "e:p", "o": [{"mapping": "n"}]}]}}},
        {"mappings": {"m": {"sources": [["a~csv"]], "s": "$(x)", "po": [{"p": "e:p", "o": [{"mapping": "m", "condition": {"function": "like", "parameters": []}}]}]}}},
        {"mappings": {"m": {"sources": [["a~csv"]], "s": "$(x)", "po": [{"p": "e:p", "o": [{"mapping": "n"}]}]}, "n": {"sources": [["b~csv"]], "s": "$(x)"}}},
        {"targets": {}, "mappings": {}},
    ],
)
def test_unknown_parts_fail_loudly(bad):
    with pytest.raises(ValueError, match="understood|no mapping|needs a condition"):
        mappings.read_mappings(bad)


def test_dates(spark):
    rows = [("2024-02-29", "date"), ("2024-02-30", "date"), ("2024-02-01+02:00", "date"), ("2024", "gYear"), ("2024-05", "gYearMonth"), ("2024-05-06T23:30:00Z", "dateTime"), ("2024-05-06T23:30:00.5-02:00", "dateTime"), ("2024-05-06T24:61:00", "dateTime"), ("2024-01-01", "string"), (None, "date"), ("x", "dateTime"), ("2024-01-01", None)]
    df = spark.createDataFrame([(i, v, k and XSD + k) for i, (v, k) in enumerate(rows)], "i int, v string, k string")
    got = df.select("i", dates.as_date(F.col("v"), F.col("k")).alias("d"), dates.as_timestamp(F.col("v"), F.col("k")).cast("string").alias("t")).orderBy("i").collect()
    day = datetime.date
    assert [r.d for r in got] == [day(2024, 2, 29), None, day(2024, 2, 1), day(2024, 1, 1), day(2024, 5, 1), day(2024, 5, 6), day(2024, 5, 7), None, None, None, None, None]
    assert [r.t for r in got] == [None] * 5 + ["2024-05-06 23:30:00", "2024-05-07 01:30:00.5"] + [None] * 5
    text = spark.sql("select timestamp'2024-01-02 03:04:05' as t").select(dates.date_text(F.col("t")).alias("d"), dates.date_time_text(F.col("t")).alias("t")).first()
    assert tuple(text) == ("2024-01-02", "2024-01-02T03:04:05Z")


def test_predicates_from_cells_and_numbers(spark):
    doc = {"mappings": {"m": {"sources": [["t"]], "s": ["http://e/$(n)/$(k)", "http://e/all"], "po": [["http://e/$(p)", "$(k)"], ["http://e/q", "b"]]}}}
    rows = spark.createDataFrame([(-1, "a/b", "q"), (-1, "b", "q"), (None, "b", "r"), (3, None, "q")], "n int, k string, p string")
    e = "http://e/"
    want = {(e + "-1/a%2Fb", e + "q", "a/b"), (e + "-1/a%2Fb", e + "q", "b"), (e + "-1/b", e + "q", "b"), (e + "all", e + "q", "a/b"), (e + "all", e + "q", "b"), (e + "all", e + "r", "b")}
    for by_subject in (False, True):
        got = [(r.s, r.p, r.o) for r in mappings.run_mappings(doc, {"t": rows}, by_subject=by_subject).collect()]
        assert set(got) == want and len(got) == len(want)


def test_the_triples_of_a_subject_are_in_one_part(spark):
    found = mappings.run_mappings(DOC, tables(spark), "g", by_subject=True)
    places = found.withColumn("at", F.spark_partition_id()).groupBy("s").agg(F.count_distinct("at").alias("n"))
    assert found.count() == mappings.run_mappings(DOC, tables(spark), "g").count() and places.where("n > 1").count() == 0
