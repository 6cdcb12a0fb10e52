"""Queries over triples made from the tables: roots, records, systems, shapes; each with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstone.functions import dates
from loomstone.operators import graphs, mappings, shapes
from loomstone.plans.queries import EX, query, t
from loomstone.session import new_folder, spread
from loomstone.sources.turtle import turtle_frame

VARIABLE, OTHER = EX + "Variable", "http://example.com/other#Variable"


def _suppliers(spark: SparkSession, d: str) -> DataFrame:
    """Triples of suppliers, one graph for each nation, with types, labels and links that some lack."""
    rows = t(spark, d, "supplier")
    key = F.col("s_suppkey")
    at = lambda col: graphs.template(EX + "s/%s", col.cast("string"))
    kind = F.when(key % 4 == 0, VARIABLE).when(key % 4 == 1, OTHER)
    predicates = [
        (graphs.RDF_TYPE, kind, "iri"),
        (graphs.RDFS + "label", F.when(key % 4 >= 2, F.col("s_name")), "literal"),
        (graphs.RDFS + "comment", F.when(key % 8 == 2, F.lit("text")), "literal"),
        (EX + "source", F.when(key % 3 == 0, at(key + 1)), "iri"),
        (EX + "target", F.when(key % 3 == 0, at(key + 1 + key % 2)), "iri"),
        (EX + "numerator", F.when(key % 3 == 1, at(key + 2)), "iri"),
        (EX + "part", F.when(key % 5 == 0, at(key + 3)), "iri"),
        (EX + "part", F.when(key % 10 == 0, at(key + 4)), "iri"),
    ]
    triples = graphs.map_rows(rows, "g", at(key), predicates)
    home = rows.select(at(key).alias("s"), F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("graph_id"))
    return triples.drop("graph_id").join(home, "s").select("graph_id", "s", "p", "o", "o_kind")


_S = f"(SELECT s_suppkey AS k, 'n' || s_nationkey AS graph_id, '{EX}s/' || s_suppkey AS s, s_name FROM supplier)"


@query(f"""SELECT graph_id, arg_min(s, (rank, s)) AS root FROM (SELECT *, CASE WHEN k % 4 = 0 THEN 0 WHEN k % 4 = 1 THEN 1 WHEN k % 8 = 2 THEN 2 END AS rank FROM {_S}) WHERE rank IS NOT NULL GROUP BY graph_id""")
def q_roots(spark, d):
    return graphs.roots(_suppliers(spark, d), VARIABLE)


@query(f"""SELECT graph_id, min(s_name) AS value FROM {_S} WHERE false GROUP BY graph_id
UNION ALL SELECT graph_id, min('{EX}s/' || (k + 1)) FROM {_S} WHERE k % 4 = 0 AND k % 3 = 0 GROUP BY graph_id""")
def q_pattern_join(spark, d):
    return graphs.pattern_join(_suppliers(spark, d), VARIABLE, EX + "source")


_PARTS = f"""CASE WHEN k % 10 = 0 THEN '["' || least('{EX}s/' || (k + 3), '{EX}s/' || (k + 4)) || '","' || greatest('{EX}s/' || (k + 3), '{EX}s/' || (k + 4)) || '"]' WHEN k % 5 = 0 THEN '{EX}s/' || (k + 3) END"""


@query(f"""SELECT graph_id, s, CASE WHEN k % 4 >= 2 THEN s_name END AS name, {_PARTS} AS parts FROM {_S} WHERE k % 4 >= 2 OR k % 5 = 0""")
def q_graph_records(spark, d):
    return graphs.record_fields(_suppliers(spark, d), {"name": graphs.RDFS + "label", "parts": EX + "part"})


@query(f"""SELECT graph_id, s, CASE WHEN k % 3 = 0 AND k % 2 = 0 THEN 'sym' WHEN k % 3 < 2 THEN 'asym' ELSE 'sym' END AS kind,
  CASE WHEN k % 3 = 0 AND k % 2 = 1 THEN '{EX}s/' || (k + 1) WHEN k % 3 = 1 THEN '{EX}s/' || (k + 2) END AS source,
  CASE WHEN k % 3 = 0 AND k % 2 = 1 THEN '{EX}s/' || (k + 2) END AS target,
  CASE WHEN k % 3 = 0 AND k % 2 = 0 THEN '{EX}s/' || (k + 1) WHEN k % 10 = 0 THEN least('{EX}s/' || (k + 3), '{EX}s/' || (k + 4)) || ' ' || greatest('{EX}s/' || (k + 3), '{EX}s/' || (k + 4)) WHEN k % 5 = 0 THEN '{EX}s/' || (k + 3) END AS parts
FROM {_S} WHERE k % 3 < 2 OR k % 5 = 0""")
def q_graph_systems(spark, d):
    found = graphs.systems(_suppliers(spark, d), EX + "source", EX + "target", EX + "part", EX + "numerator", EX + "denominator")
    return found.withColumn("parts", F.array_join("parts", " "))


@query(f"""SELECT k, CASE WHEN k % 2 = 0 THEN 'deep' ELSE s_name END AS label, coalesce(CASE WHEN k % 3 = 0 THEN 'explicit' END, CASE WHEN k % 5 = 0 THEN 'object' END, 'root') AS "on" FROM {_S}""")
def q_constraint_targets(spark, d):
    key = F.col("s_suppkey")
    label = F.when(key % 2 == 0, "hasConstraint: deep").otherwise(F.col("s_name"))
    return t(spark, d, "supplier").select(key.alias("k"), *graphs.constraint_labels(label, F.when(key % 3 == 0, "explicit"), F.when(key % 5 == 0, "object"), F.lit("root")))


@query(f"""SELECT 'two parts' AS rule, s, 2 AS n FROM {_S} WHERE k % 4 = 0 AND k % 10 = 0
UNION ALL SELECT 'no label', s, 0 FROM {_S} WHERE k % 4 < 2 AND k % 4 = 0""")
def q_shape_cardinality(spark, d):
    triples = _suppliers(spark, d)
    many = graphs.cardinality(triples, VARIABLE, EX + "part", low=0, high=1).select(F.lit("two parts").alias("rule"), "s", F.col("n").cast("int").alias("n"))
    none = graphs.cardinality(triples, VARIABLE, graphs.RDFS + "label", low=1).select(F.lit("no label").alias("rule"), "s", F.col("n").cast("int").alias("n"))
    return many.unionByName(none)


@query(f"""SELECT a.graph_id, a.s, '{EX}s/' || (a.k + 1) AS o FROM {_S} a LEFT JOIN {_S} b ON b.k = a.k + 1 AND b.graph_id = a.graph_id AND b.k % 4 < 2 WHERE a.k % 3 = 0 AND b.k IS NULL""")
def q_shape_targets(spark, d):
    return graphs.target_class(_suppliers(spark, d), EX + "source", [VARIABLE, OTHER])


@query(f"""SELECT b.graph_id, b.s FROM {_S} b LEFT JOIN {_S} a ON b.k = a.k + 1 AND b.graph_id = a.graph_id AND a.k % 3 = 0 WHERE b.k % 4 = 0 AND a.k IS NULL""")
def q_shape_unlinked(spark, d):
    return graphs.linked_from(_suppliers(spark, d), VARIABLE, EX + "source")


@query(f"""SELECT graph_id, s FROM {_S} WHERE k % 4 = 1 AND k % 3 <> 0""")
def q_shape_ends(spark, d):
    return graphs.asymmetric_complete(_suppliers(spark, d), OTHER, [EX + "source", EX + "numerator"], [EX + "target", EX + "denominator"])


# -- a mapping document, a shapes document and dates over customers, orders and nations

_MAPPING = """
prefixes:
  ex: http://example.org/
mappings:
  nation:
    sources: [[nation~table]]
    s: ex:n/$(n_nationkey)
    po:
      - [a, ex:Nation]
      - [ex:region, $(n_regionkey), xsd:integer]
  customer:
    sources: [[customer~table]]
    s: ex:c/$(c_custkey)
    po:
      - [a, ex:$(kind)]
      - [ex:label, "$(c_name), $(c_mktsegment)", en~lang]
      - p: ex:home
        o:
          - mapping: nation
            condition: {function: equal, parameters: [[str1, $(c_nationkey), s], [str2, $(n_nationkey), o]]}
  order:
    sources: [[orders~table]]
    s: ex:o/$(o_orderkey)
    po:
      - [a, ex:Order]
      - [ex:priority, $(o_orderpriority)]
      - [ex:total, $(total), xsd:decimal]
      - [ex:created, $(day), xsd:date]
      - [ex:created, $(open_day)]
      - p: ex:placedBy
        o:
          - mapping: customer
            condition: {function: equal, parameters: [[str1, $(o_custkey), s], [str2, $(c_custkey), o]]}
"""

_SHAPES = """
@prefix sh: <http://www.w3.org/ns/shacl#> . @prefix xsd: <http://www.w3.org/2001/XMLSchema#> . @prefix ex: <http://example.org/> .
ex:OrderShape sh:targetClass ex:Order ;
  sh:property [ sh:path ex:placedBy ; sh:minCount 1 ; sh:maxCount 1 ; sh:nodeKind sh:IRI ; sh:class ex:Customer ] ;
  sh:property [ sh:path ex:priority ; sh:or ( [ sh:pattern "^[1-3]-" ] [ sh:minLength 6 ] ) ; sh:message "short and late" ] ;
  sh:property [ sh:path ex:created ; sh:datatype xsd:date ] ;
  sh:property [ sh:path ex:total ; sh:maxExclusive 495000 ] .
ex:CustomerShape sh:targetClass ex:Customer ;
  sh:property [ sh:path [ sh:inversePath ex:placedBy ] ; sh:minCount 1 ; sh:maxCount 15 ; sh:class ex:Order ] ;
  sh:property [ sh:path ex:home ; sh:node [ sh:property [ sh:path ex:region ; sh:in ( 0 1 2 ) ] ] ] ;
  sh:or (
    [ sh:path ex:label ; sh:pattern "BUILDING$|MACHINERY$" ]
    [ sh:and ( [ sh:path [ sh:inversePath ex:placedBy ] ; sh:minCount 9 ] [ sh:not [ sh:path ex:home ; sh:hasValue <http://example.org/n/3> ] ] ) ]
  ) .
"""


def _trade(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    total = F.col("o_totalprice").cast("decimal(15,2)").cast("string")
    day, still_open = dates.date_text(F.col("o_orderdate")), F.col("o_orderstatus") == "P"
    orders = spread(t(spark, d, "orders")).select("o_orderkey", "o_custkey", "o_orderpriority", total.alias("total"), F.when(~still_open, day).alias("day"), F.when(still_open, day).alias("open_day"))
    customer = spread(t(spark, d, "customer")).select("c_custkey", "c_nationkey", "c_name", "c_mktsegment", F.when(F.col("c_acctbal") >= 0, "Customer").alias("kind"))
    return {"orders": orders, "customer": customer, "nation": t(spark, d, "nation")}


_XSD, _TOTAL, _DAY = graphs.XSD, "CAST(CAST(o_totalprice AS DECIMAL(15,2)) AS VARCHAR)", "strftime(o_orderdate, '%Y-%m-%d')"


_TRADE_SQL = f"""
WITH x AS (
  SELECT 'n/' || n_nationkey AS s, 'type' AS p, '{EX}Nation' AS o, 'iri' AS o_kind, NULL AS datatype, NULL AS lang FROM nation
  UNION SELECT 'n/' || n_nationkey, 'region', CAST(n_regionkey AS VARCHAR), 'literal', '{_XSD}integer', NULL FROM nation
  UNION SELECT 'c/' || c_custkey, 'type', '{EX}Customer', 'iri', NULL, NULL FROM customer WHERE c_acctbal >= 0
  UNION SELECT 'c/' || c_custkey, 'label', c_name || ', ' || c_mktsegment, 'literal', 'http://www.w3.org/1999/02/22-rdf-syntax-ns#langString', 'en' FROM customer
  UNION SELECT 'c/' || c_custkey, 'home', '{EX}n/' || n_nationkey, 'iri', NULL, NULL FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION SELECT 'o/' || o_orderkey, 'type', '{EX}Order', 'iri', NULL, NULL FROM orders
  UNION SELECT 'o/' || o_orderkey, 'priority', o_orderpriority, 'literal', '{_XSD}string', NULL FROM orders
  UNION SELECT 'o/' || o_orderkey, 'total', {_TOTAL}, 'literal', '{_XSD}decimal', NULL FROM orders
  UNION SELECT 'o/' || o_orderkey, 'created', {_DAY}, 'literal', '{_XSD}' || CASE o_orderstatus WHEN 'P' THEN 'string' ELSE 'date' END, NULL FROM orders
  UNION SELECT 'o/' || o_orderkey, 'placedBy', '{EX}c/' || c_custkey, 'iri', NULL, NULL FROM orders JOIN customer ON o_custkey = c_custkey
)
SELECT '{EX}' || s AS s, CASE p WHEN 'type' THEN '{graphs.RDF_TYPE}' ELSE '{EX}' || p END AS p, o, o_kind, datatype, lang FROM x"""


@query(f"SELECT 'trade' AS graph_id, * FROM ({_TRADE_SQL})")
def q_mapping(spark, d):
    return mappings.run_mappings(_MAPPING, _trade(spark, d), "trade")


@query(f"""
WITH per AS (SELECT c_custkey AS k, c_acctbal, c_mktsegment, c_nationkey, (SELECT n_regionkey FROM nation WHERE n_nationkey = c_nationkey) AS region, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL),
c AS (SELECT *, '{EX}c/' || k AS s FROM per WHERE c_acctbal >= 0),
o AS (SELECT orders.*, '{EX}o/' || o_orderkey AS s, c_custkey, c_acctbal FROM orders LEFT JOIN customer ON o_custkey = c_custkey),
x AS (
  SELECT 'Order' AS shape, s AS focus, 'placedBy' AS path, 'minCount' AS rule, '0' AS value, NULL AS message FROM o WHERE c_custkey IS NULL
  UNION ALL SELECT 'Order', s, 'placedBy', 'class', '{EX}c/' || c_custkey, NULL FROM o WHERE c_acctbal < 0
  UNION ALL SELECT 'Order', s, 'priority', 'or', o_orderpriority, 'short and late' FROM o WHERE left(o_orderpriority, 1) NOT IN ('1', '2', '3') AND length(o_orderpriority) < 6
  UNION ALL SELECT 'Order', s, 'created', 'datatype', {_DAY}, NULL FROM o WHERE o_orderstatus = 'P'
  UNION ALL SELECT 'Order', s, 'total', 'maxExclusive', {_TOTAL}, NULL FROM o WHERE CAST(o_totalprice AS DECIMAL(15,2)) >= 495000
  UNION ALL SELECT 'Customer', s, '^placedBy', 'minCount', '0', NULL FROM c WHERE n = 0
  UNION ALL SELECT 'Customer', s, '^placedBy', 'maxCount', CAST(n AS VARCHAR), NULL FROM c WHERE n > 15
  UNION ALL SELECT 'Customer', s, 'home', 'node', '{EX}n/' || c_nationkey, NULL FROM c WHERE region NOT IN (0, 1, 2)
  UNION ALL SELECT 'Customer', s, NULL, 'or', s, NULL FROM c WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY') AND NOT (n >= 9 AND c_nationkey <> 3)
)
SELECT 'trade' AS graph_id, '{EX}' || shape || 'Shape' AS shape, focus, CASE WHEN path LIKE '^%' THEN '^{EX}' || path[2:] ELSE '{EX}' || path END AS path, rule, value, message FROM x""")
def q_shacl(spark, d):
    path = new_folder(spark)  # the triples are looked at from several sides, so they are a table
    mappings.run_mappings(_MAPPING, _trade(spark, d), "trade", by_subject=True).write.parquet(path)
    return shapes.check(spark.read.parquet(path), turtle_frame(spark, _SHAPES), repeats=False)


@query("""SELECT strftime(o_orderdate, '%Y-%m-%d') AS day, strftime(o_orderdate, '%Y-%m-01') AS month, year(o_orderdate) AS year, count(*) AS n FROM orders WHERE o_orderstatus <> 'P' GROUP BY ALL""")
def q_dates(spark, d):
    typed = q_mapping(spark, d).where(F.col("p") == EX + "created")
    day = dates.as_date(F.col("o"), F.col("datatype"))
    month = dates.as_date(F.substring("o", 1, 7), F.lit(graphs.XSD + "gYearMonth"))
    found = typed.select(dates.date_text(day).alias("day"), dates.date_text(month).alias("month"), F.year(day).cast("bigint").alias("year")).where("day is not null")
    return found.groupBy("day", "month", "year").agg(F.count("*").alias("n"))
