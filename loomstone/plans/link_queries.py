"""Queries of linking, grids and matrices, each with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomstone.functions.records import constraints, parsed
from loomstone.operators import grids, linking
from loomstone.plans import summary
from loomstone.plans.queries import _CANDIDATES_SQL, _candidates, _mixed_records, _record_sql, query, t

_BASE = _record_sql().split(", s AS (")[0]  # WITH r(k, seg, gt, pred)


@query(f"""SELECT term, CAST(NULL AS VARCHAR) AS "none", CASE WHEN max(score) > 0.105 THEN arg_max(id, (score, -pos)) END AS cross, arg_min(id, pos) AS mcp FROM ({_CANDIDATES_SQL}) GROUP BY term""")
def q_link_reranked(spark, d):
    linked = linking.link_all(_candidates(spark, d), ("none", "cross-encoder", "mcp"), threshold=0.105)
    return linked.withColumnRenamed("cross-encoder", "cross")


@query("""SELECT p_partkey, '<|im_start|>user' || chr(10) || '<Instruct>: find ' || p_type || chr(10) || '<Query>: ' || p_name || chr(10) AS query, '<Document>: ' || p_brand || ' of ' || p_type || '<|im_end|>' AS document
FROM (SELECT *, 'parts' AS kind FROM part) WHERE p_type = 'ECONOMY'""")
def q_rerank_texts(spark, d):
    rows = t(spark, d, "part").where(F.col("p_type") == "ECONOMY")
    query_text = linking.rerank_query(F.col("p_name"), "<|im_start|>user\n", "find ECONOMY")
    return rows.select("p_partkey", query_text.alias("query"), linking.rerank_document(F.concat_ws(" of ", "p_brand", "p_type"), "<|im_end|>").alias("document"))


@query("""SELECT s_suppkey, CASE s_suppkey % 5 WHEN 0 THEN true WHEN 1 THEN s_nationkey = s_suppkey % 25 WHEN 2 THEN false WHEN 3 THEN true ELSE false END AS same FROM supplier""")
def q_uri_lists(spark, d):
    n, key = F.col("s_nationkey").cast("string"), F.col("s_suppkey")
    entity = lambda x: F.concat(F.lit("http://www.wikidata.org/entity/Q"), x)
    page = lambda x: F.concat(F.lit("https://www.wikidata.org/wiki/Q"), x)
    none = F.lit(None).cast("string")
    given = F.array(entity(n), none, F.lit("http://example.org/a/"))
    other = F.when(key % 5 == 0, F.array(page(n), none, F.lit("https://example.org/a"))).when(key % 5 == 1, F.array(page((key % 25).cast("string")), none, F.lit("http://example.org/a")))
    other = other.when(key % 5 == 2, F.array(page(n), F.lit("http://example.org/a"), none)).when(key % 5 == 3, given)
    return t(spark, d, "supplier").select("s_suppkey", linking.same_uri_list(given, other).alias("same"))


@query("""WITH f AS (SELECT doc_id, source || '/' || lang || '/' || doc_id || '.json' AS path FROM documents)
SELECT doc_id, path FROM f WHERE path NOT IN (SELECT min(path) FROM f GROUP BY split_part(path, '/', 1), split_part(path, '/', 2))""")
def q_reserved_paths(spark, d):
    """Documents but for those kept as examples, by the path of their file: the first of each folder."""
    files = t(spark, d, "documents").select("doc_id", F.concat("source", F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".json")).alias("path"))
    reserved = files.groupBy(F.substring_index("path", "/", 2)).agg(F.min("path").alias("path"))
    return grids.without(files, reserved, "path")


_ITEMS = "CASE WHEN json_type(json_extract(gt, '$.hasConstraint')) = 'ARRAY' THEN CAST(json_extract(gt, '$.hasConstraint') AS JSON[]) ELSE [] END"


@query(f"""{_BASE}, c AS (SELECT k, unnest({_ITEMS}) AS c FROM r) SELECT k, c ->> '$.label' AS label, c ->> '$.on' AS "on" FROM c""")
def q_flatten_constraints(spark, d):
    rows = _mixed_records(spark, d).select("k", constraints(parsed(F.col("gt"))).alias("items"))
    return grids.flatten_lists(rows, "items", ["k"])


@query("""SELECT 25 AS wanted, s_name FROM (SELECT s_name FROM supplier ORDER BY s_name LIMIT 25) UNION ALL SELECT 0, s_name FROM supplier""")
def q_first_by(spark, d):
    rows = t(spark, d, "supplier").select("s_name")
    some = grids.first_by(rows, "s_name", 25).withColumn("wanted", F.lit(25))
    return some.unionByName(grids.first_by(rows, "s_name", 0).withColumn("wanted", F.lit(0)))


@query("""WITH b AS (SELECT o_custkey % 40 || ' | ' || o_orderstatus AS prompt, o_custkey % 4 AS shot, o_orderpriority AS model, o_totalprice AS v FROM orders),
c AS (SELECT prompt AS row, model, round(min(v), 3) AS cell FROM b GROUP BY ALL UNION ALL SELECT shot || '-shot | MEAN', model, round(avg(v), 3) FROM b GROUP BY ALL),
m AS (SELECT model, row_number() OVER (ORDER BY avg(cell) DESC, model) AS place FROM c GROUP BY model)
SELECT row, model, place, cell FROM c JOIN m USING (model)""")
def q_matrix_by_mean(spark, d):
    """The cells of a matrix with the place of their column, which its mean decides."""
    priced = t(spark, d, "orders").select(F.concat((F.col("o_custkey") % 40).cast("string"), F.lit(" | "), "o_orderstatus").alias("prompt"), (F.col("o_custkey") % 4).alias("shot"), F.col("o_orderpriority").alias("model"), F.col("o_totalprice").alias("v"))
    wide = summary.matrix_by_mean(priced, "prompt", "shot", "model", "v")
    cells = F.array(*[F.struct(F.lit(c).alias("model"), F.lit(i).cast("bigint").alias("place"), F.col(f"`{c}`").alias("cell")) for i, c in enumerate(wide.columns[1:], 1)])
    return wide.select("row", F.inline(cells)).where("cell is not null")
