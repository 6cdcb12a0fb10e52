"""Queries that write tables with the library's sinks and scan what was written, each with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomstone.operators import graphs
from loomstone.plans.graph_queries import _TRADE_SQL, q_mapping
from loomstone.plans.queries import query, t
from loomstone.session import new_folder
from loomstone.sources import scans


@query("""SELECT 's_suppkey=' || s_suppkey AS folder, s_name, s_nationkey, s_suppkey % 2 = 0 AS has_note FROM supplier""")
def q_json_scan(spark, d):
    """A JSON file for each supplier, without null fields, scanned as whole files with their paths."""
    path = new_folder(spark)
    note = F.when(F.col("s_suppkey") % 2 == 0, "kept")
    scans.write_one_per_key(t(spark, d, "supplier").select("s_suppkey", "s_name", F.col("s_nationkey"), note.alias("note")), "s_suppkey", path)
    files = scans.json_files(spark, path)
    at = lambda f, kind: F.try_variant_get("doc", f"$.{f}", kind)
    below = scans.relative_path(F.col("path"), path.rpartition("/")[2])
    return files.select(F.substring_index(below, "/", 1).alias("folder"), at("s_name", "string").alias("s_name"), at("s_nationkey", "int").alias("s_nationkey"), F.contains(F.col("raw"), F.lit("note")).alias("has_note"))


@query("""SELECT p_partkey, 'first' || chr(10) || 'of "' || p_name || '", ' || p_type AS said, p_size > 25 AS large FROM part""")
def q_csv_scan(spark, d):
    """A table with quotes and line breaks as CSV files with headers, scanned with every row's place."""
    path = new_folder(spark)
    said = F.concat(F.lit('first\nof "'), "p_name", F.lit('", '), "p_type")
    t(spark, d, "part").select("p_partkey", said.alias("said"), (F.col("p_size") > 25).alias("large")).repartition(3).write.option("header", True).option("escape", '"').csv(path)
    rows = scans.csv_rows(spark, path)
    placed = rows.groupBy("path").agg(F.count("*").alias("n"), F.max("pos").alias("last"), F.countDistinct("pos").alias("places")).where("n = last + 1 and n = places")
    return rows.join(placed.select("path"), "path").select(F.col("p_partkey").cast("bigint").alias("p_partkey"), "said", F.col("large").cast("boolean").alias("large"))


@query("""SELECT p_partkey, CAST(p_size > 25 AS INT) AS large, CAST(p_retailprice > 1000 AS INT) AS dear FROM part""")
def q_flag_files(spark, d):
    path = new_folder(spark)
    scans.write_flags(t(spark, d, "part").select("p_partkey", (F.col("p_size") > 25).cast("int").alias("large"), (F.col("p_retailprice") > 1000).cast("int").alias("dear")), path)
    return spark.read.option("header", True).schema("p_partkey bigint, large int, dear int").csv(path)


@query("""SELECT event_id, CASE WHEN event_id % 3 > 0 THEN event_type END AS event_type, value FROM events""")
def q_line_scan(spark, d):
    """Records as JSON lines without null fields, with a ruled footer beside them, scanned as records."""
    path = new_folder(spark)
    rows = t(spark, d, "events").select("event_id", F.when(F.col("event_id") % 3 > 0, F.col("event_type")).alias("event_type"), "value")
    scans.write_records(rows, path)
    spark.range(3).select(F.concat(F.lit("==== part "), F.col("id").cast("string")).alias("value")).write.mode("append").text(path)
    return scans.json_lines(spark, path, "event_id bigint, event_type string, value double")


@query("""WITH l AS (SELECT '{"k":' || n_regionkey || ',"name":"' || n_name || '"}' AS j, row_number() OVER (ORDER BY n_regionkey, n_name) AS i, count(*) OVER () AS n FROM nation)
SELECT CASE WHEN i = 1 THEN '[' ELSE '' END || j || CASE WHEN i = n THEN ']' ELSE ',' END AS value FROM l""")
def q_json_array(spark, d):
    return scans.json_array(t(spark, d, "nation").select(F.col("n_regionkey").alias("k"), F.col("n_name").alias("name")), "k")


@query(f"SELECT * FROM ({_TRADE_SQL})")
def q_turtle_scan(spark, d):
    """A graph written as lines of N-Triples, and those files read as Turtle, datatypes and languages kept."""
    path = new_folder(spark)
    scans.write_lines(graphs.n_triples(q_mapping(spark, d)), path)
    return scans.turtle(spark, path, "*.txt").drop("graph_id")
