"""Queries over tables that outlive a run, each with DuckDB SQL; what they store lies in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstone.functions.records import parsed
from loomstone.plans import summary
from loomstone.plans.queries import _two_keys, query, t
from loomstone.session import new_folder
from loomstone.sources import stores, workbooks


@query("""WITH k AS (SELECT o_custkey % 50 AS model, o_orderpriority AS shot, bool_or(o_orderstatus = 'F') AS early, count(*) FILTER (WHERE o_custkey % 5 <> 0) AS n FROM orders GROUP BY ALL)
SELECT model, shot, CASE WHEN n > 0 THEN n END AS answer, CASE WHEN n > 0 THEN CASE WHEN early THEN 1 ELSE 2 END END AS asked_in FROM k""")
def q_answers(spark, d):
    """Two runs that ask a recorded service through a store: the second asks only what the first did not."""
    orders = t(spark, d, "orders").select((F.col("o_custkey") % 50).alias("model"), F.col("o_orderpriority").alias("shot"), "o_orderstatus", "o_custkey")
    recorded = orders.where("o_custkey % 5 <> 0").groupBy("model", "shot").agg(F.count("*").alias("answer"))
    kept = stores.Answers(spark, new_folder(spark), ["model", "shot"], "answer bigint, asked_in int", buckets=8)
    for run, wanted in ((1, orders.where("o_orderstatus = 'F'")), (2, orders)):
        kept.fill(wanted.select("model", "shot"), lambda missing, run=run: missing.join(recorded, ["model", "shot"]).withColumn("asked_in", F.lit(run)), steps=1)
    return kept.lookup(orders.select("model", "shot").distinct())


@query("""SELECT o_orderstatus AS run_id, o_orderpriority, count(*) AS n, CASE o_orderstatus WHEN 'P' THEN 1 ELSE 2 END AS written FROM orders GROUP BY ALL""")
def q_history(spark, d):
    """A history of a run for each status; two are written again, and a third attempt fails."""
    path = new_folder(spark)

    def summary(status: str, written: int) -> DataFrame:
        found = t(spark, d, "orders").where(F.col("o_orderstatus") == status).groupBy("o_orderpriority").agg(F.count("*").alias("n"))
        return found.withColumn("written", F.lit(written))

    for status, written in (("F", 1), ("O", 1), ("P", 1), ("F", 2), ("O", 2)):
        stores.write_run({"summary": summary(status, written)}, path, status, {"written": written})
    summary("P", 3).withColumns({"run_id": F.lit("P"), "attempt": F.lit("unfinished")}).write.mode("append").partitionBy("run_id", "attempt").parquet(f"{path}/summary")
    return stores.read_runs(spark, path, "summary")


_LINE = "CASE WHEN event_id % 7 = 0 THEN concat(props, 'x') WHEN event_id % 11 = 0 THEN '  ' WHEN event_id % 13 = 0 THEN concat('==== ', event_type) ELSE props END"


@query(f"""WITH e AS (SELECT event_id, {_LINE} AS line FROM events),
r AS (SELECT event_id, CASE WHEN trim(line) = '' THEN 'blank' WHEN starts_with(line, '====') THEN 'footer' WHEN TRY_CAST(line AS JSON) IS NULL THEN 'not json' ELSE 'ok' END AS reason FROM e)
SELECT reason, count(*) AS counted, count(*) AS found, CAST(sum(event_id) AS BIGINT) AS ids FROM r GROUP BY reason""")
def q_scan_counts(spark, d):
    """Lines parted from those that are no records in one pass, with the counts of that pass beside those of the tables."""
    lines = t(spark, d, "events").selectExpr("event_id", f"{_LINE} AS line")
    line = F.col("line")
    parted = stores.sort_out(lines, {"blank": F.trim(line) == "", "footer": line.startswith("===="), "not json": parsed(line).isNull()}, new_folder(spark))
    counts = F.create_map(*[x for k, v in parted.counts.items() for x in (F.lit(k), F.lit(v).cast("bigint"))])
    both = parted.good.withColumn("reason", F.lit("ok")).unionByName(parted.rejected)
    return both.groupBy("reason").agg(F.count("*").alias("found"), F.sum("event_id").alias("ids")).select("reason", F.try_element_at(counts, F.col("reason")).alias("counted"), "found", "ids")


@query("""WITH k AS (SELECT c_nationkey, 'segment' AS key, CAST(c_custkey % 3 = 0 AS DOUBLE) AS tp, CAST(c_custkey % 3 = 2 AS DOUBLE) AS fp, CAST(c_custkey % 3 = 1 AS DOUBLE) AS fn, 0.0::DOUBLE AS tn FROM customer
  UNION ALL SELECT c_nationkey, 'nothing', 0, CAST(c_custkey % 3 <> 1 AS DOUBLE), 0, CAST(c_custkey % 3 = 1 AS DOUBLE) FROM customer),
b AS (SELECT unnest(['even.xlsx', 'odd.xlsx']) AS workbook, unnest([0, 1]) AS half)
SELECT workbook, c_nationkey, key, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn, sum(tn) AS tn FROM k JOIN b ON c_nationkey % 2 = half GROUP BY ALL""")
def q_workbooks(spark, d):
    """Two runs' workbooks, written with all their sheets, and the counts of both read on top of each other."""
    path = new_folder(spark)
    rows = _two_keys(spark, d)
    for name, half in (("even", 0), ("odd", 1)):
        mine = rows.where(F.col("c_nationkey") % 2 == half).groupBy("c_nationkey").agg(*[F.struct(*[F.sum(f"{k}.{c}").alias(c) for c in summary.COUNTS]).alias(k) for k in ("segment", "nothing")], F.count("*").alias("said"))
        workbooks.write_workbook(summary.workbook_parts(mine, ["c_nationkey"], ["segment", "nothing"], ["said"], []), f"{path}/{name}.xlsx")
    counts = [workbooks.read_workbooks(spark, path, f"{k} concepts", "c_nationkey int, tp double, fp double, fn double, tn double").withColumn("key", F.lit(k)) for k in ("segment", "nothing")]
    return counts[0].unionByName(counts[1]).drop("pos")
