"""Sharding (operator 13): contiguous shards of near equal bytes, in DataFrame functions only.

Rows are put in order of id (then checksum, size and place of reading) by range
partitions. Each partition's bytes and rows are summed, prefix sums over those
totals say where a partition begins in the whole, and a running sum inside it
says where each row does. A row belongs to the shard in whose share of all bytes
its middle lies, so each cut is at most half a row from its target.

Range partitions also split rows that share an id, or are equal in all, since
the place of reading is part of the order; it is the place in a stored table,
the same when a task runs again. Two tables are stored: the rows as they are
read, and the same by partition, so that totals and running sums see the same
partitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomstone.llm.common import crc32_sql, store, table

SHARDS = 16
LAW = "bytes"


def _order() -> list:
    return [F.asc_nulls_first(c) for c in ("id", "crc", "size", "at")]


def assign_shards(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all) of ``docs`` with size, text_crc32, shard and slot.

    ``size`` is the text's UTF-8 bytes plus 1 and ``text_crc32`` its unsigned
    CRC-32; a null text counts as empty. Shards count from 0, are contiguous in
    order of id (nulls first), and each holds its share of all bytes to within the
    size of a row; a row larger than a share leaves shards empty. ``slot`` counts
    from 0 without gaps inside a shard; repeated rows each get one. Columns with
    the names of added ones are replaced. An empty table gives none.
    """
    added = ("size", "text_crc32", "shard", "slot")
    columns = [c for c in keep or docs.columns if c not in added]
    text = F.coalesce(F.col(text_col), F.lit(""))
    read = docs.select(
        F.struct(*columns).alias("row"),
        F.col(id_col).alias("id"),
        (F.octet_length(text) + F.lit(1).cast("bigint")).alias("size"),
        F.crc32(text).alias("crc"),
    )
    rows = store(read, "sizes").withColumn("at", F.monotonically_increasing_id())
    dealt = store(rows.repartitionByRange(*_order()).withColumn("part", F.spark_partition_id()), "ranges")

    # a few rows: one for each partition
    totals = dealt.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sum_before = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    every = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    begins = totals.select("part", sum_before("bytes").alias("bytes_before"), sum_before("n").alias("n_before"), F.sum("bytes").over(every).alias("all_bytes"))

    inside = Window.partitionBy("part").orderBy(*_order())
    own = dealt.withColumns({"end": F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)), "nth": F.row_number().over(inside).cast("bigint")})
    twice_middle = "2 * (bytes_before + end) - size"
    placed = own.join(F.broadcast(begins), "part").select(
        "row", "size", "crc", (F.col("n_before") + F.col("nth")).alias("place"), F.expr(f"cast(least({shards}L * ({twice_middle}) div (2 * all_bytes), {shards - 1}L) as int)").alias("shard")
    )
    firsts = placed.groupBy("shard").agg(F.min("place").alias("first"))
    return placed.join(F.broadcast(firsts), "shard").select("row.*", "size", F.col("crc").alias("text_crc32"), "shard", (F.col("place") - F.col("first")).alias("slot"))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write ``docs`` as Parquet with a folder ``shard=k`` for each shard, its rows in files by slot."""
    placed = assign_shards(docs, shards, id_col, text_col)
    placed.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = assign_shards(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return placed.select("doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


OP13_SQL = f"""
WITH s AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 1 AS size, {crc32_sql("coalesce(text, '')")} AS text_crc32 FROM documents),
c AS (SELECT *, sum(size) OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size ROWS UNBOUNDED PRECEDING) AS upto, sum(size) OVER () AS total FROM s),
p AS (SELECT *, least({SHARDS} * (2 * upto - size) // (2 * total), {SHARDS - 1}) AS shard FROM c)
SELECT doc_id, CAST(size AS BIGINT) AS size, text_crc32, '{LAW}' AS law, CAST(shard AS INTEGER) AS shard,
       row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM p
"""
