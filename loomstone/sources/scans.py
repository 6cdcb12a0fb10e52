"""Scans into DataFrames and sinks out of them."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomstone.functions.records import parsed
from loomstone.session import tasks
from loomstone.sources.stores import Sorted, sort_out
from loomstone.sources.turtle import turtle, turtle_triples  # noqa: F401


def _texts(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    files = spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", True).text(path, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("name"), F.col("value").alias("raw"))


def json_files(spark: SparkSession, path: str, on_bad: str = "fail") -> DataFrame:
    """(path, name, raw, doc) of one JSON object per file. Bad files fail the query, or go with ``on_bad="skip"``."""
    rows = _texts(spark, path, "*.json").withColumn("doc", parsed(F.col("raw")))
    if on_bad == "skip":
        return rows.where("doc is not null")
    check = F.when(F.col("doc").isNull(), F.raise_error(F.concat(F.lit("not JSON: "), F.col("path")))).otherwise(F.col("doc"))
    return rows.withColumn("doc", check)


def json_files_sorted(spark: SparkSession, path: str, side: str) -> Sorted:
    """JSON files as (path, name, raw), those that are none or blank in a side table, and the number of each; all below ``side``. A file of no bytes gives no row."""
    value = F.col("raw")
    return sort_out(_texts(spark, path, "*.json"), {"blank": F.trim(value).rlike(r"^\s*$"), "not json": parsed(value).isNull()}, side)


def relative_path(path: Column, base: str) -> Column:
    """The part of a path after the last ``base/``."""
    return F.element_at(F.split(path, f"/{re.escape(base)}/"), -1)


def examples(spark: SparkSession, path: str, n: int) -> DataFrame:
    """The first n example records by name; n is 0, 1, 3 or 5."""
    if n not in (0, 1, 3, 5):
        raise ValueError(f"no example set of {n}")
    return json_files(spark, path).orderBy("name").limit(n)


def prompt_templates(spark: SparkSession, path: str, wanted: list[str], fallback: str = "strict_minimal") -> DataFrame:
    """(wanted, template) of each wanted name, the fallback's text where it has none of its own."""
    texts = _texts(spark, path, "*.txt").select(F.regexp_replace("name", r"\.txt$", "").alias("stem"), F.col("raw").alias("template"))
    if texts.limit(1).count() == 0:
        raise RuntimeError(f"no templates in {path}")
    names = spark.createDataFrame([(w,) for w in wanted], "wanted string")
    texts = texts.groupBy("stem").agg(F.min("template").alias("template"))  # a name that several folders have counts once
    spare = texts.where(F.col("stem") == fallback).select(F.col("template").alias("spare"))
    own = names.join(texts, F.col("wanted") == F.col("stem"), "left")
    return own.join(F.broadcast(spare), F.lit(True), "left").select("wanted", F.coalesce("template", "spare").alias("template"))  # one spare row at most


def build_prompt(instructions: Column, schema: Column, shots: Column, definition: Column, footer: str) -> Column:
    """The parts of a prompt, separated by blank lines; the examples only where there are any."""
    return F.concat_ws("\n\n", instructions, schema, F.when(F.size(shots) > 0, F.array_join(shots, "\n\n")), definition, F.lit(footer))


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of a JSON-lines file; blank lines and ruled footers (``====``) and what follows on their lines go."""
    lines = spark.read.text(path).where((F.trim("value") != "") & ~F.col("value").startswith("===="))
    rows = lines.where(parsed(F.col("value")).isNotNull()).select(F.from_json("value", schema).alias("r"))
    return rows.select("r.*")


def json_lines_sorted(spark: SparkSession, path: str, schema: str, side: str) -> Sorted:
    """As ``json_lines``, with the lines that go in a side table and the number of each kind; all below ``side``."""
    value = F.col("value")
    found = sort_out(spark.read.text(path), {"blank": F.trim(value) == "", "footer": value.startswith("===="), "not json": parsed(value).isNull()}, side)
    found.good = found.good.select(F.from_json("value", schema).alias("r")).select("r.*")
    return found


def csv_rows(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with a header, all strings, with quoted line breaks, its file's ``path`` and the row's place ``pos`` in it.

    Files with quoted line breaks are not split, so a task reads a file in order and
    the ids of its rows rise by one; a row's place is its id less the file's least.
    """
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    placed = rows.select("*", F.col("_metadata.file_path").alias("path"), F.monotonically_increasing_id().alias("at"))
    firsts = placed.groupBy("path").agg(F.min("at").alias("first_at"))
    return placed.join(firsts, "path").select(*rows.columns, "path", (F.col("at") - F.col("first_at")).alias("pos"))


def forward_fill(rows: DataFrame, col: str, order: str, by: list[str]) -> DataFrame:
    """Blank cells take the last set value above them, inside each group of ``by``."""
    above = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn(col, F.last(F.nullif(F.col(col), F.lit("")), ignorenulls=True).over(above))


def distinct_or_list(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """(key, value): distinct non-null values in first-seen order as JSON, one value bare, several as a list, none as null."""
    first = rows.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.min(order).alias("_at"))
    lists = first.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", value))), lambda s: s[value]).alias("_all"))
    shown = F.when(F.size("_all") == 1, F.element_at("_all", 1)).otherwise(F.to_json("_all"))
    return rows.select(key).distinct().join(lists, key, "left").select(key, shown.alias(value))


def replayed(requests: DataFrame, answers: DataFrame, on: list[str], columns: list[str]) -> DataFrame:
    """Answers of a model or service from a recorded table; requests without one get nulls."""
    return requests.join(answers.select(*on, *columns).dropDuplicates(on), on, "left")


def responses(requests: DataFrame, recorded: DataFrame, attempts: int = 3) -> DataFrame:
    """The first usable recorded response of each (model, prompt_hash, temperature): not blank and no web page."""
    from loomstone.functions.text import is_blank, is_html

    good = recorded.where((F.col("attempt") <= attempts) & ~is_blank(F.col("text")) & ~is_html(F.col("text")))
    first = good.groupBy("model", "prompt_hash", "temperature").agg(F.min_by("text", "attempt").alias("text"))
    return requests.join(first, ["model", "prompt_hash", "temperature"], "left").withColumn("text", F.coalesce("text", F.lit("")))


def write_tables(tables: dict[str, DataFrame], path: str, run_id: str | None = None) -> None:
    """One Parquet folder per table; with a run id, runs are appended side by side."""
    for name, df in tables.items():
        if run_id is None:
            df.write.mode("overwrite").parquet(f"{path}/{name}")
        else:
            df.withColumn("run_id", F.lit(run_id)).write.mode("append").partitionBy("run_id").parquet(f"{path}/{name}")


def write_flags(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_records(df: DataFrame, path: str) -> None:
    """JSON lines without null fields."""
    df.write.mode("overwrite").json(path)


def json_array(df: DataFrame, order: str) -> DataFrame:
    """(value): one JSON array of all records in an order, a line for each, so that its lines can be written from many tasks.

    Records that tie go by their JSON; equal ones are told apart by their number.
    """
    line = df.select(F.col(order).alias("order"), F.to_json(F.struct(*df.columns)).alias("json")).groupBy("order", "json").agg(F.count("*").alias("times"))
    ends = line.agg(F.min(F.struct("order", "json")).alias("lo"), F.max(F.struct("order", "json")).alias("hi"))
    rows = line.join(F.broadcast(ends), F.lit(True))  # one row of bounds
    rows = rows.withColumn("nth", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("times"))))
    at = lambda end: F.struct("order", "json").eqNullSafe(F.col(end))
    first, final = at("lo") & (F.col("nth") == 1), at("hi") & (F.col("nth") == F.col("times"))
    value = F.concat(F.when(first, "[").otherwise(""), "json", F.when(final, "]").otherwise(","))
    return rows.select("order", "json", "nth", value.alias("value")).orderBy("order", "json", "nth").select("value")


def write_one_per_key(df: DataFrame, key: str, path: str) -> None:
    """A folder ``key=<value>`` with the key's records as JSON lines; the rows of a key meet in one file.

    A file costs far more than its bytes, so the number of tasks is fixed: few
    bytes would be put together in one. Tasks move their own files into place.
    """
    df.repartition(tasks(df.sparkSession), key).write.mode("overwrite").option("mapreduce.fileoutputcommitter.algorithm.version", "2").partitionBy(key).json(path)


def workbook(spark: SparkSession, paths: list[str], sheet: str) -> DataFrame:
    """One sheet of several workbooks (folders of Parquet sheets), with the workbook each row is from in ``workbook``."""
    rows = spark.read.option("basePath", "/").option("mergeSchema", True).parquet(*[f"{p.rstrip('/')}/{sheet}" for p in paths])
    return rows.withColumn("workbook", F.regexp_extract(F.col("_metadata.file_path"), rf"([^/]+)/{re.escape(sheet)}/[^/]*$", 1))


def write_lines(lines: DataFrame, path: str) -> None:
    """A one-column table as text, such as N-Triples or an audit log."""
    lines.write.mode("overwrite").text(path)
