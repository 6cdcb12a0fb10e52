"""Summaries of scored rows: micro, macro, pivots, rankings, audit counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstone.operators.confusion import prf

COUNTS = ("tp", "fp", "fn", "tn")


def long_counts(scored: DataFrame, keys: list[str], structs: list[str]) -> DataFrame:
    """Confusion structs of a row as rows (keys, key, tp, fp, fn, tn)."""
    each = F.array(*[F.struct(F.lit(s).alias("key"), *[F.col(f"{s}.{c}").alias(c) for c in COUNTS]) for s in structs])
    return scored.select(*keys, F.inline(each))


def wide_counts(long: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """The long table back as ``<key>_<count>`` columns, for presentation."""
    cells = [F.sum(F.when(F.col("key") == n, F.col(c))).alias(f"{n}_{c}") for n in names for c in COUNTS]
    return long.groupBy(*keys).agg(*cells)


def micro(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Counts summed over each group, then precision, recall and F1."""
    sums = rows.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in COUNTS])
    return sums.select(*keys, *COUNTS, *prf(F.col("tp"), F.col("fp"), F.col("fn")))


def macro(rows: DataFrame, unit: list[str], keys: list[str]) -> DataFrame:
    """Rounded precision, recall and F1 of each unit, averaged over each group."""
    each = micro(rows, unit)
    return each.groupBy(*keys).agg(*[F.round(F.avg(c), 3).alias(c) for c in "PRF"], F.count("*").alias("units"))


def first_value(rows: DataFrame, keys: list[str], value: str, order: list[str]) -> DataFrame:
    """The value of the first row of each group, in an explicit order."""
    return rows.groupBy(*keys).agg(F.min_by(value, F.struct(*order)).alias(value))


def repeat_stats(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean and sample standard deviation over repetitions; the latter is null for one row."""
    return rows.groupBy(*keys).agg(F.round(F.avg(value), 3).alias("mean"), F.round(F.stddev_samp(value), 3).alias("std"))


def ranking(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Group means, best first, ties by the group's names."""
    return rows.groupBy(*keys).agg(F.round(F.avg(value), 3).alias(value)).orderBy(F.desc(value), *keys)


def pivot_mean(rows: DataFrame, index: str, columns: str, values: list[str], value: str) -> DataFrame:
    """Means by index and the given columns; the index is a real column."""
    return rows.groupBy(index).pivot(columns, values).agg(F.round(F.avg(value), 3))


def stacked_means(frames: list[DataFrame], key: str, value: str) -> DataFrame:
    """Means by key over all rows of the frames on top of each other, highest first: the order of a matrix's columns."""
    stacked = frames[0].select(key, value)
    for f in frames[1:]:
        stacked = stacked.unionByName(f.select(key, value))
    return stacked.groupBy(key).agg(F.round(F.avg(value), 3).alias("mean")).orderBy(F.desc("mean"), key)


def matrix_by_mean(rows: DataFrame, index: str, shot: str, columns: str, value: str) -> DataFrame:
    """A matrix of first values by index on top of means by shot, its columns by their mean over all cells, highest first.

    Rows of means are named ``<shot>-shot | MEAN``. The names of the columns are
    collected; Spark's limit on pivoted values bounds them. Ties of a cell go by
    the least value, ties of columns by name.
    """
    cells = rows.groupBy(F.col(index).cast("string").alias("row"), columns).agg(F.round(F.min(value), 3).alias("cell"))
    means = rows.groupBy(F.concat(F.col(shot).cast("string"), F.lit("-shot | MEAN")).alias("row"), columns).agg(F.round(F.avg(value), 3).alias("cell"))
    both = means.unionByName(cells)
    order = [r[0] for r in both.where(F.col(columns).isNotNull()).groupBy(columns).agg(F.avg("cell").alias("mean")).orderBy(F.desc("mean"), columns).select(columns).limit(10_001).collect()]
    return both.groupBy("row").pivot(columns, order).agg(F.first("cell")) if order else both.select("row").distinct()


def workbook_parts(scored: DataFrame, keys: list[str], structs: list[str], outputs: list[str], by: list[str]) -> dict[str, DataFrame]:
    """The sheets of a run's workbook: one of counts for each key, the outputs, and the summary by group; none where nothing is scored."""
    if scored.isEmpty():
        return {}
    long = long_counts(scored, [*keys, *by], structs)
    parts = {f"{s} concepts": long.where(F.col("key") == s).drop("key").orderBy(*keys) for s in structs}
    return parts | {"LLM outputs": scored.select(*keys, *outputs).orderBy(*keys), "Summary": micro(long, [*by, "key"]).orderBy(*by, "key")}


def merge_summaries(left: DataFrame, right: DataFrame, on: str, suffixes: tuple[str, str]) -> DataFrame:
    """An inner join in which columns that both sides have get suffixes."""
    both = (set(left.columns) & set(right.columns)) - {on}
    names = lambda df, s: [F.col(c).alias(c + s if c in both else c) for c in df.columns]
    return left.select(names(left, suffixes[0])).join(right.select(names(right, suffixes[1])), on)


def by_shot(rows: DataFrame, key: str, shot: str, shots: list[int], value: str) -> DataFrame:
    """One column for each shot, the empty text where a shot has none."""
    wide = rows.groupBy(key).pivot(shot, shots).agg(F.max_by(value, shot))
    return wide.select(key, *[F.coalesce(F.col(str(s)), F.lit("")).alias(f"shot_{s}") for s in shots])


def natural_order(label: str) -> Column:
    """The integer in a text like ``3-shot``, to sort by."""
    return F.regexp_extract(label, r"(\d+)", 1).cast("int")


def audit_counters(events: DataFrame, flags: list[str], lists: list[str]) -> DataFrame:
    """Rows, set flags and summed list lengths of audit events."""
    return events.agg(
        F.count("*").alias("rows"),
        *[F.count_if(F.coalesce(F.col(f), F.lit(False))).alias(f) for f in flags],
        *[F.coalesce(F.sum(F.coalesce(F.size(c), F.lit(0))), F.lit(0)).cast("bigint").alias(c) for c in lists],
    )
