"""Packing (operator 8): optimal length buckets and token-budget batches.

The global histogram of lengths is exact up to ``EXACT`` tokens and has 256
bins an octave beyond, so what reaches the driver is bounded. Each bin keeps its
count, its sum and its largest length; dynamic programming over the bins finds
the boundaries that minimise padding. A bucket's padded length is its longest
document, and batches of ``budget // padded length`` documents (at least one)
fill up inside each bucket.

Places in a bucket are dense across the cluster without a global sort: rows are
ranked inside (bucket, salt) groups of about ``GROUP_ROWS``, and running sums
over the groups' counts shift those ranks.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomstone.llm.common import store, table
from loomstone.llm.tokens import token_counts

BUCKETS = 16
BUDGET = 65_536  # tokens of a batch, padding included
EXACT = 1024
PER_OCTAVE = 256
GROUP_ROWS = 20_000


def best_boundaries(longest: np.ndarray, count: np.ndarray, total: np.ndarray, buckets: int) -> list[int]:
    """Padded lengths, ascending, that pad least with at most ``buckets`` buckets.

    Bins come by length: the longest document, documents and tokens of each.
    """
    d = len(longest)
    c = np.concatenate([[0], np.cumsum(count)]).astype(np.float64)
    s = np.concatenate([[0], np.cumsum(total)]).astype(np.float64)
    best = np.full(d + 1, np.inf)
    best[0] = 0
    back = []
    for _ in range(min(buckets, d)):
        new, cut = np.full(d + 1, np.inf), np.zeros(d + 1, dtype=np.int64)
        new[0] = 0
        for j in range(1, d + 1):
            cost = best[:j] + float(longest[j - 1]) * (c[j] - c[:j]) - (s[j] - s[:j])
            cut[j] = int(np.argmin(cost))
            new[j] = cost[cut[j]]
        best = new
        back.append(cut)
    ends, j = [], d
    for cut in reversed(back):
        if j == 0:
            break
        ends.append(int(longest[j - 1]))
        j = int(cut[j])
    return sorted(set(ends))


def boundaries(lengths: DataFrame, length_col: str = "n_tokens", buckets: int = BUCKETS) -> list[tuple[int, int]]:
    """(padded length, documents) of each bucket, from the global histogram."""
    n = F.col(length_col)
    binned = F.when(n <= EXACT, n).otherwise(EXACT + F.floor(F.log2(n / EXACT) * PER_OCTAVE) + 1)
    rows = lengths.groupBy(binned.cast("long").alias("bin")).agg(F.max(n), F.count("*"), F.sum(n)).orderBy("bin").collect()
    if not rows:
        return []
    longest, count, total = (np.array([int(r[i]) for r in rows]) for i in (1, 2, 3))
    ends = best_boundaries(longest, count, total, buckets)
    at = np.searchsorted(ends, longest)
    return [(e, int(count[at == i].sum())) for i, e in enumerate(ends)]


def pack(lengths: DataFrame, id_col: str = "doc_id", length_col: str = "n_tokens", buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """(id, length, bucket, padded_len, batch, slot) of each row of ``lengths``.

    ``bucket`` counts from 0 by padded length, ``batch`` from 0 inside a bucket,
    ``slot`` from 0 inside a batch; only a bucket's last batch may be short. A
    document longer than the budget makes a batch alone. Null lengths count as
    0. Repeated rows each get a slot; other columns are ignored; an empty table
    gives none.
    """
    plain = lengths.select(F.col(id_col), F.coalesce(F.col(length_col), F.lit(0)).cast("bigint").alias(length_col))
    ends = boundaries(plain, length_col, buckets)
    case = lambda values: F.expr("CASE " + " ".join(f"WHEN `{length_col}` <= {e} THEN {v}" for (e, _), v in zip(ends, values, strict=True)) + " END") if ends else F.lit(0)
    # equal rows are told apart by nothing, so they travel once with their number
    rows = plain.groupBy(id_col, length_col).agg(F.count("*").alias("_times"))
    rows = rows.withColumns(
        {
            "bucket": case(range(len(ends))).cast("int"),
            "padded_len": case([e for e, _ in ends]).cast("bigint"),
            "_per": case([max(1, budget // max(1, e)) for e, _ in ends]).cast("bigint"),
            "_salt": F.pmod(F.xxhash64(id_col, length_col), case([1 + n // GROUP_ROWS for _, n in ends]).cast("bigint")),
        }
    )
    groups = rows.groupBy("bucket", "_salt").agg(F.sum("_times").alias("_n"))
    before = Window.partitionBy("bucket").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.select("bucket", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    inside = Window.partitionBy("bucket", "_salt").orderBy(id_col, length_col).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_rank", F.coalesce(F.sum("_times").over(inside), F.lit(0))).join(groups, ["bucket", "_salt"])
    rows = rows.withColumn("_place", F.explode(F.sequence(F.col("_rank") + F.col("_shift"), F.col("_rank") + F.col("_shift") + F.col("_times") - 1)))
    return rows.select(id_col, length_col, "bucket", "padded_len", F.expr("_place div _per").alias("batch"), (F.col("_place") % F.col("_per")).alias("slot"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return pack(store(counted.select("doc_id", "n_tokens"), "lengths"))
