"""Tables that outlive a run: answers by their key, histories of runs, and scans that say what they drop.

What is visible is decided by a small file or row written last. Data of a run
that ended early lies beside it unseen, and ``vacuum`` removes it.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from contextlib import contextmanager
from functools import reduce
from uuid import uuid4

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Folder:
    """A folder on whatever store Spark writes to."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._fs = self._hadoop.Path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._hadoop.Path(f"{self.path}/{name}" if name else self.path)

    def names(self, below: str = "") -> list[str]:
        """The names in a folder; none where it does not exist."""
        at = self._at(below)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def read(self, name: str) -> str:
        at = self._at(name)
        size = self._fs.getFileStatus(at).getLen()
        stream = self._fs.open(at)
        try:
            return bytes(stream.readNBytes(size)).decode()
        finally:
            stream.close()

    @contextmanager
    def whole(self, name: str, replace: bool = True):
        """A stream to a file that takes its place once it is written, and never does if that fails."""
        hidden = self._at(f"{name.rpartition('/')[0]}/.{uuid4().hex}".lstrip("/"))
        stream = self._fs.create(hidden, True)
        try:
            yield stream
            stream.close()
        except BaseException:
            stream.close()
            self._fs.delete(hidden, False)
            raise
        if replace and self._fs.exists(self._at(name)):
            self._fs.delete(self._at(name), False)
        if not self._fs.rename(hidden, self._at(name)):
            raise OSError(f"{name} in {self.path} exists or can't be written")

    def commit(self, name: str, text: str) -> None:
        """Write a small file whole or not at all; it must not exist yet."""
        with self.whole(name, replace=False) as stream:
            stream.write(bytearray(text.encode()))

    def remove(self, name: str) -> None:
        self._fs.delete(self._at(name), True)


class Answers:
    """Answers of a slow service, kept by the content of their key.

    Rows lie in batches, ``data/batch=<id>/bucket=<hash of the key>``; a batch
    counts once its manifest ``manifests/<id>.json`` is there. ``fill`` asks for
    what is missing only, some buckets at a time with a commit after each, so
    that a run which is stopped loses at most one step's answers.
    """

    def __init__(self, spark: SparkSession, path: str, key: list[str], answer: str, buckets: int = 64):
        self.spark, self.key, self.buckets = spark, key, buckets
        self.answer = T._parse_datatype_string(answer)
        self.folder = Folder(spark, path)

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")

    def batches(self) -> list[str]:
        """The batches that count: those with a manifest that no later one replaces."""
        said = {n.removesuffix(".json"): json.loads(self.folder.read(f"manifests/{n}")) for n in self.folder.names("manifests") if n.endswith(".json") and n[0] != "."}
        return sorted(set(said) - {old for m in said.values() for old in m["replaces"]})

    def stored(self, keys: DataFrame) -> DataFrame:
        """All stored answers, with the columns of the key as in ``keys``; one for each key, that of the first batch."""
        schema = T.StructType([keys.schema[k] for k in self.key] + self.answer.fields + [T.StructField("batch", T.StringType()), T.StructField("bucket", T.IntegerType())])
        paths = [f"{self.folder.path}/data/batch={b}" for b in self.batches()]
        if not paths:
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).option("basePath", f"{self.folder.path}/data").parquet(*paths)
        first = F.min_by(F.struct(*self.answer.names), "batch").alias("first")
        return rows.groupBy("bucket", *self.key).agg(first).select(*self.key, "first.*", "bucket")

    def _known(self, left: DataFrame, right: DataFrame) -> Column:
        return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[k]) for k in ("bucket", *self.key)])

    def fill(self, requests: DataFrame, ask: Callable[[DataFrame], DataFrame], steps: int = 4) -> int:
        """Ask for the distinct keys of ``requests`` that have no answer yet, and return how many keys were answered.

        ``ask`` gets a table of the requests' columns, one row for each missing
        key, and returns the key's columns and the answer's. Keys for which it
        returns nothing, or only nulls, stay missing. A key may have nulls.
        """
        wanted = requests.withColumn("bucket", self._bucket())
        total = 0
        for step in range(steps):
            part = wanted.where(F.col("bucket") % steps == step).dropDuplicates(self.key)
            known = self.stored(requests).where(F.col("bucket") % steps == step)
            missing = part.join(known, self._known(part, known), "left_anti").drop("bucket")
            batch = uuid4().hex
            counted = Observation()
            given = ask(missing).select(*self.key, *self.answer.names).withColumn("bucket", self._bucket())
            some = reduce(lambda a, b: a | b, [F.col(n).isNotNull() for n in self.answer.names])
            rows = given.where(some).observe(counted, F.count("*").alias("n"))
            rows.write.partitionBy("bucket").parquet(f"{self.folder.path}/data/batch={batch}")
            n = counted.get["n"]
            if n:
                self.folder.commit(f"manifests/{batch}.json", json.dumps({"rows": n, "replaces": []}))
            total += n
        return total

    def lookup(self, requests: DataFrame) -> DataFrame:
        """The requests with the answer's columns, null where there is none."""
        left = requests.withColumn("bucket", self._bucket())
        right = self.stored(requests)
        return left.join(right, self._known(left, right), "left").select(*[left[c] for c in requests.columns], *[right[n] for n in self.answer.names])

    def compact(self, keys: DataFrame) -> None:
        """Write all answers as one batch that replaces the others."""
        old, batch = self.batches(), uuid4().hex
        if len(old) > 1:
            rows = self.stored(keys)
            rows.repartition("bucket").write.partitionBy("bucket").parquet(f"{self.folder.path}/data/batch={batch}")
            self.folder.commit(f"manifests/{batch}.json", json.dumps({"rows": -1, "replaces": old}))

    def vacuum(self) -> int:
        """Remove data that no manifest names any more; only while nobody fills or reads. Returns the number of batches."""
        live = set(self.batches())
        gone = [n for n in self.folder.names("data") if n.removeprefix("batch=") not in live]
        for n in gone:
            self.folder.remove(f"data/{n}")
        for n in self.folder.names("manifests"):
            if n.removesuffix(".json") not in live:
                self.folder.remove(f"manifests/{n}")
        return len(gone)


_RUNS = "run_id string, attempt string, meta string"


def write_run(tables: dict[str, DataFrame], path: str, run_id: str, meta: dict | None = None) -> None:
    """Add a run's tables to a history; a run that is written again takes the place of the former.

    Each attempt writes a partition of its own in every table; the row of the run
    table that names the attempt is written last, in place of that partition
    alone. Until then readers see the former attempt, or nothing.
    """
    spark = next(iter(tables.values())).sparkSession
    attempt = uuid4().hex
    for name, df in tables.items():
        marked = df.drop("run_id", "attempt").withColumns({"run_id": F.lit(run_id), "attempt": F.lit(attempt)})
        marked.write.mode("append").partitionBy("run_id", "attempt").parquet(f"{path}/{name}")
    row = spark.createDataFrame([(run_id, attempt, json.dumps(meta or {}, sort_keys=True))], _RUNS)
    row.coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(f"{path}/_history_runs")


def runs(spark: SparkSession, path: str) -> DataFrame:
    """(run_id, attempt, meta) of the runs of a history that were written to their end."""
    if "_history_runs" not in Folder(spark, path).names():
        return spark.createDataFrame([], _RUNS)
    return spark.read.schema(_RUNS).parquet(f"{path}/_history_runs").select("run_id", "attempt", "meta")


def read_runs(spark: SparkSession, path: str, name: str, run_ids: list[str] | None = None) -> DataFrame:
    """A table of a history with a column ``run_id``, of all finished runs or of some; partitions of other attempts are not read."""
    seen = runs(spark, path)
    if run_ids is not None:
        seen = seen.where(F.col("run_id").isin(run_ids))
    rows = spark.read.option("mergeSchema", True).option("basePath", f"{path}/{name}").parquet(f"{path}/{name}")
    text = rows.withColumns({"run_id": F.col("run_id").cast("string"), "attempt": F.col("attempt").cast("string")})
    return text.join(seen.select("run_id", "attempt"), ["run_id", "attempt"], "left_semi").drop("attempt")


def vacuum_runs(spark: SparkSession, path: str) -> int:
    """Remove what unfinished and replaced attempts left; only while nobody writes. Returns the number of partitions."""
    live = {r.attempt for r in runs(spark, path).collect()}
    folder, gone = Folder(spark, path), 0
    for table in (n for n in folder.names() if n != "_history_runs"):
        for run in (n for n in folder.names(table) if n.startswith("run_id=")):
            for attempt in folder.names(f"{table}/{run}"):
                if attempt.startswith("attempt=") and attempt.removeprefix("attempt=") not in live:
                    folder.remove(f"{table}/{run}/{attempt}")
                    gone += 1
    return gone


class Sorted:
    """What a scan took and what it left: ``good`` and ``rejected`` (with ``reason``) read the two sides, ``counts`` the rows by reason, ``ok`` for those taken."""

    def __init__(self, good: DataFrame, rejected: DataFrame, counts: dict[str, int]):
        self.good, self.rejected, self.counts = good, rejected, counts


def sort_out(rows: DataFrame, reasons: dict[str, Column], path: str) -> Sorted:
    """Part rows from those with a reason against them, in the one pass that writes both as tables below ``path``.

    ``reasons`` has a test for each reason; the first that holds counts, one that
    is null does not hold. The counts are taken while the rows are written, so
    there is no second job. ``path`` is to be new; a column ``reason`` is replaced.
    """
    spark = rows.sparkSession
    reason = reduce(lambda out, name: F.when(F.coalesce(reasons[name], F.lit(False)), F.lit(name)).otherwise(out), reversed(list(reasons)), F.lit("ok"))
    counted = Observation()
    names = ["ok", *reasons]
    marked = rows.drop("reason").withColumn("reason", reason)
    told = marked.observe(counted, *[F.count_if(F.col("reason") == n).alias(f"n{i}") for i, n in enumerate(names)])
    told.write.partitionBy("reason").parquet(path)
    counts = {n: counted.get[f"n{i}"] for i, n in enumerate(names)}
    back = spark.read.schema(marked.schema).parquet(path)
    return Sorted(back.where("reason = 'ok'").drop("reason"), back.where("reason <> 'ok'"), counts)
