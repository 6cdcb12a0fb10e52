"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from uuid import uuid4

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomstone.session import shared_folder

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(col: Column) -> Column:
    """Lower-case A-Z only; every other letter stays as it is."""
    return F.translate(col, ASCII_UPPER, ASCII_LOWER)


def free_name(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not use yet."""
    taken = {c.lower() for c in df.columns}
    name, k = base, 0
    while name.lower() in taken:
        k += 1
        name = f"{base}_{k}"
    return name


BATCH_BYTES = 4 << 20  # of an Arrow batch between the JVM and Python
_BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by ``BATCH_BYTES``, as texts can be long; Spark has a session setting for it, which is lowered where it is higher."""
    size = re.match(r"(\d+)([bkmg]?)", spark.conf.get(_BATCH_CONF, "64m").lower())
    if size is None or int(size[1]) << {"": 0, "b": 0, "k": 10, "m": 20, "g": 30}[size[2]] > BATCH_BYTES:
        spark.conf.set(_BATCH_CONF, str(BATCH_BYTES))


def arrow(df: DataFrame, fn, schema) -> DataFrame:
    """``df.mapInArrow`` with batches of few megabytes."""
    small_batches(df.sparkSession)
    return df.mapInArrow(fn, schema)


def map_columns(
    df: DataFrame,
    fn: Callable[[pa.RecordBatch], dict[str, pa.Array]],
    added: str,
    keep: list[str] | None = None,
) -> DataFrame:
    """Append columns computed from whole Arrow batches.

    ``fn`` gets a batch and returns one array for each field of the DDL schema
    ``added``. A column of ``df`` that has the name of an added one is replaced.
    """
    extra = T._parse_datatype_string(added)
    names = [f.name for f in extra.fields]
    kept = [f for f in df.schema.fields if f.name not in names and (keep is None or f.name in keep)]
    schema = T.StructType(kept + extra.fields)
    kept_names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            out = fn(batch)
            yield pa.RecordBatch.from_arrays(
                [batch.column(n) for n in kept_names] + [out[n] for n in names],
                names=kept_names + names,
            )

    return arrow(df, run, schema)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; checkpoints go there, too, where a session has set no folder for them (tests)."""
    path = shared_folder(spark)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(path)
    return path


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage through a reliable checkpoint in the shared folder.

    Spark removes the shuffle files of a step when the driver's garbage collector
    finds that nothing needs it any more, which may take long on an idle heap; so
    it is called here, and the steps of an iteration do not pile up on the disks.
    """
    spark = df.sparkSession
    shared_dir(spark)
    out = df.checkpoint(eager=True)
    del df
    spark.sparkContext._jvm.System.gc()
    return out


_stored: dict[str, list[str]] = {}


def store(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it again.

    Results read such tables until they are written themselves; then
    ``drop_stored`` removes them.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid4().hex}"
    df.write.parquet(path)
    _stored.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def stored(spark: SparkSession) -> int:
    """The number of tables that this application has stored and not removed."""
    return len(_stored.get(spark.sparkContext.applicationId, []))


def drop_stored(spark: SparkSession, since: int = 0, but_last: int = 0) -> int:
    """Remove the tables that this application has stored; call it once its results are written.

    Those stored before the number ``since`` and the last ``but_last`` stay. Returns the number of tables removed.
    """
    sc = spark.sparkContext
    paths = _stored.get(sc.applicationId, [])
    end = max(since, len(paths) - but_last)
    gone, paths[since:end] = paths[since:end], []
    for path in gone:
        there = sc._jvm.org.apache.hadoop.fs.Path(path)
        there.getFileSystem(sc._jsc.hadoopConfiguration()).delete(there, True)
    return len(gone)


def crc32_sql(text: str) -> str:
    """A DuckDB expression for the unsigned CRC-32 of a string's UTF-8 bytes, half a byte at a time."""

    def turned(c: int) -> int:
        for _ in range(4):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        return c

    turns = ", ".join(f"{turned(i)}::BIGINT" for i in range(16))
    half = lambda e: f"xor([{turns}][CAST(({e}) & 15 AS INT) + 1], ({e}) >> 4)"
    all_bytes = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda b: CAST('0x' || b AS BIGINT))"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {all_bytes}), lambda c, x: {half(half('xor(c, x)'))}), 4294967295)"
