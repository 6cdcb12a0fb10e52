"""Session settings, and shipping the package to the workers."""

from __future__ import annotations

import hashlib
import io
import os
import re
import zipfile
from pathlib import Path
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def builder(app: str = "loomstone", cores: str = "*") -> SparkSession.Builder:
    """A builder with the settings that the library is written for; the master of ``spark-submit`` or of the environment wins."""
    plain = SparkSession.builder.appName(app)
    if "MASTER" not in os.environ and "--master" not in os.environ.get("PYSPARK_SUBMIT_ARGS", "") and "PYSPARK_GATEWAY_PORT" not in os.environ:
        plain = plain.master(f"local[{cores}]")
    return (
        plain.config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Only a local session without one may take its warehouse."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path is None and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return (path or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared").rstrip("/")


def new_folder(spark: SparkSession) -> str:
    """The path of a folder below the shared one that nobody uses yet."""
    return f"{shared_folder(spark)}/stored-{uuid4().hex}"


def tasks(spark: SparkSession) -> int:
    """Tasks for work that costs far more than its rows weigh: three for each core, or as many as a shuffle has."""
    return max(3 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def spread(rows: DataFrame) -> DataFrame:
    """The rows dealt evenly over ``tasks``; a scan has one for each group of rows in a file, and a small file has but one group."""
    return rows.repartition(tasks(rows.sparkSession))


def share_package(spark: SparkSession) -> None:
    """Ship this package to the Python workers, once for each session.

    Executors need no copy of the repository and share no local folder with the
    driver: a zip of the sources goes into the shared folder and from there,
    through Spark, to every worker.
    """
    sc = spark.sparkContext
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as archive:
        for file in sorted(Path(ROOT, "loomstone").rglob("*.py")):
            archive.writestr(zipfile.ZipInfo(str(file.relative_to(ROOT))), file.read_bytes())
    name = f"loomstone-{hashlib.sha256(packed.getvalue()).hexdigest()[:16]}.zip"
    if name in sc._python_includes:
        return
    path = sc._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/{name}")
    out = path.getFileSystem(sc._jsc.hadoopConfiguration()).create(path, True)
    out.write(bytearray(packed.getvalue()))
    out.close()
    sc.addPyFile(path.toString())
