"""Session helpers that every subpackage shares."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

BATCH_BYTES = 8 << 20
_SHIPPED: dict[str, str] = {}


def ship(spark: SparkSession) -> None:
    """Give this package to the Python workers of every executor, once per application.

    Functions of this package are pickled by reference, so a worker has to be able to import it
    wherever it runs; Spark's own file server hands out the archive.
    """
    sc = spark.sparkContext
    bound_batches(spark)
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    out = os.path.join(tempfile.mkdtemp(prefix="gleanery-"), "gleanery.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for path in sorted(root.rglob("*.py")):
            z.write(path, path.relative_to(root.parent))
    sc.addPyFile(out)
    _SHIPPED[sc.applicationId] = out


def bound_batches(spark: SparkSession) -> None:
    """Bound an Arrow batch to BATCH_BYTES where the session has Spark's default of 64 MB: JVM and worker hold each several times over."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if str(spark.conf.get(key)).lower().rstrip("b") == str(64 << 20):
        spark.conf.set(key, str(BATCH_BYTES))


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; where none is set, a temporary folder of this machine if all of Spark is on it, else an error."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return (shared or tempfile.mkdtemp(prefix="gleanery-")).rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder of the session."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def drop_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder and what it holds, if it is there."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
