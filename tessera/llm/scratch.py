"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
_written: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only where that is unset and the master is local."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="tessera-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, which need not have it installed, and bound the session's Arrow batches where the caller hasn't."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        top = Path(__file__).resolve().parents[1]
        folder = tempfile.mkdtemp(prefix="tessera-code-")  # Spark's file server reads from it as long as the driver runs
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        shutil.copytree(top, Path(folder, "zipped", top.name), ignore=shutil.ignore_patterns("__pycache__"))
        context.addPyFile(shutil.make_archive(f"{folder}/{top.name}-shipped", "zip", f"{folder}/zipped"))
        _shipped.add(context.applicationId)
        for name, most in (("maxBytesPerBatch", BATCH_BYTES), ("maxRecordsPerBatch", BATCH_ROWS)):
            if spark.conf.get(f"spark.sql.execution.arrow.{name}", None) is None:
                spark.conf.set(f"spark.sql.execution.arrow.{name}", str(most))


#: Most bytes and rows of an Arrow batch: texts differ widely in length.
BATCH_BYTES, BATCH_ROWS = 16 << 20, 4096


def store(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: cuts the lineage, survives lost executors and gives Spark the true size."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tessera-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def forget(df: DataFrame) -> None:
    """Delete a table written by store() that nothing reads any more."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/tessera-" in path:
            _delete(df.sparkSession, path)
            _written[:] = [x for x in _written if not path.endswith(x[1].rsplit("/", 1)[1])]


@atexit.register
def clean() -> None:
    """Delete all tables written by store() in this process."""
    while _written:
        spark, path = _written.pop()
        try:
            if spark.sparkContext._jsc is not None:
                _delete(spark, path)
        except Exception:  # noqa: BLE001 - the session may be gone at exit
            return
