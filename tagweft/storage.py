"""Files that the driver and all executors can see.

Intermediate tables go to the folder named by ``spark.checkpoint.dir``, so that a
lost executor takes nothing with it. Only a local session without that setting
(the tests) gets a temporary folder of its own.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []
_own: dict[str, str] = {}
_shipped: set[str] = set()


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables; raises on a cluster that names none."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not context.master.startswith("local[") and context.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _own.setdefault(context.applicationId, tempfile.mkdtemp(prefix="tagweft-"))


def new_path(spark: SparkSession, label: str) -> str:
    """An unused path in the shared folder; what is written there goes when the driver ends."""
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(_remove_all)
    _written.append((spark, path))
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table that nothing will read any more."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _remove_all() -> None:
    for spark, path in _written:
        with contextlib.suppress(Exception):  # the JVM may have gone first
            remove(spark, path)


def stored(frame: DataFrame, label: str) -> DataFrame:
    """Write ``frame`` to the shared folder and read it back: this cuts its lineage."""
    spark = frame.sparkSession
    path = new_path(spark, label)
    frame.write.parquet(path)
    table = spark.read.schema(frame.schema).parquet(path)
    table.stored_at = path
    return table


def release(table: DataFrame) -> None:
    """Delete the files of a table that :func:`stored` gave, once no plan reads it any more."""
    path = table.stored_at
    remove(table.sparkSession, path)
    _written.remove((table.sparkSession, path))


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once a session."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    _shipped.add(context.applicationId)
    top = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="tagweft-")) / f"{top.name}.zip"
    with zipfile.ZipFile(path, "w") as out:
        for file in sorted(top.rglob("*.py")):
            out.write(file, file.relative_to(top.parent))
    context.addPyFile(str(path))
