"""Folders for tables that are written to be read again: where the driver and all executors see them, deleted at the end."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import SparkSession

from specdag.errors import SpecError

_made: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names. A temporary one only if it names none and all run in one process."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise SpecError("SCRATCH", "spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="specdag-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def _clean() -> None:
    for path, spark in _made.items():
        with contextlib.suppress(Exception):  # the session may be gone when the interpreter ends
            delete(spark, path)


def scratch(spark: SparkSession, label: str) -> str:
    """A folder's path that nothing has used."""
    if not _made:
        atexit.register(_clean)
    path = f"{shared_dir(spark)}/specdag-{label}-{uuid.uuid4().hex}"
    _made[path] = spark
    return path


def forget(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder before the end."""
    if _made.pop(path, None):
        delete(spark, path)
