"""Folders for tables that end lineage: in the folder that driver and executors share, gone when the driver's Python ends."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import SparkSession

_local: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, else the session's own; without either a folder of this machine, in local mode only."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        sc = spark.sparkContext
        set_by_session = sc._jsc.sc().getCheckpointDir()
        if set_by_session.isDefined():
            named = set_by_session.get()
        elif sc.master.startswith("local") and not sc.master.startswith("local-cluster"):
            named = _local.setdefault(sc.applicationId, "file://" + tempfile.mkdtemp(prefix="tarnfold-"))
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return named.rstrip("/")


def own_dir(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder, removed when the driver's Python ends."""
    path = f"{shared_dir(spark)}/tarnfold/{what}-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    try:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # noqa: BLE001  the session may have ended before
        pass
