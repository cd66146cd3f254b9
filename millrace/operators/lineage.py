"""Cutting lineage in the shared folder the cluster names."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from functools import cache

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: that of ``spark.checkpoint.dir``.

    Only where that is unset, as in tests, and the session is local, a temporary folder stands in for it, which is removed when the
    process ends; on a cluster that would not be shared, so there it is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local[") and master != "local":
        raise RuntimeError("spark.checkpoint.dir is not set: name a folder that all executors share")
    return _temporary()


@cache
def _temporary() -> str:
    folder = tempfile.mkdtemp(prefix="millrace-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def checkpointed(spark: SparkSession, df: DataFrame) -> DataFrame:
    """``df`` written once to the checkpoint folder, :func:`shared_folder` unless the session has one, and read from there."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)
