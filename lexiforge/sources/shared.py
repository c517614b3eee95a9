"""The folder that driver and executors share: paths in it, and tables that are computed once and kept there."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; only a local session without one gets a temporary folder, which goes with it."""
    sc = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared
    if not (sc.master.startswith("local[") or sc.master == "local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    own = tempfile.mkdtemp(prefix="lexiforge-files-")
    atexit.register(shutil.rmtree, own, True)
    return own


def scratch(spark: SparkSession) -> str:
    """A new path in that folder."""
    return f"{folder(spark)}/lexiforge-{uuid.uuid4().hex}"


def settled(df: DataFrame) -> DataFrame:
    """df, written to that folder and read from there, where it outlives lost executors."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(folder(df.sparkSession))
    return df.checkpoint(eager=True)
