"""Files that more than one executor must see."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir`` or by the context's own checkpoint folder.

    Where none is named, a new temporary folder is set on a local master, as in tests; any
    other master is an error, since its workers would write to their own disks.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        own = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = own.get() if own.isDefined() else None
    if not folder:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError(f"set spark.checkpoint.dir to a folder that all workers of {master} share")
        folder = tempfile.mkdtemp(prefix="twinscout-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def materialized(df: DataFrame, name: str = "step") -> DataFrame:
    """Write a table to the shared folder and continue from there.

    For small results read several times.  A lost executor then costs no rerun of what
    made them, and the files tell the optimizer their true size.
    """
    path = new_shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
