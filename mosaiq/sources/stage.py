"""Cut lineage by a table in the folder that spark.checkpoint.dir names, which survives lost executors."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: list[str] = []


def root_of(spark: SparkSession) -> str:
    """This application's folder in the shared one. In local mode without that setting a temporary folder serves."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _OWN:
            _OWN.append(tempfile.mkdtemp(prefix="mosaiq-stage-"))
            atexit.register(shutil.rmtree, _OWN[0], True)
        root = f"file://{_OWN[0]}"
    return f"{root.rstrip('/')}/mosaiq/{spark.sparkContext.applicationId}"


def stage(df: DataFrame, label: str) -> DataFrame:
    """df, written and read back."""
    path = f"{root_of(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Delete all tables that this application has written on the way; results that read them must be written before."""
    target = spark._jvm.org.apache.hadoop.fs.Path(root_of(spark))
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
