"""Session helpers: the package on every executor."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def ship(spark: SparkSession) -> SparkSession:
    """Send the package to the executors' Python workers, once for each Spark context.

    A worker that already has the package on its path is not affected.
    """
    context = spark.sparkContext
    if getattr(context, "_studyloom_shipped", False):
        return spark
    here = Path(__file__).resolve().parent
    folder = os.path.realpath(tempfile.mkdtemp(prefix="studyloom-"))
    atexit.register(shutil.rmtree, folder, ignore_errors=True)  # executors may fetch it at any time
    target = os.path.join(folder, "studyloom.zip")
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(here.rglob("*.py")):
            z.write(p, f"studyloom/{p.relative_to(here)}")
    context.addPyFile(target)
    context._studyloom_shipped = True
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where the master is local."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="loom-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder, removed when the driver ends: its lineage ends there."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
