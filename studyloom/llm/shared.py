"""Written intermediate tables and connected components."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    A cluster names it in spark.checkpoint.dir.  Where that is unset, a local
    session gets a temporary folder; on any other master that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise RuntimeError(f"spark.checkpoint.dir must name a folder that the driver and all executors share; the master is {master}")
        folder = "file://" + tempfile.mkdtemp(prefix="loom-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def fresh_names(df: DataFrame, *names: str) -> list[str]:
    """The names, with as many underscores in front as keep them apart from all columns of df."""
    taken = {c.lower() for c in df.columns}
    lead = ""
    while any((lead + n).lower() in taken for n in names):
        lead += "_"
    return [lead + n for n in names]


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver's JVM ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: lineage ends there, and a lost executor costs no recomputation."""
    path = fresh_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession, path: str) -> None:
    """Delete a path of fresh_path(), once nothing reads it any more."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def removed(df: DataFrame) -> None:
    """Delete what written() made."""
    for f in {f.rpartition("/")[0] for f in df.inputFiles()}:
        dropped(df.sparkSession, f)


def cleaned(spark: SparkSession) -> None:
    """Let go of the shuffles of finished steps.

    Spark deletes the files of a shuffle once the driver's JVM has collected
    what refers to it.  A driver that holds little seldom collects, while the
    files of steps whose results are written stay on the executors' disks.
    The driver's Python gives freed memory back as well.
    """
    textkit.lean()
    spark._jvm.System.gc()


def executors_cleaned(spark: SparkSession) -> None:
    """Have the executors' JVMs collect garbage and give what they no longer fill back to the system.

    A heap grows over a loop of jobs to its limit, however little of it lives,
    and counts against the executor beside the Python workers.  As many
    tasks as cores reach every executor, unless one is slow to take any.
    """
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).selectExpr("java_method('java.lang.System', 'gc') AS done").write.format("noop").mode("overwrite").save()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of edges (a, b): root is the least node reachable.

    Alternating large-star and small-star rounds, each a min-aggregation and
    a join, written to the shared folder.  Every round at least halves the
    height of the trees, so the number of rounds is logarithmic.  Both sides
    of a link are never gathered in one row or task.
    """
    def state(links: DataFrame) -> tuple:
        return tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())

    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    seen = state(now)
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))).alias("x")).select("x.*").where("a <> b").distinct()
        then = written(small, "links")
        removed(now)
        now, was, seen = then, seen, state(then)
        if seen == was:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
