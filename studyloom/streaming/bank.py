"""A question bank fed by a stream.

Questions arrive in files; within the watermark a repeated stem of a module
is dropped by state, and each micro-batch inserts what its bank does not have
yet.  The bank is a folder of one sub-folder for each batch id, so a batch
that runs again after a failure overwrites its own output and adds nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..functions import text as T
from ..operators.tables import fresh


def arriving(spark: SparkSession, path: str, schema: str, watermark: str = "1 day") -> DataFrame:
    """Questions (module_id, stem, created_at ...) with their stem key, each once within the watermark."""
    rows = spark.readStream.schema(schema).json(path).withColumn("normalized_stem", T.stem_key(F.col("stem")))
    return rows.withWatermark("created_at", watermark).dropDuplicatesWithinWatermark(["module_id", "normalized_stem"])


def feed(rows: DataFrame, bank_path: str, checkpoint: str) -> StreamingQuery:
    """Start a query that merges arriving questions into the bank and ends when all are in."""

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        root = spark._jvm.org.apache.hadoop.fs.Path(bank_path)
        files = root.getFileSystem(spark._jsc.hadoopConfiguration())
        others = [s.getPath().toString() for s in files.listStatus(root)] if files.exists(root) else []
        others = [p for p in others if not p.endswith(f"/batch={batch_id}")]
        bank = spark.read.parquet(*others) if others else batch.limit(0)
        new = fresh(batch, bank, [F.col("created_at"), F.col("stem")])
        new.write.mode("overwrite").parquet(f"{bank_path}/batch={batch_id}")

    return rows.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def activity(events: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """Answers by module and day over a stream of events (ts, module_id), late ones up to the watermark."""
    return events.withWatermark("ts", watermark).groupBy(F.window("ts", "1 day"), "module_id").agg(F.count("*").alias("answers"))
