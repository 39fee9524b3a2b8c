"""Structured Streaming around the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from factloom.operators import orphans, persist


def ingest(stream: DataFrame, table: str, checkpoint: str, order: str = "ingested_at") -> StreamingQuery:
    """Appends documents that the parquet table at `table` doesn't hold yet; a batch that runs again adds nothing."""

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table)
        # only a missing table counts as empty: any other failure to read it ends the batch, which then runs again
        there = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)
        stored = spark.read.parquet(table).select("doc_id") if there else batch.select("doc_id").limit(0)
        fresh, _counts = persist.persist(batch, stored, F.col(order))
        fresh.write.mode("append").parquet(table)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def keep_ledger(references: DataFrame, ledger: orphans.OrphanLedger, parents: DataFrame, checkpoint: str) -> StreamingQuery:
    """Feeds a stream of references (orphans.REFERENCE) to a ledger; `parents` (target, key) is read anew for each batch.

    Batches are known by their number, so one that is delivered twice is applied once."""

    def apply(batch: DataFrame, number: int) -> None:
        ledger.apply(number, refs=batch, arrived=parents)

    return references.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def bursts(stream: DataFrame, at: str, key: str, hours: int = 6, late: str = "1 hour") -> DataFrame:
    """Documents per key in sliding windows of `hours`, an online approximation of burstiness; later rows are dropped."""
    w = F.window(at, f"{hours} hours", "1 hour")
    return stream.withWatermark(at, late).groupBy(key, w).agg(F.count("*").alias("n")).select(key, F.col("window.start").alias("start"), "n")
