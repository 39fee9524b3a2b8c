"""Streams give what the batch operators give."""

from datetime import datetime

from factloom.operators import orphans
from factloom.streaming import ingest


def test_ingest_is_idempotent(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = [("a", "s", datetime(2025, 1, 1)), ("a", "t", datetime(2025, 1, 2)), ("b", "s", datetime(2025, 1, 1))]
    df = spark.createDataFrame(rows, "doc_id string, source string, ingested_at timestamp")
    df.write.parquet(src)
    for run in range(2):
        stream = spark.readStream.schema(df.schema).parquet(src)
        ingest.ingest(stream, out, str(tmp_path / f"check{run}")).awaitTermination()
    assert sorted((r.doc_id, r.source) for r in spark.read.parquet(out).collect()) == [("a", "t"), ("b", "s")]


def test_ledger_stream(spark, tmp_path):
    src = str(tmp_path / "refs")
    refs = spark.createDataFrame([("t.f", "p", "k1", "d1", "", None), ("t.f", "p", "k2", "d2", "", None)], orphans.REFERENCE)
    refs.write.parquet(src)
    ledger = orphans.OrphanLedger(spark)
    parents = spark.createDataFrame([("p", "k1")], orphans.KEY)
    ingest.keep_ledger(spark.readStream.schema(refs.schema).parquet(src), ledger, parents, str(tmp_path / "c")).awaitTermination()
    assert [r.key for r in ledger.pending.collect()] == ["k2"]


def test_bursts(spark, tmp_path):
    src = str(tmp_path / "docs")
    df = spark.createDataFrame([("s", datetime(2025, 1, 1, 1)), ("s", datetime(2025, 1, 1, 2)), ("s", datetime(2025, 1, 5))], "source string, at timestamp")
    df.write.parquet(src)
    q = ingest.bursts(spark.readStream.schema(df.schema).parquet(src), "at", "source").writeStream.format("memory").queryName("bursts").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("bursts").agg({"n": "max"}).first()[0] == 2
