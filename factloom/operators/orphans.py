"""References to records that do not exist (problem 2), as an incrementally kept ledger.

State lives in a folder of the shared file system:

- keys: the parent index as deltas, one for each batch (target, key, alive), folded into one now and then;
- refs: an append-only log of every reference seen, one part for each batch;
- pending: the references that wait for their parent, written anew by each batch;
- manifest: one small file for each applied batch, written last, that names the parts that count. A ledger opened on the
  folder goes on from the newest manifest; what a broken batch left behind isn't named there and is overwritten.

A batch writes what it brings and what is pending, never the index. New references probe the index, waiting ones only the
batch's own arrivals, deletions only look into the log of the targets they touch. All probes are equi-joins, so a key that
a third of all references name stays few rows on the index side and adaptive execution may split the other side.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.durable import fresh_path

REFERENCE = "ref_field string, target string, key string, doc_id string, entity_id string, at timestamp"
KEY = "target string, key string"
_COLUMNS = [c.split()[0] for c in REFERENCE.split(", ")]
#: Deltas of the parent index that are read together before they are folded into one.
DELTAS = 16


class OrphanLedger:
    """Pending-orphan state over batches of references, arrivals and deletions.

    References with a null key wait for ever (no parent has a null key); drop them first if null means no reference.
    Repeated references count once, in whatever batches they come. An empty batch leaves the state as it is. A batch
    whose id (a number or a text) was applied already is skipped, also after a restart, so a replay changes nothing.
    """

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark = spark
        self.path = path or fresh_path(spark, "ledger")
        newest = self._newest()
        self.version: int = newest.get("version", 0)
        self.applied: set[str] = set(newest.get("applied", []))
        self._keys: list[str] = newest.get("keys", [])
        self._logs: list[str] = newest.get("refs", [])
        self._gone: bool = newest.get("gone", False)

    def _hadoop(self):
        jvm = self.spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest")
        return folder, folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), jvm

    def _newest(self) -> dict:
        folder, files, _ = self._hadoop()
        if not files.exists(folder):
            return {}
        whole = [int(s.getPath().getName()[1:]) for s in files.listStatus(folder) if s.getPath().getName()[1:].isdigit() and files.exists(s.getPath().suffix("/_SUCCESS"))]
        return json.loads(self.spark.read.text(f"{self.path}/manifest/v{max(whole)}").first()[0]) if whole else {}

    def _commit(self, batch: object, version: int, keys: list[str], logs: list[str], gone: bool) -> None:
        state = {"version": version, "applied": sorted({*self.applied, str(batch)}), "keys": keys, "refs": logs, "gone": gone}
        self.spark.createDataFrame([(json.dumps(state),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/manifest/v{version}")
        self.version, self.applied, self._keys, self._logs, self._gone = version, set(state["applied"]), keys, logs, gone

    def _part(self, kind: str, name: str, ddl: str) -> DataFrame:
        return self.spark.read.schema(ddl).parquet(f"{self.path}/{kind}/{name}")

    @property
    def pending(self) -> DataFrame:
        return self._part("pending", f"v{self.version}", REFERENCE) if self.version else self.spark.createDataFrame([], REFERENCE)

    def _alive(self, parts: list[str], gone: bool) -> DataFrame:
        """Keys of the index; repeated where no delta deletes anything."""
        if not parts:
            return self.spark.createDataFrame([], KEY)
        own = reduce(DataFrame.unionByName, [self._part("keys", n, f"{KEY}, alive boolean").withColumn("_v", F.lit(i)) for i, n in enumerate(parts)])
        if not gone:
            return own.select("target", "key")
        return own.groupBy("target", "key").agg(F.max_by("alive", F.struct("_v", ~F.col("alive"))).alias("_alive")).where("_alive").select("target", "key")

    @property
    def keys(self) -> DataFrame:
        return self._alive(self._keys, self._gone).distinct()

    @property
    def refs(self) -> DataFrame:
        return self._read_logs(self._logs)

    def _read_logs(self, logs: list[str]) -> DataFrame:
        return reduce(DataFrame.unionByName, [self._part("refs", n, REFERENCE) for n in logs]) if logs else self.spark.createDataFrame([], REFERENCE)

    def apply(self, batch: object, refs: DataFrame | None = None, arrived: DataFrame | None = None, deleted: DataFrame | None = None) -> None:
        """One batch. `arrived` and `deleted`: (target, key); a key in both is gone afterwards."""
        if str(batch) in self.applied:
            return
        version = self.version + 1
        name, parts, logs, gone = f"v{version}", list(self._keys), list(self._logs), self._gone or deleted is not None
        changes = [d.select("target", "key", F.lit(alive).alias("alive")).where("key is not null") for d, alive in ((arrived, True), (deleted, False)) if d is not None]
        own_arrivals = None
        if changes:
            reduce(DataFrame.unionByName, changes).write.mode("overwrite").parquet(f"{self.path}/keys/{name}")
            parts.append(name)
            own_arrivals = self._alive([name], deleted is not None)
        waiting = self.pending
        if own_arrivals is not None and self.version:
            waiting = waiting.join(own_arrivals, ["target", "key"], "left_anti")
        if refs is not None:
            refs.select(*_COLUMNS).write.mode("overwrite").parquet(f"{self.path}/refs/{name}")
            logs.append(name)
            new = self._part("refs", name, REFERENCE).join(self._alive(parts, gone), ["target", "key"], "left_anti").select(*_COLUMNS)
            waiting = waiting.select(*_COLUMNS).unionByName(new)
        if deleted is not None:
            lost = self._part("keys", name, f"{KEY}, alive boolean").where("not alive").select("target", "key").distinct()
            targets = [r.target for r in lost.select("target").distinct().collect()]  # names of tables
            reopened = self._read_logs(self._logs).where(F.col("target").isin(targets)).join(lost, ["target", "key"], "left_semi")
            waiting = waiting.select(*_COLUMNS).unionByName(reopened.select(*_COLUMNS))
        waiting.select(*_COLUMNS).distinct().write.mode("overwrite").parquet(f"{self.path}/pending/{name}")
        if len(parts) > DELTAS:
            self._alive(parts, gone).distinct().withColumn("alive", F.lit(True)).write.mode("overwrite").parquet(f"{self.path}/keys/{name}-all")
            parts, gone = [f"{name}-all"], False
        self._commit(batch, version, parts, logs, gone)

    def snapshot(self) -> DataFrame:
        """Pending references by table, field and month of the reference."""
        field = F.split("ref_field", r"\.")
        return self.pending.groupBy(field[0].alias("table_name"), field[1].alias("field"), F.date_format("at", "yyyy-MM").alias("month")).agg(F.count("*").alias("orphans"))


def label_reference(label: Column) -> Column:
    """The key that a source label names: lower case without outer white space, null where blank."""
    key = F.lower(F.regexp_replace(label, r"^\s+|\s+$", ""))
    return F.when(key != "", key)


def corpus_references(articles: DataFrame, edges: DataFrame) -> DataFrame:
    """All references of the corpus tables: edges name articles and entities, articles name sources."""
    doc = edges.select(F.lit("document_entities.doc_id").alias("ref_field"), F.lit("articles").alias("target"), F.col("doc_id").alias("key"), "doc_id", "entity_id", F.col("extracted_at").alias("at"))
    ent = edges.select(F.lit("document_entities.entity_id").alias("ref_field"), F.lit("entities").alias("target"), F.col("entity_id").alias("key"), "doc_id", "entity_id", F.col("extracted_at").alias("at"))
    src = articles.select(F.lit("articles.source").alias("ref_field"), F.lit("sources").alias("target"), label_reference(F.col("source")).alias("key"), "doc_id", F.lit("").alias("entity_id"), F.col("ingested_at").alias("at")).where("key is not null")
    return doc.unionByName(ent).unionByName(src)


def corpus_parents(articles: DataFrame, entities: DataFrame, sources: DataFrame) -> DataFrame:
    """(target, key, at) of every record that can be named; at is null where a table doesn't say when a row arrived."""
    never = F.lit(None).cast("timestamp").alias("at")
    return (
        articles.groupBy("doc_id").agg(F.min("ingested_at").alias("at")).select(F.lit("articles").alias("target"), F.col("doc_id").alias("key"), "at")
        .unionByName(entities.select(F.lit("entities").alias("target"), F.col("entity_id").alias("key"), never))
        .unionByName(sources.select(F.lit("sources").alias("target"), label_reference(F.col("label")).alias("key"), never))
    ).where("key is not null")


def replay(spark: SparkSession, articles: DataFrame, edges: DataFrame, entities: DataFrame, sources: DataFrame, waves: int = 3) -> OrphanLedger:
    """A ledger after the whole corpus has passed through it in `waves` batches by time, late parents included.

    The cuts between the waves are equal parts of the time the references span; rows without a time come first."""
    refs, parents = corpus_references(articles, edges), corpus_parents(articles, entities, sources)
    span = edges.agg(F.unix_seconds(F.min("extracted_at")).alias("a"), F.unix_seconds(F.max("extracted_at")).alias("b")).first()
    ledger = OrphanLedger(spark)
    low, high = (span.a, span.b) if span and span.a is not None else (0, 0)
    at = lambda i: F.timestamp_seconds(F.lit(int(low + (high - low) * i / waves)))
    for i in range(waves):
        after = F.col("at").isNull() | (F.col("at") < at(1)) if i == 0 else (F.col("at") >= at(i))
        here = after if i in (0, waves - 1) else after & (F.col("at") < at(i + 1))
        if waves == 1:
            here = F.lit(True)
        ledger.apply(i, refs=refs.where(here), arrived=parents.where(here))
    return ledger
