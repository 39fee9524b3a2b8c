"""Writing documents and sources: deduplication, anti-joins, upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def last_of_batch(batch: DataFrame, key: str, order: Column) -> DataFrame:
    """One row per key, the last by `order`; rows without key are left out. Of ties in order the one whose values hash
    highest stays, so a second run keeps the same."""
    rows = batch.where(F.col(key).isNotNull())
    plain = [c for c, kind in rows.dtypes if "map<" not in kind and kind != "variant"]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), F.struct(order, F.xxhash64(*plain))).alias("_r")).select("_r.*")


def new_rows(batch: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """Rows of the batch whose key isn't stored yet."""
    return batch.join(existing.select(key).distinct(), key, "left_anti")


def known_rows(batch: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    return batch.join(existing.select(key).distinct(), key, "left_semi")


def persist(batch: DataFrame, existing: DataFrame, order: Column, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(rows to append, one row of counts: new, skipped, sources) of a batch against the stored table."""
    one = last_of_batch(batch, key, order)
    fresh = new_rows(one, existing, key)
    known = existing.select(F.col(key), F.lit(True).alias("_known")).distinct()
    counts = one.join(known, key, "left").agg(
        F.sum(F.when(F.col("_known").isNull(), 1).otherwise(0)).alias("new"), F.sum(F.when(F.col("_known"), 1).otherwise(0)).alias("skipped"), F.countDistinct("source").alias("sources")
    )
    return fresh, counts


def upsert(stored: DataFrame, arriving: DataFrame, key: str) -> DataFrame:
    """`stored` with the rows of `arriving` in place of or beside its own; arriving keys must be distinct."""
    return stored.join(arriving.select(key), key, "left_anti").unionByName(arriving)


def ensure_sources(labels: DataFrame, registry: DataFrame, label: str = "source") -> DataFrame:
    """A source row for each label: the registry's where it knows it, else the label itself with grade F."""
    named = labels.select(F.lower(label).alias("_k"), F.col(label).alias("label")).where("label is not null").distinct()
    known = registry.select(F.col("label").alias("_k"), "name", "kind", "reliability")
    return named.join(known, "_k", "left").select("label", F.coalesce("name", "label").alias("name"), F.coalesce("kind", F.lit("other")).alias("kind"), F.coalesce("reliability", F.lit("F")).alias("reliability"))
