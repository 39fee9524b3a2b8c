"""Filling thin documents with the text of their pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions import text


def hydrate(docs: DataFrame, pages: DataFrame, most: int | None = None) -> DataFrame:
    """Documents with the main text of their landed page (url, html) as summary where they had too little.

    A filled document loses its embedding, since that was of the old text. Documents whose page is missing or has no
    prose stay as they are; `most` limits how many are filled, the smallest identifiers first."""
    thin = docs.where(text.needs_text(F.col("url"), F.col("summary"))).select("doc_id", "url")
    if most is not None:
        thin = thin.orderBy("doc_id").limit(most)
    one = pages.groupBy("url").agg(F.first("html").alias("html"))
    found = thin.join(one, "url").select("doc_id", text.main_text(F.col("html")).alias("_text")).where("_text <> ''")
    filled = docs.join(found, "doc_id", "left")
    out = filled.withColumn("summary", F.coalesce("_text", "summary")).withColumn("hydrated", F.col("_text").isNotNull())
    if "embedding" in docs.columns:
        out = out.withColumn("embedding", F.when(F.col("_text").isNull(), F.col("embedding")))
    return out.drop("_text")
