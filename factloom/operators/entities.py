"""Entities of documents and their roll-up."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import text


# Labels of named entities that are kept.
KEPT = ("PERSON", "ORG", "GPE", "LOC", "NORP", "EVENT", "FAC")


def extractor(find: Callable[[str], list[tuple[str, str]]]):
    """A column function around any recogniser of (name, label) in a text; labels that aren't kept are left out. Batches
    travel by Arrow; the recogniser is called once a text, never for null or blank ones."""

    @F.pandas_udf("array<struct<name: string, type: string>>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"name": n.strip(), "type": k} for n, k in (find(t) if isinstance(t, str) and t.strip() else []) if k in KEPT] for t in texts], dtype=object)

    return run


def mentions(docs: DataFrame, ident: str, body: str, kind: str = "ENTITY", extract: Callable[[Column], Column] | None = None) -> DataFrame:
    """(ident, entity_id, name, type, count): names that a text holds, counted per document. Spellings of one id in a
    document count together, the smallest stands for them. `extract` (see extractor) takes the place of the capitalised
    spans, which all have one type."""
    found = extract(F.col(body)) if extract else F.transform(text.name_spans(F.col(body)), lambda n: F.struct(n.alias("name"), F.lit(kind).alias("type")))
    spans = docs.select(ident, F.explode(found).alias("_e")).select(ident, "_e.name", "_e.type").where("name <> ''")
    keyed = spans.withColumn("entity_id", text.entity_key(F.col("name"), F.col("type")))
    return keyed.groupBy(ident, "entity_id", "type").agg(F.min("name").alias("name"), F.count("*").cast("int").alias("count"))


def roll_up(edges: DataFrame, docs: DataFrame, at: str) -> DataFrame:
    """(entity_id, mentions, documents, first_seen, last_seen) from distinct edges; a null count is one mention. Computed
    anew from the edges, so running it twice changes nothing. Edges without their document have no time."""
    one = edges.groupBy("doc_id", "entity_id").agg(F.max(F.coalesce("count", F.lit(1))).alias("_n"))
    when = docs.select("doc_id", F.col(at).alias("_at"))
    return one.join(when, "doc_id", "left").groupBy("entity_id").agg(F.sum("_n").alias("mentions"), F.count("*").alias("documents"), F.min("_at").alias("first_seen"), F.max("_at").alias("last_seen"))
