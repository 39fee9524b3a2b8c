"""Derived views over clusters: events with corroboration and divergence, narratives with coordination and techniques."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factloom import registries as R
from factloom.durable import cut
from factloom.functions import grades, vectors
from factloom.operators import intervals


#: Members of an event that one task compares with as many others.
BLOCK = 1000


def divergence(members: DataFrame, key: str, ident: str = "doc_id", vector: str = "embedding") -> DataFrame:
    """(key, divergence): one less the smallest cosine of two members, between 0 and 1; 0 for a single member. Vectors
    without length have cosine 0 with all. Members without a vector take no part; vectors of one key have one length.

    Angles are a metric. The member farthest from the centroid and the one farthest from it give a first large angle; two
    members whose angles to the centroid add up to no more can't be farther apart. What is left, mostly few, is compared in
    blocks by matrix products, so no row is made for a pair and no task holds an event."""
    rows = members.where(F.col(vector).isNotNull() & (F.size(vector) > 0)).select(F.col(key).alias("k"), F.col(ident).alias("i"), F.transform(vector, lambda x: x.cast("double")).alias("v")).distinct()
    rows = cut(rows.withColumn("n", F.sqrt(vectors.dot(F.col("v"), F.col("v")))), "framing")
    flat = rows.groupBy("k").agg(F.count("*").alias("_all"), F.count_if(F.col("n") == 0).alias("_flat"))
    unit = rows.where("n > 0").select("k", "i", F.transform("v", lambda x: F.try_divide(x, F.col("n"))).alias("v"))
    centre = vectors.centroids(unit, "k", "v").withColumnRenamed("centroid", "c")
    angle = lambda a, b: F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), vectors.cosine(F.col(a), F.col(b)))))
    placed = cut(unit.join(centre, "k").withColumn("t", angle("v", "c")).drop("c"), "framing-angles")
    start = placed.groupBy("k").agg(F.max_by("v", F.struct("t", "i")).alias("a"), F.max("t").alias("most"))
    first = cut(placed.join(start, "k").withColumn("c", vectors.cosine(F.col("v"), F.col("a"))).groupBy("k").agg(F.min("c").alias("c"), F.first("most").alias("most"), F.count("*").alias("m")), "framing-first")
    # two members are settled by that; of others only those that could be farther apart go on
    known = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("c"))))
    left = placed.join(first.where("m > 2").select("k", "most", known.alias("known")), "k").where(F.col("t") + F.col("most") > F.col("known") - 1e-9)
    sizes = left.groupBy("k").agg(F.count("*").alias("m"), F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")).where("m > 1").drop("m")
    dealt = left.join(sizes, "k").withColumn("own", F.pmod(F.xxhash64("i"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    meeting = dealt.select("*", other).select("k", "v", "own", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"))

    def compare(part: pd.DataFrame) -> pd.DataFrame:
        m, own = np.stack(part["v"].to_list()), part["own"].to_numpy()
        a, b = m[own == part["p"].iloc[0]], m[own == part["q"].iloc[0]]
        return pd.DataFrame({"k": part["k"].iloc[:1], "low": [float((a @ b.T).min()) if len(a) and len(b) else 1.0]})

    kind = members.schema[key].dataType.simpleString()
    low = meeting.groupBy("k", "p", "q").applyInPandas(compare, f"k {kind}, low double").unionByName(first.where("m > 1").select("k", F.col("c").alias("low"))).groupBy("k").agg(F.min("low").alias("low"))
    found = flat.join(low, "k", "left").withColumn("low", F.when((F.col("_flat") > 0) & (F.col("_all") > 1), F.least(F.coalesce("low", F.lit(0.0)), F.lit(0.0))).otherwise(F.col("low")))
    spread = F.when(F.col("_all") > 1, F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("low")))).otherwise(0.0)
    per = found.select(F.col("k").alias(key), spread.alias("divergence"))
    return members.select(key).distinct().join(per, key, "left").select(key, F.coalesce("divergence", F.lit(0.0)).alias("divergence"))


def event_view(membership: DataFrame, docs: DataFrame) -> DataFrame:
    """One row per event: its first member's title and summary, earliest time, documents, distinct sources, divergence."""
    m = membership.join(docs, "doc_id")
    rows = m.groupBy("event_id").agg(
        F.min_by("title", "step").alias("title"), F.min_by("summary", "step").alias("summary"), F.min("published").alias("occurred"), F.count("*").alias("doc_count"), F.countDistinct("source").alias("source_count")
    )
    return rows.join(divergence(m, "event_id"), "event_id")


def corroborated(membership: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_id, credibility): each member's grade from the number of distinct sources of its event."""
    m = membership.join(docs.select("doc_id", "source"), "doc_id")
    n = m.groupBy("event_id").agg(F.countDistinct("source").alias("_n"))
    return m.join(n, "event_id").select("doc_id", grades.credibility_of(F.col("_n")).alias("credibility"))


def contested(events: DataFrame, least: float = R.CONTESTED) -> Column:
    return (F.col("source_count") >= 2) & (F.col("divergence") >= least)


def burstiness(docs: DataFrame, key: str, at: Column, hours: float = R.COORDINATION_HOURS) -> DataFrame:
    """(key, burstiness): the largest share of a key's documents inside one closed span of `hours`.

    Documents without time count in the whole but in no span; fewer than two times give 0."""
    micros = int(hours * 3600 * 1_000_000)
    rows = docs.select(key, F.unix_micros(at).alias("_at"))
    most = intervals.sliding_counts(rows, key, "_at", micros).groupBy(F.col(key).alias("_k")).agg(F.max("n").alias("_max"))
    agg = rows.groupBy(key).agg(F.count("_at").alias("_known"), F.count("*").alias("_all")).join(most, F.col(key).eqNullSafe(F.col("_k")), "left")
    return agg.select(key, F.when(F.col("_known") >= 2, F.col("_max") / F.col("_all")).otherwise(0.0).alias("burstiness"))


def coordination(burst: Column, low_share: Column) -> Column:
    return F.round(burst * (F.lit(0.5) + F.lit(0.5) * low_share), 4)


def low_share(docs: DataFrame, key: str, reliability: Column) -> DataFrame:
    return docs.groupBy(key).agg(F.avg(F.when(grades.low_tier(reliability), 1.0).otherwise(0.0)).alias("low_share"))


#: Entries of a registry that every row may meet inside an expression.
CATALOGUE = 500


def nearest_techniques(rows: DataFrame, key: str, vector: str, catalogue: DataFrame, threshold: float = R.TECHNIQUE_COSINE, most: int = R.TECHNIQUE_TOP) -> DataFrame:
    """(key, technique_id, name, phase, score) of the `most` catalogue entries (with `embedding`) of highest cosine.

    The catalogue is a fixed registry, so every row meets all of it; different dimensions match nothing."""
    known = catalogue.orderBy("technique_id").limit(CATALOGUE + 1).collect()
    if len(known) > CATALOGUE:
        raise ValueError(f"more than {CATALOGUE} entries; a catalogue of that size is a table to search, not a registry")
    entries = F.array([F.struct(*[F.lit(r[c]).alias(c) for c in ("technique_id", "name", "phase")], F.array(*[F.lit(float(x)) for x in r["embedding"]]).alias("v")) for r in known])
    scored = F.transform(entries, lambda e: F.struct(vectors.cosine(F.col(vector), e["v"]).alias("score"), e["technique_id"].alias("technique_id"), e["name"].alias("name"), e["phase"].alias("phase")))
    good = F.filter(scored, lambda e: F.coalesce(e["score"] >= threshold, F.lit(False)))
    ranked = F.slice(F.array_sort(good, lambda a, b: F.when(a["score"] > b["score"], -1).when(a["score"] < b["score"], 1).when(a["technique_id"] < b["technique_id"], -1).otherwise(1)), 1, most)
    return rows.select(key, F.explode(ranked).alias("_e")).select(key, "_e.technique_id", "_e.name", "_e.phase", F.round("_e.score", 3).alias("score"))


def lexical_techniques(texts: DataFrame, key: str, body: str, catalogue: DataFrame, most: int = R.TECHNIQUE_TOP) -> DataFrame:
    """(key, technique_id, score) by the share of a technique's words (four letters or more) that a text holds; every text
    meets the whole catalogue (a fixed registry) through its words. Ties go by technique_id."""
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("([a-z]{4,})"), F.lit(1)))
    terms = catalogue.select("technique_id", words(F.concat_ws(". ", "name", "description")).alias("_t")).select("technique_id", F.size("_t").alias("_size"), F.explode("_t").alias("_w"))
    hits = texts.select(key, F.explode(words(F.col(body))).alias("_w")).join(terms, "_w").groupBy(key, "technique_id", "_size").agg(F.count("*").alias("_n"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(F.col("_n") / F.col("_size")), "technique_id"))
    return hits.withColumn("_r", rank).where(F.col("_r") <= most).select(key, "technique_id", (F.col("_n") / F.col("_size")).alias("score"))


def narrative_view(membership: DataFrame, docs: DataFrame, sources: DataFrame, catalogue: DataFrame | None = None) -> DataFrame:
    """One row per narrative: label, documents, distinct sources, first and last time, coordination and technique tags
    (null where nothing matches)."""
    grade = sources.select(F.col("label").alias("source"), "reliability")
    m = membership.join(docs, "doc_id").join(grade, "source", "left").withColumn("reliability", F.coalesce("reliability", F.lit("F")))
    rows = m.groupBy("narrative_id").agg(
        F.min_by("title", "step").alias("label"), F.min_by("summary", "step").alias("summary"), F.count("*").alias("doc_count"), F.countDistinct("source").alias("source_count"), F.min("published").alias("first_seen"), F.max("published").alias("last_seen")
    )
    scored = burstiness(m, "narrative_id", F.col("published")).join(low_share(m, "narrative_id", F.col("reliability")), "narrative_id")
    rows = rows.join(scored.select("narrative_id", coordination(F.col("burstiness"), F.col("low_share")).alias("coordination")), "narrative_id")
    if catalogue is None:
        return rows
    tags = nearest_techniques(vectors.centroids(m, "narrative_id", "embedding"), "narrative_id", "centroid", catalogue)
    tag = F.sort_array(F.collect_list(F.struct("score", "technique_id", "name", "phase")), asc=False).alias("disarm")
    return rows.join(tags.groupBy("narrative_id").agg(tag), "narrative_id", "left")
