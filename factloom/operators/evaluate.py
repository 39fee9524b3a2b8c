"""Retrieval, citation, routing and entailment metrics."""

from __future__ import annotations

from collections.abc import Callable, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.functions import grades, text


def retrieval_metrics(ranked: DataFrame, relevant: DataFrame, ks: tuple[int, ...] = (1, 3, 5), query: str = "query_id") -> DataFrame:
    """(query, recall_k…, rr) of rankings (query, doc_id, rank) against relevant pairs. A question with nothing relevant
    isn't in the result."""
    hit = relevant.select(query, "doc_id").distinct().join(ranked.select(query, "doc_id", "rank"), [query, "doc_id"], "left")
    recalls = [F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0)).alias(f"recall_{k}") for k in ks]
    return hit.groupBy(query).agg(*recalls, F.coalesce(F.lit(1.0) / F.min("rank"), F.lit(0.0)).alias("rr"))


def citation_coverage(judgments: Column) -> Column:
    """Share of judgments with a marker; 0 for none."""
    cited = F.size(F.filter(judgments, lambda j: j.rlike(r"\[[^\]]+\]")))
    return F.when(F.size(judgments) > 0, cited / F.size(judgments)).otherwise(0.0)


def fabricated(markers: Column, known: Column) -> Column:
    """How many different markers name nothing known."""
    return F.size(F.array_except(markers, known))


def routing_metrics(cases: DataFrame) -> DataFrame:
    """One row of micro precision, recall and exact share over (predicted, expected) arrays."""
    tp, fp, fn = (F.sum(F.size(e)) for e in (F.array_intersect("predicted", "expected"), F.array_except("predicted", "expected"), F.array_except("expected", "predicted")))
    exact = F.avg((F.array_sort("predicted") == F.array_sort("expected")).cast("double"))
    return cases.agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), exact.alias("exact"), F.count("*").alias("cases")).select(
        F.when(F.col("tp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(0.0).alias("precision"), F.when(F.col("tp") > 0, F.col("tp") / (F.col("tp") + F.col("fn"))).otherwise(0.0).alias("recall"),
        F.coalesce("exact", F.lit(0.0)).alias("exact"), "cases",
    )


def overlap_scorer(premise: Column, hypothesis: Column) -> Column:
    """A deterministic stand-in for an entailment model: the share of the hypothesis' content words in the premise."""
    h = text.content_tokens(hypothesis)
    return F.when(F.size(h) > 0, F.size(F.array_intersect(h, text.content_tokens(premise))) / F.size(h)).otherwise(0.0)


def model_scorer(predict: Callable[[list[tuple[str, str]]], list[float]]):
    """A pandas UDF around any function that scores (premise, hypothesis) pairs."""

    @F.pandas_udf(T.DoubleType())
    def score(premise: pd.Series, hypothesis: pd.Series) -> pd.Series:
        return pd.Series(predict(list(zip(premise, hypothesis, strict=True))))

    return score


def entailment_probability(logits: Column, index: int = 1) -> Column:
    """The share of one class in a classifier's logits, by softmax; null for none."""
    top = F.array_max(logits)
    parts = F.transform(logits, lambda x: F.exp(x - top))
    return F.when(F.size(logits) > index, F.get(parts, F.lit(index)) / F.aggregate(parts, F.lit(0.0), lambda a, x: a + x))


def entailment(briefs: DataFrame, evidence: DataFrame, threshold: float = 0.5, scorer: Callable[[Column, Column], Column] = overlap_scorer, key: str = "brief_id", atomic: bool = True) -> DataFrame:
    """(key, claims, faithfulness, support): the shares of the claims of each brief's judgments that some evidence of it
    (key, n, doc_id, title, summary) entails, and that evidence cited by the judgment, as E# or by its id, entails.

    Atomic: each clause of a judgment is a claim; otherwise the judgment, without its markers, is one. Briefs without
    evidence have no claims; judgments without words are left out."""
    judged = briefs.select(key, F.posexplode("judgments").alias("_j", "_judgment")).withColumn("_m", text.citation_markers(F.col("_judgment")))
    whole = F.trim(F.regexp_replace("_judgment", r"\s*\[[^\]]*\]", ""))
    said = text.claims(F.col("_judgment")) if atomic else F.array(whole)
    claims = judged.select(key, "_j", "_m", F.posexplode(said).alias("_c", "claim")).where(F.trim("claim") != "")
    own = evidence.select(key, F.concat_ws(". ", "title", F.when(F.col("summary") != "", F.col("summary"))).alias("_p"), F.array(F.concat(F.lit("E"), F.col("n").cast("string")), F.col("doc_id")).alias("_names"))
    scored = claims.join(own, key).withColumn("_ok", F.coalesce(scorer(F.col("_p"), F.col("claim")) >= threshold, F.lit(False)))
    each = scored.groupBy(key, "_j", "_c").agg(F.bool_or("_ok").alias("_any"), F.bool_or(F.col("_ok") & F.arrays_overlap("_m", "_names")).alias("_cited"))
    found = each.groupBy(key).agg(F.count("*").alias("claims"), F.avg(F.col("_any").cast("double")).alias("faithfulness"), F.avg(F.coalesce("_cited", F.lit(False)).cast("double")).alias("support"))
    none = {"claims": 0, "faithfulness": 0.0, "support": 0.0}
    return briefs.select(key).distinct().join(found, key, "left").na.fill(none)


def agreement(cases: DataFrame, threshold: float = 0.5, scorer: Callable[[Column, Column], Column] = overlap_scorer) -> DataFrame:
    """One row (agreement, cases): how often a scorer and people (premise, hypothesis, entailed) decide alike; 1 for no case."""
    same = ((scorer(F.col("premise"), F.col("hypothesis")) >= threshold) == F.col("entailed")).cast("double")
    return cases.agg(F.coalesce(F.avg(same), F.lit(1.0)).alias("agreement"), F.count("*").alias("cases"))


def brief_metric(judgments: Column, confidence: Column, cap: Column) -> Column:
    """Citation coverage, but nothing for a brief that is surer than its cap."""
    return F.when(grades.exceeds(F.lower(F.trim(confidence)), cap), 0.0).otherwise(citation_coverage(judgments))


def ablation(rankings: Mapping[str, DataFrame], relevant: DataFrame, ks: tuple[int, ...] = (1, 3, 5, 10, 20), query: str = "query_id") -> DataFrame:
    """(ranker, k, recall, mrr): rankers (query, doc_id, rank) side by side, means over the questions."""
    rows = None
    for name, ranked in rankings.items():
        m = retrieval_metrics(ranked, relevant, ks, query)
        means = m.agg(F.avg("rr").alias("mrr"), *[F.avg(f"recall_{k}").alias(f"recall_{k}") for k in ks])
        one = means.select(F.lit(name).alias("ranker"), F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"recall_{k}").alias("recall")) for k in ks])).alias("_r"), "mrr").select("ranker", "_r.k", "_r.recall", "mrr")
        rows = one if rows is None else rows.unionByName(one)
    return rows


def evaluation(ranked: DataFrame, relevant: DataFrame, briefs: DataFrame, evidence: DataFrame, k: int = 3, query: str = "query_id") -> DataFrame:
    """(metric, value) of a whole run over labelled questions: mean recall and reciprocal rank of the retrieval, citation
    coverage, markers that name no evidence (n, doc_id) and confidences above their cap of the briefs (query, judgments,
    confidence, cap), faithfulness and support of their claims."""
    r = retrieval_metrics(ranked, relevant, (k,), query).agg(F.avg(f"recall_{k}").alias(f"mean recall@{k}"), F.avg("rr").alias("MRR"))
    names = evidence.groupBy(query).agg(F.array_union(F.collect_set("doc_id"), F.collect_set(F.concat(F.lit("E"), F.col("n").cast("string")))).alias("_known"))
    marks = F.array_distinct(F.flatten(F.transform("judgments", text.citation_markers)))
    b = briefs.join(names, query, "left").agg(
        F.avg(citation_coverage(F.col("judgments"))).alias("citation coverage"), F.sum(fabricated(marks, F.coalesce("_known", F.array().cast("array<string>")))).cast("double").alias("fabricated citations"),
        F.sum(grades.exceeds(F.lower("confidence"), F.col("cap")).cast("double")).alias("confidence breaches"), F.avg(brief_metric(F.col("judgments"), F.col("confidence"), F.col("cap"))).alias("brief metric"),
    )
    e = entailment(briefs, evidence, key=query).agg(F.avg("faithfulness").alias("faithfulness"), F.avg("support").alias("citation support"))
    wide = r.crossJoin(b).crossJoin(e)  # one row each
    return wide.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(f"`{c}`").cast("double").alias("value")) for c in wide.columns])).alias("_r")).select("_r.*")
