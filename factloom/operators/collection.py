"""Collection on demand: from a question's gaps to new documents and a second brief.

Driver-side control over batch jobs; what runs in them are the retrieval and persist operators. Fetching is any function
from a query text to documents, so nothing here needs a network.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom import registries as R
from factloom.durable import cut
from factloom.functions import text
from factloom.operators import assess, briefs, persist, retrieval

Fetch = Callable[[str], DataFrame]


def brief(docs: DataFrame, questions: DataFrame, sources: DataFrame) -> DataFrame:
    """(query_id, body, judgments, citations, confidence): the extractive brief of each question's evidence. Questions
    without any evidence have none."""
    found = retrieval.gather(docs, questions, sources)
    return assess.digest(found.withColumn("pos", F.col("pick")), ["query_id"])


def relevant_count(docs: DataFrame, questions: DataFrame) -> DataFrame:
    """(query_id, relevant): how many documents share a subject word with each question."""
    asked = questions.select("query_id", F.explode(text.relevance_tokens(F.col("query"))).alias("_t"))
    own = docs.select("doc_id", F.explode(text.singular_forms(text.content_tokens(F.concat_ws(" ", "title", "summary")))).alias("_t"))
    n = own.join(asked, "_t").select("query_id", "doc_id").distinct().groupBy("query_id").agg(F.count("*").alias("_n"))
    return questions.select("query_id").join(n, "query_id", "left").select("query_id", F.coalesce("_n", F.lit(0)).alias("relevant"))


def collect(docs: DataFrame, queries: list[str], fetch: Fetch) -> tuple[DataFrame, int, int]:
    """(documents with what was new, fetched, new) after fetching for each query. A fetch that fails brings nothing: that
    collection doesn't succeed is never why an answer fails."""
    got = None
    for q in queries:
        try:
            part = fetch(q)
            part = cut(part.select(*[c for c in docs.columns if c in part.columns]), "fetched")
        except Exception:  # the source is away
            continue
        got = part if got is None else got.unionByName(part, allowMissingColumns=True)
    if got is None:
        return docs, 0, 0
    # of one document fetched for several queries the values that hash highest stay
    fresh = cut(persist.new_rows(persist.last_of_batch(got, "doc_id", F.lit(0)), docs, "doc_id"), "fresh")
    return docs.unionByName(fresh, allowMissingColumns=True), got.count(), fresh.count()


@dataclass
class Answer:
    """What a question got: its triage, the briefs before and after collection (None: not made), what was collected."""

    triage: str
    before: DataFrame | None
    after: DataFrame | None
    queries: list[str]
    fetched: int = 0
    new: int = 0


def _one(docs: DataFrame, question: str) -> DataFrame:
    return docs.sparkSession.createDataFrame([(0, question)], "query_id int, query string")


def answer(docs: DataFrame, question: str, sources: DataFrame, fetch: Fetch) -> Answer:
    """A question's way: small talk and questions without any reporting get no brief; where reporting is thin it is
    collected first and the count taken again; else the brief is made from what is there."""
    q = _one(docs, question)
    decide = lambda d: relevant_count(d, q).join(q, "query_id").select(briefs.triage(F.col("query"), F.col("relevant")).alias("t")).first().t
    first = decide(docs)
    if first == "capabilities":
        return Answer(first, None, None, [])
    if first == "brief":
        return Answer(first, brief(docs, q, sources), None, [])
    more, fetched, new = collect(docs, [question], fetch)
    again = decide(more)
    before = brief(docs, q, sources) if first == "collect" else None
    if again == "no_reporting":
        return Answer(again, before, None, [question], fetched, new)
    return Answer(first, before, brief(more, q, sources), [question], fetched, new)


def loop(docs: DataFrame, question: str, sources: DataFrame, fetch: Fetch, gaps: Callable[[DataFrame], str], most: int = 4) -> Answer:
    """Brief, gaps, queries from the gaps, collection, brief again over the larger corpus. `gaps` names in words what a
    brief lacks; its capitalised names become the queries."""
    q = _one(docs, question)
    before = brief(docs, q, sources)
    named = docs.sparkSession.createDataFrame([(gaps(before),)], "gaps string").select(text.gap_queries(F.col("gaps"), most).alias("q")).first().q
    more, fetched, new = collect(docs, named, fetch)
    return Answer("brief", before, brief(more, q, sources) if new else before, named, fetched, new)
