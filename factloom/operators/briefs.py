"""Stored briefs: triage of questions, rendering, snapshots, lookups, rebuilds, evaluation reports."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factloom import registries as R
from factloom.functions import text

#: Fields of a snapshot, in order.
SNAPSHOT = ("brief_id", "query", "body", "key_judgments", "citations", "confidence", "gaps", "backend")
MARKS = ("<!-- measured:begin -->", "<!-- measured:end -->")


def triage(query: Column, relevant: Column, thin: int = R.THIN_COVERAGE) -> Column:
    """What a question gets before any brief: 'capabilities' for small talk, 'no_reporting' where nothing is relevant,
    'collect' where fewer than `thin` items are, else 'brief'. Unknown counts are none."""
    n = F.coalesce(relevant, F.lit(0))
    return F.when(text.is_meta(query), "capabilities").when(n == 0, "no_reporting").when(n < thin, "collect").otherwise("brief")


def render(b: DataFrame) -> Column:
    """A brief as text: question, judgments with confidence, gaps, cited documents. Empty parts are left out."""
    listed = lambda c: F.array_join(F.transform(F.col(c), lambda x: F.concat(F.lit("- "), x)), "\n")
    part = lambda head, body, there: F.when(there, F.concat(F.lit(head + "\n"), body))
    return F.concat_ws(
        "\n\n", F.concat(F.lit("QUESTION: "), "query"), part("KEY JUDGMENTS", listed("key_judgments"), F.size("key_judgments") > 0), part("CONFIDENCE", F.col("confidence"), F.length("confidence") > 0),
        part("INTELLIGENCE GAPS", F.col("gaps"), F.length("gaps") > 0), part("CITED", listed("citations"), F.size("citations") > 0),
    )


def null_if_empty(c: str) -> Column:
    return F.when(F.size(c) > 0, F.col(c))


def worth_storing(briefs: DataFrame) -> DataFrame:
    """Briefs but for canned answers."""
    return briefs.where(F.coalesce("backend", F.lit("")) != "triage")


def append(briefs: DataFrame, path: str) -> None:
    worth_storing(briefs).write.mode("append").parquet(path)


def rebuild(view: DataFrame, path: str) -> None:
    """A derived view written anew in place of what was there."""
    view.write.mode("overwrite").parquet(path)


def snapshot(briefs: DataFrame) -> DataFrame:
    """(brief_id, line): briefs that a model wrote, as JSON of fixed fields."""
    kept = briefs.where("backend is not null and backend not in ('template', 'triage')")
    return kept.select("brief_id", F.to_json(F.struct(*SNAPSHOT)).alias("line"))


def plain(question: Column) -> Column:
    """A question without case and with single blanks."""
    return F.regexp_replace(F.lower(F.trim(question)), r"\s+", " ")


def same_question(a: Column, b: Column) -> Column:
    """Whether two questions are equal but for case and white space."""
    return plain(a) == plain(b)


def saved(briefs: DataFrame, query: str, limit: int = 1) -> DataFrame:
    """The newest stored answers of a model to a question."""
    kept = briefs.where("backend is not null and backend not in ('template', 'triage')")
    return kept.where(same_question(F.col("query"), F.lit(query))).orderBy(F.desc("created_at"), "brief_id").limit(limit)


def saved_for(briefs: DataFrame, questions: DataFrame, query: str = "query_id", limit: int = 1) -> DataFrame:
    """(query, brief_id, place): saved() for a table of questions (query, question) at once, by one equi-join."""
    kept = briefs.where("backend is not null and backend not in ('template', 'triage')").select("brief_id", "created_at", plain(F.col("query")).alias("_q"))
    met = questions.select(query, plain(F.col("question")).alias("_q")).join(kept, "_q")
    place = F.row_number().over(Window.partitionBy(query).orderBy(F.desc_nulls_last("created_at"), "brief_id"))
    return met.withColumn("place", place).where(F.col("place") <= limit).select(query, "brief_id", "place")


def report(metrics: Mapping[str, float]) -> str:
    """Measured values as a Markdown table."""
    return "\n".join(["| metric | value |", "|-|-|", *(f"| {k} | {v:.3f} |" for k, v in metrics.items())])


def replace_block(document: str, block: str) -> str:
    """`document` with `block` between its marks; appended with marks where it has none."""
    begin, end = MARKS
    marked = f"{begin}\n{block}\n{end}"
    pattern = re.compile(re.escape(begin) + r".*?" + re.escape(end), re.S)
    return pattern.sub(lambda _: marked, document, count=1) if pattern.search(document) else f"{document.rstrip()}\n\n{marked}\n"
