"""Assessment: hypotheses against evidence, confidence ceilings and caps, citations, effort routing, digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factloom import registries as R
from factloom.functions import grades, text


def label_number(label: Column) -> Column:
    """The first number of a label such as E1, 1 or [E1]; null without one."""
    return F.regexp_extract(F.coalesce(label, F.lit("")), r"(\d{1,9})", 1).try_cast("int")


def score_hypotheses(cells: DataFrame, evidence: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, hypothesis_pos, hypothesis, inconsistency, consistent, inconsistent, rank) of a matrix
    (hypothesis_pos, hypothesis, evidence, assessment) against evidence (n, reliability).

    Contradicting cells weigh by their source's grade; cells whose label is no evidence are dropped, but a hypothesis
    stays even if all its cells are. Least contradiction first, then more support, then the given order."""
    keys = keys or []
    weight = evidence.select(*keys, F.col("n").alias("_n"), grades.lookup(R.ACH_WEIGHT, F.upper(F.coalesce("reliability", F.lit("F"))), 0.5).alias("_w"))
    joined = cells.withColumn("_n", label_number(F.col("evidence"))).join(weight, [*keys, "_n"], "left")
    real = F.col("_w").isNotNull()
    against, supports = real & (F.col("assessment") == "inconsistent"), real & (F.col("assessment") == "consistent")
    scored = joined.groupBy(*keys, "hypothesis_pos", "hypothesis").agg(
        F.round(F.sum(F.when(against, F.col("_w")).otherwise(0.0)), 4).alias("inconsistency"), F.sum(supports.cast("int")).alias("consistent"), F.sum(against.cast("int")).alias("inconsistent")
    )
    scored = scored.na.fill({"consistent": 0, "inconsistent": 0})
    order = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    return scored.withColumn("rank", F.row_number().over(order.orderBy("inconsistency", F.desc("consistent"), "hypothesis_pos")))


def ceiling(evidence: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, ceiling): the highest confidence that each basis' distinct sources warrant."""
    rank = grades.lookup(R.RELIABILITY_RANK, F.substring(F.upper(F.trim(F.coalesce("reliability", F.lit("F")))), 1, 1), 0)
    best = evidence.groupBy(*keys, "source").agg(F.max(rank).alias("_r"))
    n = best.groupBy(*keys).agg(F.sum((F.col("_r") >= 3).cast("int")).alias("_c"), F.sum((F.col("_r") >= 4).cast("int")).alias("_b"))
    return n.select(*keys, F.when(F.col("_c") == 0, "low").when(F.col("_b") >= 2, "high").otherwise("moderate").alias("ceiling"))


def cap(confidence: Column, ceiling_: Column) -> Column:
    """The stated confidence, lowered to the ceiling where it is above; null stays null."""
    above = grades.lookup(R.CONFIDENCE_RANK, F.lower(confidence), 2) > grades.lookup(R.CONFIDENCE_RANK, ceiling_, 0)
    return F.when(confidence.isNull(), None).when(above, ceiling_).otherwise(confidence)


def cited_basis(evidence: DataFrame, citations: DataFrame, keys: list[str]) -> DataFrame:
    """The evidence that a brief cites, or all of it where no citation resolves."""
    cited = evidence.join(citations.select(*keys, "doc_id").distinct(), [*keys, "doc_id"], "left_semi")
    rest = evidence.join(cited.select(*keys).distinct(), keys, "left_anti")
    return cited.unionByName(rest)


def calibrate(samples: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, confidence, agreement): the most frequent of samples (pos, confidence), the first of equals, one level lower
    where fewer than two thirds agree."""
    n = samples.groupBy(*keys, "confidence").agg(F.count("*").alias("_n"), F.min("pos").alias("_first"))
    modal = n.groupBy(*keys).agg(F.sum("_n").alias("_all"), F.max_by(F.struct("confidence", "_n"), F.struct("_n", -F.col("_first"))).alias("_m"))
    agreement = F.col("_m._n") / F.col("_all")
    level = grades.lookup(R.CONFIDENCE_RANK, F.col("_m.confidence"), 0) - F.when(agreement < 2 / 3, 1).otherwise(0)
    return modal.select(*keys, F.element_at(text.words("low", "moderate", "high"), F.greatest(level, F.lit(0)) + 1).alias("confidence"), F.round(agreement, 2).alias("agreement"))


def resolve_citations(texts: DataFrame, ident: str, body: str, labels: DataFrame) -> DataFrame:
    """(ident, pos, doc_id): citations of a text in order, each document once, against labels (n, doc_id).

    A bracket of nothing but labels, numbers and document ids cites by bare numbers too; in any other bracket only E# and
    document ids count. What resolves to nothing is dropped."""
    brackets = texts.select(ident, F.posexplode(F.regexp_extract_all(text.text_or_empty(F.col(body)), F.lit(r"\[([^\]]+)\]"), F.lit(1))).alias("_b", "_inner"))
    tokens = brackets.select(ident, "_b", F.posexplode(F.filter(F.split(F.trim("_inner"), r"[,;\s]+"), lambda t: t != "")).alias("_t", "token"))
    ids = labels.select(F.col("doc_id").alias("token"), F.col("doc_id").alias("_by_id")).distinct()
    t = tokens.join(ids, "token", "left")
    shaped = F.col("_by_id").isNotNull() | F.col("token").rlike(r"^[Ee]?\d{1,9}$")
    pure = t.groupBy(ident, "_b").agg(F.bool_and(shaped).alias("_pure"))
    t = t.join(pure, [ident, "_b"]).withColumn("_n", F.when(F.col("token").rlike(r"^[Ee]\d{1,9}$") | (F.col("_pure") & F.col("token").rlike(r"^\d{1,9}$")), label_number(F.col("token"))))
    numbered = t.join(labels.select(F.col("n").alias("_n"), F.col("doc_id").alias("_by_n")), "_n", "left")
    found = numbered.withColumn("doc_id", F.coalesce("_by_id", "_by_n")).where("doc_id is not null").groupBy(ident, "doc_id").agg(F.min(F.struct("_b", "_t")).alias("_o"))
    return found.withColumn("pos", F.row_number().over(Window.partitionBy(ident).orderBy("_o"))).select(ident, "pos", "doc_id")


def effort(query: Column, all_low: Column, divergence: Column) -> Column:
    """'panel' for attribution questions, for low-grade sourcing only and for contested framing; else 'quick'."""
    band = divergence.isNotNull() & (divergence >= R.CONTESTED) & (divergence < R.SCATTERED)
    return F.when(text.asks_attribution(query) | F.coalesce(all_low, F.lit(False)) | band, "panel").otherwise("quick")


HEADERS = ("KEY JUDGMENTS", "CONFIDENCE", "KEY ASSUMPTIONS", "INDICATORS", "ALTERNATIVES", "INTELLIGENCE GAPS")


def sections(texts: DataFrame, ident: str, body: str) -> DataFrame:
    """(ident, section, pos, line): lines of a brief under its six headers, however these are decorated; text after a
    header on its own line is the section's first. Lines before any header and blank ones are left out."""
    lines = texts.select(ident, F.posexplode(F.split(text.text_or_empty(F.col(body)), r"\r?\n")).alias("pos", "_l")).withColumn("_l", F.trim("_l"))
    plain = F.regexp_replace("_l", r"^[#* ]+", "")
    head = F.coalesce(*[F.when(F.upper(plain).startswith(h), F.lit(h)) for h in HEADERS])
    marked = lines.withColumn("_h", head).withColumn("_rest", F.when(F.col("_h").isNotNull(), F.regexp_replace(F.expr("substring(regexp_replace(_l, '^[#* ]+', ''), length(_h) + 1)"), r"^[:*# ]+|[:*# ]+$", "")).otherwise(F.col("_l")))
    current = F.last("_h", ignorenulls=True).over(Window.partitionBy(ident).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    out = marked.withColumn("section", current).where("section is not null").withColumn("line", F.regexp_replace(F.trim("_rest"), r"^[-*•· ]+", ""))
    return out.where("line <> ''").select(ident, "section", "pos", "line")


def digest(items: DataFrame, keys: list[str], pos: str = "pos", most: int = 8) -> DataFrame:
    """(keys, body, judgments, citations, confidence): the extractive brief of the first `most` items."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(pos))
    top = items.withColumn("_n", nth).where(F.col("_n") <= most)
    line = F.concat(F.lit("- "), grades.rating(F.col("reliability"), F.col("credibility")), F.lit(" "), F.coalesce("source", F.lit("")), F.lit(": "), F.col("title"), F.lit(" ["), F.col("doc_id"), F.lit("]"))
    rows = top.withColumn("_line", line).withColumn("_j", F.concat("title", F.lit(" ["), F.col("doc_id"), F.lit("]")))
    agg = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_n", "_line", "_j", "doc_id"))).alias("_r"))
    return agg.select(*keys, F.array_join(F.transform("_r", lambda r: r["_line"]), "\n").alias("body"), F.transform(F.slice("_r", 1, 3), lambda r: r["_j"]).alias("judgments"), F.transform("_r", lambda r: r["doc_id"]).alias("citations"), F.lit("low").alias("confidence"))


def render_ranking(scores: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, text): scored hypotheses as numbered lines, the least contradicted first. A matrix has few hypotheses."""
    line = F.format_string("%d. %s  (disconfirm=%.2f, -%d/+%d)", F.col("rank"), F.col("hypothesis"), F.col("inconsistency"), F.col("inconsistent"), F.col("consistent"))
    lines = scores.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))).alias("_l"))
    return lines.select(*keys, F.array_join(F.transform("_l", lambda x: x["line"]), "\n").alias("text"))


def render_critiques(critiques: Column) -> Column:
    """Critiques (severity, target_hypothesis, challenged_claim, rationale, citations) as lines."""
    some = lambda c: F.when(F.length(F.coalesce(c, F.lit(""))) > 0, c)

    def line(c: Column) -> Column:
        cites = F.array_join(F.transform(F.coalesce(c["citations"], F.array().cast("array<string>")), lambda x: F.concat(F.lit("["), x, F.lit("]"))), " ")
        against = F.coalesce(F.concat(F.lit(" (vs "), some(c["target_hypothesis"]), F.lit(")")), F.lit(""))
        return F.rtrim(F.concat(F.lit("["), c["severity"], F.lit("]"), against, F.lit(" "), F.coalesce(some(c["challenged_claim"]), c["rationale"], F.lit("")), F.lit(" "), cites))

    return F.array_join(F.transform(critiques, line), "\n")


def render_finding(f: Column) -> Column:
    """A structured finding (key_judgments of judgment and citations, confidence, confidence_rationale, key_assumptions,
    indicators, alternative_hypothesis, collection_requirement, intelligence_gaps, critique_response) as a sectioned brief."""
    empty = F.array().cast("array<string>")
    listed = lambda c: F.when(F.size(F.coalesce(c, empty)) > 0, F.array_join(c, "; ")).otherwise("(none stated)")
    given = lambda c: F.when(F.length(F.coalesce(c, F.lit(""))) > 0, c)
    judgments = F.array_join(F.transform(f["key_judgments"], lambda j: F.rtrim(F.concat(F.lit("- "), j["judgment"], F.lit(" "), F.array_join(F.transform(F.coalesce(j["citations"], empty), lambda c: F.concat(F.lit("["), c, F.lit("]"))), " ")))), "\n")
    other = F.trim(F.concat_ws(" ", given(f["alternative_hypothesis"]), F.concat(F.lit("Collection requirement: "), given(f["collection_requirement"]))))
    part = lambda head, body: F.concat(F.lit(head), body)
    return F.concat_ws(
        "\n\n", part("KEY JUDGMENTS:\n", judgments), part("CONFIDENCE: ", F.concat(f["confidence"], F.lit(" — "), F.coalesce(f["confidence_rationale"], F.lit("")))), part("KEY ASSUMPTIONS: ", listed(f["key_assumptions"])),
        part("INDICATORS: ", listed(f["indicators"])), part("ALTERNATIVES: ", F.when(other != "", other).otherwise("(none stated)")), part("INTELLIGENCE GAPS: ", listed(f["intelligence_gaps"])),
        part("RED TEAM RESPONSE: ", given(f["critique_response"])),
    )


def neutral(hypotheses: DataFrame) -> DataFrame:
    """Cells for hypotheses (hypothesis_pos, hypothesis) of which nothing was assessed: they score nothing, in their order."""
    return hypotheses.select("hypothesis_pos", "hypothesis", F.lit(None).cast("string").alias("evidence"), F.lit("neutral").alias("assessment"))
