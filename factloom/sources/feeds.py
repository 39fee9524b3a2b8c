"""News feeds and article lists as documents: RSS, Atom, article-list JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom import schemas
from factloom.functions import text
from factloom.operators import timestamps

_NONE = "cast(null as string)"


def _published(df: DataFrame, raw: Column) -> DataFrame:
    parsed = timestamps.resolve(timestamps.parse_fields(df.withColumn("_raw", raw), "_raw"), F.lit(None).cast("string"), "_us")
    return parsed.withColumn("published", F.timestamp_micros("_us")).drop("_us", "_raw")


def parse_gdelt(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """Documents of article-list JSON: source is the domain, the address makes the identifier; articles without address
    are left out, payloads that aren't JSON give none."""
    rows = payloads.select(F.explode(F.from_json(payload, schemas.GDELT)["articles"]).alias("a")).select("a.*").where("url is not null and url <> ''")
    source = F.lower(F.coalesce(F.when(F.col("domain") != "", F.col("domain")), F.lit("gdelt")))
    seen = F.when(F.col("seendate").rlike(r"^\d{8}T\d{6}Z$"), F.try_to_timestamp("seendate", F.lit("yyyyMMdd'T'HHmmss'Z'")))
    return rows.select(
        text.hashed_id(source, F.col("url")).alias("doc_id"), source.alias("source"), F.coalesce(F.when(F.col("title") != "", F.col("title")), F.col("url")).alias("title"), F.expr(_NONE).alias("summary"),
        "url", "language", F.col("sourcecountry").alias("country"), seen.alias("published"), F.to_json(F.struct("*")).alias("raw"),
    )


def parse_rss(feeds: DataFrame, xml: str = "xml", source: str = "source") -> DataFrame:
    """Documents of RSS 2.0 items; items without title are left out."""
    root = F.from_xml(F.col(xml), schemas.RSS, {"mode": "PERMISSIVE"})
    items = feeds.where(F.col(xml).rlike(r"(?is)^\s*(<\?xml.*?\?>\s*)?(<!--.*?-->\s*)*<rss\b")).select(source, F.explode(root["channel"]["item"]).alias("i"))
    rows = items.select(source, "i.*").withColumn("title", text.clean(F.col("title"))).where("title is not null")
    dated = _published(rows, F.col("pubDate"))
    link = F.trim("link")
    ident = F.coalesce(F.when(link != "", link), F.when(F.trim("guid") != "", F.trim("guid")), F.col("title"))
    return dated.select(
        text.hashed_id(F.col(source), ident).alias("doc_id"), source, "title", text.clean(F.col("description")).alias("summary"), F.when(link != "", link).alias("url"), "published",
        F.when(F.size("category") > 0, F.transform("category", lambda c: F.trim(c))).alias("tags"), F.to_json(F.struct("author")).alias("raw"),
    )


def parse_atom(feeds: DataFrame, xml: str = "xml", source: str = "source") -> DataFrame:
    """Documents of Atom entries: the alternate link, else the first; summary, else content; published, else updated."""
    root = F.from_xml(F.col(xml), schemas.ATOM, {"ignoreNamespace": "true"})
    rows = feeds.where(F.col(xml).rlike(r"(?is)^\s*(<\?xml.*?\?>\s*)?(<!--.*?-->\s*)*<feed\b")).select(source, F.explode(root["entry"]).alias("e")).select(source, "e.*")
    rows = rows.withColumn("title", text.clean(F.col("title"))).where("title is not null")
    best = F.filter("link", lambda k: k["_rel"].isNull() | (k["_rel"] == "alternate"))
    link = F.coalesce(F.get(best, F.lit(0))["_href"], F.get("link", F.lit(0))["_href"])
    dated = _published(rows.withColumn("_link", link), F.coalesce("published", "updated"))
    terms = F.filter(F.transform("category", lambda c: c["_term"]), lambda t: t.isNotNull())
    return dated.select(
        text.hashed_id(F.col(source), F.coalesce("_link", "id", "title")).alias("doc_id"), source, "title", F.coalesce(text.clean(F.col("summary")), text.clean(F.col("content"))).alias("summary"), F.col("_link").alias("url"), "published",
        F.when(F.size(terms) > 0, terms).alias("tags"), F.to_json(F.struct("author")).alias("raw"),
    )


def parse_feeds(feeds: DataFrame, xml: str = "xml", source: str = "source") -> tuple[DataFrame, DataFrame]:
    """(documents of all feeds, the feeds with an unknown root): one bad feed doesn't stop the others."""
    known = F.col(xml).rlike(r"(?is)^\s*(<\?xml.*?\?>\s*)?(<!--.*?-->\s*)*<(rss|feed)\b")
    return parse_rss(feeds, xml, source).unionByName(parse_atom(feeds, xml, source)), feeds.where(~F.coalesce(known, F.lit(False)))
