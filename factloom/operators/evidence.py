"""Evidence items: lane rows to the common contract, deduplication by record and by episode.

Episode rule: an item joins the first cluster of its identity that has any member within the window. That depends on the
order of arrival, so it can't be a window function; but items on either side of a gap longer than the window never meet.
Identities are therefore cut at such gaps, sessions that fit the window are one cluster without any Python, and only the
rest go through a grouped map, with nothing but positions and times.
"""

from __future__ import annotations

import bisect

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factloom import durable
from factloom import registries as R
from factloom.functions import grades, text
from factloom.operators import intervals

EPISODE_SECONDS = R.EPISODE_MINUTES * 60


def iso_seconds(published: Column) -> Column:
    """Seconds since 1970 of an ISO date or date-time, with or without dashes and colons, with fractions (no zone: UTC);
    null for anything else."""
    iso = r"^(\d{4})-?(\d{2})-?(\d{2})(?:[Tt ](\d{2})(?::?(\d{2})(?::?(\d{2})(?:[.,](\d+))?)?)?(Z|[+-]\d{2}(?::?\d{2})?)?)?$"
    # dashes in a date stand at both places or at none, colons likewise
    even = published.rlike(r"^(\d{4}-\d{2}-\d{2}|\d{8})([Tt ]|$)") & ~published.rlike(r"[Tt ]\d{2}(:\d{2}\d|\d{2}:)")
    parts = F.split(F.regexp_replace(published, iso, "$1-$2-$3|$4|$5|$6|$7|$8"), r"\|")
    two = lambda i: F.when(parts[i] == "", "00").otherwise(parts[i])
    whole = F.unix_seconds(F.try_to_timestamp(F.concat(parts[0], F.lit("T"), two(1), F.lit(":"), two(2), F.lit(":"), two(3), F.lit("Z"))))
    fraction = F.when(parts[4] == "", 0).otherwise(F.rpad(F.substring(parts[4], 1, 6), 6, "0").try_cast("int")) / 1e6
    digits = F.regexp_replace(parts[5], "[^0-9]", "")
    east = (F.substring(digits, 1, 2).try_cast("int") * 60 + F.coalesce(F.substring(digits, 3, 2).try_cast("int"), F.lit(0))) * 60
    offset = F.when(digits == "", 0).when(parts[5].startswith("-"), -east).otherwise(east)
    return F.when(published.rlike(iso) & even, whole + fraction - offset)


def identity(source: Column, title: Column) -> Column:
    """Source and title without case and punctuation; null where either is empty."""
    t = F.trim(F.regexp_replace(F.lower(title), r"[^a-z0-9]+", " "))
    s = F.trim(F.lower(source))
    return F.when((s != "") & (t != ""), F.concat(s, F.lit("\x1f"), t))


def clusters(rows: DataFrame, window: float = EPISODE_SECONDS) -> DataFrame:
    """(pos, slot): for rows (pos, ident, at), the position of the first member of each row's episode.

    pos must be distinct; rows without identity or time are episodes of their own."""
    loose = rows.where("ident is null or at is null").select("pos", F.col("pos").alias("slot"))
    timed = rows.where("ident is not null and at is not null")
    cut = intervals.stretches(timed, ["ident"], "at", window, "_session")
    spans = cut.groupBy("ident", "_session").agg((F.max("at") - F.min("at")).alias("_span"), F.min("pos").alias("slot"))
    joined = durable.cut(cut.join(spans, ["ident", "_session"]), "sessions")
    simple = joined.where(F.col("_span") <= window).select("pos", "slot")

    def greedy(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("pos")
        # members of all clusters in order of time, each with its cluster's number: those within the window are a slice
        times: list[float] = []
        owner: list[int] = []
        firsts: list[int] = []
        slots = []
        for pos, at in zip(part["pos"], part["at"], strict=True):
            near = owner[bisect.bisect_left(times, at - window) : bisect.bisect_right(times, at + window)]
            hit = min(near, default=len(firsts))
            if hit == len(firsts):
                firsts.append(pos)
            k = bisect.bisect_right(times, at)
            times.insert(k, at)
            owner.insert(k, hit)
            slots.append(firsts[hit])
        return pd.DataFrame({"pos": part["pos"], "slot": slots})

    hard = joined.where(F.col("_span") > window).select("ident", "_session", "pos", "at").groupBy("ident", "_session").applyInPandas(greedy, "pos bigint, slot bigint")
    return loose.unionByName(simple).unionByName(hard)


def deduplicate(items: DataFrame, pos: str = "pos", by: str | None = None) -> DataFrame:
    """Evidence items in order of `pos` (distinct), each record and each episode of a source once.

    Items of one doc_id are one; of the rest, items of one source and title within the window are. The richest item
    (longest summary, an address, a time; the first of equals) stands in its episode's first place. Items without a
    usable time are only collapsed by doc_id; a null doc_id is equal to none. With `by`, items of different values of that
    column are never one."""
    part = F.concat(F.coalesce(F.col(by).cast("string"), F.lit("")), F.lit("\x1d")) if by else F.lit("")
    ranked = items.withColumn("_pos", F.col(pos).cast("bigint"))
    detail = F.struct(F.length(F.coalesce("summary", F.lit(""))), F.col("url").isNotNull(), F.col("published").isNotNull(), -F.col("_pos"))
    owner = F.concat(part, F.coalesce(F.col("doc_id"), F.concat(F.lit("\x1f"), F.col("_pos").cast("string"))))
    ranked = ranked.withColumn("_owner", owner).withColumn("_part", part)
    firsts = ranked.groupBy("_owner").agg(F.min("_pos").alias("_first"), F.min_by(F.struct("source", "title", "published", "_part"), "_pos").alias("_f"))
    firsts = durable.cut(firsts, "firsts")
    rows = firsts.select(F.col("_first").alias("pos"), F.concat(F.col("_f._part"), identity(F.col("_f.source"), F.col("_f.title"))).alias("ident"), iso_seconds(F.col("_f.published")).alias("at"))
    slot = clusters(rows).withColumnRenamed("pos", "_first")
    placed = ranked.join(firsts.select("_owner", "_first"), "_owner").join(slot, "_first")
    best = placed.groupBy("slot").agg(F.max_by(F.struct(*items.columns), detail).alias("_r"))
    return best.select("_r.*", "slot").withColumn(pos, F.col("slot")).drop("slot")


def episode_identity(detector: Column, mmsi: Column, icao24: Column, counterpart: Column, zone: Column) -> Column:
    """Detector with the unordered pair of subjects, the one subject, or the zone; null where nothing is known."""
    low = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    primary = F.when(low(mmsi) != "", low(mmsi)).otherwise(low(icao24))
    pair = F.array_join(F.array_sort(F.array(primary, low(counterpart))), "\x1f")
    subject = F.when((primary != "") & (low(counterpart) != ""), pair).when(primary != "", primary).when(low(zone) != "", F.concat(F.lit("zone:"), low(zone)))
    return F.when(low(detector) != "", F.concat(low(detector), F.lit("\x1e"), subject))


def deduplicate_episodes(rows: DataFrame, pos: str = "pos") -> DataFrame:
    """Detections in order of `pos`, repeated ones of the same subjects within the window once, the richest (zone, longest
    summary, address; the first of equals) in the first one's place."""
    ident = episode_identity(F.col("detector"), F.col("mmsi"), F.col("icao24"), F.col("counterpart_mmsi"), F.col("zone"))
    keyed = rows.withColumn("_pos", F.col(pos).cast("bigint"))
    slot = clusters(keyed.select(F.col("_pos").alias("pos"), ident.alias("ident"), iso_seconds(F.col("published")).alias("at"))).withColumnRenamed("pos", "_pos")
    full = lambda c: F.length(F.coalesce(c, F.lit("")))
    detail = F.struct(full(F.col("zone")) > 0, full(F.col("summary")), full(F.col("url")) > 0, -F.col("_pos"))
    best = keyed.join(slot, "_pos").groupBy("slot").agg(F.max_by(F.struct(*rows.columns), detail).alias("_r"))
    return best.select("_r.*", "slot").withColumn(pos, F.col("slot")).drop("slot")


def geoint_items(rows: DataFrame, lane: str, base_url: str = "") -> DataFrame:
    """Detections as evidence: identifiers carry the lane, relative addresses the base, grades are validated, the zone is
    named unless the text has it. Rows without identifier or title are left out."""
    t = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))
    body = F.when(t("summary") != "", t("summary")).otherwise(t("title"))
    zone = F.when((t("zone") != "") & ~F.contains(F.lower(body), F.lower(t("zone"))), F.concat(F.lit(" Zone: "), t("zone"), F.lit("."))).otherwise("")
    url = F.when(F.col("url").startswith("/"), F.concat(F.lit(base_url), F.col("url"))).when(F.col("url") != "", F.col("url"))
    return rows.where((t("doc_id") != "") & (t("title") != "")).select(
        F.concat(F.lit(f"{lane}:"), t("doc_id")).alias("doc_id"), t("title").alias("title"), F.lit(lane).alias("source"), grades.as_reliability(F.col("reliability")).alias("reliability"),
        grades.as_credibility(F.col("credibility")).alias("credibility"), F.concat(body, zone).alias("summary"), F.when(F.col("published") != "", F.col("published")).alias("published"), url.alias("url"),
        *[c for c in rows.columns if c not in R_EVIDENCE],
    )


R_EVIDENCE = ("doc_id", "title", "source", "reliability", "credibility", "summary", "published", "url")


def alias_scan(texts: DataFrame, ident: str, body: str, actors: DataFrame) -> DataFrame:
    """(ident, actor, nation) of the threat actors that a text names, by name or alias, on word boundaries.

    Aliases that are everyday words are never scanned for; those of chemical elements only as they are written. The
    alias table is a fixed registry, so it becomes two alternations, longest name first; matches meet it by equi-join."""
    names = sorted({n for row in R.rows(R.ACTORS) for n in (row[0], *row[2].split(","))}, key=lambda n: (-len(n), n))
    loose = [n for n in names if n.lower() not in R.UNSCANNED_ALIASES and n not in R.CASED_ALIASES]
    scan = lambda flags, some: F.regexp_extract_all(text.text_or_empty(F.col(body)), F.lit(flags + r"\b(" + "|".join(n.replace(".", r"\.") for n in some) + r")\b"), F.lit(1))
    found = F.concat(scan("(?i)", loose), scan("", [n for n in names if n in R.CASED_ALIASES]))
    aliases = actors.select(F.col("name").alias("actor"), "nation", F.explode(F.concat(F.array("name"), "aliases")).alias("_n")).select("actor", "nation", F.lower("_n").alias("_n"))
    hits = texts.select(ident, F.explode(F.array_distinct(F.transform(found, lambda n: F.lower(n)))).alias("_n"))
    return hits.join(aliases, "_n").select(ident, "actor", "nation").distinct()


def campaign_text(c: DataFrame) -> Column:
    parts = [F.when(F.col(k) != "", F.col(k)) for k in ("name", "title", "label", "description", "summary")]
    return F.concat_ws(" ", *parts, F.filter(F.transform(F.coalesce("reports", F.array()), lambda r: r["title"]), lambda t: t != ""))


def technique_ids(techniques: Column) -> Column:
    ids = F.transform(F.coalesce(techniques, F.array()), lambda t: F.coalesce(F.when(t["technique_id"] != "", t["technique_id"]), t["id"]))
    return F.filter(ids, lambda i: F.coalesce(i != "", F.lit(False)))


def rank_campaigns(campaigns: DataFrame, techniques: DataFrame | None, pos: str = "pos") -> DataFrame:
    """Campaigns that share techniques (technique_id) with a question, most shared first, then in their own order.

    None (the mapper is away) passes all through in their order; an empty table (the question isn't about cyber) gives
    none: the two are different states."""
    if techniques is None:
        return campaigns.withColumn("overlap", F.lit(None).cast("bigint"))
    own = campaigns.select(pos, F.explode(F.array_distinct(technique_ids(F.col("techniques")))).alias("technique_id"))
    shared = own.join(techniques.select("technique_id").distinct(), "technique_id").groupBy(pos).agg(F.count("*").alias("overlap"))
    return campaigns.join(shared, pos).orderBy(F.desc("overlap"), pos)


def campaign_items(campaigns: DataFrame, actors: DataFrame, pos: str = "pos", lane: str = "cyber") -> DataFrame:
    """Campaigns as evidence of grade B: what they link, exploited vulnerabilities, recency and attributions in the text."""
    named = alias_scan(campaigns.withColumn("_t", campaign_text(campaigns)), pos, "_t", actors)
    actor_list = named.groupBy(pos).agg(F.array_sort(F.collect_set("actor")).alias("_actors"), F.array_sort(F.collect_set("nation")).alias("_nations"))
    c = campaigns.join(actor_list, pos, "left")
    some = lambda col: F.coalesce(col, F.array())
    listed = lambda col, n: F.when(F.size(some(col)) > 0, F.array_join(F.slice(some(col), 1, n), ", ")).otherwise("n/a")
    cid = F.coalesce(F.when(F.col("campaign_id") != "", F.col("campaign_id")), F.when(F.col("id") != "", F.col("id")), F.lit("?"))
    stated = grades.as_int(F.col("report_count"))
    reports = F.when(stated != 0, stated).otherwise(F.size(some(F.col("reports"))))
    exploited = F.size(some(F.col("kev_cves"))) > 0
    credibility = F.when(exploited, F.least(grades.credibility_of(reports), F.lit(2))).otherwise(grades.credibility_of(reports))
    age = grades.as_float(F.col("age_days"))
    note = lambda when, *parts: F.when(when, F.concat(*parts)).otherwise("")
    summary = F.concat(
        F.lit("Cyber campaign linking "), reports.cast("string"), F.lit(" CTI reports. CVEs: "), listed(F.col("cve_ids"), 5), F.lit(". ATT&CK: "), listed(technique_ids(F.col("techniques")), 6), F.lit("."),
        note(exploited, F.lit(" KEV: confirmed exploitation in the wild ("), F.array_join(F.slice(some(F.col("kev_cves")), 1, 3), ", "), F.lit(").")),
        note(age.isNotNull(), F.lit(" Most recent report ~"), F.format_string("%.0f", F.rint(age)), F.lit("d ago.")),
        note(F.col("_actors").isNotNull(), F.lit(" Attributed in open reporting to "), F.array_join("_actors", ", "), F.lit(" ("), F.array_join("_nations", ", "), F.lit(") — contested, human-review.")),
    )
    title = F.concat(F.lit("Cyber threat campaign "), cid, note(exploited, F.lit(" [KEV]")), note(F.col("_nations").isNotNull(), F.lit(" — "), F.array_join("_nations", ", ")))
    return c.select(pos, F.concat(F.lit(f"{lane}:"), cid).alias("doc_id"), title.alias("title"), F.lit(lane).alias("source"), F.lit("B").alias("reliability"), credibility.alias("credibility"), summary.alias("summary"))


def lines(items: DataFrame, pos: str = "pos") -> DataFrame:
    """(label, doc_id, line): items in order of `pos` as E1, E2, … and as they are shown to readers. For a bounded context."""
    n = F.row_number().over(Window.orderBy(pos))
    labelled = items.withColumn("label", F.concat(F.lit("E"), n.cast("string")))
    when = F.when(F.length(F.coalesce("published", F.lit(""))) > 0, F.concat(F.lit(" ("), F.col("published"), F.lit(")"))).otherwise("")
    body = F.coalesce(F.when(F.col("summary") != "", F.col("summary")), F.col("title"))
    line = F.concat(
        F.lit("["), "label", F.lit("] "), grades.rating(F.col("reliability"), F.col("credibility")), F.lit(" ("), grades.reliability_label(F.col("reliability")), F.lit("; "),
        grades.credibility_label(F.col("credibility")), F.lit(") "), "source", when, F.lit(": "), "title", F.lit(". "), body,
    )
    return labelled.select(pos, "label", "doc_id", line.alias("line"))


def relevant(query_tokens: Column, title: Column, summary: Column) -> Column:
    """Whether an item shares a subject token with the question; everything does where the question has none."""
    own = text.singular_forms(text.content_tokens(F.concat_ws(" ", title, summary)))
    return (F.size(query_tokens) == 0) | F.arrays_overlap(query_tokens, own)
