"""Routing of questions to lanes and fusion of what the lanes give."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom import durable
from factloom import registries as R
from factloom.functions import text
from factloom.operators import evidence, intervals


def lanes(query: Column, names: Mapping[str, list[str]] = R.LANE_NAMES) -> Column:
    """The lanes that a question goes to, in lane order: all if it asks for all; those it names; all if it has no subject;
    else open sources and every lane whose vocabulary it touches."""
    everything = text.words(*R.LANES)
    q = text.text_or_empty(query)
    named = F.filter(everything, lambda lane: F.coalesce(*[F.when(lane == n, q.rlike("(?i)" + "|".join(p))) for n, p in names.items()], F.lit(False)))
    subject = text.subject_tokens(q)
    both = F.array_union(subject, F.transform(F.filter(subject, lambda t: t.endswith("s")), lambda t: F.regexp_replace(t, "s$", "")))
    touched = F.filter(everything, lambda lane: (lane == "osint") | F.coalesce(*[F.when(lane == n, F.arrays_overlap(both, text.words(*w))) for n, w in R.LANE_WORDS.items()], F.lit(False)))
    return F.when(text.asks_all_sources(q), everything).when(F.size(named) > 0, named).when(F.size(subject) == 0, everything).otherwise(touched)


def reason(query: Column, names: Mapping[str, list[str]] = R.LANE_NAMES) -> Column:
    """Which of the four rules decided."""
    q = text.text_or_empty(query)
    named = q.rlike("(?i)" + "|".join(p for ps in names.values() for p in ps))
    return F.when(text.asks_all_sources(q), "all sources asked for").when(named, "named lanes").when(F.size(text.subject_tokens(q)) == 0, "no subject").otherwise("open sources and lanes whose words occur")


def _lane_number(lane: str = "lane") -> Column:
    return F.coalesce(*[F.when(F.col(lane) == n, F.lit(i)) for i, n in enumerate(R.LANES)], F.lit(len(R.LANES)))


def interleave(items: DataFrame, pos: str = "pos", lane: str = "lane", limits: Mapping[str, int] | None = None) -> DataFrame:
    """Items (lane, pos, …) with `pos` renumbered so that the lanes take turns, in lane order; of a lane with a limit only
    its first so many."""
    numbered = intervals.row_numbers(items, lane, pos, "_turn")
    for name, most in (limits or {}).items():
        numbered = numbered.where((F.col(lane) != name) | (F.col("_turn") <= most))
    return numbered.withColumn(pos, (F.col("_turn") * (len(R.LANES) + 1) + _lane_number(lane)).cast("bigint")).drop("_turn")


def fuse(by_lane: Mapping[str, DataFrame], limits: Mapping[str, int] | None = None) -> DataFrame:
    """The routed lanes' evidence: each deduplicated and limited, taken in turns, deduplicated across lanes. All lanes go
    through each step together, their name being part of what has to be equal."""
    parts = [by_lane[lane].withColumn("lane", F.lit(lane)) for lane in R.LANES if lane in by_lane]
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p, allowMissingColumns=True)
    apart = union.withColumn("pos", (F.col("pos") * (len(R.LANES) + 1) + _lane_number()).cast("bigint"))
    own = evidence.deduplicate(apart, by="lane")
    return evidence.deduplicate(durable.cut(interleave(own, limits=limits), "lanes"))


def gather(spark, question: str, fetch: Mapping[str, Callable[[str], DataFrame]], limits: Mapping[str, int] | None = None) -> tuple[DataFrame, list[str]]:
    """Evidence of the lanes that a question goes to, and these lanes. A sibling lane that fails is left out; the open
    source lane's errors pass on."""
    routed = spark.range(1).select(lanes(F.lit(question)).alias("l")).first().l
    got = {}
    for lane in routed:
        try:
            if lane in fetch:
                got[lane] = fetch[lane](question)
        except Exception:
            if lane == "osint":
                raise
    return fuse(got, limits), routed


def or_salient(filtered: DataFrame, salient: DataFrame) -> DataFrame:
    """The items that fit a question, or the most salient ones where none does."""
    return salient if filtered.isEmpty() else filtered


def overfetch(rows: DataFrame, keep: Column, limit: int, pos: str = "pos") -> DataFrame:
    """Rows that fit among the first ten times `limit` (at most POOL_MOST), episodes once, at most `limit`."""
    pool = rows.orderBy(pos).limit(min(limit * R.OVERFETCH, R.POOL_MOST))
    return evidence.deduplicate_episodes(pool.where(keep)).orderBy(pos).limit(limit)


def lane_counts(items: DataFrame, lane: str = "lane") -> DataFrame:
    return items.groupBy(lane).agg(F.count("*").alias("n"))


_STATUS = "lane string, label string, configured boolean, reachable boolean, count bigint, count_label string, last_doc_id string, last_title string, detail string"


def overview(spark, fetch: Mapping[str, Callable[[], DataFrame]], labels: Mapping[str, str] | None = None) -> DataFrame:
    """One row per lane, in lane order: whether it is set up and answers, how many items it holds, its latest item.

    `fetch` gives a lane's items (doc_id, title, published as time). Lanes are asked side by side; one that fails is
    reported as unreachable and hides no other, but the open-source lane's errors pass on, since that is the own store."""

    def ask(lane: str) -> tuple:
        label = (labels or {}).get(lane, lane.title())
        if lane not in fetch:
            return lane, label, False, False, None, "items", None, None, "not set up"
        newest = F.max_by(F.struct("doc_id", "title"), F.struct(F.col("published").isNotNull(), "published", "doc_id"))
        try:
            row = fetch[lane]().agg(F.count("*").alias("n"), newest.alias("last")).first()
        except Exception:
            if lane == "osint":
                raise
            return lane, label, True, False, None, "items", None, None, "status check failed"
        return lane, label, True, True, row.n, "documents" if lane == "osint" else "items", row.last and row.last.doc_id, row.last and row.last.title, None

    with ThreadPoolExecutor(max_workers=len(R.LANES)) as pool:
        rows = list(pool.map(ask, R.LANES))
    return spark.createDataFrame(rows, _STATUS)
