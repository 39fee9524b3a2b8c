"""Queries of the analytics engine's own operators over the corpus tables, with their SQL.

`documents` of the data model is the table `articles` (one row per doc_id, the latest arrival); vectors come from
`embeddings` on the numeric documents. Small literal tables stand for lane payloads and briefs, which the corpus lacks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factloom import registries as R
from factloom import schemas
from factloom.durable import cut
from factloom.functions import grades, text, vectors
from factloom.operators import assess, briefs, clustering, collection, entities, evaluate, evidence, export, fusion, intervals, orphans, persist, retrieval, timestamps, views
from factloom.plans import problems
from factloom.session import table
from factloom.sources import feeds, pages

_QUERIES: dict = {}
_SQL: dict[str, str] = {}


def op(sql: str | None = None):
    """Registers a query under its function's name."""

    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def docs(spark: SparkSession, root: str) -> DataFrame:
    """The latest arrival of each article, its published time read from any spelling (null where no single instant is meant)."""
    rows = persist.last_of_batch(table(spark, root, "articles"), "doc_id", F.col("ingested_at"))
    timed = timestamps.normalise(rows, table(spark, root, "sources"), out="published_at")
    return timed.withColumn("published_at", F.timestamp_micros("published_at")).withColumn("source_key", timestamps.label_key(F.col("source")))


DOCS = r"""docs AS (SELECT *, nullif(lower(regexp_replace(source, '^\s+|\s+$', '', 'g')), '') AS source_key
  FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ingested_at DESC) AS rn FROM articles) WHERE rn = 1)"""
#: The same with the instant of every spelling of the published time.
TIMED = problems._instants() + r""", docs AS (SELECT a.*, make_timestamp(f.utc_micros) AS published_at, nullif(lower(regexp_replace(a.source, '^\s+|\s+$', '', 'g')), '') AS source_key
  FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ingested_at DESC) AS rn FROM articles) a
  LEFT JOIN (SELECT DISTINCT record_key, published, utc_micros FROM found WHERE table_name = 'articles' AND utc_micros IS NOT NULL) f ON f.record_key = a.doc_id AND f.published = a.published WHERE rn = 1)"""


def graded(spark: SparkSession, root: str) -> DataFrame:
    """Documents with their source's grade, F where it isn't known."""
    grade = table(spark, root, "sources").select(timestamps.label_key(F.col("label")).alias("source_key"), F.col("reliability").alias("grade"), "name")
    return docs(spark, root).join(grade, "source_key", "left").withColumn("reliability", F.coalesce("grade", F.lit("F")))


_GRADED = """, graded AS (SELECT d.*, s.name, coalesce(s.reliability, 'F') AS reliability FROM docs d LEFT JOIN sources s ON d.source_key = lower(s.label))"""
GRADED = DOCS + _GRADED
TIMED_GRADED = TIMED + _GRADED


def vdocs(spark: SparkSession, root: str) -> DataFrame:
    """Numeric documents with vector, time, title (first line) and summary (the rest)."""
    emb = table(spark, root, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding", "label")
    d = table(spark, root, "documents")
    return d.join(emb, "doc_id").select("doc_id", "source", F.col("collected_at").alias("published"), F.get(F.split("text", "\n"), F.lit(0)).alias("title"), F.col("text").alias("summary"), "embedding", F.col("label").alias("topic"))


VDOCS = """vdocs AS (SELECT d.doc_id, d.source, d.collected_at AS published, e.embedding, e.label AS topic FROM documents d JOIN embeddings e ON e.vec_id = d.doc_id)"""


def encoded(spark: SparkSession, root: str) -> DataFrame:
    """Articles with vectors of their titles and the time they were published."""
    d = docs(spark, root).select("doc_id", F.col("source_key").alias("source"), "title", "summary", F.col("published_at").alias("published"), F.lit(None).cast("array<float>").alias("embedding"))
    return cut(vectors.encode_missing(d, "title"), "articles-encoded")


def golds(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "eval_items").where("kind = 'gold_query'").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"), "expectation")


GOLDS = "golds AS (SELECT item_id AS query_id, text AS query, expectation FROM eval_items WHERE kind = 'gold_query')"


def literal(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def values(rows: list, names: str) -> str:
    """Rows as an SQL VALUES list."""

    def one(v) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, (list, tuple)):
            return "[" + ", ".join(map(one, v)) + "]"
        return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)

    return "(VALUES " + ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows) + f") AS t({names})"


def sql_list(words) -> str:
    return "[" + ", ".join("'" + w + "'" for w in words) + "]"


# ---- sources

@op(r"""SELECT coalesce(nullif(lower(a.source), ''), 'gdelt') || ':' || sha256(url)[:24] AS doc_id, coalesce(nullif(lower(a.source), ''), 'gdelt') AS source, CASE WHEN title = '' THEN url ELSE title END AS title, url,
  epoch_us(date_trunc('second', ingested_at)) AS published_us FROM articles a WHERE url <> ''""")
def op_S2_gdelt_parse(spark, root):
    """Article-list JSON, made of the whole table, parsed again."""
    a = table(spark, root, "articles")
    row = F.struct("url", "title", F.col("source").alias("domain"), "language", F.col("country").alias("sourcecountry"), F.date_format("ingested_at", "yyyyMMdd'T'HHmmss'Z'").alias("seendate"))
    payload = a.select(F.to_json(F.struct(F.array(row).alias("articles"))).alias("payload"))
    return feeds.parse_gdelt(payload).select("doc_id", "source", "title", "url", F.unix_micros("published").alias("published_us"))


PHRASES = [(1, "US and IRAN dynamics"), (2, "What does the EU say on grain"), (3, "an ox"), (4, "U.S. strike near Hodeidah, Yemen"), (5, "UN envoy in Kyiv")]


_SHORT = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in R.SHORT_NAMES.items())
_ASKED = f"asked AS (SELECT query_id, query FROM golds UNION ALL SELECT * FROM {values([(-i, p) for i, p in PHRASES], 'query_id, query')})"
_KEYWORDS = rf"""word AS (SELECT query_id, unnest(string_split_regex(trim(query), '\s+')) AS w, generate_subscripts(string_split_regex(trim(query), '\s+'), 1) AS i FROM asked),
  bare AS (SELECT *, regexp_replace(w, '^[,.;:!?()]+|[,.;:!?()]+$', '', 'g') AS b FROM word),
  kept AS (SELECT query_id, i, coalesce(CASE lower(b) {_SHORT} END, CASE WHEN length(b) >= 3 THEN w END) AS k FROM bare),
  keywords AS (SELECT a.query_id, coalesce(string_agg(k, ' ' ORDER BY i), any_value(query)) AS keywords FROM asked a LEFT JOIN kept ON kept.query_id = a.query_id AND k IS NOT NULL GROUP BY 1)"""


@op(f"WITH {GOLDS}, {_ASKED}, {_KEYWORDS} SELECT * FROM keywords")
def op_S3_keyword_query(spark, root):
    rows = golds(spark, root).select("query_id", "query").unionByName(literal(spark, [(-i, p) for i, p in PHRASES], "query_id bigint, query string"))
    return rows.select("query_id", text.keyword_query(F.col("query")).alias("keywords"))


@op(rf"""WITH {GOLDS}, {_ASKED}, {_KEYWORDS}, noun AS (SELECT query_id, t, min(i) AS i FROM (SELECT query_id, unnest(n) AS t, generate_subscripts(n, 1) AS i
    FROM (SELECT query_id, regexp_extract_all(query, '(?:^|[^\p{{L}}\p{{M}}\p{{N}}_])([A-Z][\p{{L}}\p{{M}}\p{{N}}_.''-]*[\p{{L}}\p{{M}}\p{{N}}_]|[A-Z])', 1) AS n FROM asked)) GROUP BY ALL),
  shown AS (SELECT query_id, i, coalesce(CASE lower(t) {_SHORT} END, CASE WHEN length(t) >= 3 THEN CASE WHEN t = upper(t) THEN upper(t[1]) || lower(t[2:]) ELSE t END END) AS k FROM noun),
  joined AS (SELECT query_id, string_agg(k, ' ' ORDER BY i) AS nouns FROM shown WHERE k IS NOT NULL GROUP BY 1)
  SELECT a.query_id, CASE WHEN nouns <> keywords THEN nouns END AS nouns FROM asked a JOIN keywords USING (query_id) LEFT JOIN joined j ON j.query_id = a.query_id""")
def op_S4_proper_noun_query(spark, root):
    rows = golds(spark, root).select("query_id", "query").unionByName(literal(spark, [(-i, p) for i, p in PHRASES], "query_id bigint, query string"))
    return rows.select("query_id", text.proper_noun_query(F.col("query")).alias("nouns"))


def _xml(c: str):
    return F.replace(F.replace(F.replace(F.coalesce(F.col(c), F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


@op()
def op_S5_rss(spark, root):
    """Every article as an RSS item of a feed of its own, read again."""
    a = docs(spark, root).withColumn("source_key", F.coalesce("source_key", F.lit("unknown")))
    xml = F.concat(F.lit("<rss version='2.0'><channel><title>t</title><item><title>"), _xml("title"), F.lit("</title><link>"), _xml("url"), F.lit("</link><description>"), _xml("summary"), F.lit("</description><pubDate>"), _xml("published"), F.lit("</pubDate></item></channel></rss>"))
    return feeds.parse_rss(a.select(F.col("source_key").alias("source"), xml.alias("xml"))).select("doc_id", "source", "title", "summary", F.unix_micros("published").alias("published_us"))


@op()
def op_S6_atom(spark, root):
    a = docs(spark, root).withColumn("source_key", F.coalesce("source_key", F.lit("unknown")))
    xml = F.concat(F.lit("<feed xmlns='http://www.w3.org/2005/Atom'><title>t</title><entry><title>"), _xml("title"), F.lit("</title><link rel='self' href='x:y'/><link rel='alternate' href='"), F.replace(_xml("url"), F.lit("'"), F.lit("&apos;")), F.lit("'/><id>"), _xml("doc_id"), F.lit("</id><summary>"), _xml("summary"), F.lit("</summary><updated>"), _xml("published"), F.lit("</updated></entry></feed>"))
    return feeds.parse_atom(a.select(F.col("source_key").alias("source"), xml.alias("xml"))).select("doc_id", "source", "title", "summary", F.unix_micros("published").alias("published_us"))


@op("SELECT label AS source FROM sources WHERE length(label) % 3 = 0")
def op_S7_unknown_feeds(spark, root):
    """Sources whose payload is no feed at all: here those whose label has a length divisible by three."""
    s = table(spark, root, "sources").select(F.col("label").alias("source"), F.when(F.length("label") % 3 == 0, "<html/>").otherwise("<rss><channel/></rss>").alias("xml"))
    return feeds.parse_feeds(s)[1].select("source")


@op(r"""SELECT doc_id, nullif(trim(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(summary, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'),
  '&#39;', ''''), '&#x27;', ''''), '&apos;', ''''), '&nbsp;', chr(160)), '&mdash;', '—'), '&ndash;', '–'), '&hellip;', '…'), '&amp;', '&'), '<[^>]+>', ' ', 'g'), '[\s\x{A0}]+', ' ', 'g')), '') AS clean
  FROM articles""")
def op_S8_clean(spark, root):
    return table(spark, root, "articles").select("doc_id", text.clean(F.col("summary")).alias("clean"))


def _page():
    return F.concat(F.lit("<html><head><script>var a = '<p>no</p>';</script></head><body><nav><p>menu entry that is long enough to look like prose but must not be kept</p></nav><article><p>"), F.regexp_replace(F.col("text"), "\n", "</p><p>"), F.lit("</p></article><footer><p>footer</p></footer></body></html>"))


def _unescaped(c: str) -> str:
    """SQL of the entities that the texts hold."""
    for name, char in (("lt", "'<'"), ("gt", "'>'"), ("quot", "chr(34)"), ("#39", "chr(39)"), ("#x27", "chr(39)"), ("apos", "chr(39)"), ("nbsp", "chr(160)"), ("mdash", "'—'"), ("ndash", "'–'"), ("hellip", "'…'"), ("amp", "'&'")):
        c = f"replace({c}, '&{name};', {char})"
    return c


_FURNITURE = "page"
for _name in R.PAGE_FURNITURE:
    _FURNITURE = rf"regexp_replace({_FURNITURE}, '(?is)<{_name}\b.*?</{_name}>', ' ', 'g')"


@op(rf"""WITH pages AS (SELECT doc_id, '<article><p>' || replace(text, chr(10), '</p><p>') || '</p></article>' AS page FROM documents WHERE text IS NOT NULL),
  bare AS (SELECT doc_id, regexp_replace({_FURNITURE}, '(?s)<!--.*?-->', ' ', 'g') AS page FROM pages),
  inside AS (SELECT doc_id, regexp_extract_all(regexp_extract(page, '(?is)<article\b.*?</article>'), '(?is)<p\b[^>]*>(.*?)</p>', 1) AS ps FROM bare),
  p AS (SELECT doc_id, unnest(ps) AS p, generate_subscripts(ps, 1) AS i FROM inside),
  c AS (SELECT doc_id, i, trim(regexp_replace({_unescaped("regexp_replace(p, '<[^>]+>', ' ', 'g')")}, '[\s\x{{0b}}\x{{A0}}]+', ' ', 'g')) AS t FROM p),
  k AS (SELECT *, sum(length(t)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM c WHERE length(t) >= 60 AND contains(t, ' '))
  SELECT d.doc_id, coalesce(substr(string_agg(t, ' ' ORDER BY i), 1, 1800), '') AS body FROM documents d LEFT JOIN k ON k.doc_id = d.doc_id AND coalesce(before, 0) < 1800 GROUP BY d.doc_id""")
def op_S9_main_text(spark, root):
    """The text of each document read back out of a page around it, markup of its own treated as the page's."""
    return table(spark, root, "documents").select("doc_id", text.main_text(_page()).alias("body"))


@op(rf"""WITH {DOCS}, p AS (SELECT doc_id, url, summary, length(coalesce(url, '')) > 0 AND length(coalesce(summary, '')) < 80 AS thin, trim(regexp_replace({_unescaped("regexp_replace(repeat(title || ' and ', 3), '<[^>]+>', ' ', 'g')")}, '[\s\x{{0b}}\x{{A0}}]+', ' ', 'g')) AS t FROM docs),
  one AS (SELECT url, min(substr(t, 1, 1800)) FILTER (length(t) >= 60) AS t, count(DISTINCT t) AS n FROM p WHERE url IS NOT NULL GROUP BY 1)
  SELECT p.doc_id, thin AND one.t IS NOT NULL AS hydrated, length(CASE WHEN thin AND one.t IS NOT NULL THEN one.t ELSE summary END) AS n FROM p LEFT JOIN one USING (url)""")
def op_S10_hydrate(spark, root):
    """Thin articles filled from pages: each page here is the article's title written out."""
    d = docs(spark, root).select("doc_id", "url", "summary", "title")
    p = d.where("url is not null").select("url", F.concat(F.lit("<p>"), F.repeat(F.concat("title", F.lit(" and ")), 3), F.lit("</p>")).alias("html"))
    return pages.hydrate(d, p).select("doc_id", F.coalesce("hydrated", F.lit(False)).alias("hydrated"), F.length("summary").alias("n"))


@op(f"WITH {DOCS} SELECT count(*) AS all_rows, count(enriched_at) AS enriched, count(*) FILTER (enriched_at IS NULL) AS waiting FROM docs")
def op_S15_scan_waiting(spark, root):
    return docs(spark, root).agg(F.count("*").alias("all_rows"), F.count("enriched_at").alias("enriched"), F.sum(F.col("enriched_at").isNull().cast("int")).alias("waiting"))


@op("SELECT * FROM " + values([tuple(r) for r in R.rows(R.PUBLISHERS)], "label, name, kind, reliability"))
def op_S16_publishers(spark, root):
    return R.publishers(spark)


@op("SELECT name, nation, len(string_split(aliases, ',')) AS aliases FROM " + values([tuple(r) for r in R.rows(R.ACTORS)], "name, nation, aliases"))
def op_S16_actors(spark, root):
    return R.actors(spark).select("name", "nation", F.size("aliases").alias("aliases"))


@op("SELECT technique_id, name, phase FROM " + values([tuple(r) for r in R.rows(R.TECHNIQUES)], "technique_id, name, phase, description"))
def op_S16_techniques(spark, root):
    return R.techniques(spark).select("technique_id", "name", "phase")


# ---- sinks

@op("""WITH b AS (SELECT doc_id, max(ingested_at) AS t FROM articles GROUP BY doc_id), old AS (SELECT DISTINCT doc_id FROM document_entities)
  SELECT count(*) FILTER (doc_id NOT IN (SELECT doc_id FROM old)) AS new, count(*) FILTER (doc_id IN (SELECT doc_id FROM old)) AS skipped,
  (SELECT count(DISTINCT source) FROM (SELECT arg_max(source, ingested_at) AS source FROM articles GROUP BY doc_id)) AS sources FROM b""")
def op_K1_persist(spark, root):
    """Articles against the documents that the edge table knows: what would be new, what is skipped."""
    stored = table(spark, root, "document_entities").select("doc_id")
    return persist.persist(table(spark, root, "articles").select("doc_id", "source", "ingested_at"), stored, F.col("ingested_at"))[1]


@op(f"""WITH k AS (SELECT DISTINCT source AS label FROM articles WHERE source IS NOT NULL)
  SELECT k.label, coalesce(s.name, k.label) AS name, coalesce(s.kind, 'other') AS kind, coalesce(s.reliability, 'F') AS reliability FROM k LEFT JOIN sources s ON lower(k.label) = s.label""")
def op_K2_ensure_sources(spark, root):
    return persist.ensure_sources(table(spark, root, "articles"), table(spark, root, "sources"))


def uuid5_sql(key: str) -> str:
    """SQL of the name-based UUID of a text."""
    h = f"sha1(unhex('{export.NAMESPACE.hex}') || encode({key}))"
    return f"(SELECT h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || ['8', '9', 'a', 'b'][1 + ((strpos('0123456789abcdef', h[17]) - 1) % 4)] || h[18:20] || '-' || h[21:32] FROM (SELECT {h} AS h))"


NARRATIVES = [("nar:1", "ports closed", [("T0002", "Facilitate State Propaganda", "Execute", 0.5)]), ("nar:2", "untagged", []), ("nar:3", "no tags known", None)]
_TECHNIQUE_ROWS = values([tuple(r) for r in R.rows(R.TECHNIQUES)], "technique_id, name, phase, description")


@op(f"""SELECT 'attack-pattern' AS type, 'attack-pattern--' || {uuid5_sql("'technique:' || technique_id")} AS id, name, 0 AS refs FROM {_TECHNIQUE_ROWS} UNION ALL SELECT 'identity', 'identity--' || {uuid5_sql("'source:' || label")}, coalesce(nullif(name, ''), label), 0 FROM sources
  UNION ALL SELECT 'report', 'report--' || {uuid5_sql("'nar:1'")}, 'ports closed', 1""")
def op_K5_bundle(spark, root):
    """The exported bundle, put together from its lines and read again: types, identifiers, names and references."""
    told = literal(spark, NARRATIVES, "narrative_id string, label string, disarm array<struct<technique_id:string,name:string,phase:string,score:double>>").withColumns({"summary": F.lit(None).cast("string"), "last_seen": F.lit(None).cast("timestamp")})
    lines = export.bundle(export.bundle_objects(R.techniques(spark), table(spark, root, "sources"), told))
    whole = lines.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("key", "line"))), lambda x: x["line"]), "").alias("json"))  # a registry
    objects = F.from_json("json", "type string, id string, objects array<struct<type:string,id:string,name:string,object_refs:array<string>>>")["objects"]
    return whole.select(F.explode(objects).alias("o")).select("o.type", "o.id", "o.name", F.coalesce(F.size("o.object_refs"), F.lit(0)).alias("refs")).withColumn("refs", F.greatest("refs", F.lit(0)))


@op("SELECT split, n FROM (SELECT 'valid' AS split, greatest(1, floor(count(*) * 0.2))::BIGINT AS n FROM documents UNION ALL SELECT 'train', count(*) - greatest(1, floor(count(*) * 0.2))::BIGINT FROM documents)")
def op_K6_train_valid(spark, root):
    return export.train_valid(table(spark, root, "documents").select("doc_id"), F.col("doc_id")).groupBy("split").agg(F.count("*").alias("n"))


@op(f"WITH {GOLDS} SELECT query_id, 3 AS turns, query AS asked FROM golds")
def op_K7_chat_example(spark, root):
    chat = export.chat_example("You write cited briefs.", F.col("query"), F.coalesce("expectation", F.lit("")))
    return golds(spark, root).withColumn("messages", chat).select("query_id", F.size("messages").alias("turns"), F.col("messages")[1]["content"].alias("asked"))


# ---- projections and predicates

@op(f"WITH {DOCS} SELECT doc_id, CASE WHEN length(coalesce(summary, '')) > 0 THEN title || '. ' || summary ELSE title END AS text FROM docs")
def op_P1_document_text(spark, root):
    return docs(spark, root).select("doc_id", text.document_text(F.col("title"), F.col("summary")).alias("text"))


@op(f"WITH {DOCS} SELECT doc_id, length(coalesce(url, '')) > 0 AND length(coalesce(summary, '')) < 80 AS thin FROM docs")
def op_P2_needs_text(spark, root):
    return docs(spark, root).select("doc_id", text.needs_text(F.col("url"), F.col("summary")).alias("thin"))


@op(f"WITH {GRADED} SELECT doc_id, reliability FROM graded")
def op_P4_grade(spark, root):
    return graded(spark, root).select("doc_id", "reliability")


@op("""WITH n AS (SELECT entity_id, count(DISTINCT doc_id) AS n FROM document_entities GROUP BY 1)
  SELECT entity_id, CASE WHEN n >= 4 THEN 1 WHEN n = 3 THEN 2 WHEN n = 2 THEN 3 WHEN n = 1 THEN 4 ELSE 6 END AS credibility FROM n""")
def op_P5_credibility(spark, root):
    n = table(spark, root, "document_entities").groupBy("entity_id").agg(F.countDistinct("doc_id").alias("n"))
    return n.select("entity_id", grades.credibility_of(F.col("n")).alias("credibility"))


@op("SELECT item_id, upper(coalesce(nullif(reliability, ''), 'F')) || coalesce(nullif(credibility, 0), 6) AS rating FROM evidence_items")
def op_P6_rating(spark, root):
    return table(spark, root, "evidence_items").select("item_id", grades.rating(F.col("reliability"), F.col("credibility")).alias("rating"))


@op(r"""SELECT item_id, CASE WHEN credibility BETWEEN 1 AND 6 THEN credibility END AS credibility, CASE WHEN upper(trim(coalesce(reliability, ''))) IN ('A','B','C','D','E','F') THEN upper(trim(reliability)) ELSE 'F' END AS reliability
  FROM evidence_items""")
def op_P7_P8_coercions(spark, root):
    return table(spark, root, "evidence_items").select("item_id", grades.as_credibility(F.col("credibility")).alias("credibility"), grades.as_reliability(F.col("reliability")).alias("reliability"))


NUMBERS = [("1", "3"), ("2", "3.9"), ("3", " 7 "), ("4", "x"), ("5", None), ("6", "-2"), ("7", "1e3")]


@op(r"SELECT k, coalesce(CASE WHEN regexp_full_match(trim(v), '[+-]?\d{1,9}') THEN CAST(trim(v) AS INT) END, 0) AS whole, try_cast(trim(v) AS DOUBLE) AS number FROM " + values(NUMBERS, "k, v"))
def op_P9_numbers(spark, root):
    return literal(spark, NUMBERS, "k string, v string").select("k", grades.as_int(F.col("v")).alias("whole"), grades.as_float(F.col("v")).alias("number"))


DETECTIONS = [
    (1, "d1", "AIS gap near reef", "x", "b", "2", "A vessel went dark", "2025-01-01T10:00:00Z", "/i/1", "gap", "111", "", "", "North Reef"),
    (2, "d2", "Rendezvous", "x", "B", "9", "", "2025-01-01T10:05:00Z", "", "meet", "111", "222", "", "North Reef"),
    (3, "d3", "Rendezvous", "x", "Z", "3", "Two tankers in North Reef", "2025-01-01T10:20:00Z", "http://h/3", "meet", "222", "111", "", "North Reef"),
    (4, "d4", "Orbit", "x", None, "x", None, "2025-01-01T11:00:00Z", None, "orbit", None, None, "abc", None),
    (5, "d5", "Rendezvous", "x", "C", "4", "later", "2025-01-01T12:00:00Z", "", "meet", "111", "222", "", ""),
    (6, "", "no id", "x", "C", "4", "", "", "", "meet", "", "", "", ""),
]
_GEO = "pos bigint, " + schemas.GEOINT.replace(", kind string", "")
_GEO_NAMES = ", ".join(c.split()[0] for c in _GEO.split(", "))


@op(rf"""SELECT 'ocean:' || doc_id AS doc_id, title, CASE WHEN upper(coalesce(reliability, '')) IN ('A','B','C','D','E','F') THEN upper(reliability) ELSE 'F' END AS reliability,
  CASE WHEN regexp_full_match(credibility, '[1-6]') THEN credibility::INT END AS credibility,
  coalesce(nullif(summary, ''), title) || CASE WHEN coalesce(zone, '') <> '' AND NOT contains(lower(coalesce(nullif(summary, ''), title)), lower(zone)) THEN ' Zone: ' || zone || '.' ELSE '' END AS summary,
  CASE WHEN starts_with(url, '/') THEN 'http://base' || url ELSE nullif(url, '') END AS url FROM {values(DETECTIONS, _GEO_NAMES)} WHERE doc_id <> '' AND title <> ''""")
def op_P10_geoint_items(spark, root):
    rows = literal(spark, DETECTIONS, _GEO)
    return evidence.geoint_items(rows, "ocean", "http://base").select("doc_id", "title", "reliability", "credibility", "summary", "url")


CAMPAIGNS = [
    (1, "c1", None, "Sandworm wave", ["CVE-1", "CVE-2"], ["CVE-1"], "5", [("T1", None, "n", 0.5), ("T2", None, "n", 0.4)], "2.4", [("Report on ZINC",)]),
    (2, None, "c2", "Zinc mining hit", None, None, None, [("T2", None, "n", 0.9)], None, [("a",), ("b",)]),
    (3, None, None, None, [], [], "x", None, "old", None),
]
_CAMPAIGN = "pos bigint, campaign_id string, id string, name string, cve_ids array<string>, kev_cves array<string>, report_count string, techniques array<struct<technique_id:string,id:string,name:string,score:double>>, age_days string, reports array<struct<title:string>>"


def _campaigns(spark) -> DataFrame:
    rows = literal(spark, CAMPAIGNS, _CAMPAIGN)
    return rows.withColumns({c: F.lit(None).cast("string") for c in ("title", "label", "description", "summary")})


@op()
def op_P11_campaign_items(spark, root):
    return evidence.campaign_items(_campaigns(spark), R.actors(spark)).drop("pos")


@op()
def op_P12_P13_campaign_fields(spark, root):
    c = _campaigns(spark)
    return c.select("pos", F.array_join(evidence.technique_ids(F.col("techniques")), ",").alias("ids"), evidence.campaign_text(c).alias("text"))


@op(f"WITH {GOLDS}, q AS (SELECT query_id, query FROM golds UNION ALL SELECT * FROM {values([(-1, 'hi!'), (-2, 'What can you do?'), (-3, 'who is behind the attack'), (-4, 'why did it fail')], 'query_id, query')}) "
    "SELECT query_id, regexp_full_match(query, '(?i)\\s*(hi|what can you do)\\s*[?!.]*\\s*') AS meta FROM q")
def op_P14_meta(spark, root):
    more = literal(spark, [(-1, "hi!"), (-2, "What can you do?"), (-3, "who is behind the attack"), (-4, "why did it fail")], "query_id bigint, query string")
    return golds(spark, root).select("query_id", "query").unionByName(more).select("query_id", text.is_meta(F.col("query")).alias("meta"))


_BLAMES = (
    "(regexp_matches(lower(query), 'who\\s+(is|was|are|were)?\\s*(really\\s+)?(behind|responsible)\\b') OR regexp_matches(lower(query), '\\bwho\\s+(did|caused|ordered|fired|attacked|launched|sabotaged)\\b')"
    " OR regexp_matches(lower(query), '\\b(is|was|are|were)\\s+.{0,60}\\b(caused|carried\\s+out|orchestrated|staged|ordered)\\b') OR regexp_matches(lower(query), '\\bwhy\\s+(did|is|was|are|were)\\b')"
    " OR regexp_matches(lower(query), '\\b(attribution|attributing|blame)\\b|\\bculpab|\\bwho\\s+fired\\s+first\\b'))"
)


@op(f"WITH {GOLDS} SELECT query_id, {_BLAMES} AS attribution FROM golds")
def op_P15_attribution(spark, root):
    return golds(spark, root).select("query_id", text.asks_attribution(F.col("query")).alias("attribution"))


@op(f"""WITH {VDOCS} SELECT (topic * 1000 + doc_id // 100)::BIGINT AS event_id, bool_or(coalesce(reliability, 'F') IN ('A','B','C')) AND bool_or(coalesce(reliability, 'F') IN ('D','E','F')) AS crosses FROM vdocs v LEFT JOIN sources s ON s.label = v.source GROUP BY 1""")
def op_P16_tier_crossing(spark, root):
    """Whether an event (one topic, neighbouring identifiers) is reported by high and by low grades."""
    grade = table(spark, root, "sources").select(F.col("label").alias("source"), "reliability")
    m = vdocs(spark, root).join(grade, "source", "left").withColumn("event_id", (F.col("topic") * 1000 + F.floor(F.col("doc_id") / 100)).cast("bigint"))
    return m.groupBy("event_id").agg(grades.crosses_tiers(F.col("reliability")).alias("crosses"))


_CASE = lambda c, labels: f"CASE {c} " + " ".join(f"WHEN {k!r} THEN '{v}'" for k, v in labels.items()) + " END"


@op(f"""WITH {GRADED}, top AS (SELECT *, row_number() OVER (ORDER BY ingested_at DESC, doc_id) AS n FROM graded), t AS (SELECT *, upper(reliability) AS r, coalesce(nullif(credibility, 0), 6) AS c FROM top WHERE n <= 12)
  SELECT doc_id, 'E' || n AS label, '[E' || n || '] ' || r || c || ' (' || {_CASE('r', R.RELIABILITY_LABELS)} || '; ' || coalesce({_CASE('c', R.CREDIBILITY_LABELS)}, '{R.CREDIBILITY_LABELS[6]}') || ') ' || source || CASE WHEN length(coalesce(published, '')) > 0 THEN ' (' || published || ')' ELSE '' END
    || ': ' || title || '. ' || CASE WHEN coalesce(summary, '') <> '' THEN summary ELSE title END AS line FROM t""")
def op_P17_evidence_lines(spark, root):
    """The twelve latest articles as labelled evidence, as readers see it."""
    top = graded(spark, root).orderBy(F.desc("ingested_at"), "doc_id").limit(R.CONTEXT_ITEMS)
    n = top.withColumn("pos", F.row_number().over(Window.orderBy(F.desc("ingested_at"), "doc_id")))
    return evidence.lines(n).select("doc_id", "label", "line")


@op("SELECT source AS brief_id, source AS query_id FROM evidence_items WHERE source IS NOT NULL AND regexp_replace(lower(trim(source)), '\\s+', ' ', 'g') = lower(source) GROUP BY 1")
def op_P18_saved(spark, root):
    """Stored answers to questions that are asked again in other case and white space."""
    b = _stored(spark, root).where("brief_id is not null").withColumn("created_at", F.lit(None).cast("timestamp"))
    plain = b.where(F.regexp_replace(F.lower(F.trim("brief_id")), r"\s+", " ") == F.lower("brief_id"))
    asked = plain.select(F.col("brief_id").alias("query_id"), F.concat(F.lit("  WHAT   does "), F.upper("brief_id"), F.lit(" say? ")).alias("question"))
    found = briefs.saved_for(plain, asked, limit=50).where("brief_id = query_id")
    return found.select("brief_id", "query_id")


@op(f"WITH {DOCS} SELECT doc_id, CASE WHEN len(tags) > 0 THEN array_to_string(tags, ',') END AS tags FROM docs")
def op_P20_empty_is_null(spark, root):
    return docs(spark, root).select("doc_id", F.when(F.size("tags") > 0, F.array_join("tags", ",")).alias("tags"))


# ---- joins

@op(f"WITH {GRADED} SELECT doc_id, name, reliability FROM graded")
def op_J1_J2_documents_sources(spark, root):
    return graded(spark, root).select("doc_id", "name", "reliability")


@op("SELECT DISTINCT e.doc_id FROM document_entities e WHERE e.doc_id NOT IN (SELECT doc_id FROM articles)")
def op_J3_anti(spark, root):
    return persist.new_rows(table(spark, root, "document_entities").select("doc_id").distinct(), table(spark, root, "articles"), "doc_id")


@op("SELECT count(DISTINCT e.doc_id) AS known FROM document_entities e WHERE e.doc_id IN (SELECT doc_id FROM articles)")
def op_J4_semi(spark, root):
    return persist.known_rows(table(spark, root, "document_entities").select("doc_id").distinct(), table(spark, root, "articles"), "doc_id").agg(F.count("*").alias("known"))


BRIEFS = [
    (1, "Ships vanished [E1, E3] near the reef [2 vessels], see [E02].", ["Two ships went dark [E1]", "No claim"], "high"),
    (2, "[1, 2] agree; [9] does not exist; [E3 and d2] mixed", ["x [E1] and the port closed while ships waited offshore"], "moderate"),
    (3, "nothing cited", [], "low"),
]
LABELS = [(1, "d1", "B", "wire"), (2, "d2", "D", "blog"), (3, "d3", "C", "paper")]


def _briefs(spark) -> DataFrame:
    return literal(spark, BRIEFS, "brief_id bigint, body string, judgments array<string>, confidence string")


def _labels(spark) -> DataFrame:
    return literal(spark, LABELS, "n int, doc_id string, reliability string, source string")


@op("SELECT * FROM (VALUES (1, 1, 'd1'), (1, 2, 'd3'), (1, 3, 'd2'), (2, 1, 'd1'), (2, 2, 'd2'), (2, 3, 'd3')) AS t(brief_id, pos, doc_id)")
def op_F11_J5_citations(spark, root):
    return assess.resolve_citations(_briefs(spark), "brief_id", "body", _labels(spark).select("n", "doc_id"))


@op("SELECT * FROM (VALUES (1, 'high', 'moderate'), (2, 'moderate', 'moderate'), (3, 'low', 'low')) AS t(brief_id, confidence, capped)")
def op_A10_A11_J6_caps(spark, root):
    """Confidence of briefs capped by what they cite, or by all evidence where nothing is cited."""
    b = _briefs(spark)
    cites = assess.resolve_citations(b, "brief_id", "body", _labels(spark).select("n", "doc_id"))
    pool = literal(spark, [(b_[0], *row) for b_ in BRIEFS for row in LABELS], "brief_id bigint, n int, doc_id string, reliability string, source string")
    ceiling = assess.ceiling(assess.cited_basis(pool, cites, ["brief_id"]), ["brief_id"])
    return b.join(ceiling, "brief_id").select("brief_id", "confidence", assess.cap(F.col("confidence"), F.col("ceiling")).alias("capped"))


CELLS = [(1, "h1", "E1", "inconsistent"), (1, "h1", "[E2]", "consistent"), (2, "h2", "2", "inconsistent"), (2, "h2", "E9", "inconsistent"), (3, "h3", "E7", "consistent")]


@op("SELECT * FROM (VALUES ('h3', 0.0, 0, 0, 1), ('h2', 0.4, 0, 1, 2), ('h1', 0.9, 1, 1, 3)) AS t(hypothesis, inconsistency, consistent, inconsistent, rank)")
def op_A9_J7_F16_hypotheses(spark, root):
    cells = literal(spark, CELLS, "hypothesis_pos int, hypothesis string, evidence string, assessment string")
    return assess.score_hypotheses(cells, _labels(spark).select("n", "reliability")).drop("hypothesis_pos")


@op(f"""WITH {VDOCS}, m AS (SELECT (topic * 1000 + doc_id // 100)::BIGINT AS event_id, doc_id, embedding FROM vdocs),
  p AS (SELECT a.event_id, min(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])) AS low FROM m a JOIN m b ON a.event_id = b.event_id AND a.doc_id < b.doc_id GROUP BY 1)
  SELECT m.event_id, round(CASE WHEN low IS NULL THEN 0 ELSE greatest(0, least(1, 1 - low)) END, 6) AS divergence FROM (SELECT DISTINCT event_id FROM m) m LEFT JOIN p USING (event_id)""")
def op_A6_J8_divergence(spark, root):
    """Framing divergence inside groups of one topic and neighbouring identifiers."""
    m = vdocs(spark, root).withColumn("event_id", (F.col("topic") * 1000 + F.floor(F.col("doc_id") / 100)).cast("bigint"))
    return views.divergence(m, "event_id").select("event_id", F.round("divergence", 6).alias("divergence"))


_TOK = "regexp_extract_all(lower({}), '[a-z0-9]{{3,}}')"
_STOP = sql_list(R.STOPWORDS)
_GENERIC = sql_list(R.GENERIC)


def _subject_sql(expr: str) -> str:
    return f"list_filter(list_distinct({_TOK.format(expr)}), lambda x: NOT list_contains({_STOP}, x) AND NOT list_contains({_GENERIC}, x) AND NOT (ends_with(x, 's') AND list_contains({_GENERIC}, x[:-2])))"


@op(rf"SELECT doc_id, array_to_string(list_sort(list_filter(list_distinct({_TOK.format('title')}), lambda x: NOT list_contains({_STOP}, x))), ' ') AS tokens FROM articles")
def op_F1_content_tokens(spark, root):
    return table(spark, root, "articles").select("doc_id", F.array_join(F.array_sort(text.content_tokens(F.col("title"))), " ").alias("tokens"))


@op(rf"SELECT doc_id, array_to_string(list_sort({_subject_sql('title')}), ' ') AS tokens FROM articles")
def op_F2_F3_subject_tokens(spark, root):
    return table(spark, root, "articles").select("doc_id", F.array_join(F.array_sort(text.subject_tokens(F.col("title"))), " ").alias("tokens"))


@op(rf"""WITH s AS (SELECT doc_id, {_subject_sql('title')} AS t FROM articles)
  SELECT doc_id, array_to_string(list_sort(list_distinct(list_concat(t, list_transform(list_filter(t, lambda x: length(x) > 4 AND ends_with(x, 's')), lambda x: x[:-2])))), ' ') AS tokens FROM s""")
def op_F4_singular(spark, root):
    return table(spark, root, "articles").select("doc_id", F.array_join(F.array_sort(F.array_distinct(text.singular_forms(text.subject_tokens(F.col("title"))))), " ").alias("tokens"))


def _relevance_sql(expr: str) -> str:
    """SQL of the subject words of a text in both numbers with the vocabularies that they call up."""
    both = f"(SELECT list_distinct(list_concat(x, list_transform(list_filter(x, lambda t: length(t) > 4 AND ends_with(t, 's')), lambda t: t[:-2]))) FROM (SELECT {_subject_sql(expr)} AS x))"
    wide = "x"
    for anchors, group in R.SUBJECT_GROUPS:
        wide = f"list_concat({wide}, CASE WHEN list_has_any(x, {sql_list(anchors)}) THEN {sql_list(group)} ELSE [] END)"
    return f"(SELECT list_distinct({wide}) FROM (SELECT {both} AS x))"


@op(f"WITH {GOLDS} SELECT query_id, array_to_string(list_sort({_relevance_sql('query')}), ' ') AS tokens FROM golds")
def op_F5_relevance_tokens(spark, root):
    return golds(spark, root).select("query_id", F.array_join(F.array_sort(text.relevance_tokens(F.col("query"))), " ").alias("tokens"))


_RELEVANT = f"""asked AS (SELECT query_id, unnest({_relevance_sql('query')}) AS t FROM golds),
  content AS (SELECT item_id, list_filter(list_distinct({_TOK.format("concat_ws(' ', title, summary)")}), lambda x: NOT list_contains({_STOP}, x)) AS w FROM evidence_items),
  own AS (SELECT item_id, unnest(list_distinct(list_concat(w, list_transform(list_filter(w, lambda x: length(x) > 4 AND ends_with(x, 's')), lambda x: x[:-2])))) AS t FROM content),
  relevant AS (SELECT query_id, count(DISTINCT item_id) AS relevant FROM own JOIN asked USING (t) GROUP BY 1)"""


@op(f"WITH {GOLDS}, {_RELEVANT} SELECT * FROM relevant")
def op_J9_relevant_evidence(spark, root):
    """How many evidence items share a subject word with each gold question, by token equi-join."""
    asked = golds(spark, root).select("query_id", F.explode(text.relevance_tokens(F.col("query"))).alias("t"))
    own = table(spark, root, "evidence_items").select("item_id", F.explode(text.singular_forms(text.content_tokens(F.concat_ws(" ", "title", "summary")))).alias("t"))
    return own.join(asked, "t").select("query_id", "item_id").distinct().groupBy("query_id").agg(F.count("*").alias("relevant"))


def _catalogue(spark) -> DataFrame:
    return R.techniques(spark).withColumn("embedding", vectors.hash_embedding(64)(F.concat_ws(". ", "name", "description")))


@op()
def op_J10_V9_technique_vectors(spark, root):
    """Nearest techniques of every document's text, both by the hashing encoder."""
    d = table(spark, root, "documents").select("doc_id", vectors.hash_embedding(64)(F.col("text")).alias("v"))
    return views.nearest_techniques(d, "doc_id", "v", _catalogue(spark))


_TERMS = values([(r[0], f"{r[1]}. {r[3]}") for r in R.rows(R.TECHNIQUES)], "technique_id, body")


@op(rf"""WITH t AS (SELECT technique_id, list_distinct(regexp_extract_all(lower(body), '[a-z]{{4,}}')) AS w FROM {_TERMS}), u AS (SELECT technique_id, len(w) AS n, unnest(w) AS w FROM t),
  d AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]{{4,}}'))) AS w FROM documents),
  s AS (SELECT doc_id, technique_id, count(*) / any_value(n) AS score FROM d JOIN u USING (w) GROUP BY 1, 2)
  SELECT doc_id, technique_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, technique_id) AS r FROM s) WHERE r <= 3""")
def op_J11_technique_words(spark, root):
    return views.lexical_techniques(table(spark, root, "documents"), "doc_id", "text", R.techniques(spark)).withColumn("score", F.round("score", 6))


@op("SELECT * FROM (VALUES (1, 2), (2, 1)) AS t(pos, overlap)")
def op_J12_campaign_ranking(spark, root):
    wanted = literal(spark, [("T1",), ("T2",)], "technique_id string")
    return evidence.rank_campaigns(_campaigns(spark), wanted).select("pos", "overlap")


ACTOR_TEXTS = [(1, "ZINC and apt28 struck; APT10 did not"), (2, "Zinc mining output"), (3, "a snake in the garden, Fancy Bear"), (4, None), (5, "the Lazarus Group")]


_ALIASES = values([(r[0], n) for r in R.rows(R.ACTORS) for n in (r[0], *r[2].split(",")) if n.lower() not in R.UNSCANNED_ALIASES], "actor, name")


@op(f"""WITH texts AS (SELECT doc_id AS k, text AS body FROM documents UNION ALL SELECT -item_id, concat_ws(' ', title, summary) FROM evidence_items UNION ALL SELECT 1000000000 + k, body FROM {values(ACTOR_TEXTS, 'k, body')}), a AS (SELECT * FROM {_ALIASES})
  SELECT DISTINCT k, actor FROM texts JOIN a ON CASE WHEN list_contains({sql_list(R.CASED_ALIASES)}, name) THEN contains(body, name) AND regexp_matches(body, '\\b' || name || '\\b') ELSE contains(lower(body), lower(name)) AND regexp_matches(lower(body), '\\b' || lower(name) || '\\b') END""")
def op_J13_alias_scan(spark, root):
    """Threat actors named in all documents and evidence items, and in some texts that do name them."""
    rows = table(spark, root, "documents").select(F.col("doc_id").alias("k"), F.col("text").alias("body")).unionByName(table(spark, root, "evidence_items").select((-F.col("item_id")).alias("k"), F.concat_ws(" ", "title", "summary").alias("body")))
    rows = rows.unionByName(literal(spark, [(1_000_000_000 + k, b) for k, b in ACTOR_TEXTS], "k bigint, body string"))
    return evidence.alias_scan(rows, "k", "body", R.actors(spark)).select("k", "actor")


@op("SELECT nation, count(*) AS actors FROM " + values([tuple(r) for r in R.rows(R.ACTORS)], "name, nation, aliases") + " GROUP BY nation")
def op_J14_nations(spark, root):
    return R.actors(spark).groupBy("nation").agg(F.count("*").alias("actors"))


@op("SELECT * FROM (VALUES (1, 2, 0.5, 0.5), (2, 2, 1.0, 0.0), (3, 0, 0.0, 0.0)) AS t(brief_id, claims, faithfulness, support)")
def op_J15_A16_entailment(spark, root):
    ev = literal(spark, [(1, 1, "d1", "Two ships went dark near the reef", None), (2, 2, "d2", "The port closed", "Ships waited offshore for days")], "brief_id bigint, n int, doc_id string, title string, summary string")
    return evaluate.entailment(_briefs(spark), ev)


@op("WITH p AS (SELECT item_id, text, lead(text) OVER (ORDER BY item_id) AS other FROM eval_items WHERE kind = 'entailment_pair') SELECT 1.0 AS agreement, 2 * count(*) - 1 AS cases FROM p")
def op_A16_agreement(spark, root):
    """Items against themselves, which they entail, and against their neighbours, which they mostly share too few words with."""
    e = table(spark, root, "eval_items").where("kind = 'entailment_pair'").select("item_id", "text")
    n = e.withColumn("_n", F.row_number().over(Window.orderBy("item_id")))
    other = n.select((F.col("_n") - 1).alias("_n"), F.col("text").alias("hypothesis"))
    cases = e.select(F.col("text").alias("premise"), F.col("text").alias("hypothesis"), F.lit(True).alias("entailed")).unionByName(n.join(other, "_n").select(F.col("text").alias("premise"), "hypothesis", F.lit(False).alias("entailed")))
    return evaluate.agreement(cases, 0.9)


@op(r"""WITH l AS (SELECT doc_id, text, string_split_regex(text, '\r\n|[\n\x{0b}\f\r\x{85}\x{2028}\x{2029}]') AS ls FROM documents WHERE text IS NOT NULL)
  SELECT doc_id, CASE WHEN lower(regexp_extract(text, '(?i)\b(low|moderate|high)\b', 1)) = 'high' THEN 0.0 ELSE round(len(list_filter(ls, lambda x: regexp_matches(x, '\[[^\]]+\]'))) / len(ls), 9) END AS metric FROM l""")
def op_A17_brief_metric(spark, root):
    """Citation coverage of every document's lines, nothing where the first confidence it states is above 'moderate'."""
    d = table(spark, root, "documents").where("text is not null").select("doc_id", F.split("text", r"\R").alias("lines"), text.confidence_word(F.col("text")).alias("confidence"))
    return d.select("doc_id", F.round(evaluate.brief_metric(F.col("lines"), F.col("confidence"), F.lit("moderate")), 9).alias("metric"))


@op(r"""WITH m AS (SELECT doc_id, unnest(regexp_extract_all(text, '\[([^\]]+)\]', 1)) AS inside FROM documents), t AS (SELECT doc_id, unnest(string_split_regex(trim(inside), '[,\s]+')) AS t FROM m)
  SELECT d.doc_id, count(DISTINCT t) FILTER (t <> '' AND NOT regexp_full_match(t, 'E([1-9]|1[0-2])')) AS fabricated FROM documents d LEFT JOIN t ON t.doc_id = d.doc_id GROUP BY 1""")
def op_A14_fabricated(spark, root):
    """Markers of every document that name none of twelve labels."""
    known = text.words(*[f"E{i}" for i in range(1, 13)])
    return table(spark, root, "documents").select("doc_id", evaluate.fabricated(F.array_distinct(text.citation_markers(F.col("text"))), known).cast("bigint").alias("fabricated"))


@op(r"""WITH n AS (SELECT doc_id, unnest(regexp_extract_all(text, '[a-z]+ (?:council|ministry|institute)')) AS name FROM documents) SELECT doc_id, substr(sha256('ORG:' || lower(name)), 1, 24) AS entity_id, name, count(*) AS n FROM n GROUP BY ALL""")
def op_F7_extractor(spark, root):
    """Entities by a recogniser of its own labels: here bodies by their word, with a label that isn't kept."""
    import re

    bodies = re.compile("[a-z]+ (?:council|ministry|institute)")
    find = entities.extractor(lambda t: [*((m, "ORG") for m in bodies.findall(t)), ("whatever", "ORDINAL")])
    return entities.mentions(table(spark, root, "documents"), "doc_id", "text", extract=find).select("doc_id", "entity_id", "name", F.col("count").cast("bigint").alias("n"))


@op("SELECT a.doc_id, count(*) AS mentions, count(e.entity_id) AS resolved FROM (SELECT DISTINCT doc_id, entity_id FROM document_entities) a LEFT JOIN entities e USING (entity_id) GROUP BY 1")
def op_J18_membership(spark, root):
    e = table(spark, root, "document_entities").select("doc_id", "entity_id").distinct()
    known = table(spark, root, "entities").select("entity_id", F.lit(1).alias("k"))
    return e.join(known, "entity_id", "left").groupBy("doc_id").agg(F.count("*").alias("mentions"), F.count("k").alias("resolved"))


# ---- aggregations

@op("SELECT 'articles' AS name, count(DISTINCT doc_id) AS n FROM articles UNION ALL SELECT 'sources', count(*) FROM sources UNION ALL SELECT 'entities', count(*) FROM entities UNION ALL SELECT 'evidence_items', count(*) FROM evidence_items UNION ALL SELECT 'briefs', count(DISTINCT source) FROM evidence_items UNION ALL SELECT 'events', count(DISTINCT label * 1000 + doc_id // 100) FROM embeddings JOIN documents ON doc_id = vec_id")
def op_A1_counts(spark, root):
    n = lambda name, e: table(spark, root, name).agg(e.alias("n")).select(F.lit(name).alias("name"), "n")
    return n("articles", F.countDistinct("doc_id")).unionByName(n("sources", F.count("*"))).unionByName(n("entities", F.count("*"))).unionByName(n("evidence_items", F.count("*"))).unionByName(_stored(spark, root).where("brief_id is not null").agg(F.count("*").alias("n")).select(F.lit("briefs").alias("name"), "n")).unionByName(
        _events(spark, root).agg(F.count("*").alias("n")).select(F.lit("events").alias("name"), "n")
    )


_MEMBERSHIP = "m AS (SELECT source_key AS event_id, * FROM graded WHERE source_key IS NOT NULL)"


@op(f"""WITH {TIMED_GRADED}, {_MEMBERSHIP} SELECT event_id, count(*) AS doc_count, count(DISTINCT language) AS kinds, epoch_us(min(published_at)) AS first_us, epoch_us(max(published_at)) AS last_us,
  arg_min(title, doc_id) AS title FROM m GROUP BY 1""")
def op_A2_group_roll_up(spark, root):
    """The roll-up of an event view over a given membership: here articles by source, members in order of doc_id."""
    m = graded(spark, root).where("source_key is not null").groupBy(F.col("source_key").alias("event_id"))
    return m.agg(F.count("*").alias("doc_count"), F.countDistinct("language").alias("kinds"), F.unix_micros(F.min("published_at")).alias("first_us"), F.unix_micros(F.max("published_at")).alias("last_us"), F.min_by("title", "doc_id").alias("title"))


@op()
def op_A2_D4_events(spark, root):
    """Events clustered from vectors and times, with their roll-up."""
    d = encoded(spark, root)
    return views.event_view(clustering.events(d), d).select("event_id", "title", "doc_count", "source_count", F.round("divergence", 6).alias("divergence"))


@op()
def op_P3_P5_contested(spark, root):
    d = encoded(spark, root)
    e = views.event_view(clustering.events(d), d)
    return e.where(views.contested(e)).orderBy(F.desc("divergence"), "event_id").limit(50).select("event_id", "source_count", F.round("divergence", 6).alias("divergence"))


@op()
def op_A3_D5_narratives(spark, root):
    d = encoded(spark, root)
    m = clustering.narratives(d)
    src = table(spark, root, "sources").select("label", "reliability")
    return views.narrative_view(m, d, src, _catalogue(spark)).select("narrative_id", "label", "doc_count", "source_count", "coordination", F.size("disarm").alias("tags"))


@op("SELECT entity_id, sum(n)::BIGINT AS mentions, count(*) AS documents, epoch_us(min(t)) AS first_us, epoch_us(max(t)) AS last_us FROM (SELECT doc_id, entity_id, max(coalesce(count, 1)) AS n FROM document_entities GROUP BY 1, 2) LEFT JOIN (SELECT doc_id, max(ingested_at) AS t FROM articles GROUP BY 1) USING (doc_id) GROUP BY 1")
def op_A5_entity_roll_up(spark, root):
    d = table(spark, root, "articles").groupBy("doc_id").agg(F.max("ingested_at").alias("ingested_at"))
    r = entities.roll_up(table(spark, root, "document_entities"), d, "ingested_at")
    return r.select("entity_id", "mentions", "documents", F.unix_micros("first_seen").alias("first_us"), F.unix_micros("last_seen").alias("last_us"))


@op(f"WITH {GRADED} SELECT source_key, avg(CASE WHEN upper(reliability) IN ('D','E','F') THEN 1.0 ELSE 0.0 END) AS low_share FROM (SELECT coalesce(language, '') AS source_key, reliability FROM graded) GROUP BY 1")
def op_A7_low_share(spark, root):
    g = graded(spark, root).select(F.coalesce("language", F.lit("")).alias("source_key"), "reliability")
    return views.low_share(g, "source_key", F.col("reliability"))


_BURST = """b AS (SELECT source_key, published_at, count(published_at) OVER (PARTITION BY source_key ORDER BY published_at RANGE BETWEEN INTERVAL 6 HOUR PRECEDING AND CURRENT ROW) AS n FROM graded WHERE source_key IS NOT NULL),
  burst AS (SELECT source_key, CASE WHEN count(published_at) >= 2 THEN max(n) FILTER (published_at IS NOT NULL) / count(*) ELSE 0 END AS burstiness FROM b GROUP BY 1)"""


@op(f"WITH {TIMED_GRADED}, {_BURST} SELECT source_key, round(burstiness, 6) AS burstiness FROM burst")
def op_W1_burstiness(spark, root):
    d = docs(spark, root).where("source_key is not null")
    return views.burstiness(d, "source_key", F.col("published_at")).select("source_key", F.round("burstiness", 6).alias("burstiness"))


@op(f"WITH {TIMED_GRADED}, {_BURST}, low AS (SELECT source_key, avg(CASE WHEN reliability IN ('D','E','F') THEN 1.0 ELSE 0.0 END) AS s FROM graded WHERE source_key IS NOT NULL GROUP BY 1) SELECT source_key, round(burstiness * (0.5 + 0.5 * s), 4) AS coordination FROM burst JOIN low USING (source_key)")
def op_A8_coordination(spark, root):
    g = graded(spark, root).where("source_key is not null")
    both = views.burstiness(g, "source_key", F.col("published_at")).join(views.low_share(g, "source_key", F.col("reliability")), "source_key")
    return both.select("source_key", views.coordination(F.col("burstiness"), F.col("low_share")).alias("coordination"))


SAMPLES = [(1, 1, "high"), (1, 2, "high"), (1, 3, "low"), (2, 1, "high"), (2, 2, "low"), (3, 1, "low"), (4, 1, "moderate"), (4, 2, "high"), (4, 3, "low")]


@op("SELECT * FROM (VALUES (1, 'high', 0.67), (2, 'moderate', 0.5), (3, 'low', 1.0), (4, 'low', 0.33)) AS t(k, confidence, agreement)")
def op_A12_calibrate(spark, root):
    return assess.calibrate(literal(spark, SAMPLES, "k bigint, pos int, confidence string"), ["k"])


@op("SELECT * FROM (VALUES (1, 0.5), (2, 1.0), (3, 0.0)) AS t(brief_id, coverage)")
def op_A14_F10_coverage(spark, root):
    return _briefs(spark).select("brief_id", evaluate.citation_coverage(F.col("judgments")).alias("coverage"))


ROUTING = [
    ("Assess suspicious vessels in the strait", ["osint", "ocean"]), ("Assess GNSS jamming affecting regional aviation", ["osint", "sky"]), ("Who is behind the ransomware exploitation wave?", ["osint", "cyber"]),
    ("Are aircraft and naval vessels coordinating near the reef?", ["osint", "sky", "ocean"]), ("What did the governing coalition decide after the election?", ["osint"]), ("Any updates?", ["osint", "sky", "ocean", "cyber"]),
    ("Assess the disputed reef using OSINT", ["osint"]), ("Check all sources on the harvest", ["osint", "sky", "ocean", "cyber"]),
]


@op("SELECT 1.0 AS precision, 1.0 AS recall, 1.0 AS exact, 8 AS cases")
def op_A15_R1_routing(spark, root):
    cases = literal(spark, ROUTING, "query string, expected array<string>").withColumn("predicted", fusion.lanes(F.col("query")))
    return evaluate.routing_metrics(cases)


@op(f"""WITH {GOLDS} SELECT query_id, CASE WHEN expectation IS NULL THEN false ELSE expectation <> 'low' AND expectation = 'high' END AS over FROM golds""")
def op_A18_over_confident(spark, root):
    """Whether the expected confidence is above a cap of 'moderate'."""
    return golds(spark, root).select("query_id", grades.exceeds(F.col("expectation"), F.lit("moderate")).alias("over"))


@op(r"""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM documents), p AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY 1, 2)
  SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM p GROUP BY 1""")
def op_A19_V1_terms(spark, root):
    """Document and corpus frequency of every term."""
    return retrieval.postings(table(spark, root, "documents"), "doc_id", "text").groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


@op(f"WITH {GRADED} SELECT coalesce(kind, '-') AS lane, count(*) AS n FROM graded g LEFT JOIN (SELECT label, kind FROM sources) s ON s.label = g.source_key GROUP BY 1")
def op_A20_lane_counts(spark, root):
    kind = table(spark, root, "sources").select(F.col("label").alias("source_key"), "kind")
    return fusion.lane_counts(docs(spark, root).join(kind, "source_key", "left").select(F.coalesce("kind", F.lit("-")).alias("lane")))


# ---- retrieval

_BM25 = r"""
 t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM documents),
 dl AS (SELECT doc_id, len(regexp_extract_all(lower(text), '[a-z0-9]+')) AS dl FROM documents),
 st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
 p AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY 1, 2),
 df AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
 raw AS (SELECT term, ln(n - df + 0.5) - ln(df + 0.5) AS idf FROM df, st),
 mean AS (SELECT avg(idf) AS m FROM raw),
 idf AS (SELECT term, CASE WHEN idf < 0 THEN 0.25 * m ELSE idf END AS idf FROM raw, mean),
 q AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest(regexp_extract_all(lower(query), '[a-z0-9]+')) AS term FROM golds) GROUP BY 1, 2),
 lex AS (SELECT query_id, doc_id, sum(CAST(round(times * idf * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl)), 9) AS DECIMAL(24, 9))) AS score FROM q JOIN p USING (term) JOIN idf USING (term) JOIN dl USING (doc_id), st GROUP BY 1, 2)
"""


@op(f"WITH {GOLDS}, {_BM25} SELECT query_id, doc_id, rank, round(score::DOUBLE, 5) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM lex) WHERE rank <= 10")
def op_V2_W5_bm25(spark, root):
    d, q = table(spark, root, "documents").select("doc_id", "text"), golds(spark, root)
    top = retrieval.top_k(retrieval.bm25(d, q), d, 10, queries=q)
    return top.select("query_id", "doc_id", "rank", F.round(F.col("score").cast("double"), 5).alias("score"))


@op(f"""WITH {GOLDS}, {VDOCS}, q AS (SELECT query_id, embedding AS v FROM golds JOIN embeddings ON vec_id = query_id),
  s AS (SELECT query_id, doc_id, round(list_cosine_similarity(embedding::DOUBLE[], v::DOUBLE[]), 9) AS score FROM vdocs, q)
  SELECT query_id, doc_id, round(score, 6) AS score, rank FROM (SELECT *, rank() OVER (PARTITION BY query_id ORDER BY score DESC) AS rank FROM s) WHERE rank <= 5""")
def op_V3_W2_dense(spark, root):
    q = golds(spark, root).join(table(spark, root, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")), "query_id")
    return retrieval.dense(vdocs(spark, root), q, 5).select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


@op(f"WITH {VDOCS} SELECT topic, i AS i, round(avg(x::DOUBLE), 6) AS x FROM (SELECT topic, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS i FROM vdocs) GROUP BY 1, 2")
def op_V4_centroids(spark, root):
    c = vectors.centroids(vdocs(spark, root), "topic", "embedding")
    return c.select("topic", F.posexplode("centroid").alias("i", "x")).withColumn("x", F.round("x", 6))


@op(f"""WITH {GOLDS}, {VDOCS}, {_BM25}, qv AS (SELECT query_id, embedding AS v FROM golds JOIN embeddings ON vec_id = query_id),
  s AS (SELECT query_id, doc_id, round(list_cosine_similarity(embedding::DOUBLE[], v::DOUBLE[]), 9) AS score FROM vdocs, qv),
  lr AS (SELECT query_id, doc_id, rank() OVER (PARTITION BY query_id ORDER BY score DESC) AS lr FROM lex), rest AS (SELECT query_id, count(*) + 1 AS rest FROM lex GROUP BY 1),
  sr AS (SELECT query_id, doc_id, rank() OVER (PARTITION BY query_id ORDER BY score DESC) AS sr FROM s),
  f AS (SELECT query_id, doc_id, round(1.0 / (60 + coalesce(lr, rest)) + coalesce(1.0 / (60 + sr), 0), 12) AS score FROM lr FULL JOIN sr USING (query_id, doc_id) JOIN rest USING (query_id))
  SELECT query_id, doc_id, rank, round(score, 9) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM f) WHERE rank <= 10""")
def op_V5_fusion(spark, root):
    q = golds(spark, root)
    qv = q.join(table(spark, root, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")), "query_id")
    d = table(spark, root, "documents").select("doc_id", "text")
    top = retrieval.fuse(retrieval.bm25(d, q), retrieval.Dense(vdocs(spark, root), qv), d, q, 10)
    return top.select("query_id", "doc_id", "rank", F.round("score", 9).alias("score"))


@op("SELECT round(2.0 / 61, 9) AS best")
def op_V6_best_score(spark, root):
    return spark.range(1).select(F.round(F.lit(2.0) / (R.RRF_K + 1), 9).alias("best"))


@op("SELECT d.doc_id, 64 AS dim, e.vec_id IS NULL AS filled FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id")
def op_V7_V8_encode(spark, root):
    """Vectors of all documents: those that are known, and encoded ones where there was none."""
    emb = table(spark, root, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    d = table(spark, root, "documents").select("doc_id", "text").join(emb, "doc_id", "left").withColumn("filled", F.col("embedding").isNull())
    v = vectors.encode_missing(d, "text")
    return v.select("doc_id", F.size("embedding").alias("dim"), "filled")


@op(f"""WITH {GOLDS}, {_BM25}, r AS (SELECT l.query_id, l.doc_id, coalesce(d.source, '') AS source, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM lex l JOIN documents d USING (doc_id)),
  n AS (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY rank) AS nth FROM r), k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY nth > 3, rank) AS pick FROM n)
  SELECT query_id, doc_id, pick FROM k WHERE pick <= 12""")
def op_W3_diverse(spark, root):
    d, q = table(spark, root, "documents"), golds(spark, root)
    ranked = retrieval.bm25(d, q).join(d.select("doc_id", F.coalesce("source", F.lit("")).alias("source")), "doc_id")
    return retrieval.diverse(ranked, R.CONTEXT_ITEMS).select("query_id", "doc_id", "pick")


@op()
def op_V10_W15_gather(spark, root):
    """The whole retrieval pipeline over the articles for every gold question."""
    d = docs(spark, root).select("doc_id", "title", "summary", "source", "credibility", "url")
    pages_ = d.where("url is not null").select("url", F.concat(F.lit("<p>"), F.repeat(F.concat("title", F.lit(" and ")), 3), F.lit("</p>")).alias("html"))
    return retrieval.gather(d, golds(spark, root), table(spark, root, "sources"), pages=pages_)


# ---- windows, sorts, limits (the reports' own limits)

@op(f"WITH {TIMED} SELECT doc_id, title FROM docs ORDER BY published_at DESC NULLS LAST, doc_id LIMIT 200")
def op_W6_latest_published(spark, root):
    return docs(spark, root).orderBy(F.desc_nulls_last("published_at"), "doc_id").limit(200).select("doc_id", "title")


@op(f"WITH {TIMED} SELECT doc_id FROM docs ORDER BY published_at DESC NULLS LAST, ingested_at DESC, doc_id LIMIT 1")
def op_W7_latest(spark, root):
    return docs(spark, root).orderBy(F.desc_nulls_last("published_at"), F.desc("ingested_at"), "doc_id").limit(1).select("doc_id")


@op("SELECT label, reliability, row_number() OVER (ORDER BY reliability, label) AS n FROM sources")
def op_W8_sources_by_grade(spark, root):
    s = table(spark, root, "sources")
    return s.select("label", "reliability", F.row_number().over(Window.orderBy("reliability", "label")).alias("n"))


_EVENTS = f"""m AS (SELECT (topic * 1000 + doc_id // 100)::BIGINT AS event_id, v.*, d.text FROM vdocs v JOIN documents d USING (doc_id)),
  p AS (SELECT a.event_id, min(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])) AS low FROM m a JOIN m b ON a.event_id = b.event_id AND a.doc_id < b.doc_id GROUP BY 1),
  ev AS (SELECT m.event_id, count(*) AS doc_count, count(DISTINCT source) AS source_count, epoch_us(min(published)) AS occurred_us, arg_min(string_split(text, chr(10))[1], doc_id) AS title, round(CASE WHEN any_value(low) IS NULL THEN 0 ELSE greatest(0, least(1, 1 - any_value(low))) END, 6) AS divergence
    FROM m LEFT JOIN p USING (event_id) GROUP BY 1)"""


def _events(spark, root) -> DataFrame:
    """The event view over groups of one topic and neighbouring identifiers, members in order of doc_id."""
    d = vdocs(spark, root)
    m = d.select((F.col("topic") * 1000 + F.floor(F.col("doc_id") / 100)).cast("bigint").alias("event_id"), "doc_id", F.col("doc_id").alias("step"))
    return views.event_view(m, d).withColumn("divergence", F.round("divergence", 6))


@op(f"WITH {VDOCS}, {_EVENTS} SELECT * FROM ev")
def op_A2_event_view(spark, root):
    return _events(spark, root).select("event_id", "doc_count", "source_count", F.unix_micros("occurred").alias("occurred_us"), "title", "divergence")


@op(f"WITH {VDOCS}, {_EVENTS} SELECT event_id, source_count, doc_count FROM ev ORDER BY source_count DESC, doc_count DESC, event_id LIMIT 100")
def op_W9_top_events(spark, root):
    return _events(spark, root).orderBy(F.desc("source_count"), F.desc("doc_count"), "event_id").limit(100).select("event_id", "source_count", "doc_count")


@op(f"WITH {VDOCS}, {_EVENTS} SELECT event_id, divergence FROM ev WHERE source_count >= 2 AND divergence >= 0.30 ORDER BY divergence DESC, event_id LIMIT 100")
def op_P3_W10_contested(spark, root):
    e = _events(spark, root)
    return e.where(views.contested(e)).orderBy(F.desc("divergence"), "event_id").limit(100).select("event_id", "divergence")


@op(f"""WITH {VDOCS}, {_EVENTS}, n AS (SELECT m.*, coalesce(s.reliability, 'F') AS reliability, count(published) OVER (PARTITION BY event_id ORDER BY published RANGE BETWEEN INTERVAL 6 HOUR PRECEDING AND CURRENT ROW) AS c FROM m LEFT JOIN sources s ON s.label = m.source)
  SELECT event_id AS narrative_id, count(*) AS doc_count, count(DISTINCT source) AS source_count, epoch_us(min(published)) AS first_us, epoch_us(max(published)) AS last_us,
    round(CASE WHEN count(published) >= 2 THEN max(c) FILTER (published IS NOT NULL) / count(*) ELSE 0 END * (0.5 + 0.5 * avg(CASE WHEN reliability IN ('D', 'E', 'F') THEN 1.0 ELSE 0.0 END)), 4) AS coordination FROM n GROUP BY 1 ORDER BY coordination DESC, narrative_id LIMIT 1000""")
def op_A3_W11_narratives(spark, root):
    """The narrative view over the same groups, the most coordinated first."""
    d = vdocs(spark, root)
    m = d.select((F.col("topic") * 1000 + F.floor(F.col("doc_id") / 100)).cast("bigint").alias("narrative_id"), "doc_id", F.col("doc_id").alias("step"))
    v = views.narrative_view(m, d, table(spark, root, "sources").select("label", "reliability"))
    v = v.orderBy(F.desc_nulls_first("coordination"), "narrative_id").limit(1000)
    return v.select("narrative_id", "doc_count", "source_count", F.unix_micros("first_seen").alias("first_us"), F.unix_micros("last_seen").alias("last_us"), "coordination")


@op("SELECT source AS brief_id FROM evidence_items WHERE source IS NOT NULL GROUP BY 1 ORDER BY max(item_id) DESC LIMIT 100")
def op_W12_newest_briefs(spark, root):
    made = table(spark, root, "evidence_items").groupBy(F.col("source").alias("brief_id")).agg(F.timestamp_seconds(F.max("item_id")).alias("created_at"))
    b = _stored(spark, root).drop("created_at").join(made, "brief_id")
    return b.orderBy(F.desc("created_at"), "brief_id").limit(100).select("brief_id")


@op("""SELECT item_id, (t * 5 + lane)::BIGINT AS place FROM (SELECT item_id, lane, row_number() OVER (PARTITION BY lane ORDER BY item_id) AS t FROM (SELECT item_id, (item_id % 4)::INT AS lane FROM evidence_items))""")
def op_W4_interleave(spark, root):
    """All evidence items dealt to four lanes by number, with their places when the lanes take turns."""
    lane = F.element_at(text.words(*R.LANES), (F.col("item_id") % 4 + 1).cast("int"))
    taken = fusion.interleave(table(spark, root, "evidence_items").select("item_id", lane.alias("lane"), F.col("item_id").alias("pos")))
    return taken.select("item_id", F.col("pos").alias("place"))


@op()
def op_W14_overfetch(spark, root):
    rows = literal(spark, DETECTIONS, _GEO)
    return fusion.overfetch(rows, F.col("title") != "no id", 3).select("pos", "doc_id")


@op("""SELECT user_id, max(n) AS most FROM (SELECT user_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 60 SECOND PRECEDING AND CURRENT ROW) AS n FROM events) GROUP BY 1""")
def op_W17_sliding_count(spark, root):
    """The most requests of a user in any sixty seconds."""
    e = table(spark, root, "events").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    return intervals.sliding_counts(e, "user_id", "t", 60_000_000).groupBy("user_id").agg(F.max("n").alias("most"))


# ---- deduplication, sets, clusters

@op("SELECT doc_id, arg_max(title, ingested_at) AS title, count(*) AS copies FROM articles GROUP BY 1")
def op_D1_last_wins(spark, root):
    a = table(spark, root, "articles")
    return a.groupBy("doc_id").agg(F.max_by("title", "ingested_at").alias("title"), F.count("*").alias("copies"))


@op()
def op_D2_evidence_dedup(spark, root):
    """All evidence items in order of item_id, records and episodes once."""
    return evidence.deduplicate(table(spark, root, "evidence_items").withColumn("pos", F.col("item_id"))).select("pos", "item_id", "doc_id")


@op("SELECT * FROM (VALUES (1, 'd1'), (2, 'd3'), (4, 'd4'), (5, 'd5'), (6, '')) AS t(pos, doc_id)")
def op_D3_episodes(spark, root):
    return evidence.deduplicate_episodes(literal(spark, DETECTIONS, _GEO)).select("pos", "doc_id")


@op("SELECT entity_id, 'evt:' || substr(sha256(string_agg(doc_id, '|' ORDER BY doc_id)), 1, 21) AS event_id FROM (SELECT DISTINCT entity_id, doc_id FROM document_entities) GROUP BY 1")
def op_D6_cluster_ids(spark, root):
    m = table(spark, root, "document_entities").select("entity_id", "doc_id").distinct()
    return clustering.cluster_ids(m, ["entity_id"], "evt").withColumnRenamed("cluster_id", "event_id")


@op("SELECT lane, count(*) AS n FROM (SELECT 'a' AS lane FROM articles UNION ALL SELECT 'e' FROM evidence_items) GROUP BY 1")
def op_D7_union(spark, root):
    a = table(spark, root, "articles").select(F.lit("a").alias("lane"))
    return a.unionByName(table(spark, root, "evidence_items").select(F.lit("e").alias("lane"))).groupBy("lane").agg(F.count("*").alias("n"))


@op("SELECT count(*) AS both FROM (SELECT doc_id FROM articles INTERSECT SELECT doc_id FROM evidence_items)")
def op_D8_sets(spark, root):
    both = table(spark, root, "articles").select("doc_id").intersect(table(spark, root, "evidence_items").select("doc_id"))
    return both.agg(F.count("*").alias("both"))


# ---- functions

_W, _WS = r"[\p{L}\p{M}\p{N}_''-]", r"[\s\x{0b}\x{85}\p{Z}]"
_SPANS = (
    rf"list_filter(list_transform(regexp_extract_all({{0}}, '(?:^|[^\p{{L}}\p{{M}}\p{{N}}_])([A-Z]{_W}+(?:{_WS}+(?:of|the|and|[A-Z]{_W}+)){{0,4}})', 1), lambda x: trim(x)), lambda x: length(x) >= 3 AND NOT list_contains({sql_list(R.SENTENCE_OPENERS)}, "
    rf"regexp_extract(x, '^[^\s\x{{0b}}\x{{85}}\p{{Z}}]+')))"
).replace("{0}", "@@")


def spans_sql(expr: str) -> str:
    """SQL of the name spans of a text."""
    return _SPANS.replace("@@", expr)


@op(f"SELECT doc_id, coalesce(array_to_string(list_sort(list_distinct({spans_sql('text')})), '|'), '') AS spans FROM documents")
def op_F6_name_spans(spark, root):
    """Name spans of every text."""
    return table(spark, root, "documents").select("doc_id", F.array_join(F.array_sort(F.array_distinct(text.name_spans(F.col("text")))), "|").alias("spans"))


@op(f"""WITH {DOCS}, t AS (SELECT doc_id, unnest({spans_sql("CASE WHEN length(coalesce(summary, '')) > 0 THEN title || '. ' || summary ELSE title END")}) AS name FROM docs)
  SELECT substr(sha256('ENTITY:' || lower(trim(name))), 1, 24) AS entity_id, min(name) AS name, count(*) AS mentions FROM t GROUP BY 1""")
def op_A4_F6_F8_mentions(spark, root):
    d = docs(spark, root).withColumn("text", text.document_text(F.col("title"), F.col("summary")))
    return entities.mentions(d, "doc_id", "text").groupBy("entity_id").agg(F.min("name").alias("name"), F.sum("count").alias("mentions"))


@op("SELECT entity_id AS id, substr(sha256(type || ':' || lower(trim(name))), 1, 24) AS key FROM entities")
def op_F8_F26_entity_keys(spark, root):
    return table(spark, root, "entities").select(F.col("entity_id").alias("id"), text.entity_key(F.col("name"), F.col("type")).alias("key"))


@op(r"""WITH p AS (SELECT item_id, regexp_extract(published, '^(\d{4})-?(\d{2})-?(\d{2})(?:[Tt ](\d{2})(?::?(\d{2})(?::?(\d{2})(?:[.,](\d+))?)?)?(Z|[+-]\d{2}(?::?\d{2})?)?)?$', ['y', 'mo', 'd', 'h', 'mi', 's', 'f', 'z']) AS g,
    regexp_matches(published, '^(\d{4}-\d{2}-\d{2}|\d{8})([Tt ]|$)') AND NOT regexp_matches(published, '[Tt ]\d{2}(:\d{2}\d|\d{2}:)') AS ok FROM evidence_items),
  t AS (SELECT item_id, ok, g, try_cast(g.y || '-' || g.mo || '-' || g.d || ' ' || CASE WHEN g.h = '' THEN '00' ELSE g.h END || ':' || CASE WHEN g.mi = '' THEN '00' ELSE g.mi END || ':' || CASE WHEN g.s = '' THEN '00' ELSE g.s END AS TIMESTAMP) AS t FROM p)
  SELECT item_id, CASE WHEN ok THEN epoch_us(t) + CASE WHEN g.f = '' THEN 0 ELSE rpad(substr(g.f, 1, 6), 6, '0')::BIGINT END
    - CASE WHEN g.z IN ('', 'Z') THEN 0 ELSE (CASE WHEN g.z[1] = '-' THEN -1 ELSE 1 END) * (g.z[2:3]::BIGINT * 60 + CASE WHEN length(g.z) > 3 THEN right(g.z, 2)::BIGINT ELSE 0 END) * 60000000 END END AS at_us FROM t""")
def op_F9_F22_iso_times(spark, root):
    """The ISO time of every evidence item, with and without dashes and colons; null for what is no ISO time."""
    return table(spark, root, "evidence_items").select("item_id", F.round(evidence.iso_seconds(F.col("published")) * 1e6).cast("bigint").alias("at_us"))


@op("SELECT doc_id, nullif(lower(regexp_extract(text, '(?i)\\b(low|moderate|high)\\b', 1)), '') AS confidence FROM documents")
def op_F13_confidence(spark, root):
    return table(spark, root, "documents").select("doc_id", text.confidence_word(F.col("text")).alias("confidence"))


SECTIONED = [(1, "intro\n## Key Judgments:\n- one [E1]\n* two\n**CONFIDENCE:** moderate because\n\nIntelligence gaps\nWho paid Acme Corp and Jane Roe?")]


@op("SELECT * FROM (VALUES (1, 'KEY JUDGMENTS', 'one [E1]'), (1, 'KEY JUDGMENTS', 'two'), (1, 'CONFIDENCE', 'moderate because'), (1, 'INTELLIGENCE GAPS', 'Who paid Acme Corp and Jane Roe?')) AS t(k, section, line)")
def op_F12_sections(spark, root):
    return assess.sections(literal(spark, SECTIONED, "k bigint, body string"), "k", "body").drop("pos")


@op(r"""WITH line AS (SELECT doc_id, unnest(string_split_regex(text, '\r\n|[\n\x{0b}\f\r\x{85}\x{2028}\x{2029}]')) AS line FROM documents),
  bare AS (SELECT doc_id, trim(regexp_replace(line, '\s*\[[^\]]*\]', '', 'g')) AS t FROM line),
  parts AS (SELECT doc_id, t, list_transform(string_split_regex(t, '(?i)[.;]\s+|,?\s+(?:and|but|while|whereas|though|although|which|characteri[sz]ed\s+by)\s+|,\s+'), lambda p: regexp_replace(regexp_replace(regexp_replace(trim(p),
    '(?i)^(?:we\s+assess[^,]*?that|it\s+is\s+(?:likely|probable|possible|assessed|unclear)\s+that|there\s+(?:is|are)\s+likely|it\s+appears\s+that|reporting\s+(?:suggests|indicates)\s+that)\s+', ''),
    '(?i)^(?:likely|probably|possibly|reportedly|allegedly|apparently)\s+', ''), '^[ ,.]+|[ ,.]+$', '', 'g')) AS ps FROM bare),
  whole AS (SELECT doc_id, t, list_filter(ps, lambda p: len(list_filter(string_split_regex(p, '\s+'), lambda w: w <> '')) >= 3) AS ps FROM parts)
  SELECT doc_id, unnest(CASE WHEN len(ps) > 0 THEN ps WHEN t <> '' THEN [t] ELSE [] END) AS claim FROM whole""")
def op_F14_claims(spark, root):
    """Checkable claims of every line of every document."""
    lines = table(spark, root, "documents").select("doc_id", F.explode(F.split("text", r"\R")).alias("line"))
    return lines.select("doc_id", F.explode(text.claims(F.col("line"))).alias("claim"))


@op(rf"""WITH x AS (SELECT doc_id, regexp_extract_all(text, '(?:^|[^\p{{L}}\p{{M}}\p{{N}}_])([A-Z]{_W}+(?:{_WS}+[A-Z]{_W}+)+)', 1) AS n FROM documents),
  o AS (SELECT doc_id, q, min(i) AS i FROM (SELECT doc_id, unnest(n) AS q, generate_subscripts(n, 1) AS i FROM x) GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM o)
  SELECT d.doc_id, coalesce(string_agg(q, '|' ORDER BY k), '') AS queries FROM documents d LEFT JOIN r ON r.doc_id = d.doc_id AND k <= 4 GROUP BY 1""")
def op_F17_gap_queries(spark, root):
    return table(spark, root, "documents").select("doc_id", F.array_join(text.gap_queries(F.col("text")), "|").alias("queries"))


@op(f"""WITH h AS (SELECT label, sha1(unhex('{export.NAMESPACE.hex}') || encode('source:' || label)) AS h FROM sources)
  SELECT label, 'identity--' || h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || ['8', '9', 'a', 'b'][1 + ((strpos('0123456789abcdef', h[17]) - 1) % 4)] || h[18:20] || '-' || h[21:32] AS id FROM h""")
def op_F18_uuid5(spark, root):
    return table(spark, root, "sources").select("label", export.object_id("identity", F.concat(F.lit("source:"), "label")).alias("id"))


@op("SELECT doc_id, len(json_keys(raw)) AS fields FROM articles WHERE json_valid(raw) AND json_type(raw) = 'OBJECT'")
def op_F25_json(spark, root):
    """How many fields each article's payload has; what is no JSON object is left out."""
    return table(spark, root, "articles").select("doc_id", F.size(F.json_object_keys("raw")).alias("fields")).where("fields >= 0")


# ---- routing, briefs, evaluation

_TOUCHED = "['osint'] || " + " || ".join(f"CASE WHEN list_has_any(w, {sql_list(R.LANE_WORDS[n])}) THEN ['{n}'] ELSE [] END" for n in R.LANES[1:])


@op(rf"""WITH {GOLDS}, s AS (SELECT query_id, query, {_subject_sql('query')} AS x FROM golds), w AS (SELECT *, list_concat(x, list_transform(list_filter(x, lambda t: ends_with(t, 's')), lambda t: t[:-2])) AS w,
    regexp_matches(lower(query), '\b(all[ -]source|all (available )?(sources|lanes)|every (source|lane))\b') AS every, CASE WHEN regexp_matches(lower(query), '\b(osint|gdelt|rss|open[ -]source( reporting)?)\b') THEN ['osint'] ELSE [] END
    || CASE WHEN regexp_matches(lower(query), '\bsky lane\b') THEN ['sky'] ELSE [] END || CASE WHEN regexp_matches(lower(query), '\bocean lane\b') THEN ['ocean'] ELSE [] END || CASE WHEN regexp_matches(lower(query), '\bcyber lane\b') THEN ['cyber'] ELSE [] END AS named FROM s)
  SELECT query_id, array_to_string(CASE WHEN every THEN ['osint', 'sky', 'ocean', 'cyber'] WHEN len(named) > 0 THEN named WHEN len(x) = 0 THEN ['osint', 'sky', 'ocean', 'cyber'] ELSE {_TOUCHED} END, ',') AS lanes,
    CASE WHEN every THEN 'all sources asked for' WHEN len(named) > 0 THEN 'named lanes' WHEN len(x) = 0 THEN 'no subject' ELSE 'open sources and lanes whose words occur' END AS reason FROM w""")
def op_R1_lanes(spark, root):
    q = golds(spark, root)
    return q.select("query_id", F.array_join(fusion.lanes(F.col("query")), ",").alias("lanes"), fusion.reason(F.col("query")).alias("reason"))


@op()
def op_R3_fused(spark, root):
    """Lanes made of evidence items by number, fused."""
    items = table(spark, root, "evidence_items").withColumn("pos", F.col("item_id"))
    return fusion.fuse({lane: items.where(F.col("item_id") % 4 == i) for i, lane in enumerate(R.LANES)}).select("pos", "lane", "item_id")


@op(f"""WITH {GOLDS}, {_BM25}, {VDOCS}, top AS (SELECT query_id, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS r FROM lex) WHERE r <= 12),
  low AS (SELECT query_id, bool_and(coalesce(s.reliability, 'F') IN ('D', 'E', 'F')) AS low FROM top JOIN documents d USING (doc_id) LEFT JOIN sources s ON s.label = lower(regexp_replace(d.source, '^\\s+|\\s+$', '', 'g')) GROUP BY 1),
  v AS (SELECT query_id, doc_id, embedding FROM top JOIN vdocs USING (doc_id)),
  far AS (SELECT a.query_id, greatest(0, least(1, 1 - min(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])))) AS d FROM v a JOIN v b ON a.query_id = b.query_id AND a.doc_id < b.doc_id GROUP BY 1)
  SELECT query_id, CASE WHEN {_BLAMES} OR coalesce(low, false) OR (d >= 0.30 AND d < 0.75) THEN 'panel' ELSE 'quick' END AS mode FROM golds LEFT JOIN low USING (query_id) LEFT JOIN far USING (query_id)""")
def op_R5_effort(spark, root):
    """How much effort each gold question gets, by its wording and by grades and framing of its twelve best documents."""
    q, d = golds(spark, root), table(spark, root, "documents")
    top = retrieval.top_k(retrieval.bm25(d.select("doc_id", "text"), q), d, R.CONTEXT_ITEMS).select("query_id", "doc_id")
    grade = table(spark, root, "sources").select(F.col("label").alias("_l"), "reliability")
    sourced = top.join(d.select("doc_id", timestamps.label_key(F.col("source")).alias("_l")), "doc_id").join(grade, "_l", "left")
    low = sourced.groupBy("query_id").agg(F.bool_and(grades.low_tier(F.col("reliability"))).alias("low"))
    far = views.divergence(top.join(vdocs(spark, root).select("doc_id", "embedding"), "doc_id"), "query_id")
    rated = q.join(low, "query_id", "left").join(far, "query_id", "left")
    return rated.select("query_id", assess.effort(F.col("query"), F.col("low"), F.col("divergence")).alias("mode"))


@op("""WITH r AS (SELECT source, doc_id, title, upper(coalesce(nullif(reliability, ''), 'F')) || coalesce(nullif(credibility, 0), 6) AS g, row_number() OVER (PARTITION BY source ORDER BY item_id) AS n FROM evidence_items)
  SELECT source, string_agg('- ' || g || ' ' || coalesce(source, '') || ': ' || title || ' [' || doc_id || ']', chr(10) ORDER BY n) AS body FROM r WHERE n <= 8 GROUP BY 1""")
def op_R7_digest(spark, root):
    e = table(spark, root, "evidence_items").withColumn("pos", F.col("item_id"))
    return assess.digest(e, ["source"]).select("source", "body")


_RANKINGS = f"""{_BM25}, qv AS (SELECT query_id, embedding AS v FROM golds JOIN embeddings ON vec_id = query_id),
  cs AS (SELECT query_id, doc_id, round(list_cosine_similarity(embedding::DOUBLE[], v::DOUBLE[]), 9) AS score FROM vdocs, qv),
  lr AS (SELECT query_id, doc_id, rank() OVER (PARTITION BY query_id ORDER BY score DESC) AS lr FROM lex), rest AS (SELECT query_id, count(*) + 1 AS rest FROM lex GROUP BY 1),
  sr AS (SELECT query_id, doc_id, rank() OVER (PARTITION BY query_id ORDER BY score DESC) AS sr FROM cs),
  fs AS (SELECT query_id, doc_id, round(1.0 / (60 + coalesce(lr, rest)) + coalesce(1.0 / (60 + sr), 0), 12) AS score FROM lr FULL JOIN sr USING (query_id, doc_id) JOIN rest USING (query_id)),
  ranked AS (SELECT * FROM (SELECT 'bm25' AS ranker, query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM lex UNION ALL SELECT 'dense', query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) FROM cs
    UNION ALL SELECT 'rrf', query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) FROM fs) WHERE rank <= 20),
  rel AS (SELECT g.query_id, v.doc_id FROM golds g JOIN embeddings e ON e.vec_id = g.query_id JOIN vdocs v ON v.topic = e.label)"""


def _rankings(spark, root) -> tuple[dict[str, DataFrame], DataFrame]:
    """The first twenty by words, by vectors and by both; relevant are the documents of the question's topic."""
    q, d, v = golds(spark, root), table(spark, root, "documents").select("doc_id", "text"), vdocs(spark, root)
    emb = table(spark, root, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"), F.col("label").alias("topic"))
    lexical, dense = retrieval.bm25(d, q), retrieval.Dense(v, q.join(emb, "query_id"))
    first = lambda df: df.select("query_id", "doc_id", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")).alias("rank")).where("rank <= 20")
    rankings = {"bm25": first(lexical), "dense": first(dense.top(20)), "rrf": retrieval.fuse(lexical, dense, d, q, 20).select("query_id", "doc_id", "rank")}
    return rankings, q.join(emb, "query_id").join(v.select("doc_id", "topic"), "topic").select("query_id", "doc_id")


@op(f"""WITH {GOLDS}, {VDOCS}, {_RANKINGS}, kk AS (SELECT unnest([1, 3, 5, 10, 20]) AS k), rk AS (SELECT unnest(['bm25', 'dense', 'rrf']) AS ranker),
  hit AS (SELECT rk.ranker, rel.query_id, rel.doc_id, ranked.rank FROM rel CROSS JOIN rk LEFT JOIN ranked ON ranked.ranker = rk.ranker AND ranked.query_id = rel.query_id AND ranked.doc_id = rel.doc_id),
  per AS (SELECT ranker, query_id, k, avg(CASE WHEN rank <= k THEN 1.0 ELSE 0.0 END) AS recall, coalesce(1.0 / min(rank), 0) AS rr FROM hit, kk GROUP BY ALL)
  SELECT ranker, k, round(avg(recall), 9) AS recall, round(avg(rr), 9) AS mrr FROM per GROUP BY 1, 2""")
def op_A13_J17_R16_ablation(spark, root):
    """Recall at five depths and mean reciprocal rank of three rankers."""
    rankings, relevant = _rankings(spark, root)
    return evaluate.ablation(rankings, relevant).select("ranker", "k", F.round("recall", 9).alias("recall"), F.round("mrr", 9).alias("mrr"))


@op(f"""WITH {GOLDS}, {VDOCS}, {_RANKINGS}, hit AS (SELECT rel.query_id, ranked.rank FROM rel LEFT JOIN ranked ON ranker = 'rrf' AND ranked.query_id = rel.query_id AND ranked.doc_id = rel.doc_id),
  per AS (SELECT query_id, avg(CASE WHEN rank <= 3 THEN 1.0 ELSE 0.0 END) AS recall, coalesce(1.0 / min(rank), 0) AS rr FROM hit GROUP BY 1)
  SELECT unnest(['mean recall@3', 'MRR', 'citation coverage', 'fabricated citations', 'confidence breaches', 'brief metric', 'faithfulness', 'citation support']) AS metric,
    unnest([round(avg(recall), 9), round(avg(rr), 9), 0.5, (SELECT count(*) FROM golds), (SELECT count(*) FILTER (expectation = 'low') FROM golds), round((SELECT avg(CASE WHEN expectation = 'low' THEN 0.0 ELSE 0.5 END) FROM golds), 9), 0.5, 0.5]) AS value FROM per""")
def op_R13_evaluation(spark, root):
    """A whole evaluation run: the fused ranking, and for each question a brief of two judgments of which one is made up."""
    rankings, relevant = _rankings(spark, root)
    q = golds(spark, root)
    made = q.select("query_id", F.array(F.lit("Two ships went dark near the reef [E1]"), F.lit("[E9]")).alias("judgments"), F.lit("Moderate").alias("confidence"), F.col("expectation").alias("cap"))
    made = made.withColumn("judgments", F.array(F.col("judgments")[0], F.lit("nobody can say what happened there"))).withColumn("judgments", F.array(F.concat(F.col("judgments")[0], F.lit(" [E9]")), F.col("judgments")[1]))
    ev = q.select("query_id", F.lit(1).alias("n"), F.lit("d1").alias("doc_id"), F.lit("Two ships went dark near the reef").alias("title"), F.lit(None).cast("string").alias("summary"))
    return evaluate.evaluation(rankings["rrf"], relevant, made, ev).select("metric", F.round("value", 9).alias("value"))


@op("SELECT source AS brief_id, 3 AS turns, 'What does ' || source || ' say?' AS asked FROM evidence_items WHERE source IS NOT NULL AND length(source) % 5 > 2 GROUP BY 1")
def op_R14_trainset(spark, root):
    """Stored briefs fit for training; a part of them here lacks a citation, judgments, citations or a body."""
    b, n = _stored(spark, root).where("brief_id is not null"), F.length("brief_id") % 5
    none = F.array().cast("array<string>")
    odd = b.withColumns({"judgments": F.when(n == 0, none).when(n == 1, F.array(F.lit("not cited"))).otherwise(F.col("key_judgments")), "citations": F.when(n == 2, none).otherwise(F.col("citations"))})
    return export.training_examples(odd, "You write cited briefs.").select("brief_id", F.size("messages").alias("turns"), F.col("messages")[1]["content"].alias("asked"))


@op(f"""WITH {TIMED}, osint AS (SELECT count(*) AS n, arg_max(doc_id, (coalesce(epoch_us(published_at), -1), doc_id)) AS d, arg_max(title, (coalesce(epoch_us(published_at), -1), doc_id)) AS t FROM docs),
  other AS (SELECT item_id % 4 AS lane, count(*) AS n, arg_max(doc_id, item_id) AS d, arg_max(title, item_id) AS t FROM evidence_items GROUP BY 1)
  SELECT 'osint' AS lane, true AS configured, true AS reachable, n AS count, d AS last_doc_id, t AS last_title, NULL AS detail FROM osint UNION ALL SELECT 'sky', true, true, n, d, t, NULL FROM other WHERE lane = 1
  UNION ALL SELECT 'ocean', true, false, NULL, NULL, NULL, 'status check failed' UNION ALL SELECT 'cyber', false, false, NULL, NULL, NULL, 'not set up'""")
def op_R4_overview(spark, root):
    """State of the lanes: the articles, a part of the evidence, one that fails, one that isn't there."""
    e = table(spark, root, "evidence_items").where("item_id % 4 = 1").select("doc_id", "title", F.timestamp_seconds("item_id").alias("published"))

    def away():
        raise OSError

    lanes = {"osint": lambda: docs(spark, root).select("doc_id", "title", F.col("published_at").alias("published")), "sky": lambda: e, "ocean": away}
    return fusion.overview(spark, lanes).select("lane", "configured", "reachable", "count", "last_doc_id", "last_title", "detail")


@op(f"""WITH {DOCS}, hit AS (SELECT * FROM docs WHERE contains(lower(title), 'coast guard'))
  SELECT 'Coast Guard|Border Council' AS queries, (SELECT count(*) FROM hit) AS fetched, (SELECT count(*) FROM hit WHERE credibility IS NULL) AS new, (SELECT count(*) FROM docs WHERE credibility IS NOT NULL) > 0 AS briefed""")
def op_R11_collection_loop(spark, root):
    """A question's gaps become queries; what they bring is stored and the brief made again. One source is away."""
    own = docs(spark, root).select("doc_id", "title", "summary", "source", "credibility", "url")

    def fetch(q: str) -> DataFrame:
        if q != "Coast Guard":
            raise OSError
        return own.where(F.lower("title").contains("coast guard"))

    done = collection.loop(own.where("credibility is not null"), "What does the coast guard say?", table(spark, root, "sources"), fetch, lambda _: "Nothing on the Coast Guard, or on the Border Council and others")
    return literal(spark, [("|".join(done.queries), done.fetched, done.new, done.after.count() > 0)], "queries string, fetched bigint, new bigint, briefed boolean")


@op(f"""WITH {DOCS}, hit AS (SELECT count(*) FILTER (credibility IS NULL) AS new, count(*) AS fetched FROM docs WHERE contains(lower(title), 'coast guard'))
  SELECT * FROM (SELECT 'hello!' AS question, 'capabilities' AS triage, 0 AS fetched, 0 AS new UNION ALL SELECT 'zzqx wvvk', 'no_reporting', fetched, new FROM hit)""")
def op_R6_answers(spark, root):
    """Questions that get no brief: small talk, and one on which nothing is there even after collection."""
    own = docs(spark, root).select("doc_id", "title", "summary", "source", "credibility", "url")
    stored, fetch = own.where("credibility is not null"), lambda q: own.where(F.lower("title").contains("coast guard"))
    rows = [(q, a.triage, a.fetched, a.new) for q in ("hello!", "zzqx wvvk") for a in [collection.answer(stored, q, table(spark, root, "sources"), fetch)]]
    return literal(spark, rows, "question string, triage string, fetched bigint, new bigint")


# ---- stored briefs and the rest of the control flow

def _stored(spark, root) -> DataFrame:
    """A digest of every evidence source as a stored brief."""
    e = table(spark, root, "evidence_items").withColumn("pos", F.col("item_id"))
    d = assess.digest(e, ["source"])
    return d.select(F.col("source").alias("brief_id"), F.concat(F.lit("What does "), "source", F.lit(" say?")).alias("query"), "body", F.col("judgments").alias("key_judgments"), "citations", "confidence", F.lit(None).cast("string").alias("gaps"), F.lit("model").alias("backend"), F.lit(None).cast("timestamp").alias("created_at"))


@op("SELECT source AS brief_id, least(8, count(*)) AS cited FROM evidence_items WHERE source IS NOT NULL GROUP BY 1")
def op_K8_snapshot(spark, root):
    """Snapshot lines of the stored briefs, with the number of documents each cites."""
    line = F.from_json("line", "citations array<string>")["citations"]
    return briefs.snapshot(_stored(spark, root)).where("brief_id is not null").select("brief_id", F.size(line).cast("bigint").alias("cited"))


@op("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY item_id) AS n FROM evidence_items)
  SELECT source AS brief_id, coalesce('QUESTION: What does ' || source || ' say?' || chr(10) || chr(10), '') || 'KEY JUDGMENTS' || chr(10) || string_agg('- ' || title || ' [' || doc_id || ']', chr(10) ORDER BY n) FILTER (n <= 3) || chr(10) || chr(10) || 'CONFIDENCE' || chr(10) || 'low' || chr(10) || chr(10)
    || 'CITED' || chr(10) || string_agg('- ' || doc_id, chr(10) ORDER BY n) FILTER (n <= 8) AS text FROM r GROUP BY 1""")
def op_K10_render(spark, root):
    b = _stored(spark, root)
    return b.select("brief_id", briefs.render(b).alias("text"))


@op("SELECT source AS brief_id FROM evidence_items WHERE source IS NOT NULL GROUP BY 1")
def op_K4_worth_storing(spark, root):
    return briefs.worth_storing(_stored(spark, root)).where("brief_id is not null").select("brief_id")


@op(f"""WITH {GOLDS}, {_RELEVANT} SELECT query_id, CASE WHEN lower(query) IN ('hi', 'hello', 'help') THEN 'capabilities' WHEN coalesce(relevant, 0) = 0 THEN 'no_reporting' WHEN relevant < 3 THEN 'collect' ELSE 'brief' END AS answer
  FROM golds LEFT JOIN relevant USING (query_id)""")
def op_R6_triage(spark, root):
    """What each gold question gets, by the number of evidence items that share a subject word with it."""
    n = op_J9_relevant_evidence(spark, root)
    q = golds(spark, root).join(n, "query_id", "left")
    return q.select("query_id", briefs.triage(F.col("query"), F.col("relevant")).alias("answer"))


@op("SELECT count(*) AS n FROM evidence_items WHERE starts_with(lower(title), 'ais gap')")
def op_R2_salient_fallback(spark, root):
    """Items on AIS gaps, or all where there is none."""
    e = table(spark, root, "evidence_items")
    return fusion.or_salient(e.where(F.lower("title").startswith("ais gap")), e).agg(F.count("*").alias("n"))


@op(f"WITH {DOCS} SELECT doc_id, title, source, url, language, country, credibility FROM docs")
def op_P19_projection(spark, root):
    return docs(spark, root).select("doc_id", "title", "source", "url", "language", "country", "credibility")


FINDING = ([("Ships left", ["E1", "E2"]), ("Port closed", None)], "moderate", "two sources", ["weather held"], None, "", "ask the pilots", ["who paid"], None)
_FINDING = "key_judgments array<struct<judgment:string,citations:array<string>>>, confidence string, confidence_rationale string, key_assumptions array<string>, indicators array<string>, alternative_hypothesis string, collection_requirement string, intelligence_gaps array<string>, critique_response string"


@op("SELECT chr(10) AS nl, 'KEY JUDGMENTS:|- Ships left [E1] [E2]|- Port closed||CONFIDENCE: moderate — two sources||KEY ASSUMPTIONS: weather held||INDICATORS: (none stated)||ALTERNATIVES: Collection requirement: ask the pilots||INTELLIGENCE GAPS: who paid' AS finding, "
    "'[high] (vs h1) wrong port [E1]|[low] thin' AS critiques, '1. h3  (disconfirm=0.00, -0/+0)|2. h2  (disconfirm=0.40, -1/+0)|3. h1  (disconfirm=0.90, -1/+1)' AS ranking")
def op_F19_F20_renderers(spark, root):
    """A finding, critiques and a ranking as text, line ends shown as bars."""
    f = literal(spark, [FINDING], _FINDING)
    c = literal(spark, [([("high", "h1", "wrong port", None, ["E1"]), ("low", None, None, "thin", None)],)], "c array<struct<severity:string,target_hypothesis:string,challenged_claim:string,rationale:string,citations:array<string>>>")
    cells = literal(spark, CELLS, "hypothesis_pos int, hypothesis string, evidence string, assessment string")
    ranking = assess.render_ranking(assess.score_hypotheses(cells, _labels(spark).select("n", "reliability")).withColumn("g", F.lit(1)), ["g"])
    bars = lambda x: F.regexp_replace(x, "\n", "|")
    one = f.select(bars(assess.render_finding(F.struct("*"))).alias("finding")).crossJoin(c.select(bars(assess.render_critiques(F.col("c"))).alias("critiques"))).crossJoin(ranking.select(bars(F.col("text")).alias("ranking")))  # one row each
    return one.select(F.lit("\n").alias("nl"), "finding", "critiques", "ranking")


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
