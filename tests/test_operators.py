"""Operators against plain Python, on random and awkward input."""

import hashlib
import json
import random
import uuid
from datetime import UTC, datetime, timedelta

import numpy as np
from pyspark.sql import functions as F

from factloom import registries as R
from factloom.functions import grades, sql, text, vectors
from factloom.operators import assess, clustering, collection, entities, evaluate, evidence, export, fusion, intervals, persist, retrieval, views
from factloom.operators.components import connected_components
from factloom.sources import feeds, landed, pages

AT = datetime(2025, 1, 1)


def one(spark, value, *columns, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(*columns).first()


def test_text_functions(spark):
    v = F.col("v")
    assert one(spark, "Are ships, tensions and Updates?", F.array_sort(text.subject_tokens(v)).alias("r")).r == ["ships"]
    assert "vessel" in one(spark, "the ocean", text.relevance_tokens(v).alias("r")).r
    assert one(spark, None, text.tokens(v).alias("r")).r == [] and one(spark, None, text.clean(v).alias("r")).r is None
    assert one(spark, " &lt;b&gt;Hi&lt;/b&gt;  there&nbsp;now ", text.clean(v).alias("r")).r == "Hi there now"
    assert one(spark, "US and IRAN dynamics", text.keyword_query(v).alias("a"), text.proper_noun_query(v).alias("b")) == ('"United States" and IRAN dynamics', '"United States" Iran')
    assert one(spark, "an ox", text.keyword_query(v).alias("a"), text.proper_noun_query(v).alias("b")) == ("an ox", None)
    assert one(spark, "The Bank of Xanadu met Élan Corp. It rained", text.name_spans(v).alias("r")).r[0] != "The"
    assert one(spark, "Two ships sailed [E1], and it is likely that the port closed early.", text.claims(v).alias("r")).r == ["Two ships sailed", "the port closed early"]
    assert one(spark, "x [E1, E2] y [d3]", text.citation_markers(v).alias("r")).r == ["E1", "E2", "d3"]
    assert one(spark, "ask Jane Roe and Acme Corp, Jane Roe", text.gap_queries(v).alias("r")).r == ["Jane Roe", "Acme Corp"]
    for q, meta in (("hi!", True), ("What can you do?", True), ("what is happening at the reef?", False), (None, False)):
        assert one(spark, q, text.is_meta(F.col("v")).alias("r")).r is meta


def test_main_text(spark):
    prose = "This sentence is long enough to pass for prose in a page of news, it is."
    page = f"<nav><p>{prose} nav</p></nav><!-- <p>{prose}</p> --><article><p>short</p><p>{prose} &amp; more</p><script><p>{prose}</p></script><p>{prose}</p></article><p>{prose} outside</p>"
    assert one(spark, page, text.main_text(F.col("v")).alias("r")).r == f"{prose} & more {prose}"
    assert one(spark, None, text.main_text(F.col("v")).alias("r")).r == ""
    assert len(one(spark, f"<p>{prose * 40}</p><p>{prose}</p>", text.main_text(F.col("v")).alias("r")).r) == R.MAX_BODY


def test_grades(spark):
    v = F.col("v")
    got = [one(spark, x, grades.as_credibility(v).alias("r")).r for x in ("3", " 6 ", "0", "7", "3.9", "x", None)]
    assert got == [3, 6, None, None, None, None, None]
    assert one(spark, None, grades.rating(v, F.lit(None).cast("int")).alias("r")).r == "F6"


def brute_dedup(items):
    """The episode rule item by item."""
    kept, ids, clusters = [], {}, {}
    score = lambda x: (len(x["summary"] or ""), x["url"] is not None, x["published"] is not None)
    for x in items:
        if x["doc_id"] in ids:
            i = ids[x["doc_id"]]
        else:
            ident = (x["source"].lower().strip(), " ".join("".join(c if c.isascii() and c.isalnum() else " " for c in x["title"].lower()).split()))
            t = datetime.fromisoformat(x["published"].replace("Z", "+00:00")) if x["published"] else None
            hit = None
            if t and all(ident):
                hit = next((c for c in clusters.get(ident, []) if any(abs(t - u) <= timedelta(minutes=30) for u in c[0])), None)
            if hit is None:
                ids[x["doc_id"]] = len(kept)
                if t and all(ident):
                    clusters.setdefault(ident, []).append(([t], len(kept)))
                kept.append((x["pos"], x))
                continue
            hit[0].append(t)
            i = ids[x["doc_id"]] = hit[1]
        if score(x) > score(kept[i][1]):
            kept[i] = (kept[i][0], x)
    return [(slot, x["item"]) for slot, x in kept]


def test_evidence_dedup_random(spark):
    rng = random.Random(5)
    for _ in range(3):
        rows = []
        for i in range(120):
            t = datetime(2025, 1, 1, tzinfo=UTC) + timedelta(minutes=rng.randrange(0, 400))
            rows.append({"pos": i, "item": i, "doc_id": f"d{rng.randrange(90)}", "title": rng.choice(["A b!", "a  B", "c", "--"]), "source": rng.choice(["S", "s ", "t"]), "summary": rng.choice([None, "x", "longer"]), "url": rng.choice([None, "u"]), "published": rng.choice([None, t.strftime("%Y-%m-%dT%H:%M:%SZ"), t.isoformat()])})
        df = spark.createDataFrame(rows, "pos bigint, item bigint, doc_id string, title string, source string, summary string, url string, published string")
        assert sorted((r.pos, r.item) for r in evidence.deduplicate(df).collect()) == sorted(brute_dedup(rows))
    assert evidence.deduplicate(df.limit(0)).count() == 0


def test_event_clusters_match_one_pass(spark):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((6, 8))
    rows = []
    for i in range(80):
        v = base[i % 6] + 0.25 * rng.standard_normal(8)
        at = datetime(2025, 1, 1) + timedelta(days=float(rng.integers(0, 40)))
        rows.append((f"d{i:02}", at, [float(x) for x in v], f"s{i % 5}", f"t{i}", None))
    df = spark.createDataFrame(rows, "doc_id string, published timestamp, embedding array<float>, source string, title string, summary string")
    ordered = sorted(rows, key=lambda r: (r[1], r[0]))
    cuts = clustering.greedy(np.array([r[2] for r in ordered], np.float32), np.array([r[1].timestamp() for r in ordered]), 0.78, 3 * 86400)
    want = {frozenset(r[0] for r, c in zip(ordered, cuts, strict=True) if c == k) for k in set(cuts)}
    found: dict = {}
    for r in clustering.events(df).collect():
        found.setdefault(r.event_id, set()).add(r.doc_id)
    assert {frozenset(s) for s in found.values()} == want and len(want) > 10
    view = views.event_view(clustering.events(df), df)
    assert view.agg(F.sum("doc_count")).first()[0] == 80
    odd = spark.createDataFrame([("a", None, None, "s", "t", None), ("b", None, [], "s", "t", None), ("c", None, [0.0, 0.0], "s", "t", None)], df.schema)
    assert [r.doc_id for r in clustering.events(odd).collect()] == ["c"]


def test_events_without_time_come_last(spark):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((5, 8))
    rows = [(f"d{i:02}", None if i % 4 == 0 else datetime(2025, 1, 1) + timedelta(days=float(rng.integers(0, 60))), [float(x) for x in base[i % 5] + 0.3 * rng.standard_normal(8)]) for i in range(90)]
    df = spark.createDataFrame(rows, "doc_id string, published timestamp, embedding array<float>")
    ordered = sorted(rows, key=lambda r: (r[1] is None, r[1] or AT, r[0]))
    cuts = clustering.greedy(np.array([r[2] for r in ordered], np.float32), np.array([np.nan if r[1] is None else r[1].timestamp() for r in ordered]), 0.78, 3 * 86400)
    want = {frozenset(r[0] for r, c in zip(ordered, cuts, strict=True) if c == k) for k in set(cuts)}
    found: dict = {}
    for r in clustering.events(df).collect():
        found.setdefault(r.event_id, set()).add(r.doc_id)
    assert {frozenset(s) for s in found.values()} == want
    only = df.where("published is null")
    assert clustering.events(only).select("doc_id").distinct().count() == only.count() and clustering.events(df.limit(0)).count() == 0


def test_cluster_ids(spark):
    rows = [(k % 7, f"m{k % 30:02}") for k in range(500)] + [(1, None)]
    got = {r.g: r.cluster_id for r in clustering.cluster_ids(spark.createDataFrame(rows, "g int, doc_id string").repartition(6), ["g"], "evt").collect()}
    want = {g: "evt:" + hashlib.sha256("|".join(sorted({m for h, m in rows if h == g and m})).encode()).hexdigest()[:21] for g in range(7)}
    assert got == want


def test_divergence_random(spark, monkeypatch):
    monkeypatch.setattr(views, "BLOCK", 20)
    rng = np.random.default_rng(9)
    rows = [(f"e{k % 5}", f"d{k:03}", [float(x) for x in np.array([3.0, 0, 0, 0]) * (k % 3) + rng.standard_normal(4)]) for k in range(300)] + [("one", "x", [1.0, 0.0, 0.0, 0.0]), ("flat", "x", [0.0] * 4), ("flat", "y", [1.0, 0.0, 0.0, 0.0]), ("none", "z", None)]
    got = {r.event_id: r.divergence for r in views.divergence(spark.createDataFrame(rows, "event_id string, doc_id string, embedding array<float>"), "event_id").collect()}
    for e in {r[0] for r in rows}:
        m = np.array([r[2] for r in rows if r[0] == e and r[2]], np.float32).astype(float)
        n = np.linalg.norm(m, axis=1, keepdims=True) if len(m) else m
        unit = m / np.where(n == 0, 1, n) if len(m) else m
        want = float(np.clip(1 - (unit @ unit.T)[np.triu_indices(len(m), 1)].min(), 0, 1)) if len(m) > 1 else 0.0
        assert abs(got[e] - want) < 1e-9, e


def test_narratives(spark):
    rows = [(f"d{i}", [1.0, 0.01 * i], f"s{i}", "t", None, AT + timedelta(hours=i)) for i in range(3)] + [("z", [0.0, 1.0], "s", "t", None, None)]
    df = spark.createDataFrame(rows, "doc_id string, embedding array<float>, source string, title string, summary string, published timestamp")
    sources = spark.createDataFrame([(f"s{i}", "D") for i in range(3)], "label string, reliability string")
    m = clustering.narratives(df)
    row = views.narrative_view(m, df, sources).first()
    assert row.doc_count == 3 and row.coordination == 1.0 and row.first_seen == AT


def test_divergence(spark):
    df = spark.createDataFrame([("a", "1", [1.0, 0.0]), ("a", "2", [0.6, 0.8]), ("b", "1", [1.0, 0.0]), ("c", "1", [0.0, 0.0]), ("c", "2", [1.0, 0.0])], "event_id string, doc_id string, embedding array<float>")
    assert {r.event_id: round(r.divergence, 6) for r in views.divergence(df, "event_id").collect()} == {"a": 0.4, "b": 0.0, "c": 1.0}


def test_burstiness_random(spark):
    rng = random.Random(1)
    rows = [(f"k{rng.randrange(8)}", rng.choice([None, AT + timedelta(minutes=rng.randrange(0, 3000))])) for _ in range(200)]
    df = spark.createDataFrame(rows, "k string, at timestamp")
    for k, burst in [(r.k, r.burstiness) for r in views.burstiness(df, "k", F.col("at")).collect()]:
        times = [t for key, t in rows if key == k]
        known = sorted(t for t in times if t)
        best = max((sum(1 for u in known if t <= u <= t + timedelta(hours=6)) for t in known), default=0)
        assert abs(burst - (best / len(times) if len(known) >= 2 else 0)) < 1e-9


def chosen(ranked, cap, k):
    """(identifiers of the first k, at most `cap` of a source, filled up by rank) of (identifier, source) in order."""
    first, rest, n = [], [], {}
    for d, s in ranked:
        (first if cap <= 0 or n.get(s, 0) < cap else rest).append(d)
        n[s] = n.get(s, 0) + 1
    return (first + rest)[:k]


def test_diverse_random(spark):
    rng = random.Random(4)
    for cap, k in ((2, 5), (0, 4), (1, 9)):
        rows = [(1, f"d{i:02}", rng.choice("aaab"), float(rng.randrange(6))) for i in range(40)]
        ranked = [(d, s) for _, d, s, _x in sorted(rows, key=lambda r: (-r[3], r[1]))]
        df = spark.createDataFrame(rows, "query_id int, doc_id string, source string, score double")
        assert [r.doc_id for r in retrieval.diverse(df, k, cap).orderBy("pick").collect()] == chosen(ranked, cap, k)


def fused(docs, vectors_, lexical, qvectors):
    """Reciprocal rank fusion of everything, by definition: {query: [(identifier, score) best first]}."""
    out = {}
    for q, v in qvectors.items():
        cos = {d: round(float(np.dot(x, v) / ((np.linalg.norm(x) * np.linalg.norm(v)) or 1)), 9) for d, x in vectors_.items()}
        lex = {d: s for (qq, d), s in lexical.items() if qq == q and s > 0}
        score = {}
        for d in docs:
            lr = 1 + sum(x > lex[d] for x in lex.values()) if d in lex else len(lex) + 1
            score[d] = 1 / (60 + lr) + (1 / (60 + 1 + sum(x > cos[d] for x in cos.values())) if d in cos else 0)
        out[q] = sorted(((d, round(x, 12)) for d, x in score.items()), key=lambda t: (-t[1], t[0]))
    return out


def test_fusion_of_rankings_equals_definition(spark):
    rng = np.random.default_rng(7)
    docs = [f"d{i:03}" for i in range(400)]
    vecs = {d: np.round(rng.standard_normal(4), 1) for d in docs[:300]}
    vecs["d005"] = np.zeros(4)
    qv = {q: rng.standard_normal(4) for q in (1, 2, 3, 4)}
    # ties everywhere; question 3 matches little, question 4 nothing
    lexical = {(q, d): float(rng.integers(1, 9)) for q, share in ((1, 0.6), (2, 0.2), (3, 0.01)) for d in docs if rng.random() < share}
    dd = spark.createDataFrame([(d, [float(x) for x in vecs[d]] if d in vecs else None) for d in docs], "doc_id string, embedding array<float>").repartition(5)
    qs = spark.createDataFrame([(q, [float(x) for x in v]) for q, v in qv.items()], "query_id int, vector array<double>")
    lex = spark.createDataFrame([(q, d, s) for (q, d), s in lexical.items()], "query_id int, doc_id string, score double")
    floats = {d: np.float32(v).astype(float) for d, v in vecs.items()}
    want = fused(docs, floats, lexical, qv)
    for k in (5, 40):
        got: dict = {}
        for r in retrieval.fuse(lex, retrieval.Dense(dd, qs), dd, qs, k).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append((r.doc_id, r.score))
        assert got == {q: w[:k] for q, w in want.items()}
    sources = {d: "big" if rng.random() < 0.95 else f"s{rng.integers(4)}" for d in docs}
    body = dd.join(spark.createDataFrame(list(sources.items()), "doc_id string, source string"), "doc_id")
    picked: dict = {}
    for r in retrieval._picked(lex, body, qs, 6, 2).orderBy("query_id", "pick").collect():
        picked.setdefault(r.query_id, []).append(r.doc_id)
    assert picked == {q: chosen([(d, sources[d]) for d, _ in w], 2, 6) for q, w in want.items()}
    assert retrieval.dense(dd.limit(0), qs, 3).count() == 0 and retrieval.dense(dd, qs.limit(0), 3).count() == 0


def test_gather(spark):
    docs = spark.createDataFrame(
        [("a", "Tanker seized near port", None, "S1", 2, "http://x/a"), ("b", "Tanker crew freed", "The crew of the tanker was freed on Monday and is on its way home by plane, the owner of the vessel said.", "s1", 3, None), ("c", "Harvest news", None, None, None, None)],
        "doc_id string, title string, summary string, source string, credibility int, url string",
    )
    page = spark.createDataFrame([("http://x/a", "<p>" + "The tanker was seized by the coast guard near the port on Sunday night. " * 2 + "</p>")], "url string, html string")
    asked, sources = spark.createDataFrame([(1, "tanker seizure")], "query_id int, query string"), spark.createDataFrame([("s1", "B")], "label string, reliability string")
    got = {r.doc_id: (r.reliability, r.summary) for r in retrieval.gather(docs, asked, sources, pages=page).collect()}
    assert set(got) == {"a", "b"} and got["a"][0] == "B" and got["a"][1].startswith("The tanker was seized")


def test_bm25_fill_and_empty(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["red fox", "red red dog", "blue cat", "", None])], "doc_id int, text string")
    q = spark.createDataFrame([(1, "red"), (2, "none of this")], "query_id int, query string")
    top = retrieval.top_k(retrieval.bm25(docs, q), docs, 3, queries=q)
    assert [r.doc_id for r in top.where("query_id = 1").orderBy("rank").collect()][:2] == [1, 0]
    assert [r.doc_id for r in top.where("query_id = 2").orderBy("rank").collect()] == [0, 1, 2]
    assert retrieval.bm25(docs.limit(0), q).count() == 0


def test_components_random(spark):
    rng = random.Random(9)
    edges = [(f"n{rng.randrange(60):02}", f"n{rng.randrange(60):02}") for _ in range(50)] + [(f"c{i:03}", f"c{i + 1:03}") for i in range(70)]
    parent: dict = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    want = {n: min(m for m in parent if find(m) == find(n)) for n in list(parent)}
    df = spark.createDataFrame([*edges, ("x", None)], "a string, b string")
    assert {r.node: r.component for r in connected_components(df).collect()} == want
    assert connected_components(df.limit(0)).count() == 0


def test_persist(spark):
    batch = spark.createDataFrame([("a", "s", 1), ("a", "t", 2), ("b", "s", 1), (None, "s", 1)], "doc_id string, source string, n int")
    stored = spark.createDataFrame([("b",)], "doc_id string")
    fresh, counts = persist.persist(batch, stored, F.col("n"))
    assert [(r.doc_id, r.source) for r in fresh.collect()] == [("a", "t")] and tuple(counts.first()) == (1, 1, 2)
    out = persist.upsert(batch.where("n = 1 and doc_id is not null"), spark.createDataFrame([("b", "new", 5)], batch.schema), "doc_id")
    assert {r.doc_id: r.source for r in out.collect()} == {"a": "s", "b": "new"}


def test_feeds(spark):
    rss = "<rss><channel><item><title>A &amp;amp; b</title><link>http://x/1</link><pubDate>Thu, 02 Jan 2025 03:04:05 GMT</pubDate><category>k</category><description>&lt;p&gt;body&lt;/p&gt;</description></item><item><link>http://x/2</link></item></channel></rss>"
    atom = "<feed xmlns='http://www.w3.org/2005/Atom'><entry><title>T</title><link rel='self' href='s'/><link rel='alternate' href='http://y'/><updated>2025-01-02T03:04:05Z</updated><content>c</content></entry></feed>"
    df = spark.createDataFrame([("r", rss), ("a", atom), ("h", "<html/>"), ("n", None), ("e", "")], "source string, xml string")
    docs, bad = feeds.parse_feeds(df)
    got = {r.source: r for r in docs.collect()}
    assert got["r"].title == "A & b" and got["r"].summary == "body" and got["r"].tags == ["k"] and got["r"].published == datetime(2025, 1, 2, 3, 4, 5)
    assert got["a"].url == "http://y" and got["a"].summary == "c" and got["a"].tags is None and len(got) == 2
    assert sorted(r.source for r in bad.collect()) == ["e", "h", "n"]
    payload = json.dumps({"articles": [{"url": "u", "domain": "X.com", "title": "", "seendate": "20250102T030405Z"}, {"title": "no url"}]})
    g = feeds.parse_gdelt(spark.createDataFrame([(payload,), ("[]",), (None,), ("no json",)], "payload string")).collect()
    assert len(g) == 1 and g[0].source == "x.com" and g[0].title == "u" and g[0].published == datetime(2025, 1, 2, 3, 4, 5)


def test_landed_and_pages(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"campaigns": [{"campaign_id": "c1", "report_count": "4", "cve_ids": ["X"]}]}))
    assert landed.read_campaigns(spark, str(tmp_path / "c.json")).first().campaign_id == "c1"
    (tmp_path / "g.json").write_text('{"doc_id": "g1", "title": "t", "credibility": "3"}\nnot json\n')
    assert [r.doc_id for r in landed.read_geoint(spark, str(tmp_path / "g.json")).collect()] == ["g1"]
    prose = "long enough prose to be taken from the page into the document, with blanks"
    docs = spark.createDataFrame([("1", "u1", "thin", [1.0]), ("2", "u2", "thin", [1.0]), ("3", None, None, [1.0])], "doc_id string, url string, summary string, embedding array<float>")
    got = {r.doc_id: r for r in pages.hydrate(docs, spark.createDataFrame([("u1", f"<p>{prose}</p>")], "url string, html string")).collect()}
    assert got["1"].summary == prose and got["1"].embedding is None and got["2"].embedding == [1.0] and not got["3"].hydrated
    spark.dataSource.register(landed.FetchSource)
    rows = spark.read.format("factloom_fetch").option("urls", '["file:///etc/hostname", "http://127.0.0.1:9/x"]').option("tries", "1").load().collect()
    assert [r.body for r in rows] == [None, None]


def test_export(spark):
    keys = ["a", "source:b", "é"]
    got = [r[0] for r in spark.createDataFrame([(k,) for k in keys], "k string").select(export.uuid5(F.col("k"))).collect()]
    assert got == [str(uuid.uuid5(export.NAMESPACE, k)) for k in keys]
    for n, valid in ((0, 0), (1, 0), (2, 1), (7, 1), (103, 20)):
        df = spark.range(n).withColumnRenamed("id", "k")
        assert export.train_valid(df, F.col("k")).where("split = 'valid'").count() == valid


def test_assess_and_evaluate(spark):
    ev = spark.createDataFrame([(1, "a", "B"), (1, "b", "B"), (2, "a", "D"), (3, "a", None), (4, "a", "A")], "k int, source string, reliability string")
    assert {r.k: r.ceiling for r in assess.ceiling(ev, ["k"]).collect()} == {1: "high", 2: "low", 3: "low", 4: "moderate"}
    low, high = F.lit("low"), F.lit("high")
    assert spark.range(1).select(assess.cap(high, low), assess.cap(low, high), assess.cap(F.lit(None).cast("string"), low)).first() == ("low", "low", None)
    modes = spark.range(1).select(*[assess.effort(F.lit(q), F.lit(a), F.lit(d).cast("double")) for q, a, d in (("who is behind this", False, None), ("what is new", True, None), ("what is new", False, 0.5), ("what is new", False, 0.9), ("what is new", None, None))]).first()
    assert tuple(modes) == ("panel", "panel", "panel", "quick", "quick")
    ranked = spark.createDataFrame([(1, "a", 1), (1, "b", 2)], "query_id int, doc_id string, rank int")
    relevant = spark.createDataFrame([(1, "b"), (1, "z"), (2, "y")], "query_id int, doc_id string")
    got = {r.query_id: (r.recall_1, r.recall_3, r.rr) for r in evaluate.retrieval_metrics(ranked, relevant, (1, 3)).collect()}
    assert got == {1: (0.0, 0.5, 0.5), 2: (0.0, 0.0, 0.0)}
    scorer = evaluate.model_scorer(lambda pairs: [float(h in p) for p, h in pairs])
    b = spark.createDataFrame([(1, ["ships went dark there [E1]", "nobody was seen [d1], and ships went dark there"]), (2, []), (3, ["no evidence at all"])], "brief_id int, judgments array<string>")
    e = spark.createDataFrame([(1, 1, "d1", "we saw ships went dark there", None), (1, 2, "d2", "nobody was seen", "")], "brief_id int, n int, doc_id string, title string, summary string")
    got = {r.brief_id: (r.claims, round(r.faithfulness, 3), round(r.support, 3)) for r in evaluate.entailment(b, e, scorer=scorer).collect()}
    assert got == {1: (3, 1.0, 0.667), 2: (0, 0.0, 0.0), 3: (0, 0.0, 0.0)}
    strict = {r.brief_id: (r.claims, r.faithfulness) for r in evaluate.entailment(b, e, scorer=scorer, atomic=False).collect()}
    assert strict[1] == (2, 0.5)
    logits = spark.createDataFrame([([1.0, 3.0, 0.5],), ([1000.0, 0.0, 0.0],), (None,)], "x array<double>").select(evaluate.entailment_probability(F.col("x")).alias("p")).collect()
    assert abs(logits[0].p - np.exp(3) / np.exp([1, 3, 0.5]).sum()) < 1e-12 and logits[1].p == 0 and logits[2].p is None
    assert evaluate.agreement(spark.createDataFrame([], "premise string, hypothesis string, entailed boolean")).first().agreement == 1.0


def test_fetch_articles(spark):
    asked, waits = [], []

    def get(url):
        asked.append(url)
        if len(asked) == 1:
            raise OSError
        return '{"articles": []}' if len(asked) == 2 else '{"articles": [{"url": "http://x/1", "title": "T", "domain": "X.com", "seendate": "20250101T000000Z"}]}'

    got = landed.fetch_articles(spark, "What is the EU doing about Iran", "http://api", get, wait=waits.append, language="eng").collect()
    assert [r.source for r in got] == ["x.com"] and len(asked) == 3 and waits == [1.0, 5.0]
    assert "maxrecords=75" in asked[0] and "sourcelang%3Aeng" in asked[0] and "Iran" in asked[2] and "doing" not in asked[2]
    assert landed.fetch_articles(spark, "ports", "http://api", lambda _: "<html>", wait=waits.append).count() == 0


def test_collection(spark):
    schema = "doc_id string, title string, summary string, source string, credibility int, url string"
    docs = spark.createDataFrame([("a", "Tanker seized near Aden", None, "s1", 2, None)], schema)
    sources = spark.createDataFrame([("s1", "B")], "label string, reliability string")
    more = spark.createDataFrame([("a", "other", None, "s1", 2, None), ("b", "Tanker crew freed", None, "s1", 3, None), ("c", "Tanker owner speaks", None, "s2", 3, None)], schema)
    thin = collection.answer(docs, "tanker seizure", sources, lambda q: more)
    assert (thin.triage, thin.fetched, thin.new) == ("collect", 3, 2) and len(thin.before.first().citations) == 1 and set(thin.after.first().citations) == {"a", "b", "c"}

    def away(_):
        raise OSError

    assert collection.answer(docs, "tanker seizure", sources, away).new == 0 and collection.answer(docs, "volcano", sources, away).triage == "no_reporting"
    assert collection.answer(docs, "thanks!", sources, away).triage == "capabilities"


def test_entities_idempotent(spark):
    docs = spark.createDataFrame([("d1", "Acme Corp met Jane Roe. Acme Corp lost", AT), ("d2", "so did Acme Corp", datetime(2024, 1, 1)), ("d3", None, AT)], "doc_id string, text string, at timestamp")
    edges = entities.mentions(docs, "doc_id", "text").select("doc_id", "entity_id", "count", "name")
    twice = edges.unionByName(edges)
    rolled = entities.roll_up(twice, docs, "at").join(edges.select("entity_id", "name").distinct(), "entity_id")
    acme = rolled.where("name = 'Acme Corp'").first()
    assert (acme.mentions, acme.documents, acme.first_seen) == (3, 2, datetime(2024, 1, 1))


def test_fusion(spark):
    items = lambda lane, n: spark.createDataFrame([(i, f"{lane}{i}", f"{lane} {i}", lane, "B", None, None) for i in range(n)], "pos bigint, doc_id string, title string, source string, reliability string, summary string, url string").withColumn("published", F.lit(None).cast("string"))
    got = [r.doc_id for r in fusion.fuse({"osint": items("o", 3), "cyber": items("c", 1)}).orderBy("pos").collect()]
    assert got == ["o0", "c0", "o1", "o2"]

    def broken(_):
        raise OSError

    fused, routed = fusion.gather(spark, "hackers and malware", {"osint": lambda q: items("o", 2), "cyber": broken})
    assert routed == ["osint", "cyber"] and fused.count() == 2
    try:
        fusion.gather(spark, "harvest", {"osint": broken})
        raise AssertionError
    except OSError:
        pass
    camp = spark.createDataFrame([(1, [("T1",)])], "pos bigint, techniques array<struct<technique_id:string>>").withColumn("techniques", F.transform("techniques", lambda t: F.struct(t["technique_id"].alias("technique_id"), F.lit(None).cast("string").alias("id"))))
    assert evidence.rank_campaigns(camp, None).count() == 1 and evidence.rank_campaigns(camp, spark.createDataFrame([], "technique_id string")).count() == 0


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.6, 0.8]), ([0.0, 0.0], [1.0, 0.0]), ([1.0], [1.0, 0.0])], "a array<float>, b array<float>")
    assert [None if r[0] is None else round(r[0], 6) for r in df.select(vectors.cosine(F.col("a"), F.col("b"))).collect()] == [0.6, 0.0, None]
    assert df.select(vectors.hyperplane_bucket(F.col("b"), 2, 4)).first()[0] in {f"{i:04b}" for i in range(16)}


def test_intervals_random(spark):
    rng = random.Random(7)
    rows = [(rng.choice(["a", "a", "b", None]), rng.choice([None, rng.randrange(0, 400), 10, 20])) for _ in range(300)]
    df = spark.createDataFrame(rows, "k string, at bigint")
    got = sorted((str(r.k), r.at, r.n) for r in intervals.sliding_counts(df, "k", "at", 10).collect())
    want = sorted((str(k), t, sum(1 for k2, u in rows if k2 == k and u is not None and t - 10 <= u <= t)) for k, t in rows if t is not None)
    assert got == want
    timed = df.where("at is not null and k is not null")
    for k in ("a", "b"):
        times = sorted(t for key, t in rows if key == k and t is not None)
        stretch, cuts = {}, 0
        for x, y in zip(times, times[1:]):
            stretch.setdefault(x, cuts)
            cuts += y - x > 3
            stretch.setdefault(y, cuts)
        found = {r.at: r.stretch for r in intervals.stretches(timed, ["k"], "at", 3).where(F.col("k") == k).collect()}
        assert found == stretch
    numbered = intervals.row_numbers(spark.createDataFrame([(k, i) for i, (k, _) in enumerate(rows)], "k string, i int"), "k", "i", "n").collect()
    for k in ("a", "b", None):
        assert [r.n for r in sorted((r for r in numbered if r.k == k), key=lambda r: r.i)] == list(range(1, sum(1 for key, _ in rows if key == k) + 1))


def test_competition_ranks_random(spark):
    rng = random.Random(8)
    rows = [(rng.choice([1, 1, 2, None]), rng.choice([0.0, 0.5, float(rng.randrange(50)), None])) for _ in range(400)]
    got = sorted(((str(r.q), str(r.s), r.rank) for r in intervals.competition_ranks(spark.createDataFrame(rows, "q int, s double"), "q", "s", "rank").collect()))
    key = lambda s: -1.0 if s is None else s
    want = sorted((str(q), str(s), 1 + sum(1 for q2, s2 in rows if q2 == q and key(s2) > key(s))) for q, s in rows)
    assert got == want


def test_functions_for_sql(spark):
    assert sql.register(spark) == ["fl_html_unescape", "fl_hash_embedding", "fl_cosine"]
    row = spark.sql("SELECT fl_html_unescape('a &amp; b &eacute;') AS t, size(fl_hash_embedding('some words')) AS n, fl_cosine(array(1D, 0D), array(3D, 4D)) AS c, fl_cosine(array(1D), array(1D, 2D)) AS none").first()
    assert tuple(row) == ("a & b é", 64, 0.6, None)
