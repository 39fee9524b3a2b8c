"""Queries over small tables whose rows are the awkward ones, against plain Python."""

import datetime
import html
import os
import re

import pytest

import __spark_entry__ as entry

UTC = datetime.UTC


def write(spark, path, **tables):
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(os.path.join(path, f"{name}.parquet"))
    return str(path)


def run(spark, root, name):
    return entry.queries()[name](spark, root).collect()


SPELLINGS = [  # doc_id, source, published, the hour of 1 May 2024 (UTC) that is meant
    ("d1", "alpha", "2024-05-01T10:00:00Z", 10), ("d2", "alpha", "1 May 2024 13:00 CEST", 11), ("d3", " Alpha ", "20240501T120000Z", 12), ("d4", "alpha", "1714564800", 12),
    ("d5", "alpha", "2024-05-01 22:00", 20), ("d6", "alpha", "soon", None), ("d7", "beta", "2024-05-01T09:00:00+09:00", 0), ("d8", "beta", "May 1, 2024 11:00 PM UTC", 23), ("d9", "beta", None, None),
]


@pytest.fixture(scope="module")
def spelled(spark, tmp_path_factory):
    arrived = datetime.datetime(2024, 5, 2, tzinfo=UTC)
    rows = [(d, s, f"title {d}", "", f"http://x/{d}", "en", "de", p, 2, [], None, None, arrived) for d, s, p, _ in SPELLINGS]
    articles = "doc_id string, source string, title string, summary string, url string, language string, country string, published string, credibility int, tags array<string>, raw string, enriched_at timestamp, ingested_at timestamp"
    sources = [("alpha", "Alpha", "news", "E", "", "", "Europe/Berlin"), ("beta", "Beta", "news", "A", "", "", None)]
    return write(spark, tmp_path_factory.mktemp("spelled"), articles=(rows, articles), sources=(sources, "label string, name string, kind string, reliability string, homepage string, notes string, tz string"))


def test_every_spelling_of_a_time_counts(spark, spelled):
    hours = lambda key: [h for _, s, _, h in SPELLINGS if s.strip().lower() == key]
    micros = lambda h: int(datetime.datetime(2024, 5, 1, h, tzinfo=UTC).timestamp()) * 1_000_000
    share = lambda key: max(sum(0 <= h - x <= 6 for x in hours(key) if x is not None) for h in hours(key) if h is not None) / len(hours(key))
    burst = {r.source_key: r.burstiness for r in run(spark, spelled, "op_W1_burstiness")}
    assert burst == {k: pytest.approx(share(k), abs=1e-6) for k in ("alpha", "beta")} and burst["alpha"] == pytest.approx(4 / 6, abs=1e-6)
    together = {r.source_key: r.coordination for r in run(spark, spelled, "op_A8_coordination")}
    assert together == {"alpha": pytest.approx(share("alpha"), abs=1e-4), "beta": pytest.approx(share("beta") / 2, abs=1e-4)}
    spans = {r.event_id: (r.doc_count, r.first_us, r.last_us) for r in run(spark, spelled, "op_A2_group_roll_up")}
    assert spans == {"alpha": (6, micros(10), micros(20)), "beta": (3, micros(0), micros(23))}
    order = [d for d, _, _, h in sorted(SPELLINGS, key=lambda r: (r[3] is None, -(r[3] or 0), r[0]))]
    assert [r.doc_id for r in run(spark, spelled, "op_W6_latest_published")] == order
    assert [r.doc_id for r in run(spark, spelled, "op_W7_latest")] == order[:1]


def documents(spark, path, texts):
    return write(spark, path, documents=(list(enumerate(texts)), "doc_id bigint, text string"))


def test_claims_of_every_line(spark, tmp_path):
    texts = ["Ships waited offshore for days\r\n\nWe assess that the port closed early [E1], and two cranes stood idle\nIt is likely that traffic will fall", "one line of claims only", None, ""]
    got = sorted((r.doc_id, r.claim) for r in run(spark, documents(spark, tmp_path, texts), "op_F14_claims"))
    want = ["Ships waited offshore for days", "the port closed early", "two cranes stood idle", "traffic will fall"]
    assert got == [*((0, c) for c in sorted(want)), (1, "one line of claims only")]


LEADS = {"The", "A", "An", "This", "That", "These", "Those", "It", "But", "And", "In", "On"}


def spans(t):
    found = [m.strip() for m in re.findall(r"\b([A-Z][\w'-]+(?:\s+(?:of|the|and|[A-Z][\w'-]+)){0,4})", t or "")]
    return "|".join(sorted({x for x in found if len(x) >= 3 and x.split()[0] not in LEADS}))


def test_name_spans_outside_ascii(spark, tmp_path):
    texts = ["The port of Málaga met José Muñoz Pérez and Anna", "Сергей met Boris Иванов in Kyiv", "Café Union Hall opened, The Port closed", "Plain Name here", "nothing", ""]
    got = {r.doc_id: r.spans for r in run(spark, documents(spark, tmp_path, texts), "op_F6_name_spans")}
    assert got == {i: spans(t) for i, t in enumerate(texts)} and "José Muñoz" in got[0] and "Boris" in got[1]


def test_iso_times_of_all_items(spark, tmp_path):
    times = ["2024-05-01T10:00:00Z", "2024-05-01", "2024-05-01 10:30", "2024-05-01T10:00:00.25+02:00", "2024-05-01T10:00:00-0530", "2024-05-01T10:00:00.123456-03:00", "2024-02-30", "soon", None]
    def micros(p):
        try:
            t = datetime.datetime.fromisoformat(p)
        except (TypeError, ValueError):
            return None
        return (t.replace(tzinfo=t.tzinfo or UTC) - datetime.datetime(1970, 1, 1, tzinfo=UTC)) // datetime.timedelta(microseconds=1)
    root = write(spark, tmp_path, evidence_items=(list(enumerate(times)), "item_id bigint, published string"))
    assert {r.item_id: r.at_us for r in run(spark, root, "op_F9_F22_iso_times")} == {i: micros(p) for i, p in enumerate(times)}


def body(t):
    page = "<article><p>" + t.replace("\n", "</p><p>") + "</p></article>"
    kept, total = [], 0
    for p in re.findall(r"(?is)<p\b[^>]*>(.*?)</p>", re.search(r"(?is)<article\b.*?</article>", page)[0]):
        p = re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]+>", " ", p))).strip()
        if len(p) >= 60 and " " in p and total < 1800:
            kept.append(p)
            total += len(p)
    return " ".join(kept)[:1800]


def test_main_text_with_markup(spark, tmp_path):
    long = "the harbour office said on Monday that the ferries would not sail before the end of the week"
    texts = [f"{long}\nshort\n{long} again", f"<p>{long}</p>\n{long} &amp; <b>more</b>", f"{long} <PLACE NAME> R&amp;D &lt;now&gt;", f"a & b, {long}", "", *[f"{long}\n" * 40]]
    got = {r.doc_id: r.body for r in run(spark, documents(spark, tmp_path, texts), "op_S9_main_text")}
    assert got == {i: body(t) for i, t in enumerate(texts)} and "more" in got[1] and "R&D <now>" in got[2]
