"""Schemas of the corpus tables and of the records that operators exchange."""

from __future__ import annotations

SOURCES = "label string, name string, kind string, reliability string, homepage string, notes string"
DOCUMENTS = (
    "doc_id string, source string, title string, summary string, url string, language string, country string, published timestamp, "
    "credibility int, embedding array<float>, tags array<string>, raw string, enriched_at timestamp, ingested_at timestamp"
)
ENTITIES = "entity_id string, name string, type string, mentions bigint, first_seen timestamp, last_seen timestamp"
DOCUMENT_ENTITIES = "doc_id string, entity_id string, count int"
EVENTS = "event_id string, title string, summary string, occurred timestamp, doc_count bigint, source_count bigint, divergence double"
EVENT_DOCUMENTS = "event_id string, doc_id string"
TAG = "struct<technique_id:string,name:string,phase:string,score:double>"
NARRATIVES = (
    f"narrative_id string, label string, summary string, doc_count bigint, source_count bigint, coordination double, disarm array<{TAG}>, "
    "first_seen timestamp, last_seen timestamp, created_at timestamp"
)
BRIEFS = (
    "brief_id string, query string, body string, key_judgments array<string>, citations array<string>, confidence string, "
    "gaps string, backend string, created_at timestamp"
)
#: What every lane gives before fusion.
EVIDENCE = "doc_id string, title string, source string, reliability string, credibility int, summary string, published string, url string"
EVIDENCE_COLUMNS = [c.split()[0] for c in EVIDENCE.split(", ")]
GEOINT = (
    "doc_id string, title string, source string, reliability string, credibility string, summary string, published string, url string, "
    "kind string, detector string, mmsi string, counterpart_mmsi string, icao24 string, zone string"
)
CAMPAIGN = (
    "campaign_id string, id string, name string, title string, label string, description string, summary string, cve_ids array<string>, kev_cves array<string>, "
    "report_count string, techniques array<struct<technique_id:string,id:string,name:string,score:double>>, age_days string, reports array<struct<title:string>>"
)
GDELT = "articles array<struct<url:string,title:string,domain:string,language:string,sourcecountry:string,seendate:string>>"
ITEM = "title:string,link:string,guid:string,description:string,pubDate:string,category:array<string>,author:string"
RSS = f"channel struct<title:string,item:array<struct<{ITEM}>>>"
LINK = "struct<_rel:string,_href:string>"
ATOM = (
    f"title string, entry array<struct<title:string,link:array<{LINK}>,id:string,summary:string,content:string,published:string,updated:string,"
    "category:array<struct<_term:string>>,author:struct<name:string>>>"
)
