"""The orphan ledger against recomputing everything."""

import random
from datetime import datetime

from factloom.operators import orphans

REF = orphans.REFERENCE


def refs(spark, keys, at=datetime(2025, 1, 1)):
    return spark.createDataFrame([("t.f", "p", k, f"d{i}", "", at) for i, k in enumerate(keys)], REF)


def keys(spark, names):
    return spark.createDataFrame([("p", n) for n in names], orphans.KEY)


def pending(ledger):
    return sorted(str(r.key) for r in ledger.pending.collect())


def test_arrivals_resolve_and_deletions_reopen(spark):
    ledger = orphans.OrphanLedger(spark)
    ledger.apply(1, refs=refs(spark, ["a", "b", None]), arrived=keys(spark, ["a"]))
    assert pending(ledger) == ["None", "b"]
    ledger.apply(2, arrived=keys(spark, ["b", "c"]))
    assert pending(ledger) == ["None"]
    ledger.apply(3, deleted=keys(spark, ["a"]))
    assert pending(ledger) == ["None", "a"]
    ledger.apply(3, deleted=keys(spark, ["b"]))  # the same batch again
    assert pending(ledger) == ["None", "a"]
    ledger.apply(4, arrived=keys(spark, ["a"]), deleted=keys(spark, ["a"]))
    assert pending(ledger) == ["None", "a"]
    ledger.apply(5)
    assert pending(ledger) == ["None", "a"]


def test_random_batches(spark):
    rng = random.Random(3)
    ledger, alive, seen = orphans.OrphanLedger(spark), set(), []
    for batch in range(5):
        new = [(f"k{rng.randrange(12)}", f"{batch}-{i}") for i in range(10)]
        come, go = {f"k{rng.randrange(12)}" for _ in range(3)}, {f"k{rng.randrange(12)}" for _ in range(2)}
        ledger.apply(batch, refs=spark.createDataFrame([("t.f", "p", k, d, "", None) for k, d in new], REF), arrived=keys(spark, come), deleted=keys(spark, go))
        alive = (alive | come) - go
        seen += new
        assert sorted((r.key, r.doc_id) for r in ledger.pending.collect()) == sorted(x for x in seen if x[0] not in alive)


def test_a_reference_of_two_batches_counts_once(spark):
    ledger = orphans.OrphanLedger(spark)
    ledger.apply(1, refs=refs(spark, ["x", "y"]))
    ledger.apply(2, refs=refs(spark, ["x", "y"]))
    assert pending(ledger) == ["x", "y"] and ledger.snapshot().first().orphans == 2
    ledger.apply(3, arrived=keys(spark, ["x"]))
    ledger.apply(4, refs=refs(spark, ["x", "y"]), deleted=keys(spark, ["x"]))
    assert pending(ledger) == ["x", "y"]


def test_a_reopened_ledger_goes_on(spark, tmp_path):
    path = str(tmp_path / "ledger")
    orphans.OrphanLedger(spark, path).apply("a", refs=refs(spark, ["x", "y"]), arrived=keys(spark, ["z"]))
    # a broken batch: data without a manifest
    refs(spark, ["lost"]).write.parquet(f"{path}/refs/v2")
    again = orphans.OrphanLedger(spark, path)
    assert pending(again) == ["x", "y"] and again.version == 1
    again.apply("a", refs=refs(spark, ["w"]))
    assert pending(again) == ["x", "y"]
    again.apply("b", refs=refs(spark, ["z"]), arrived=keys(spark, ["y"]), deleted=keys(spark, ["z"]))
    assert pending(orphans.OrphanLedger(spark, path)) == ["x", "z"] and orphans.OrphanLedger(spark, path).refs.count() == 3


def test_folded_index(spark, monkeypatch):
    monkeypatch.setattr(orphans, "DELTAS", 2)
    ledger = orphans.OrphanLedger(spark)
    for n, (come, go) in enumerate([(["a"], ["q"]), (["b"], ["a"]), (["c"], []), (["a"], ["b"]), (["d"], [])]):
        ledger.apply(n, arrived=keys(spark, come), deleted=keys(spark, go) if go else None)
    assert sorted(r.key for r in ledger.keys.collect()) == ["a", "c", "d"] and len(ledger._keys) <= 2
    ledger.apply("probe", refs=refs(spark, ["a", "b", "c", "d"]))
    assert pending(ledger) == ["b"]


def test_corpus(spark):
    at = datetime(2025, 2, 3)
    articles = spark.createDataFrame([("d1", " Wire ", at, 1), ("d2", "  ", at, 1), ("d3", None, at, 1), ("d4", "ghost", None, 1)], "doc_id string, source string, ingested_at timestamp, n int")
    edges = spark.createDataFrame([("d1", "e1", at), ("x", "y", at), ("x", "y", at), ("d2", "zz", None)], "doc_id string, entity_id string, extracted_at timestamp")
    entities, sources = spark.createDataFrame([("e1",)], "entity_id string"), spark.createDataFrame([("wire",)], "label string")
    for waves in (1, 3):
        ledger = orphans.replay(spark, articles, edges, entities, sources, waves)
        assert sorted((r.ref_field, r.doc_id, r.entity_id) for r in ledger.pending.collect()) == [
            ("articles.source", "d4", ""), ("document_entities.doc_id", "x", "y"), ("document_entities.entity_id", "d2", "zz"), ("document_entities.entity_id", "x", "y"),
        ]
    counts = {(r.table_name, r.field, r.month): r.orphans for r in ledger.snapshot().collect()}
    assert counts[("document_entities", "entity_id", "2025-02")] == 1 and counts[("document_entities", "entity_id", None)] == 1
    empty = orphans.replay(spark, articles.limit(0), edges.limit(0), entities.limit(0), sources.limit(0))
    assert empty.pending.count() == 0
