"""Leaks that only a search of every window and every item window finds."""

from factloom.llm import leakage


def kinds(spark, docs, items):
    d, i = spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame(items, "item_id int, text string")
    return {(r.doc_id, r.item_id): r.kind for r in leakage.leaks(leakage.search(d, i)).collect()}


def test_paraphrase_with_nine_known_words(spark):
    item = "alpha bravo charlie delta echo foxtrot golf hotel india juliett kilo lima"
    told = " ".join("zulu" if k in (2, 5, 8) else w for k, w in enumerate(item.split()))
    assert kinds(spark, [(1, told), (2, "nothing of it")], [(7, item)]) == {(1, 7): "paraphrase"}


def test_paraphrase_of_a_farther_window(spark):
    w = [f"w{k}" for k in range(15)]
    told = [w[k] for k in (3, 4, 5, 6, 7, 8, 12, 13, 14, 11, 10, 9, 2, 1, 0, 1, 0)]
    assert kinds(spark, [(1, " ".join(told)), (2, "nothing of it")], [(7, " ".join(w))]) == {(1, 7): "paraphrase"}


def test_run_of_common_words_among_rare_ones(spark):
    common, rare = [f"c{k}" for k in range(12)], [f"r{k}" for k in range(24)]
    docs = [(i, " ".join(f"{c} x{i}" for c in common)) for i in range(1, 41)]
    leak = (100, " ".join([*rare[:6], *common, *rare[6:]]))
    found = kinds(spark, [*docs, leak], [(7, " ".join(common)), *((20 + k, " ".join(rare[k::2])) for k in (0, 1))])
    assert found.get((100, 7)) == "exact" and not any(d < 100 and k == "exact" for (d, _), k in found.items())
