"""Caps, formatting copies and containers against plain Python."""

import itertools
import random
import unicodedata

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from factloom.llm import capping, formatting_copies, packing


def test_cap_random(spark):
    rng = random.Random(2)
    for most in (0, 1, 3, 17):
        rows = [(f"{rng.choice(['', 'a', 'ab:', 'é'])}{rng.randrange(400)}", rng.choice(["big", "big", "small", None]), rng.choice([None, 0, 1, 2, 6, 9])) for _ in range(300)]
        rows = list({r[0]: r for r in rows}.values())
        df = spark.createDataFrame(rows * 2 + [(None, "big", 1)], "doc_id string, g string, key int")
        want = set()
        for group in ("big", "small"):
            ranked = sorted((q if q in range(1, 7) else 6, d.encode()) for d, g, q in rows if g == group)
            want |= {d.decode() for _, d in ranked[most:]}
        got = capping.over_cap(df, F.col("g"), "doc_id", F.col("key"), most=most)
        assert {r.doc_id for r in got.collect()} == want and got.count() == len(want)


def test_cap_share_and_empty(spark):
    df = spark.createDataFrame([(f"d{i:03}", "s", 3) for i in range(150)], "doc_id string, g string, q int")
    assert capping.over_cap(df, F.col("g"), "doc_id", F.col("q"), share=0.01).count() == 149
    assert capping.over_cap(df.limit(0), F.col("g"), "doc_id", F.col("q"), share=0.01).count() == 0


def variants(rng, title):
    t = rng.choice([title, title.upper(), title.lower(), unicodedata.normalize("NFD", title), title.replace(" ", "  "), f"- {title};", title.replace("e", "e-", 1) if "e" in title else title])
    return t


def test_copies_random(spark):
    rng = random.Random(6)
    base = ["Côte d'Azur alert", "Straße zu", "AIS gap 12", "gap AIS 12", "été", "ete", "Ölfund über", "12", "--"]
    rows = []
    for i in range(240):
        fields = rng.sample(base, rng.randrange(1, 3))
        title = rng.choice([" | ", " - ", " :: ", " — "]).join(variants(rng, f) for f in fields)
        rows.append((i, rng.choice(["Wire", " wire", "W-ire", "post"]), title))
    rows += [(900, None, "x"), (901, "Wire", None), (902, None, "x"), (None, "Wire", "x")]
    df = spark.createDataFrame(rows + rows[:5], "item_id int, source string, title string").withColumn("key", F.lit(1)).withColumn("h1", F.lit(2))
    by: dict = {}
    for i, s, t in rows:
        if None not in (i, s, t):
            by.setdefault(formatting_copies.exact_key(s, t), set()).add(i)
    want = {(min(g), i) for g in by.values() for i in g if i != min(g)}
    got = formatting_copies.copy_groups(df)
    assert {(r.keep, r["copy"]) for r in got.collect()} == want and got.count() == len(want)
    assert formatting_copies.copy_groups(df.limit(0)).count() == 0


def test_exact_key():
    key = formatting_copies.exact_key
    assert key("Wire", "A b | C") == key("w i r e", "c — a B!") and key("w", "a b") != key("w", "b a")
    assert key("w", "été") == key("w", "été") != key("w", "ete")


def test_skeleton_is_the_letters(spark):
    """The invariants are made of what the exact key is made of, for any text of Unicode."""
    texts = ["Straße", "STRASSE", "É l'eau", "é L’EAU", "E\u0301 l eau", "й И", "и\u0306 И", "İx", "ΣΑΣ", "σας", "ﬁle", "File", "がぎ", "か\u3099き\u3099", "한글", "\u1112\u1161\u11ab\u1100\u1173\u11af", "", "--", "𝔘nicode", "Ⅷ"]
    rng = random.Random(4)
    texts += ["".join(chr(rng.choice([rng.randrange(32, 0x500), rng.randrange(0x1E00, 0x3100), rng.randrange(0xAC00, 0xD7A3), rng.randrange(0xF900, 0xFFDC)])) for _ in range(12)) for _ in range(400)]
    texts += [unicodedata.normalize("NFD", t) for t in texts] + [t.upper() for t in texts]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", formatting_copies.skeleton(F.col("t")).alias("s")).collect()
    assert all(r.s == formatting_copies.letters(r.t) for r in got)


def test_copies_in_other_scripts(spark):
    pairs = [("がぎぐ情報", unicodedata.normalize("NFD", "がぎぐ情報")), ("한글 소식", unicodedata.normalize("NFD", "한글 소식")), ("ﬁle report", "FILE: report"), ("Étude | ßig", "SSIG - e\u0301tude")]
    rows = [(2 * k + n, "Wire", t) for k, pair in enumerate(pairs) for n, t in enumerate(pair)]
    got = formatting_copies.copy_groups(spark.createDataFrame(rows, "item_id int, source string, title string"))
    assert {(r.keep, r["copy"]) for r in got.collect()} == {(2 * k, 2 * k + 1) for k in range(len(pairs))}


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 50), min_size=1, max_size=9), st.integers(1, 5))
def test_optimal_bounds(hist, buckets):
    sizes, counts = np.array(sorted(hist)), np.array([hist[k] for k in sorted(hist)])
    cost = lambda bounds: int(sum((min(b for b in bounds if b >= s) - s) * c for s, c in zip(sizes, counts, strict=True)))
    best = min(cost([*some, sizes[-1]]) for n in range(min(buckets, len(sizes))) for some in itertools.combinations(sizes[:-1], n))
    got = packing.optimal_bounds(sizes, counts, buckets)
    assert len(got) <= buckets and cost(got) == best


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 100), st.integers(1, 200), min_size=1, max_size=12))
def test_plan_places_every_rank_once(hist):
    bounds, counts = np.array(sorted(hist)), np.array([hist[k] for k in sorted(hist)])
    load, seen = {}, {b: [] for b in range(len(bounds))}
    for b, start, per, first, times in packing.plan(bounds, counts, 100):
        for r in range(start, start + per * times):
            c = first + (r - start) // per
            load[c] = load.get(c, 0) + bounds[b]
            seen[b].append(r)
    assert max(load.values()) <= 100 and sorted(load) == list(range(len(load)))
    assert all(sorted(seen[b]) == list(range(counts[b])) for b in seen)


def test_pack(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice([0, 1, 5, 30, 49, 50, 51, 149, 150, 1000])) for i in range(300)] + [(7, 30)]
    tokens = spark.createDataFrame(rows, "doc_id bigint, n_tokens bigint")
    out = packing.pack(tokens, capacity=50, buckets=3, tokens=tokens).toPandas()
    assert out.groupby("container_id").n_tokens.sum().max() <= 50
    assert out.n_tokens.sum() == sum(n for _, n in rows) and len(out) == sum(max(1, -(-n // 50)) for _, n in rows)
    used = out[out.n_tokens > 0].container_id
    assert set(used) == set(range(used.max() + 1))
    assert packing.pack(tokens.limit(0), tokens=tokens.limit(0)).count() == 0


def test_pack_in_many_parts(spark, monkeypatch):
    """A bucket of one size that holds nearly everything is numbered in parts."""
    monkeypatch.setattr(packing, "NUMBERED", 7)
    tokens = spark.createDataFrame([(i, 50 if i % 10 else 20) for i in range(400)], "doc_id bigint, n_tokens bigint")
    out = packing.pack(tokens, capacity=50, buckets=4, tokens=tokens).toPandas()
    assert out.groupby("container_id").n_tokens.sum().max() <= 50 and out.container_id.nunique() == 360 + 20


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab1.é \n\t'", max_size=80), st.integers(1, 9))
def test_parts_have_the_tokens_of_the_whole(text, size):
    enc = packing._encoder(packing.TOKENIZER)
    parts = list(packing.parts(text, size))
    assert "".join(parts) == text and [t for p in parts for t in enc.encode_ordinary(p)] == enc.encode_ordinary(text)


def test_count_tokens(spark):
    long = "word " * 40_000 + "x" * 120_000
    df = spark.createDataFrame([(1, "hello world"), (2, None), (3, ""), (4, "<|endoftext|>"), (5, long)], "doc_id bigint, text string")
    got = {r.doc_id: r.n_tokens for r in packing.count_tokens(df, "doc_id", "text").collect()}
    assert got[1] == 2 and got[2] == 0 and got[3] == 0 and got[4] > 1 and got[5] > 40_000
    assert "".join(packing.parts(long, 1000)) == long
