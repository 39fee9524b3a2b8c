"""Leaks against brute force; residue on made-up pages; both on awkward input."""

import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from factloom.llm import leakage, residue

seqs = st.lists(st.integers(-1, 3), max_size=9).map(lambda x: np.array(x, np.int64))


@settings(max_examples=100, deadline=None)
@given(seqs, seqs)
def test_runs_and_subsequences(a, b):
    run = max((n for n in range(1, 10) for i in range(len(a) - n + 1) for j in range(len(b) - n + 1) if (a[i : i + n] >= 0).all() and (a[i : i + n] == b[j : j + n]).all()), default=0)
    table = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(len(a)):
        for j in range(len(b)):
            table[i + 1, j + 1] = table[i, j] + 1 if a[i] == b[j] and a[i] >= 0 else max(table[i, j + 1], table[i + 1, j])
    assert leakage.longest_run(a, b) == run and leakage.longest_subsequence(a, b) == table[-1, -1]


def corpus(rng, n_items=12, n_docs=150):
    common = [f"c{i}" for i in range(40)]
    own = lambda i: [f"i{i}x{k}" for k in range(18)]
    items = []
    for i in range(n_items):
        w = []
        for k in range(30):
            w.append(rng.choice(common) if k % 3 else own(i)[k // 3])
        items.append((i, " ".join(w)))
    docs = []
    for d in range(n_docs):
        w = [rng.choice(common) if rng.random() < 0.5 else f"d{d}x{rng.randrange(50)}" for _ in range(rng.randrange(0, 90))]
        if d % 3 == 0:
            i = rng.randrange(n_items)
            n = rng.choice([8, 11, 12, 13, 20, 30])
            at = rng.randrange(0, 30 - n + 1)
            cut = items[i][1].split()[at : at + n]
            cut = [c.upper() for c in cut] if d % 2 else cut
            p = rng.randrange(len(w) + 1)
            w[p:p] = cut
        docs.append((d, rng.choice([" ", "  ", ", "]).join(w)))
    return items, docs


def brute(items, docs):
    out = set()
    for d, t in docs:
        w = leakage.words(t)
        grams = {tuple(w[i : i + 12]) for i in range(len(w) - 11)}
        for i, s in items:
            x = leakage.words(s)
            if any(tuple(x[k : k + 12]) in grams for k in range(len(x) - 11)):
                out.add((d, i))
    return out


def test_leaks_equal_brute_force(spark, monkeypatch):
    items, docs = corpus(random.Random(8))
    want = brute(items, docs)
    i, d = spark.createDataFrame(items, "item_id int, text string"), spark.createDataFrame([*docs, (500, None), (501, ""), (502, "one")], "doc_id int, text string")
    for most in (leakage.VOCABULARY, 120):  # one block, then several
        monkeypatch.setattr(leakage, "VOCABULARY", most)
        found = leakage.leaks(leakage.search(d, i))
        got = {(r.doc_id, r.item_id) for r in found.where("kind = 'exact'").collect()}
        assert got == want and len(want) > 20
    assert leakage.search(d.limit(0), i).count() == 0 and leakage.search(d, i.limit(0)).count() == 0


def rewritten(rng, text):
    """A rewording: small words changed, a quarter of the others replaced or inflected, the halves swapped now and then."""
    out = []
    for w in text.split():
        if len(w) <= 3:
            out += [rng.choice(["the", "of", "with", "that", "on"])] if rng.random() < 0.6 else []
        elif rng.random() < 0.12:
            out += ["otherwise"]
        else:
            out += [w + rng.choice(["", "", "s", "ed"]) if len(w) >= 6 else w]
    if rng.random() < 0.3:
        at = rng.randrange(2, 6)
        out = out[at:] + ["and", *out[:at]]
    return " ".join(out)


def test_paraphrases_are_found(spark):
    rng = random.Random(12)
    word = lambda n: "".join(rng.choice("bdfgklmnprstvz") + rng.choice("aeiou") for _ in range(n))
    pool = [word(rng.randrange(2, 5)) for _ in range(900)]
    small = ["of", "the", "a", "in", "to", "for"]
    sentence = lambda n: " ".join(rng.choice(small) if k % 3 == 1 else rng.choice(pool) for k in range(n))
    items = [(i, sentence(26)) for i in range(60)]
    docs = [(100 + i, f"{sentence(40)} {rewritten(rng, t)} {sentence(40)}") for i, t in items] + [(1000 + k, sentence(120)) for k in range(200)]
    found = leakage.leaks(leakage.search(spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame(items, "item_id int, text string")))
    got = {(r.doc_id, r.item_id) for r in found.collect()}
    right = {(100 + i, i) for i, _ in items}
    assert len(got & right) >= 0.9 * len(right) and len(got - right) <= 0.05 * len(right)


def test_a_run_without_telling_words(spark):
    """Common words only, repeated ones among them, still make a run."""
    items = [(k, "the cat and the dog and the bird and the fish and the fox ran") for k in range(3)] + [(9, "another one with the words of its own that nobody else has at all today")]
    docs = spark.createDataFrame([(1, "x y the cat and the dog and the bird and the fish and z"), (2, "the cat and the dog and the bird and the")], "doc_id int, text string")
    found = leakage.leaks(leakage.search(docs, spark.createDataFrame(items, "item_id int, text string"))).where("kind = 'exact'")
    assert {(r.doc_id, r.item_id) for r in found.collect()} == {(1, 0), (1, 1), (1, 2)}


def test_latent_space_keeps_the_leading_directions(spark):
    """Against a full decomposition of the same matrix."""
    rng = np.random.default_rng(3)
    topics = [rng.permutation(60)[:12] for _ in range(6)]
    windows = [rng.choice(topics[k % 6], 10) for k in range(300)]
    df = spark.createDataFrame([(w.tolist(),) for w in windows], "stems array<int>").repartition(3)
    idf = np.linspace(1, 2, 60)
    space = leakage.latent_space(df, np.arange(60), idf, [], rank=6)
    row, col, x = leakage._vectors(windows, idf)
    full = np.zeros((300, 60))
    full[row, col] = x
    best = np.linalg.svd(full)[1][:6]
    assert np.linalg.norm(full @ space) >= 0.97 * np.sqrt((best**2).sum()) and np.allclose(space.T @ space, np.eye(space.shape[1]), atol=1e-4)


REAL = ["The port authority of Kimberg reported a drop in traffic.", "A former negotiator asked for more observers at the crossing.", "The river council suspended ferry services until further notice.", "An advisory published in Torgrad ordered a review of contracts.", "The customs office denied having lost contact with the convoy."]
NOTICE = ["Please enable JavaScript to view this page.", "404 Not Found. The page could not be loaded, try again later.", "Sorry, the story could not be loaded. Go back and try again.", "This content requires cookies and scripting. Allow both and refresh.", "Checking your browser before you enter the site."]
MENU = ["Home | World | Contact", "Sign in   Subscribe", "All rights reserved"]
FILLER = "Lorem ipsum dolor sit amet. Elit magna dolore consectetur et adipiscing do eiusmod. Sed ipsum nostrud tempor magna veniam ut labore."


def texts(rng):
    body = lambda n: " ".join(rng.choice(REAL) for _ in range(n))
    good = [f"A headline\n\n{body(rng.randrange(4, 9))}\n\n{body(4)}" for _ in range(150)]
    good += [f"A headline\n\n{body(5)}\n\nPlease enable JavaScript to view the comments." for _ in range(15)]
    good += [f"A headline\n\n{body(5)} The phishing kit still contained the marker {{{{victim_name}}}}, which helped investigators." for _ in range(15)]
    good += [f"A headline\n\n{body(4)} Readers saw only the words 404 Not Found for some minutes, the operator admitted." for _ in range(10)]
    bad = ["\n\n".join(rng.sample(MENU, 1) + [rng.choice(NOTICE)] + rng.sample(MENU, 1)) for _ in range(40)]
    bad += [f"{rng.choice(MENU)}\n\n{rng.choice(NOTICE)}\n\nMost read\nThe port authority asked for more\nA former negotiator left" for _ in range(10)]
    bad += [f"A headline\n\n{FILLER}" for _ in range(10)]
    def hole(gap):
        w = body(5).split()
        w[rng.randrange(3, 20)] = gap
        return "A headline\n\n" + " ".join(w)
    bad += [hole(g) for g in ("{{city}}", "${COUNT}", "TKTK", "[place]", "<PLACE NAME>", "undefined", "[[TITLE]]", "{0}", "%source.label%", "__SOURCE__") for _ in range(2)]
    return good, bad


def test_residue(spark):
    good, bad = texts(random.Random(3))
    rows = [(i, t) for i, t in enumerate([*good, *bad])] + [(9001, None), (9002, ""), (9003, "﻿ \n"), (9004, "word " * 200_000)]
    out = {r.doc_id: r.excluded for r in residue.score(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    short = {r.doc_id for r in residue.to_exclude(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    assert short == {i for i, x in out.items() if x}
    right = sum(out[i] is (i >= len(good)) for i in range(len(good) + len(bad)))
    assert right >= 0.97 * (len(good) + len(bad))
    assert not any(out[i] for i in (9001, 9002, 9003, 9004))
    empty = spark.createDataFrame([], "doc_id int, text string")
    assert residue.score(empty).count() == 0 and residue.to_exclude(empty).count() == 0


OTHER = [
    "The harbour master closed the eastern quay after a crane failed. No one was hurt, and ferries will resume on Friday.", "Heavy rain flooded the lower town overnight.", "Our correspondent visited the bakery. Bread prices doubled in a month.",
    "Parliament will vote tomorrow on the new fishing quotas. Two parties object.", "The museum opens at nine.", "Farmers expect a late harvest this year because of the cold spring. Yields may fall by a tenth. Cooperatives ask for aid.",
    "She scored twice in the second half. The coach praised her patience.", "A lorry overturned near the bridge this morning.", "Lawyers for the miners filed an appeal. The court meets again in March. Both sides declined to comment.",
]


def test_short_real_texts_of_other_words_stay():
    """Words that no passage of the sample had say nothing, whatever the length of the text."""
    good, bad = texts(random.Random(9))
    models = residue.fit(good + bad)
    assert not any(residue.excludes(models, t) for t in OTHER)
    assert not any(residue.excludes(models, s) for t in OTHER for s in t.split(". "))
    assert all(residue.excludes(models, n) for n in NOTICE)
    unseen = "qwy zxv plm bnk wrt ghj."
    assert residue.decide(models, unseen)[0] == 0


def test_gaps_and_passages():
    assert len(residue.gaps("a {{x}} b ${y} c [E2] d [12] e")) == 2
    assert residue.passages("<p>One two. Three!</p>\nFour") == ["One two.", "Three!", "Four"]
    assert residue.decide(residue.fit([]), "Please enable JavaScript.") == (0, 0, 0)


def test_awkward_rows_and_clashing_columns(spark):
    """Nulls, empty and very long texts, repeated rows, and columns that are named like the operators' own."""
    item = "alpha bravo charlie delta echo foxtrot golf hotel india juliett kilo lima mike november oscar papa"
    docs = [(1, f"{item} once", 5, "a", 0), (1, f"{item} once", 5, "a", 0), (2, None, None, None, None), (None, item, 1, "b", 2), (3, "word " * 120_000 + item, 7, "c", 1), (4, "", 1, "", 1), (5, "é" * 5000, 1, "", 1)]
    d = spark.createDataFrame(docs, "doc_id int, text string, stem int, ids string, kind int")
    i = spark.createDataFrame([(7, item, 1), (7, item, 1), (8, None, 2), (9, "", 3)], "item_id int, text string, n int")
    found = leakage.leaks(leakage.search(d, i)).where("kind = 'exact'").collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.item_id) for r in found) == [(False, 1, 7), (False, 3, 7), (True, 0, 7)]
    many = spark.createDataFrame([(1, "404 Not Found.", 1, 1.0), (1, "404 Not Found.", 1, 1.0), (2, None, None, None)], "doc_id int, text string, errors int, excluded double")
    assert residue.score(many).count() == 3 and residue.to_exclude(many).count() <= 2
