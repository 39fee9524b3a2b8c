"""Name linking against brute force and on awkward input."""

import random
from itertools import combinations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from factloom.llm import names, spelling


def true_distance(a, b):
    """Unrestricted Damerau-Levenshtein, cell by cell."""
    inf = len(a) + len(b)
    d = [[inf] * (len(b) + 2) for _ in range(len(a) + 2)]
    for i in range(len(a) + 1):
        d[i + 1][1] = i
    for j in range(len(b) + 1):
        d[1][j + 1] = j
    row: dict = {}
    for i in range(1, len(a) + 1):
        col = 0
        for j in range(1, len(b) + 1):
            k, at = row.get(b[j - 1], 0), col
            cost = a[i - 1] != b[j - 1]
            if not cost:
                col = j
            d[i + 1][j + 1] = min(d[i][j] + cost, d[i + 1][j] + 1, d[i][j + 1] + 1, d[k][at] + (i - k - 1) + 1 + (j - at - 1))
        row[a[i - 1]] = i
    return d[len(a) + 1][len(b) + 1]


words = st.text(alphabet="abcd", max_size=7)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(words, words), min_size=1, max_size=8))
def test_distance(pairs):
    got = spelling.distances([a for a, _ in pairs], [b for _, b in pairs])
    assert got.tolist() == [true_distance(a, b) for a, b in pairs]


@settings(max_examples=60, deadline=None)
@given(words, words, words)
def test_distance_is_a_metric(a, b, c):
    x, y, z = spelling.distances([a, b, a], [b, c, c])
    assert z <= x + y


@pytest.mark.parametrize(("radius", "pivots"), [(1, 64), (2, 64), (1, 2), (2, 2)])
def test_radius_join_equals_all_pairs(spark, radius, pivots, monkeypatch):
    """Small parameters, so that pivots, replication and slices all take part; with few pivots, wide cells."""
    monkeypatch.setattr(names, "MOST_PIVOTS", pivots)
    monkeypatch.setattr(names, "PER_PIVOT", 40)
    monkeypatch.setattr(names, "SLICE", 50)
    rng = random.Random(radius)
    cores = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(5, 9))) for _ in range(150)]
    cores += ["".join(c if rng.random() > 0.12 else rng.choice("abcdefgh") for c in w) for w in cores] + ["", ""]
    rows = [(b, f"k{i:03}", c) for b, part in (("x", cores[:260]), ("y", cores[260:])) for i, c in enumerate(part)]
    got = {(r.a, r.b, r.distance) for r in names.radius_join(spark.createDataFrame([(b, b + k, c) for b, k, c in rows], "block string, key string, core string"), radius).collect()}
    want = set()
    for i, (b1, k1, c1) in enumerate(rows):
        for b2, k2, c2 in rows[i + 1 :]:
            if b1 == b2 and abs(len(c1) - len(c2)) <= radius and (d := true_distance(c1, c2)) <= radius:
                want.add((*sorted((b1 + k1, b2 + k2)), d))
    assert got == want and len(want) > 20


@settings(max_examples=100, deadline=None)
@given(words, words, st.integers(0, 3))
def test_words_within_the_radius_have_a_remnant_in_common(a, b, radius):
    left = [set(), set()]
    for row, hashes in names._remnants([a, b], radius):
        for r, h in zip(row.tolist(), hashes.tolist(), strict=True):
            assert h not in left[r]
            left[r].add(h)
    assert len(left[0]) == len({"".join(a[i] for i in kept) for k in range(max(0, len(a) - radius), len(a) + 1) for kept in combinations(range(len(a)), k)})
    assert left[0] & left[1] or true_distance(a, b) > radius


def test_large_types_do_not_meet_all_pairs():
    """Of 20,000 words (200 million pairs) few meet, with the same pairs in any part size."""
    rng = random.Random(3)
    cores = ["".join(rng.choice("bcdfglmnprstv") + rng.choice("aeiou") for _ in range(5)) for _ in range(20_000)]
    parts = list(names._remnants(cores, 2))
    rows, cells = np.concatenate([r for r, _ in parts]), np.concatenate([h for _, h in parts])
    order = np.argsort(cells, kind="stable")
    i, j = (np.concatenate(x) for x in zip(*names._meetings(cells[order], rows[order]), strict=True))
    assert len(rows) <= 56 * len(cores) and len(i) < 5_000_000
    assert np.unique(np.minimum(i, j) * len(cores) + np.maximum(i, j)).size < 1_000_000


def test_large_and_small_types_in_one_join(spark, monkeypatch):
    monkeypatch.setattr(names, "MOST_PIVOTS", 2)
    monkeypatch.setattr(names, "PER_PIVOT", 2)
    rows = [("large", f"l{i}", w) for i, w in enumerate(["abcd", "abdc", "abxcd", "xbcd", "", "p", "pq"])] + [("small", f"s{i}", w) for i, w in enumerate(["abcd", "abcd", "p"])]
    got = names.radius_join(spark.createDataFrame(rows, "block string, key string, core string"), 1).collect()
    assert sorted(map(tuple, got)) == [("l0", "l1", 1), ("l0", "l2", 1), ("l0", "l3", 1), ("l4", "l5", 1), ("l5", "l6", 1), ("s0", "s1", 0)]


def test_abbreviations_meet_as_by_definition(spark):
    rng = random.Random(4)
    longs = sorted({"".join(rng.choice("abcé") for _ in range(rng.randrange(4, 9))) for _ in range(150)} | {"abc" * 9, "🙂bca"})
    shorts = sorted({"".join(rng.choice("abcé") for _ in range(rng.randrange(2, 7))) for _ in range(150)} | {"🙂a", "ac"})
    keys = spark.createDataFrame([("ORG|", shorts)], "kind string, short array<string>")
    support = spark.createDataFrame([(t, w) for t in ("ORG", "GPE") for w in longs], "type string, w string")
    want = {s: set(spelling.listed(s, "ORG")) for s in shorts if spelling.listed(s, "ORG")}
    for w in longs:
        forms = {w[:n] for n in range(2, min(6, len(w) - 1) + 1)}
        if len(w) <= 24:
            forms |= {w[0] + "".join(m) + w[-1] for n in range(4) for m in combinations(w[1:-1], n)}
        for s in forms & set(shorts):
            if len(s) < len(w):
                want.setdefault(s, set()).add(w)
    got = {r.short: set(r.means) for r in names.abbreviated(keys, support).collect()}
    assert got == want and len(want) > 50


def groups(spark, rows):
    df = spark.createDataFrame([(i, n, t, "x", "y") for i, (n, t) in enumerate(rows)], "entity_id int, name string, type string, key string, core string")
    found: dict = {}
    for r in names.same_entity(df).collect():
        found.setdefault(r.group_key, set()).add(rows[r.entity_id][0])
    assert not any(n is None or not n.strip() for s in found.values() for n in s)
    return {frozenset(map(str, s)) for s in found.values() if len(s) > 1}


def test_people(spark):
    same = ["Elizabeth Gallibalin", "Gallibalin, Liz", "GALLIBALIN Beth", "Dr. E. Gallibalín", "Elizabeth D. Galliblain", "Elizabteh Gallibalin"]
    other = ["Edward Mervulunin", "E Mervulunin", "Kimberly Gallibalin", "Henry Kanhafuguv", "Helena Kanhafuguv", "H. Kanhafuguv"]
    assert groups(spark, [(n, "PERSON") for n in same + other]) == {frozenset(same), frozenset(["Edward Mervulunin", "E Mervulunin"])}


def test_things(spark):
    org = ["Jornalasaro Shipping Institute", "Shpg Inst of Jornakasaro", "The Jornalasaro Shipping Institute (JSI)", "SHIPPING INSTITUTE, JORNALASARO"]
    apart = ["Jornalasaro Maritime Institute", "Jornalasaro Shipping Company"]
    assert groups(spark, [(n, "ORG") for n in org + apart]) == {frozenset(org)}
    place = ["Mount Veltefukaburg", "Veltefukabugr, Mt."]
    assert groups(spark, [(n, "GPE") for n in [*place, "Port Veltefukaburg"]]) == {frozenset(place)}
    event = ["Operation Rolmaketus 2023", "op rolmaketus, '23", "Rolmaketus Operation (2023)"]
    assert groups(spark, [(n, "EVENT") for n in [*event, "Operation Rolmaketus 2024", "Exercise Rolmaketus 2023"]]) == {frozenset(event)}


def test_people_outside_every_list(spark):
    """Names of which no list knows a word: order, initials and two typos link, like initials don't."""
    rows = ["Zbigniew Kowalczyk", "Kowalczyk Zbigniew", "Zbigniew Kowalczik", "Zbigniew Kowalcyzkk", "Zofia Kowalczyk", "Hiroshi Tanakawa", "TANAKAWA, Hiroshi", "Haruka Tanakawa", "Wei Chenmar", "Wanda Chenmar", "Chenmar Wanda", "W. Chenmar", "H. Nakamori", "Hideo Nakamori"]
    want = [["Zbigniew Kowalczyk", "Kowalczyk Zbigniew", "Zbigniew Kowalczik", "Zbigniew Kowalcyzkk"], ["Hiroshi Tanakawa", "TANAKAWA, Hiroshi"], ["Wanda Chenmar", "Chenmar Wanda"], ["H. Nakamori", "Hideo Nakamori"]]
    assert groups(spark, [(n, "PERSON") for n in rows]) == {frozenset(w) for w in want}


def test_abbreviations_outside_every_list(spark):
    same = [["Northern Fisheries Board", "Nthn Fisheries Brd"], ["Ministry of Education Torgrad", "Min. of Educ. Torgrad", "Torgrad Education Ministry"], ["Energy Council Vostok", "Engy Cncl Vostok"]]
    other = ["Northern Forestry Board", "Ministry of Health Torgrad", "Southern Fisheries Board"]
    assert groups(spark, [(n, "ORG") for s in same for n in s] + [(n, "ORG") for n in other]) == {frozenset(s) for s in same}


def test_two_meanings_stay_alone(spark):
    rows = ["Patricia Vosmalen", "Patrick Vosmalen", "Pat Vosmalen", "P. Vosmalen", "Trish Vosmalen"]
    assert groups(spark, [(n, "PERSON") for n in rows]) == {frozenset(["Patricia Vosmalen", "Trish Vosmalen"])}
    assert groups(spark, [(n, "PERSON") for n in ["Patricia Vosmalen", "Pat Vosmalen"]]) == {frozenset(["Patricia Vosmalen", "Pat Vosmalen"])}


def test_words_in_common_use_are_no_typos_of_one_another(spark):
    surnames = ["Abelkrantz", "Bohusova", "Cermakidis", "Dvorenko", "Estragonis", "Fiorentzi", "Gundersdal", "Hovlandsen"]
    rows = [(f"{g} {s}", "PERSON") for g in ("Marta", "Maria") for s in surnames]
    assert groups(spark, rows) == set()


def test_unseen_names_recall_and_precision(spark):
    """Random names of no list, each typed in five ways with a random edit: links against the truth."""
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("bcdfgklmnprstvz") + rng.choice("aeiou") for _ in range(n)).capitalize()
    rows, truth = [], {}
    for person in range(120):
        given_name, surname = word(3), word(4)
        for kind in range(5):
            g, s = given_name, surname
            at = rng.randrange(1, len(s) - 1)
            if kind == 1:
                s = s[:at] + s[at + 1 :]
            if kind == 2:
                s = s[:at] + rng.choice("aeiou") + s[at:]
            n = f"{s} {g}" if kind == 3 else f"{s.upper()}, {g}" if kind == 4 else f"{g} {s}"
            truth[len(rows)] = person
            rows.append((len(rows), n, "PERSON"))
    got: dict = {}
    for r in names.same_entity(spark.createDataFrame(rows, "entity_id int, name string, type string")).collect():
        got.setdefault(r.group_key, []).append(r.entity_id)
    pairs = [(a, b) for ids in got.values() for a in ids for b in ids if a < b]
    right = sum(truth[a] == truth[b] for a, b in pairs)
    assert right >= 0.97 * len(pairs) and right >= 0.97 * 120 * 10


def test_types_stay_apart_and_awkward_rows(spark):
    rows = [("Mutlojageland Island", "GPE"), ("Mutlojageland Island", "ORG"), (None, "PERSON"), ("", "PERSON"), (" ", "PERSON"), ("Ж" * 3000, None), ("Ж" * 3000, None), ("x", "PERSON"), ("Dr", "PERSON"), ("🙂", "EVENT")]
    found = groups(spark, rows)
    assert found == {frozenset({"Ж" * 3000})} or not found
    df = spark.createDataFrame([], "entity_id int, name string, type string")
    assert names.same_entity(df).count() == 0
    twice = spark.createDataFrame([(1, "Henry Gotvagogan", "PERSON")] * 3 + [(2, "Hank Gotvagogan", "PERSON")], "entity_id int, name string, type string")
    assert names.same_entity(twice).count() == 2 and names.same_entity(twice).select("group_key").distinct().count() == 1


def test_encode_empty():
    codes, lengths = spelling.encode([])
    assert codes.shape == (0, 0) and lengths.tolist() == []
    assert np.array_equal(spelling.distances(["", "a"], ["b", "a"]), [1, 0])


def test_clashing_columns_and_nulls(spark):
    df = spark.createDataFrame([(1, "Zbigniew Kowalczyk", "PERSON", "x", None), (2, "Kowalczyk, Zbigniew", "PERSON", "y", 3), (None, "Zbigniew Kowalczyk", "PERSON", "z", 4), (4, "Torgrad", None, None, None), (5, "TORGRAD", None, None, None), (6, "A B", "PERSON", "", 1)], "entity_id int, name string, type string, slots string, edits int")
    found: dict = {}
    for r in names.same_entity(df).collect():
        found.setdefault(r.group_key, set()).add(r.entity_id)
    assert {frozenset(s) for s in found.values()} == {frozenset({1, 2, None}), frozenset({4, 5}), frozenset({6})}
