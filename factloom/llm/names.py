"""Variant spellings of names linked into entities (problem 1).

Two names are variants if their words match one to one, in any order, each pair equal, listed as forms of one word or
within a few edits (spelling.parse reads the words). The work is done on the distinct words:

Metric-space partitioning. In each type some distinct words are pivots. A word is at home in the cell of its nearest
pivot and is replicated to every cell whose pivot is no more than twice the radius farther: by the triangle inequality
any two words within the radius then meet in the home cell of either. Inside a cell an exact radius join runs with the
unrestricted Damerau-Levenshtein distance, a true metric, after bounds from lengths, pivot distances and letter counts.
Cells that are too large for one task are cut into slices that meet pairwise. Words of a type that has more of them than
its pivots are meant for, so that cells would grow with the words and their pairs with the square, have pivots of their
own: what is left of a word without some letters, as many as the radius at most. Each edit touches one letter on either
side, so words within the radius have such a pivot in common. Both ways are exact.

Names then meet on two of their words: each stands in an index under every pair of its words, and asks for the pairs
that its two rarest words and their near words make. Equal readings are one key from the start, so repeated names cost
nothing. What meets is checked by the cheapest one-to-one match of the words. Links between keys make components.

Names that leave something open (an initial, an abbreviation no list knows, a pet name of two names) join the one
component that they can mean, nearest spelling first; where they can mean several they stay alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import chain, combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.durable import cut
from factloom.llm import spelling
from factloom.operators.components import connected_components

#: Edits allowed between two words by the letters that the shorter must have, and in a whole name.
RADII = ((1, 4), (2, 8))
EDITS = 2
#: Runs of more letters aren't words that anyone misspells: they are equal to themselves only.
LONGEST = 64
#: Words for which a type gets one more pivot, and the most pivots of a type.
PER_PIVOT, MOST_PIVOTS = 256, 24
#: Words of a cell that one task joins with as many others.
SLICE = 4000
#: Rows of words at pivots, and pairs of them, that a task holds at once.
MEETING = 200_000
#: Two near words that both stand in so many names, the rarer in such a share of the other's, are different words.
COMMON, SHARE = 5, 0.2

_WORDS = "array<struct<w: string, means: array<string>>>"


def read_names(entities: DataFrame, ident: str, name: str, kind: str) -> DataFrame:
    """(ident, key, kind, initial, words, short): names with equal keys are variants at once. Null and blank names have no key."""
    id_type = entities.schema[ident].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, n, k in zip(b[ident], b[name], b[kind], strict=True):
                if isinstance(n, str) and n.strip():
                    r = spelling.parse(k if isinstance(k, str) else None, n)
                    rows.append((i, r.key, r.kind, r.initial, [{"w": w, "means": list(m)} for w, m in r.words], list(r.short)))
            yield pd.DataFrame(rows, columns=[ident, "key", "kind", "initial", "words", "short"])

    return _spread(entities.select(ident, name, kind)).mapInPandas(run, f"{ident} {id_type}, key string, kind string, initial string, words {_WORDS}, short array<string>")


def radius_join(keys: DataFrame, radius: int) -> DataFrame:
    """(a, b, distance) of the pairs of `keys` (block, key, core; distinct) of one block whose cores are within `radius`.

    Each pair once, a < b by key."""
    sizes = keys.groupBy("block").agg(F.count("*").alias("n")).where(F.col("n") > PER_PIVOT * MOST_PIVOTS)
    large = [r.block for r in sizes.select("block").collect()]  # one for so many words at least
    if not large:
        return _pivot_join(keys, radius)
    among = F.coalesce(F.col("block").isin(large), F.lit(False))
    return _pivot_join(keys.where(~among), radius).unionByName(_remnant_join(keys.where(among), radius))


def _remnants(cores: list[str], radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, hash) of what is left of each word without up to `radius` of its letters, in parts; each hash once a word.

    A hash is a polynomial in an odd number modulo 2 ** 64, so what follows a letter that goes is divided by that number."""
    base = 0x9E3779B97F4A7C15
    codes, lengths = spelling.encode(cores)
    for n in np.unique(lengths).tolist():
        rows = np.nonzero(lengths == n)[0]
        gone = [np.array(list(combinations(range(n), k)), np.int64) for k in range(min(radius, n) + 1)]
        many = max(1, 2_000_000 // sum(map(len, gone)))
        powers = np.array([pow(base, k + 1, 1 << 64) for k in range(n)], np.uint64)
        for part in (rows[at : at + many] for at in range(0, len(rows), many)):
            sums = np.zeros((len(part), n + 1), np.uint64)
            np.cumsum((codes[part, :n].astype(np.uint64) + np.uint64(1)) * powers, axis=1, out=sums[:, 1:])
            found = []
            for which in gone:
                start, total = np.zeros(len(which), np.int64), np.zeros((len(part), len(which)), np.uint64)
                for k in range(which.shape[1] + 1):
                    stop = which[:, k] if k < which.shape[1] else np.full(len(which), n)
                    total += (sums[:, stop] - sums[:, start]) * np.uint64(pow(base, -k, 1 << 64))
                    start = stop + 1
                found.append(total)
            hashes = np.sort(np.concatenate(found, axis=1), axis=1)
            row, at = np.nonzero(np.concatenate([np.ones((len(part), 1), bool), hashes[:, 1:] != hashes[:, :-1]], axis=1))
            yield part[row], hashes[row, at].view(np.int64)


def _meetings(cells: np.ndarray, idents: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of identifiers that stand in one cell, in parts; cells in order."""
    at, step, met, n = np.arange(len(cells)), 0, [], 0
    while len(at):
        step += 1
        at = at[at + step < len(cells)]
        at = at[cells[at] == cells[at + step]]
        met.append((idents[at], idents[at + step]))
        n += len(at)
        if n and (n >= MEETING or not len(at)):
            yield tuple(np.concatenate(x) for x in zip(*met, strict=True))
            met, n = [], 0


def _remnant_join(keys: DataFrame, radius: int) -> DataFrame:
    """As radius_join, with what is left of the words as pivots. Equal hashes only bring words together; what decides is
    the distance."""
    numbered = cut(keys.select("block", "key", "core", F.monotonically_increasing_id().alias("ident")), "name-numbers")

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            place, ident = b["place"].to_numpy(), b["ident"].to_numpy()
            for row, left in _remnants(b["core"].tolist(), radius):
                yield pd.DataFrame({"cell": left ^ place[row], "ident": ident[row]})

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, rows = [], 0
        for b in chain(batches, [None]):
            if b is not None:
                held.append((b["cell"].to_numpy(), b["ident"].to_numpy()))
                rows += len(b)
                if rows < MEETING:
                    continue
            if not held:
                return
            cells, idents = (np.concatenate(x) for x in zip(*held, strict=True))
            end = len(cells) if b is None else int(np.searchsorted(cells, cells[-1]))  # the last cell may go on
            for x, y in _meetings(cells[:end], idents[:end]):
                yield pd.DataFrame({"i": np.minimum(x, y), "j": np.maximum(x, y)})
            held, rows = [(cells[end:], idents[end:])], 0

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b = b.assign(distance=spelling.distances(b["core_i"].tolist(), b["core_j"].tolist()).astype("int32"))
            yield b.loc[b["distance"] <= radius, ["a", "b", "distance"]]

    spread_out = _spread(numbered.select(F.xxhash64("block").alias("place"), "ident", "core")).mapInPandas(spread, "cell bigint, ident bigint")
    met = spread_out.repartition("cell").sortWithinPartitions("cell").mapInPandas(meet, "i bigint, j bigint").distinct()
    side = lambda s: numbered.select(F.col("ident").alias(s), F.col("block").alias(f"block_{s}"), F.col("key").alias(f"key_{s}"), F.col("core").alias(f"core_{s}"))
    both = met.join(side("i"), "i").join(side("j"), "j").where("block_i = block_j")
    both = both.select(F.least("key_i", "key_j").alias("a"), F.greatest("key_i", "key_j").alias("b"), "core_i", "core_j")
    return both.mapInPandas(measure, "a string, b string, distance int")


def _spread(df: DataFrame) -> DataFrame:
    """`df` over all cores: few bytes can be much work in Python, and files are cut by bytes."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


def _pivot_join(keys: DataFrame, radius: int) -> DataFrame:
    counts = keys.groupBy("block").agg(F.count("*").alias("n")).where(F.col("n") > PER_PIVOT)
    chosen = keys.join(counts, "block").where(F.pmod(F.xxhash64("key"), F.lit(1_000_000)) < 1_000_000 * F.lit(4 * MOST_PIVOTS) / F.col("n"))
    few = F.slice(F.transform(F.array_sort(F.collect_set(F.struct(F.xxhash64("core").alias("h"), "core"))), lambda x: x["core"]), 1, F.least(F.lit(MOST_PIVOTS), F.ceil(F.first("n") / PER_PIVOT).cast("int")))
    pivots = chosen.groupBy("block").agg(few.alias("pivots"))

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for block, part in b.groupby("block", sort=False):
                cores, own = part["core"].tolist(), part["pivots"].iloc[0]
                if own is None or not len(own):
                    out.append(pd.DataFrame({"block": block, "cell": 0, "key": part["key"], "core": part["core"], "home": True, "far": 0}))
                    continue
                d = np.stack([spelling.distances(cores, [p] * len(cores)) for p in own], axis=1)
                near = d.argmin(axis=1)
                row, cell = np.nonzero(d <= d.min(axis=1)[:, None] + 2 * radius)
                out.append(pd.DataFrame({"block": block, "cell": cell, "key": part["key"].to_numpy()[row], "core": part["core"].to_numpy()[row], "home": near[row] == cell, "far": d[row, cell]}))
            yield pd.concat(out) if out else pd.DataFrame(columns=["block", "cell", "key", "core", "home", "far"])

    placed = _spread(keys.select("block", "key", "core").join(pivots, "block", "left")).mapInPandas(assign, "block string, cell int, key string, core string, home boolean, far int")
    placed = cut(placed, "name-cells")
    slices = placed.groupBy("block", "cell").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / SLICE)).cast("int").alias("slices"))
    sliced = placed.join(slices, ["block", "cell"]).withColumn("own", F.pmod(F.xxhash64("key"), F.col("slices")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("other")
    meeting = sliced.select("*", other).select("block", "cell", "key", "core", "home", "far", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))

    def join(part: pd.DataFrame) -> pd.DataFrame:
        return _pairs(part, radius)

    return meeting.groupBy("block", "cell", "i", "j").applyInPandas(join, "a string, b string, distance int").distinct()


def _pairs(part: pd.DataFrame, radius: int) -> pd.DataFrame:
    """Pairs within the radius, of which one is at home in the cell, and that aren't of one slice where two meet."""
    part = part.assign(_n=part["core"].str.len()).sort_values(["_n", "key"]).reset_index(drop=True)
    codes, lengths = spelling.encode(part["core"].tolist())
    far, home, own = part["far"].to_numpy(), part["home"].to_numpy(), part["own"].to_numpy()
    across = part["i"].iloc[0] != part["j"].iloc[0]
    # the letters that a word has, as bits of which an edit changes two at most, and how often it has each
    counts, bits = np.zeros((len(part), 32), np.int8), np.zeros(len(part), np.uint32)
    for j in range(codes.shape[1]):
        some = np.nonzero(codes[:, j] > 0)[0]
        letter = codes[some, j] % 32
        counts[some, letter] += 1
        bits[some] |= np.uint32(1) << letter.astype(np.uint32)
    at_home = np.nonzero(home)[0]
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for at in range(0, len(at_home), 256):
        rows = at_home[at : at + 256]
        start, stop = np.searchsorted(lengths, lengths[rows[0]] - radius), np.searchsorted(lengths, lengths[rows[-1]] + radius, side="right")
        i, j = np.nonzero(np.bitwise_count(bits[rows, None] ^ bits[None, start:stop]) <= 2 * radius)
        i, j = rows[i], j + start
        close = (i != j) & (np.abs(lengths[i] - lengths[j]) <= radius) & (np.abs(far[i] - far[j]) <= radius) & ~(home[j] & (j < i))
        if across:
            close &= own[i] != own[j]
        i, j = i[close], j[close]
        bag = np.abs(counts[i] - counts[j]).sum(axis=1, dtype=np.int32) <= 2 * radius
        left.append(i[bag])
        right.append(j[bag])
    a, b = np.concatenate(left), np.concatenate(right)
    if not len(a):
        return pd.DataFrame({"a": [], "b": [], "distance": []}).astype({"a": str, "b": str, "distance": "int32"})
    cores, keys = part["core"].to_numpy(), part["key"].to_numpy()
    d = np.concatenate([spelling.distances(cores[a[k : k + 20_000]].tolist(), cores[b[k : k + 20_000]].tolist()) for k in range(0, len(a), 20_000)])
    fits = d <= radius
    x, y = keys[a[fits]], keys[b[fits]]
    swap = x > y
    return pd.DataFrame({"a": np.where(swap, y, x), "b": np.where(swap, x, y), "distance": d[fits].astype("int32")})


def near_words(keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(support: type, w, n of the words as typed; near: type, w, v, p of the words v within p edits of an unlisted w).

    Long given names of the list are compared as well, so a misspelt one is near to what it was meant to be."""
    spark = keys.sparkSession
    typed = keys.select(F.element_at(F.split("kind", r"\|"), 1).alias("type"), F.explode("words").alias("_w")).select("type", "_w.w", (F.array_contains("_w.means", F.col("_w.w")) & (F.size("_w.means") == 1)).alias("plain"))
    support = cut(typed.groupBy("type", "w").agg(F.count("*").alias("n"), F.bool_and("plain").alias("plain")), "name-words")
    given = spark.createDataFrame([("PERSON", w) for w in spelling.LONG_GIVEN], "type string, w string")
    known = given.withColumn("given", F.lit(True))
    vocabulary = support.where("plain").select("type", "w").unionByName(given).distinct()
    vocabulary = cut(vocabulary.where(~F.col("w").rlike(r"\d")).select(F.col("type").alias("block"), F.concat_ws("\x1f", "type", "w").alias("key"), F.col("w").alias("core")), "name-vocabulary")
    least = F.least(F.length(F.element_at(F.split("a", "\x1f"), 2)), F.length(F.element_at(F.split("b", "\x1f"), 2)))
    # a join for each radius; the pairs of one whose shorter word allows more edits come from the next
    steps = list(zip(RADII, [letters for _, letters in RADII[1:]] + [LONGEST + 1], strict=True))
    joins = [radius_join(vocabulary.where(F.length("core").between(letters, min(beyond - 1 + radius, LONGEST))), radius).where((least >= letters) & (least < beyond)) for (radius, letters), beyond in steps]
    found = cut(reduce(DataFrame.unionByName, joins), "near-pairs")
    side = lambda c: F.split(c, "\x1f")
    pairs = found.select(side("a")[0].alias("type"), side("a")[1].alias("w"), side("b")[1].alias("v"), F.col("distance").alias("p"))
    # two letters replaced by others make another word; of two edits at least one must add, drop or swap
    letters = lambda c: F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.substring(F.col(c), i, F.lit(1)))
    changed = F.zip_with(letters("w"), letters("v"), lambda x, y: F.when(x == y, F.lit("=")).otherwise(F.concat(x, y)))
    odd = F.filter(changed, lambda x: x != "=")
    swapped = F.exists("_odd", lambda x: F.array_contains("_odd", F.reverse(x)))
    pairs = pairs.withColumn("_odd", odd).where((F.col("p") < 2) | (F.length("w") != F.length("v")) | (F.size("_odd") > 2) | swapped).drop("_odd")
    both = pairs.unionByName(pairs.select("type", F.col("v").alias("w"), F.col("w").alias("v"), "p"))
    n = support.select("type", "w", "n")
    rated = both.join(n.withColumnsRenamed({"n": "n_w"}), ["type", "w"], "left").join(n.withColumnsRenamed({"w": "v", "n": "n_v"}), ["type", "v"], "left")
    rated = rated.join(known.withColumnsRenamed({"given": "given_w"}), ["type", "w"], "left").join(known.withColumnsRenamed({"w": "v", "given": "given_v"}), ["type", "v"], "left")
    low, high = F.least(F.coalesce("n_w", F.lit(0)), F.coalesce("n_v", F.lit(0))), F.greatest(F.coalesce("n_w", F.lit(0)), F.coalesce("n_v", F.lit(0)))
    different = (low >= COMMON) & (low >= SHARE * high)
    # a listed word is never itself a misspelling; a word in common use isn't one of a listed name either
    apart = F.coalesce(F.col("given_v"), F.lit(False)) & (F.col("n_w") >= COMMON) & (F.col("n_w") >= SHARE * F.coalesce("n_v", F.lit(0)))
    return support, cut(rated.where("given_w is null and n_w is not null").where(~different & ~apart).select("type", "w", "v", "p", F.coalesce("given_v", F.lit(False)).alias("given")), "near-words")


def abbreviated(keys: DataFrame, support: DataFrame) -> DataFrame:
    """(type, short, means) of the words that an abbreviation can stand for: those it begins, and those of which it has
    the first and the last letter and up to three between them, and words of the list that they contract. Both sides meet
    on the short form."""
    short = keys.select(F.element_at(F.split("kind", r"\|"), 1).alias("type"), F.explode("short").alias("short")).distinct()

    long = support.where(F.length("w") >= 4).join(short.select("type").distinct(), "type", "left_semi").select("type", F.col("w").alias("v"))
    begun = long.select("type", F.explode(F.transform(F.sequence(F.lit(2), F.least(F.lit(6), F.length("v") - 1)), lambda n: F.substring("v", F.lit(1), n))).alias("short"), "v")
    begun = begun.join(short, ["type", "short"])
    # contractions meet on the first letter, the next one that is kept, if any, and the last; later ones must follow
    letter = lambda c, i: F.substring(F.col(c), i, F.lit(1))
    inner = F.array_distinct(F.transform(F.sequence(F.lit(2), F.length("v") - 1), lambda i: letter("v", i)))
    clipped = long.where(F.length("v") <= 24).select("type", "v", letter("v", F.lit(1)).alias("_first"), F.explode(F.concat(F.array(F.lit("")), inner)).alias("_next"), letter("v", F.length("v")).alias("_last"))
    kept = short.where(F.length("short") <= 5).select("type", "short", letter("short", F.lit(1)).alias("_first"), F.when(F.length("short") > 2, letter("short", F.lit(2))).otherwise("").alias("_next"), letter("short", F.length("short")).alias("_last"))
    clipped = clipped.join(kept, ["type", "_first", "_next", "_last"]).withColumn("_at", F.expr("locate(_next, v, 2)"))
    for i, n in ((3, 4), (4, 5)):
        clipped = clipped.withColumn("_at", F.when(F.length("short") < n, F.col("_at")).otherwise(F.expr(f"locate(substring(short, {i}, 1), v, _at + 1)")))
        clipped = clipped.where((F.length("short") < n) | ((F.col("_at") > 0) & (F.col("_at") < F.length("v"))))
    long = begun.select("type", "short", "v").unionByName(clipped.select("type", "short", "v"))

    def look_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(t, w, v) for t, w in zip(b["type"], b["short"], strict=True) for v in sorted(spelling.listed(w, t))], columns=["type", "short", "v"])

    met = long.where(F.length("v") > F.length("short")).unionByName(short.mapInPandas(look_up, "type string, short string, v string"))
    return met.groupBy("type", "short").agg(F.collect_set("v").alias("means"))


_SLOTS = "array<struct<w: string, n: bigint, open: boolean, base: array<struct<v: string, p: int>>, more: array<struct<v: string, p: int>>>>"


def _slots(keys: DataFrame) -> DataFrame:
    """(key, kind, initial, loose, slots): each word of a name with what it means (base) and the words near it (more)."""
    support, near = near_words(keys)
    heads = keys.sparkSession.createDataFrame([(w, h) for w, hs in spelling.LONG_GIVEN.items() for h in hs], "v string, head string")
    given = near.where("given").join(heads, "v").groupBy("type", "w", F.col("head").alias("v")).agg(F.min("p").alias("p"))
    given = given.groupBy("type", "w").agg(F.collect_list(F.struct("v", "p")).alias("given"))
    more = near.where("not given").groupBy("type", "w").agg(F.collect_list(F.struct("v", "p")).alias("more"))
    words = keys.select("key", "kind", "initial", F.element_at(F.split("kind", r"\|"), 1).alias("type"), F.explode("words").alias("_w")).select("key", "kind", "initial", "type", F.col("_w.w").alias("w"), F.col("_w.means").alias("means"))
    none = F.array().cast("array<struct<v: string, p: int>>")
    meant = F.transform("means", lambda m: F.struct(m.alias("v"), F.lit(0).alias("p")))
    # a misspelling that stands for one listed name is as good as that name, one edit away
    words = words.join(support.select("type", "w", "n"), ["type", "w"], "left").join(given, ["type", "w"], "left").join(more, ["type", "w"], "left")
    full = words.select("key", "kind", "initial", F.struct("w", "n", (F.size("means") > 1).alias("open"), F.concat(meant, F.coalesce("given", none)).alias("base"), F.coalesce("more", none).alias("more")).alias("slot"))
    short = keys.select("key", "kind", "initial", F.element_at(F.split("kind", r"\|"), 1).alias("type"), F.explode("short").alias("short")).join(abbreviated(keys, support), ["type", "short"], "left")
    own = F.array(F.struct(F.concat("short", F.lit(".")).alias("v"), F.lit(0).alias("p")))
    wide = F.transform(F.coalesce("means", F.array().cast("array<string>")), lambda m: F.struct(m.alias("v"), F.lit(0).alias("p")))
    short = short.select("key", "kind", "initial", F.struct(F.col("short").alias("w"), F.lit(1_000_000).cast("bigint").alias("n"), F.lit(True).alias("open"), own.alias("base"), wide.alias("more")).alias("slot"))
    grouped = full.unionByName(short).groupBy("key", "kind", "initial").agg(F.collect_list("slot").alias("slots"))
    return grouped.withColumn("loose", (F.col("initial") != "") | F.exists("slots", lambda x: x["open"]))


def _begins(word: str, means) -> set[str]:
    """Letters that an initial of the word can be."""
    return {*spelling.initials(word), *(v[0] for v in means)}


def _keys_of(slots, choose: int) -> list[str]:
    """Pairs of values (single ones for one word) under which a name stands (0) or asks (1)."""
    def readings(s) -> list[str]:
        return sorted({x["v"] for x in s["base"]} | ({x["v"] for x in s["more"]} if choose else set()))

    order = sorted(slots, key=lambda s: (s["n"] or 0, s["w"])) if choose else list(slots)
    if len(order) == 1:
        return readings(order[0])
    pairs = [(order[0], order[1])] if choose else list(combinations(order, 2))
    return sorted({"\x1e".join(sorted((x, y))) for s, t in pairs for x in readings(s) for y in readings(t)})


def _emit(named: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(asked, stood): (k, key) of what each name asks for and stands under. Names with an initial ask among those of one
    word more, one of which begins with it; otherwise the number of words is the same."""

    def run(choose: int):
        def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                rows = []
                for key, kind, initial, slots in zip(b["key"], b["kind"], b["initial"], b["slots"], strict=True):
                    slots = list(slots)
                    if choose or initial:
                        rows += [(f"{kind}|{len(slots)}|{initial}|{k}", key) for k in _keys_of(slots, choose)]
                    if not choose and not initial:
                        rows += [(f"{kind}|{len(slots)}||{k}", key) for k in _keys_of(slots, 0)]
                        if kind == "PERSON|" and len(slots) > 1:  # as the person of an initial
                            for at, s in enumerate(slots):
                                letters = sorted(_begins(s["w"], [x["v"] for x in s["base"]]))
                                rest = _keys_of(slots[:at] + slots[at + 1 :], 0)
                                rows += [(f"{kind}|{len(slots) - 1}|{c}|{k}", key) for c in letters for k in rest]
                yield pd.DataFrame(sorted(set(rows)), columns=["k", "key"])

        return emit

    rows = named.select("key", "kind", "initial", "slots")
    return rows.mapInPandas(run(1), "k string, key string"), rows.mapInPandas(run(0), "k string, key string")


def _plain(slots) -> list[tuple[str, dict, dict]]:
    """(word, edits by value that it means, edits by value that is near it) of each word."""
    return [(s["w"], {x["v"]: x["p"] for x in s["base"]}, {x["v"]: x["p"] for x in s["more"]}) for s in slots]


def _cost(a: tuple, b: tuple) -> int:
    """Fewest edits between two words: over the values that one can have and the other means; 99 if there is none."""
    (_, base_a, more_a), (_, base_b, more_b) = a, b
    ways = [p + base_b[v] for v, p in base_a.items() if v in base_b]
    ways += [p + base_b[v] for v, p in more_a.items() if v in base_b] + [p + base_a[v] for v, p in more_b.items() if v in base_a]
    return min(ways, default=99)


def match(a: list[tuple], b: list[tuple], initial: str = "") -> int:
    """Edits of the cheapest one-to-one match of the words of two names; 99 where there is none. With an initial, one word
    of `b` that can begin with it stays over."""
    best = 99
    for over in range(len(b)) if initial else [-1]:
        if over >= 0 and initial not in _begins(b[over][0], b[over][1]):
            continue
        others = [s for i, s in enumerate(b) if i != over]
        if len(others) != len(a):
            continue
        reached = {0: 0}
        for s in a:
            step: dict[int, int] = {}
            for used, c in reached.items():
                for j, t in enumerate(others):
                    if not used >> j & 1 and (total := c + _cost(s, t)) <= EDITS:
                        step[used | 1 << j] = min(total, step.get(used | 1 << j, 99))
            reached = step
        best = min([best, *reached.values()])
    return best


def _checked(met: DataFrame) -> DataFrame:
    """(a, b, loose_a, loose_b, edits) of the pairs that match."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            edits = [match(_plain(x), _plain(y), i if not j else "") for x, y, i, j in zip(b["slots_a"], b["slots_b"], b["initial_a"], b["initial_b"], strict=True)]
            out = b[["a", "b", "loose_a", "loose_b"]].assign(edits=np.array(edits, np.int32))
            yield out[out["edits"] <= EDITS]

    return met.mapInPandas(run, "a string, b string, loose_a boolean, loose_b boolean, edits int")


def same_entity(entities: DataFrame, ident: str = "entity_id", name: str = "name", kind: str = "type") -> DataFrame:
    """(ident, group_key): rows with the same group_key name the same entity. Rows without a name, or with a blank one,
    are in no group. Repeated rows are one; names of nothing but marks are equal only to equal ones."""
    rows = cut(read_names(entities, ident, name, kind), "names")
    keys = rows.groupBy("key").agg(*[F.first(c).alias(c) for c in ("kind", "initial", "words", "short")])
    keys = cut(keys, "name-keys")
    named = cut(_slots(keys), "name-slots")
    asked, stood = _emit(named)
    met = asked.withColumnRenamed("key", "a").join(stood.withColumnRenamed("key", "b"), "k").where("a <> b").select("a", "b")
    side = lambda s: named.select(F.col("key").alias(s), F.col("slots").alias(f"slots_{s}"), F.col("initial").alias(f"initial_{s}"), F.col("loose").alias(f"loose_{s}"))
    # an initial comes first where only one has it, else any order does
    met = met.distinct().join(side("a"), "a").join(side("b"), "b").where("initial_a = initial_b or initial_b = ''")
    fits = cut(_checked(met), "name-pairs")
    strict = connected_components(fits.where("not loose_a and not loose_b").select("a", "b"))
    component = named.where("not loose").select(F.col("key").alias("b")).join(strict.withColumnRenamed("node", "b"), "b", "left").select("b", F.coalesce("component", "b").alias("component"))
    ways = fits.where("loose_a and not loose_b").select("a", "b", "edits").unionByName(fits.where("loose_b and not loose_a").select(F.col("b").alias("a"), F.col("a").alias("b"), "edits"))
    ways = cut(ways.join(component, "b").groupBy("a", "component").agg(F.min("edits").alias("edits")), "name-ways")
    nearest = ways.groupBy("a").agg(F.min_by("component", "edits").alias("component"), F.min("edits").alias("edits"), F.count("*").alias("_all"))
    certain = ways.join(nearest.select("a", F.col("edits").alias("_least")), "a").where("edits = _least").groupBy("a").agg(F.count("*").alias("n"), F.first("component").alias("component")).where("n = 1")
    taken = nearest.select("a")
    lonely = fits.where("loose_a and loose_b").select("a", "b").join(taken, "a", "left_anti").join(taken.withColumnRenamed("a", "b"), "b", "left_anti")
    links = fits.where("not loose_a and not loose_b").select("a", "b").unionByName(certain.select("a", F.col("component").alias("b"))).unionByName(lonely.select("a", "b"))
    parts = connected_components(links).withColumnsRenamed({"node": "key", "component": "group_key"})
    return rows.join(parts, "key", "left").select(ident, F.coalesce("group_key", "key").alias("group_key")).distinct()
