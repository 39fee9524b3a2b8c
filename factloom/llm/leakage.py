"""Evaluation passages inside training text (problem 8).

Latent semantic retrieval. Documents and items are cut into overlapping windows of words; a window is a TF-IDF vector over
the items' word stems (weights from all documents). A randomised SVD, distributed, gives the latent space: a random test
matrix is broadcast, every task multiplies its windows with it and back and adds up, the sums are added by executors, and
the driver only ever holds a matrix of vocabulary x rank. Windows are searched by cosine against the items' windows, and
candidates are checked: the longest common run of words for passages taken over word for word, the longest common
subsequence and the share of the item's telling words (its answer words) for paraphrases. Runs have an exact way besides:
what shares as many words with an item as a run has is checked at any cosine.

The corpus is read once, whatever the number of items. Items come in blocks whose vocabulary is at most VOCABULARY stems,
so what is broadcast for a block (test matrix, space, latent windows) has a fixed bound; documents are never gathered. A
window of WINDOW words at every STEP contains every run of RUN words whole, and every stretch of WINDOW - STEP. Only
windows are written that can pass a check: RUN words in a row that items have, or as many stems of telling words as the
least answer needs.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.durable import cut

RUN = 12
WINDOW, STEP = 36, 12
#: Words of an item's window for runs and for paraphrases, and the steps between them.
ASKED = ((RUN, 3), (24, 6))
VOCABULARY = 8192
RANK, OVERSAMPLE, ROUNDS = 160, 16, 1
#: Different words of all items together, which every task knows; more are refused.
MOST_WORDS = 2_000_000
#: Letters of a word's stem.
STEM = 6
#: Cosine from which on a window can be a paraphrase (runs are looked for at any), the share of an item window's telling
#: stems in order and in any order, and how many it must have. Telling: in no more than this share of the items.
COSINE, SUBSEQUENCE, ANSWER = 0.4, 0.6, 0.7
LEAST_TELLING, TELLING_SHARE = 6, 0.04

_WORD = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    """Maximal runs of letters and digits in lower case."""
    if not isinstance(text, str):
        return []
    # outside ASCII, lower case can change where words end
    return _WORD.findall(text.lower()) if text.isascii() else [w.lower() for w in _WORD.findall(text)]


def longest_run(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest run of equal non-negative numbers that both sequences hold."""
    equal = (a[:, None] == b[None, :]) & (a >= 0)[:, None]
    length, runs = 0, equal
    while runs.any():
        length += 1
        runs = runs[:-1, :-1] & equal[length:, length:]
    return length


def longest_subsequence(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence of two sequences; negative numbers match nothing."""
    row = np.zeros(len(b) + 1, np.int64)
    for x in a:
        take = row[:-1] + ((b == x) & (x >= 0))
        row = np.maximum.accumulate(np.concatenate([[0], np.maximum(row[1:], take)]))
    return int(row[-1])


@dataclass
class Asked:
    """All items: their words and stems as numbers, and which stems tell."""

    ids: list
    words: dict[str, int]
    stems: dict[str, int]
    runs: list[np.ndarray]
    sequences: list[np.ndarray]
    telling: np.ndarray


def read_items(items: list[tuple[object, str]]) -> Asked:
    """Items without words are left out."""
    out = Asked([], {}, {}, [], [], np.zeros(0, bool))
    held: Counter = Counter()
    for ident, text in items:
        own = words(text)
        if own:
            out.ids.append(ident)
            out.runs.append(np.array([out.words.setdefault(w, len(out.words)) for w in own], dtype=np.int64))
            out.sequences.append(np.array([out.stems.setdefault(w[:STEM], len(out.stems)) for w in own], dtype=np.int64))
            held.update(set(out.sequences[-1].tolist()))
    if len(out.words) > MOST_WORDS:
        raise ValueError(f"{len(out.words)} different words in the items; split them into sets of at most {MOST_WORDS}")
    out.telling = np.array([held[i] <= max(1, TELLING_SHARE * len(out.ids)) for i in range(len(out.stems))], dtype=bool)
    return out


@dataclass
class Block:
    """Items whose stems fit a vocabulary: positions in Asked, and the stems' numbers there in order of their own."""

    members: list[int]
    stems: np.ndarray


def blocks(asked: Asked) -> list[Block]:
    out: list[tuple[list[int], dict[int, None]]] = []
    for j, seq in enumerate(asked.sequences):
        own = dict.fromkeys(seq.tolist())
        if not out or len(out[-1][1].keys() | own.keys()) > VOCABULARY and out[-1][0]:
            out.append(([], {}))
        out[-1][0].append(j)
        out[-1][1].update(own)
    return [Block(members, np.array(sorted(stems), dtype=np.int64)) for members, stems in out]


def _windows(seq: np.ndarray, size: int, step: int) -> list[np.ndarray]:
    last = max(0, len(seq) - size)
    return [seq[i : i + size] for i in sorted({*range(0, last + 1, step), last})]


def _document_windows(docs: DataFrame, ident: str, text: str, asked: Asked) -> DataFrame:
    """Rows of windows (kind 0: ident, ids of words, stems) and of document frequencies (kind 1: n documents hold a stem;
    stem -1: all)."""
    kind = docs.schema[ident].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast((asked.words, asked.stems, asked.telling))
    need = int(np.ceil(ANSWER * LEAST_TELLING))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, stems, telling = shared.value
        for b in batches:
            df = np.zeros(len(stems) + 1, np.int64)
            owner, found, stemmed = [], [], []
            for ident_, t in zip(b[ident], b[text], strict=True):
                own = words(t)
                seq = np.array([known.get(w, -1) for w in own], dtype=np.int64)
                stem = np.array([stems.get(w[:STEM], -1) for w in own], dtype=np.int64)
                df[np.unique(stem[stem >= 0])] += 1
                df[-1] += 1
                in_items = np.concatenate([[0], np.cumsum(seq >= 0)])
                tells = np.concatenate([[0], np.cumsum((stem >= 0) & telling[stem])])
                whole = np.concatenate([[0], np.cumsum(in_items[RUN:] - in_items[:-RUN] == RUN)]) if len(seq) >= RUN else None
                for i in range(0, max(1, len(seq) - WINDOW + STEP), STEP):
                    end = min(len(seq), i + WINDOW)
                    if end - i >= RUN and whole[end - RUN + 1] > whole[i] or tells[end] - tells[i] >= need:
                        owner.append(ident_)
                        found.append(seq[i:end])
                        stemmed.append(stem[i:end])
            if owner:
                yield pd.DataFrame({"kind": 0, ident: pd.Series(owner, dtype=b[ident].dtype), "stem": -2, "n": 0, "ids": found, "stems": stemmed})
            some = np.nonzero(df)[0]
            yield pd.DataFrame({"kind": 1, ident: pd.Series([None] * len(some), dtype=object), "stem": np.where(some == len(stems), -1, some), "n": df[some], "ids": None, "stems": None})

    return docs.select(ident, text).mapInPandas(run, f"kind int, {ident} {kind}, stem int, n bigint, ids array<int>, stems array<int>")


def _vectors(windows: list[np.ndarray], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, word, weight) of the unit TF-IDF vectors of windows of the block's own stem numbers (-1: none)."""
    lengths = np.array([len(w) for w in windows], dtype=np.int64)
    flat, row = np.concatenate(windows) if len(windows) else np.zeros(0, np.int64), np.repeat(np.arange(len(windows)), lengths)
    keep = flat >= 0
    key, n = np.unique(row[keep] * len(idf) + flat[keep], return_counts=True)
    row, word = key // len(idf), key % len(idf)
    x = n * idf[word]
    norm = np.sqrt(np.bincount(row, weights=x * x, minlength=len(windows)))
    return row, word, (x / norm[row]).astype(np.float32)


def _times(row: np.ndarray, word: np.ndarray, x: np.ndarray, n: int, matrix: np.ndarray) -> np.ndarray:
    """The windows' vectors times a matrix of stems x columns; rows in ascending order."""
    out = np.zeros((n, matrix.shape[1]), np.float32)
    if len(row):
        first = np.nonzero(np.concatenate([[True], row[1:] != row[:-1]]))[0]
        out[row[first]] = np.add.reduceat(matrix[word] * x[:, None], first, axis=0)
    return out


def _back(row: np.ndarray, word: np.ndarray, x: np.ndarray, y: np.ndarray, total: np.ndarray) -> None:
    """Adds the transposed vectors times `y` to `total`."""
    if len(row):
        order = np.argsort(word, kind="stable")
        first = np.nonzero(np.concatenate([[True], np.diff(word[order]) != 0]))[0]
        total[word[order][first]] += np.add.reduceat(y[row[order]] * x[order, None], first, axis=0)


#: Stems whose sums travel as one row.
_CHUNK = 256


def _local(stems: np.ndarray, lookup: np.ndarray) -> np.ndarray:
    """Stems as the block's own numbers."""
    return np.where(stems >= 0, lookup[stems], -1)


def _gram_times(windows: DataFrame, lookup: np.ndarray, idf: np.ndarray, matrix: np.ndarray, extra: list[np.ndarray]) -> np.ndarray:
    """The Gram matrix of the windows' vectors times `matrix`, without that Gram matrix: tasks multiply there and back,
    executors add up. `extra`: windows of the items, added on the driver."""
    size, columns = matrix.shape
    shared = windows.sparkSession.sparkContext.broadcast((lookup, idf, matrix.astype(np.float32)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lookup_, idf_, m = shared.value
        total = np.zeros((size, columns), np.float64)
        for b in batches:
            for at in range(0, len(b), 1024):
                own = [_local(np.asarray(w, dtype=np.int64), lookup_) for w in b["stems"].iloc[at : at + 1024]]
                v = _vectors(own, idf_)
                _back(*v, _times(*v, len(own), m), total)
        parts = [(c, total[c * _CHUNK : (c + 1) * _CHUNK]) for c in range(-(-size // _CHUNK))]
        yield pd.DataFrame([(c, p.astype(np.float32).tobytes()) for c, p in parts if p.any()], columns=["chunk", "v"])

    def add(part: pd.DataFrame) -> pd.DataFrame:
        total = np.sum([np.frombuffer(v, np.float32).astype(np.float64) for v in part["v"]], axis=0)
        return pd.DataFrame({"chunk": part["chunk"].iloc[:1], "v": [total.astype(np.float32).tobytes()]})

    # one partial sum a core, however many windows there are
    parts = windows.select("stems").coalesce(max(1, windows.sparkSession.sparkContext.defaultParallelism)).mapInPandas(run, "chunk int, v binary")
    out = np.zeros((size, columns), np.float64)
    for r in parts.groupBy("chunk").applyInPandas(add, "chunk int, v binary").collect():  # vocabulary x rank numbers
        rows = np.frombuffer(r.v, np.float32).reshape(-1, columns)
        out[r.chunk * _CHUNK : r.chunk * _CHUNK + len(rows)] += rows
    v = _vectors(extra, idf)
    _back(*v, _times(*v, len(extra), matrix.astype(np.float32)), out)
    return out


def latent_space(windows: DataFrame, lookup: np.ndarray, idf: np.ndarray, extra: list[np.ndarray], rank: int = RANK, seed: int = 7) -> np.ndarray:
    """Leading right singular vectors of the windows' matrix by a randomised range finder with ROUNDS power rounds."""
    columns = min(rank + OVERSAMPLE, len(idf))
    q = np.random.default_rng(seed).standard_normal((len(idf), columns))
    for _ in range(ROUNDS + 1):
        q, _r = np.linalg.qr(_gram_times(windows, lookup, idf, q, extra))
    inner = q.T @ _gram_times(windows, lookup, idf, q, extra)
    values, vectors = np.linalg.eigh((inner + inner.T) / 2)
    keep = values[::-1][: min(rank, len(idf))] > 1e-6
    return (q @ vectors[:, ::-1][:, : len(keep)][:, keep]).astype(np.float32)


def _project(windows: list[np.ndarray], idf: np.ndarray, space: np.ndarray) -> np.ndarray:
    out = _times(*_vectors(windows, idf), len(windows), space)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def search(docs: DataFrame, items: DataFrame, ident: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """(ident, item, run, subsequence, answered, cosine) of the candidate documents and items that can be leaks, each pair once.

    run: longest common run of words, 0 where too few words are shared for RUN; answered and subsequence: shares of the
    telling stems of an item's window that a document's window holds, in any order and in order, of the best window among
    those near enough, 0 if none is. Texts without words match nothing; repeated documents give the same rows, once for
    an identifier. The items are the query set: they are read to the driver, MOST_WORDS bounds their words."""
    spark = docs.sparkSession
    kind, item_kind = docs.schema[ident].dataType.simpleString(), items.schema[item].dataType.simpleString()
    schema = f"{ident} {kind}, {item} {item_kind}, run int, subsequence double, answered double, cosine double"
    asked = read_items([tuple(r) for r in items.select(item, item_text).orderBy(item).collect()])
    if not asked.ids:
        return spark.createDataFrame([], schema)
    rows = cut(_document_windows(docs, ident, text, asked), "leak-windows")
    windows = rows.where("kind = 0").select(ident, "ids", "stems")
    df = {r.stem: r.n for r in rows.where("kind = 1").groupBy("stem").agg(F.sum("n").alias("n")).collect()}  # the items' vocabulary
    total = df.get(-1, 0)
    results = None
    for block in blocks(asked):
        idf = np.log((total + 1) / (np.array([df.get(int(i), 0) for i in block.stems]) + 1)) + 0.1
        lookup = np.full(len(asked.stems), -1, np.int64)
        lookup[block.stems] = np.arange(len(block.stems))
        own = [(j, k, w) for j in block.members for k, (size, step) in enumerate(ASKED) for w in _windows(asked.sequences[j], size, step)]
        local = [_local(w, lookup) for _, _, w in own]
        space = latent_space(windows, lookup, idf, local)
        known = spark.sparkContext.broadcast((lookup, idf, space, _project(local, idf, space), [j for j, _, _ in own], local, asked.telling[block.stems], asked.ids, {j: asked.runs[j] for j in block.members}, len(asked.words)))
        found = windows.mapInPandas(_searcher(known, ident, item), schema)
        results = found if results is None else results.unionByName(found)
    best = F.max(F.struct("run", "subsequence", "answered", "cosine"))
    return results.groupBy(ident, item).agg(best.alias("_b"), F.max("subsequence").alias("subsequence"), F.max("answered").alias("answered")).select(ident, item, "_b.run", "subsequence", "answered", "_b.cosine")


def _searcher(known, ident: str, item: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lookup, idf, space, latent, of, asked, telling, ids, runs, n_words = known.value
        of = np.array(of)
        members = np.array(sorted(runs))
        starts = np.searchsorted(of, members)  # each item's windows stand together
        tells = [w[telling[w]] for w in asked]
        told = np.array([len(set(w.tolist())) for w in tells])
        can = told >= LEAST_TELLING
        answers = np.zeros((len(idf), len(asked)), np.uint8)
        for k, t in enumerate(tells):
            answers[t, k] = 1
        # items that hold a word, by word
        holders: list[list[int]] = [[] for _ in range(n_words)]
        for k, j in enumerate(members):
            for w in np.unique(runs[j]):
                holders[w].append(k)
        holders = [np.array(h, dtype=np.int64) for h in holders]
        for b in batches:
            out = []
            for at in range(0, len(b), 512):
                part = b.iloc[at : at + 512]
                stems = [_local(np.asarray(x, dtype=np.int64), lookup) for x in part["stems"]]
                cosines = _project(stems, idf, space) @ latent.T
                owners = part[ident].to_numpy()
                for n, (row, x) in enumerate(zip(cosines, part["ids"], strict=True)):
                    seq = np.asarray(x, dtype=np.int64)
                    hits = np.nonzero((row >= COSINE) & can)[0]
                    best: dict[int, tuple[float, float]] = {}
                    if len(hits):
                        held = np.unique(stems[n][stems[n] >= 0])
                        shares = answers[held][:, hits].sum(axis=0, dtype=np.int64) / told[hits]
                        for k, share in zip(hits[shares >= ANSWER].tolist(), shares[shares >= ANSWER].tolist(), strict=True):
                            if (order := longest_subsequence(stems[n], tells[k]) / len(tells[k])) >= SUBSEQUENCE:
                                best[int(of[k])] = max(best.get(int(of[k]), (0.0, 0.0)), (order, share))
                    # what has RUN words in a row that an item has can hold a run of it, however far away it is
                    exact: list[int] = []
                    if "1" * RUN in "".join("1" if w >= 0 else "0" for w in x):
                        shared = np.zeros((len(members), len(seq) + 1), np.int16)
                        for at_word, w in enumerate(x, 1):
                            if w >= 0:
                                shared[holders[w], at_word] = 1
                        upto = shared.cumsum(axis=1)
                        exact = members[np.nonzero((upto[:, RUN:] - upto[:, :-RUN] == RUN).any(axis=1))[0]].tolist()
                    if best or exact:
                        nearest = np.maximum.reduceat(row, starts)
                        for j in sorted({*exact, *best}):
                            run_ = longest_run(seq, runs[j])
                            if run_ >= RUN or j in best:
                                out.append((owners[n], ids[j], run_ if run_ >= RUN else 0, *best.get(j, (0.0, 0.0)), float(nearest[np.searchsorted(members, j)])))
            yield pd.DataFrame(out, columns=[ident, item, "run", "subsequence", "answered", "cosine"])

    return run


def leaks(found: DataFrame) -> DataFrame:
    """Of search(): the pairs with a run of RUN words (exact), or with enough of a window's telling words, enough of them in
    order (paraphrase)."""
    kind = F.when(F.col("run") >= RUN, "exact").when((F.col("subsequence") >= SUBSEQUENCE) & (F.col("answered") >= ANSWER), "paraphrase")
    return found.withColumn("kind", kind).where("kind is not null")
