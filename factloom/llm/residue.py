"""Template residue and error-page text (problem 9).

Two positive-unlabelled naive Bayes models, fitted by expectation-maximisation on a bounded sample of documents:

- passages: trusted positives are the passages of records that consist of unmistakable error, notice or filler text; all
  other passages are unlabelled. Scored passages are aggregated to a decision on the record.
- gaps: strings that look like unfilled placeholders are either left over where a word should stand, or quoted by a text
  about them. Trusted examples of the first are places of ordinary sentences with their word masked; all found strings
  are unlabelled, the words around them are the features.

A record is excluded if it has error passages and no passage of real content beside headlines, menus and teasers, or if
it has a placeholder that was left unfilled.
"""

from __future__ import annotations

import functools
import html
import itertools
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Documents that the models are fitted on, and the width of the hashed passage features.
SAMPLE_DOCS = 12_000
WIDTH = 1 << 16
ROUNDS = 8
#: Characters on either side of a place that hold its two neighbouring words.
NEAR = 80
#: Weight of the ordinary words' distribution in that of quoted placeholders.
SMOOTHING = 2.0
#: Share of the words of all passages in either class's distribution, and what is taken off each count: words that a class
#: has once, or that no passage has, say next to nothing about it.
BACKGROUND, DISCOUNT = 0.3, 1.0
#: Log odds from which on a pair of words is clear evidence.
CLEAR = 0.5
#: Places masked in each ordinary sentence.
MASKED = 3
#: Words from which on a passage with an end mark is a sentence of content.
CONTENT_WORDS = 5
#: A record with so many sentences that no trusted wording explains is one of content: its passages are negatives.
SURE_SENTENCES = 4

# Wording that error pages, notices and filler text are made of, in several languages.
_TRUSTED = re.compile(
    r"lorem ipsum|dolor sit amet|placeholder text|\basdf\b|your content goes here|body copy|blindtext|text text text|sample paragraph"
    r"|\b(?:40[0134]|429|50[0234])\b[ :-]*(?:not found|bad gateway|forbidden|too many|service|gateway|internal|unauthori[sz]ed|error)"
    r"|fatal error|stack trace|traceback \(most recent|keyerror|down for maintenance|session has expired|unhandled exception|something went wrong|page (?:not found|isn.t available|cannot be|could not be)"
    r"|could not be loaded|no longer here|has been taken down|refused the connection|failed to open|the link may be broken"
    r"|enable (?:javascript|cookies|scripts?)|(?:javascript|scripts?) (?:is|are) (?:disabled|off|required)|turn on javascript|without scripts|script support"
    r"|requires? (?:cookies|javascript)|checking your browser|verifying (?:that )?you are|are you (?:a )?human|signed-in users|sign in to (?:continue|read|view)|log in to (?:continue|read|view)"
    r"|activer? javascript|javascript aktivieren|active? (?:el )?javascript|ativar? o? ?javascript|attivare? javascript|включите javascript",
)
#: Strings of which every wording above has one; looked for first, since that is far cheaper.
_CUES = (
    "lorem", "dolor sit", "placeholder", "asdf", "your content", "body copy", "blindtext", "text text", "sample", "40", "429", "50", "error", "trace", "maintenance", "expired", "exception",
    "wrong", "page", "loaded", "longer", "taken", "refused", "failed", "link", "script", "cookies", "browser", "verifying", "human", "signed", "sign in", "log in",
)
# The words of the printers' filler text.
_LATIN = frozenset(
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud "
    "exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur "
    "excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum".split()
)
# Spellings of placeholders.
_GAP = re.compile(
    r"\{\{[^{}\n]{0,60}\}\}|\$\{[^{}\n]{0,60}\}|\{\w{1,40}\}|\{[A-Za-z][\w .]{0,40}\}|\[\[[^\[\]\n]{1,60}\]\]|\[object Object\]"
    r"|\[(?!E?\d)[^\W\d][^\[\]\d\n]{1,50}\]|<(?!/)[^\W\d_][^<>\n=/]{1,40}>|%[A-Za-z][\w.]{1,40}%|%[sd](?!\w)|__[A-Z][A-Z_]*__|@@\w+@@"
    r"|\b(?:TKTK|TK|TBD|XXX+|undefined|NaN|null|FIXME|TODO)\b"
)
#: What every placeholder begins with or is.
_GAP_CUE = re.compile(r"[{\[<%@]|__|TK|TBD|XXX|undefined|NaN|null|FIXME|TODO")
_HTML = re.compile(r"</?(?:p|br|b|i|u|em|strong|span|div|a|li|ul|ol|h[1-6]|table|tr|td|th|img|hr|blockquote|code|pre|sup|sub|small|script|style|figure|section|article)\b[^<>]*>", re.I)
_SENTENCE = re.compile(r"(?<=[.!?…])[\"'”»)]*\s+")
_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
_DIGITS = re.compile(r"\d+")


def passages(text: str) -> list[str]:
    """Sentences of the lines of `text`, without tags and byte-order marks."""
    bare = _HTML.sub(" ", text.replace("﻿", ""))
    return [s for line in bare.splitlines() for s in _SENTENCE.split(line.strip()) if s]


def _words(passage: str) -> list[str]:
    return _WORD.findall(_DIGITS.sub("0", passage.lower()))


@dataclass
class Passage:
    """A passage with what is read off it more than once."""

    text: str
    words: list[str]
    sentence: bool

    @classmethod
    def of(cls, text: str) -> Passage:
        words = _words(text)
        return cls(text, words, len(words) >= CONTENT_WORDS and text.rstrip("\"'”») ")[-1:] in (".", "!", "?", "…"))


def read(text: str) -> list[Passage]:
    return [Passage.of(p) for p in passages(text)]


def is_trusted(passage: Passage) -> bool:
    """Whether a passage has unmistakable wording, or is filler text for the most part."""
    low = passage.text.lower()
    if any(c in low for c in _CUES) and _TRUSTED.search(low):
        return True
    words = passage.words
    return len(words) >= 4 and sum(w in _LATIN for w in words) >= 0.75 * len(words)


@functools.lru_cache(maxsize=200_000)
def _hash(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass"))


def record_features(own: list[Passage]) -> set[int]:
    """What a record lends to each of its passages: the words of its short lines."""
    return {_hash("near:" + w) % WIDTH for p in own if not p.sentence and len(p.words) < 8 for w in p.words}


def _pairs(passage: Passage) -> list[int]:
    hashes = [_hash(w) for w in passage.words]
    return [(a * 0x9E3779B1 + b) % WIDTH for a, b in zip(hashes, hashes[1:])]


def _features(passage: Passage, around: set[int]) -> list[int]:
    if not passage.words:
        return []
    out = {_hash(w) % WIDTH for w in passage.words}
    out.update(_pairs(passage))
    out |= around if passage.sentence else around - {_hash("near:" + w) % WIDTH for w in passage.words}
    return sorted(out)


def gaps(sentence: str) -> list[tuple[str, ...]]:
    """Contexts of the placeholder strings of a sentence: two words before and two after, names and numbers as such."""
    return [_context(sentence[max(0, m.start() - NEAR) : m.start()], sentence[m.end() : m.end() + NEAR]) for m in _GAP.finditer(sentence)]


def _context(before: str, after: str, bare: bool = False) -> tuple[str, ...]:
    """bare: neither side holds a placeholder."""
    if not bare:
        before, after = _GAP.sub(" N ", before), _GAP.sub(" N ", after)

    def shape(w: str) -> str:
        return "#" if w.isdigit() else "N" if w[:1].isupper() else w

    left = ["^", "^", *map(shape, _WORD.findall(before)[-2:])][-2:]
    right = [*map(shape, _WORD.findall(after)[:2]), "$", "$"][:2]
    return (f"a:{left[0]}", f"b:{left[1]}", f"c:{right[0]}", f"d:{right[1]}")


@dataclass
class Models:
    """Log odds of passage features, with a constant; log odds that a context's word speaks for a quoted placeholder."""

    passage: np.ndarray
    bias: float
    quoted: dict[str, float] = field(default_factory=dict)
    unknown: float = 0.0

    def error(self, passage: Passage, around: set[int]) -> bool:
        """Whether a passage speaks for error more than for content, and not by a few everyday words alone: two words that
        stand together must speak for it, or half of all its words, or wording that is trusted anyway."""
        f = _features(passage, around)
        if not f or self.bias + float(self.passage[f].sum()) <= 0:
            return False
        pairs, words = _pairs(passage), [_hash(w) % WIDTH for w in passage.words]
        return not pairs or float(self.passage[pairs].max()) > CLEAR or float((self.passage[words] > CLEAR).mean()) >= 0.5 or is_trusted(passage)

    def left_over(self, context: tuple[str, ...]) -> bool:
        return sum(self.quoted.get(c, self.unknown) for c in context) <= 0


def _expectation_maximisation(trusted: list[list[int]], unlabelled: list[list[int]], negative: list[list[int]]) -> tuple[np.ndarray, float]:
    rows = trusted + unlabelled + negative
    lengths = np.array([len(r) for r in rows])
    flat = np.concatenate([np.array(r, np.int64) for r in rows]) if rows else np.zeros(0, np.int64)
    of = np.repeat(np.arange(len(rows)), lengths)
    w = np.zeros(len(rows))
    w[: len(trusted)] = 1.0
    log_odds, bias = np.zeros(WIDTH), -1.0
    every = np.bincount(flat, minlength=WIDTH) + 1.0 / WIDTH
    common = every / every.sum()
    for _ in range(ROUNDS):
        log_odds = np.log(_distribution(flat, w[of], common)) - np.log(_distribution(flat, 1 - w[of], common))
        bias = float(np.log((w.sum() + 1) / (len(w) - w.sum() + 1)))
        score = bias + np.bincount(of, weights=log_odds[flat], minlength=len(rows))
        w = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
        w[: len(trusted)] = 1.0
        w[len(trusted) + len(unlabelled) :] = 0.0
    return log_odds, bias


def _distribution(flat: np.ndarray, weight: np.ndarray, common: np.ndarray) -> np.ndarray:
    """A class's features: its discounted counts with the distribution of both classes behind them. A feature that the
    class hasn't is as likely as that background, in either class the same share, so size alone says nothing."""
    held = np.maximum(np.bincount(flat, weights=weight, minlength=WIDTH) - DISCOUNT, 0.0)
    return (1 - BACKGROUND) * held / max(held.sum(), 1e-9) + BACKGROUND * common


def fit(texts: list[str]) -> Models:
    """Models from a sample of texts. Without trusted passages nothing is an error passage."""
    trusted, unlabelled, negative, ordinary, found = [], [], [], [], []
    for text in texts:
        own = read(text)
        marks = [is_trusted(p) for p in own]
        pure = any(marks) and all(m for m, p in zip(marks, own, strict=True) if p.sentence)
        full = not pure and sum(p.sentence and not m for p, m in zip(own, marks, strict=True)) >= SURE_SENTENCES
        around = record_features(own)
        for p, m in zip(own, marks, strict=True):
            if (f := _features(p, around)) and not (full and m):
                (trusted if pure and m else negative if full else unlabelled).append(f)
        for p in () if pure else own:
            if holes := gaps(p.text):
                found += holes
            elif p.sentence:
                places = list(_WORD.finditer(p.text))
                for k in range(MASKED):  # other places where a sentence comes again
                    at = places[(len(ordinary) * 7 + k) % len(places)]
                    ordinary.append(_context(p.text[max(0, at.start() - NEAR) : at.start()], p.text[at.end() : at.end() + NEAR], bare=True))
    if not trusted:
        return Models(np.zeros(WIDTH), -1.0)
    log_odds, bias = _expectation_maximisation(trusted, unlabelled, negative)
    models = Models(log_odds, bias)
    use = Counter(c for ctx in ordinary for c in ctx)
    size = len(use) + 1
    n = len(ordinary) / 1.0
    p_use = {c: (k + 0.5) / (n + 0.5 * size) for c, k in use.items()}
    rare = 0.5 / (n + 0.5 * size)
    weight = np.array([float(sum(np.log(1.0 / size) - np.log(p_use.get(c, rare)) for c in ctx) > 0) for ctx in found])
    odds, unknown = {}, 0.0
    for _ in range(ROUNDS):
        quoted: Counter = Counter()
        for ctx, w in zip(found, weight, strict=True):
            for c in ctx:
                quoted[c] += w
        total = weight.sum()
        prior = np.log((total + 1) / (len(found) - total + 1)) / 4
        # one occurrence proves nothing (it may be the judged one itself), so it is taken off; the rest is smoothed by the words of ordinary places
        held = lambda c: max(quoted[c] - 1, 0.0) / p_use.get(c, rare) + SMOOTHING
        odds = {c: float(np.log(held(c) / (total + SMOOTHING)) + prior) for c in {*use, *quoted}}
        unknown = float(np.log(SMOOTHING / (total + SMOOTHING)) + prior)
        weight = np.array([1 / (1 + np.exp(-np.clip(sum(odds.get(c, unknown) for c in ctx), -30, 30))) for ctx in found])
    models.quoted, models.unknown = (odds, unknown) if len(found) else ({}, -1.0)
    return models


def decide(models: Models, text: str | None) -> tuple[int, int, int]:
    """(error passages, content sentences, placeholders left over) of a text; nothing for null and empty ones."""
    errors = content = left = 0
    own = read(text) if isinstance(text, str) else []
    around = record_features(own)
    for p in own:
        if models.error(p, around):
            errors += 1
        else:
            content += p.sentence
            left += sum(map(models.left_over, gaps(p.text)))
    return errors, content, left


def excludes(models: Models, text: str | None) -> bool:
    """Whether decide() leads to exclusion, read only as far as that needs: one sentence of content settles that a record
    is no error page, and only passages with a placeholder string have to be looked at for those."""
    own = passages(text) if isinstance(text, str) else []
    sentences, others = [], []
    for p in own:
        marked = p.rstrip("\"'”») ")[-1:] in (".", "!", "?", "…")
        full = marked and sum(1 for _ in itertools.islice(_WORD.finditer(p), CONTENT_WORDS)) == CONTENT_WORDS
        (sentences if full else others).append(p)
    around = {h for p in others if len(ws := _words(p)) < 8 for h in (_hash("near:" + w) % WIDTH for w in ws)}
    error = functools.cache(lambda p: models.error(Passage.of(p), around))
    if all(map(error, sentences)) and any(map(error, own)):
        return True
    return any(not error(p) and any(map(models.left_over, found)) for p in own if _GAP_CUE.search(p) and (found := gaps(p)))


def sample(docs: DataFrame, ident: str, text: str, most: int = SAMPLE_DOCS) -> list[str]:
    """About `most` texts, chosen by their identifier's hash."""
    rate = min(1.0, most / max(1, docs.count()))
    chosen = docs.where(F.col(text).isNotNull() & (F.pmod(F.xxhash64(ident), F.lit(1_000_000)) < int(rate * 1_000_000)))
    return [html.unescape(r[0]) for r in chosen.select(text).collect()]


def to_exclude(docs: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """(ident) of the records to exclude, as score() has them. Repeated rows give repeated results."""
    models = docs.sparkSession.sparkContext.broadcast(fit(sample(docs.select(ident, text), ident, text)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = models.value
        for b in batches:
            yield b.loc[[excludes(m, html.unescape(t)) if isinstance(t, str) else False for t in b[text]], [ident]]

    return docs.select(ident, text).mapInPandas(run, f"{ident} {docs.schema[ident].dataType.simpleString()}")


def score(docs: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """(ident, errors, content, left_over, excluded) of each record. Repeated rows give repeated results."""
    models = docs.sparkSession.sparkContext.broadcast(fit(sample(docs.select(ident, text), ident, text)))
    kind = docs.schema[ident].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = models.value
        for b in batches:
            counts = np.array([decide(m, html.unescape(t) if isinstance(t, str) else None) for t in b[text]], dtype=np.int32).reshape(-1, 3)
            out = pd.DataFrame({ident: b[ident], "errors": counts[:, 0], "content": counts[:, 1], "left_over": counts[:, 2]})
            out["excluded"] = ((out.errors > 0) & (out.content == 0)) | (out.left_over > 0)
            yield out

    return docs.select(ident, text).mapInPandas(run, f"{ident} {kind}, errors int, content int, left_over int, excluded boolean")
