"""Languages of documents and of their sentences (problem 3).

Interpolated Kneser-Ney character models, one per language, in sorted hash arrays that all languages share: an n-gram's
row holds its probability under each model, a context's row each model's weight for the shorter context. A sentence gets
the language of lowest length-normalised cross-entropy. Confidence and rejection are calibrated on sentences that were kept
back from training: the posterior's slope is the one under which they are likeliest, and a sentence is rejected where even
the best model finds it stranger than all but REJECTED of that language's sentences of its length.

The models are trained on a bounded sample of labelled rows (PER_LANGUAGE documents a language). Since labels are partly
wrong, sentences that models of the other half of the sample assign to another language are left out first, twice.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ORDER = 5
PER_LANGUAGE = 3000
#: Bits by which a sentence must favour its language over the document's main one to count as foreign.
FOREIGN_BITS = 12.0
#: Letters below which a sentence isn't judged.
SHORTEST = 8
#: Share of the training sentences kept back for calibration (one of so many), the letters that these are cut to for the
#: slope of the confidence, the slopes that are tried, and the share of true sentences that may be rejected.
KEPT_BACK, LENGTHS, SLOPES, REJECTED = 5, (8, 12, 16, 24, 40), (0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.4, 0.5, 0.6, 0.8, 1.0), 0.001

# Notations of the seven languages, lower case, without region.
NOTATIONS = {
    "en": "en eng english anglais inglés englisch",
    "fr": "fr fra fre french français francais französisch",
    "de": "de deu ger german deutsch allemand",
    "es": "es spa spanish español espanol castellano espagnol",
    "pt": "pt por portuguese português portugues",
    "it": "it ita italian italiano italien",
    "ru": "ru rus russian русский",
}
_OF_NOTATION = {n: lang for lang, names in NOTATIONS.items() for n in names.split()}
LANGS = tuple(NOTATIONS)

_TAG = re.compile(r"<[^<>]*>")
_ADDRESS = re.compile(r"\b(?:https?://|www\.)\S+", re.I)
_BREAK = re.compile(r"(?<=[.!?…])[\"'”»)]*\s+|\s*[\r\n]+\s*|\s+(?:/+|\|+|::|•|·|–|—)\s+")
_P = np.uint64(0x9E3779B97F4A7C15)
_START = 2


def label_language(label: str | None) -> str | None:
    """The language that a label names in any notation, or None if it says nothing."""
    if not isinstance(label, str):
        return None
    return _OF_NOTATION.get(re.split(r"[-_ (]", label.strip().lower(), maxsplit=1)[0])


def sentences(*texts: str | None) -> list[str]:
    """Sentences of `texts`; addresses and tags are left out. A text without end marks is one sentence."""
    out = []
    for text in texts:
        if not isinstance(text, str):
            continue
        bare = _TAG.sub(" ", text) if "<" in text else text
        bare = html.unescape(bare) if "&" in bare else bare
        bare = (_ADDRESS.sub(" ", bare) if "://" in bare or "www." in bare.lower() else bare).strip()
        if not re.search(r"\s", bare) and re.search(r"[./]", bare):
            continue
        out += [s.strip() for s in _BREAK.split(bare) if s and s.strip()]
    return out


_IS_LETTER = np.array([chr(c).isalpha() or c == 0x27 for c in range(0x3000)] + [True])


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all texts in lower case, runs of anything but letters as one blank, each text after ORDER - 1 start
    marks and before a blank; the places of the characters; the first of them of each text."""
    lines = [t.replace("\n", " ") for t in texts]
    a = np.frombuffer(("\n".join(lines).lower() + "\n").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    end = a == 10
    blank = ~_IS_LETTER[np.minimum(a, 0x3000)] & ~end
    before = np.concatenate([[True], (blank | end)[:-1]])  # a blank after a blank or at the start goes
    after = np.concatenate([end[1:], [True]])  # and so does one at the end
    keep = ~(blank & (before | after))
    a, end = np.where(blank | end, 32, a)[keep], end[keep]
    of = np.cumsum(end) - end
    places = np.arange(len(a)) + (ORDER - 1) * (of + 1)
    codes = np.full(len(a) + (ORDER - 1) * len(texts), _START, np.uint64)
    codes[places] = a
    return codes, places, np.concatenate([[0], np.nonzero(end)[0][:-1] + 1])


def _hashes(codes: np.ndarray) -> list[np.ndarray]:
    """h[k][i]: hash of the k characters that end at i (h[0] is 0)."""
    h = [np.zeros(len(codes), np.uint64)]
    with np.errstate(over="ignore"):
        mixed = (codes + np.uint64(1)) * _P
        mixed ^= mixed >> np.uint64(29)
        for _ in range(ORDER):
            prev = np.concatenate([[np.uint64(7)], h[-1][:-1]])
            x = prev * np.uint64(0xBF58476D1CE4E5B9) + mixed
            h.append(x ^ (x >> np.uint64(31)))
    return h


def _find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


@dataclass
class Models:
    """For each order: sorted n-gram hashes with a row of log2 probabilities, sorted context hashes with a row of log2 weights."""

    langs: tuple[str, ...]
    grams: list[np.ndarray]
    logs: list[np.ndarray]
    contexts: list[np.ndarray]
    weights: list[np.ndarray]
    strange: np.ndarray
    spread: np.ndarray | None = None
    slope: float = 1.0

    def limit(self, best: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Bits per character above which a sentence of n letters isn't of the language that fits it best."""
        return self.strange[best] + (0.0 if self.spread is None else self.spread[best] / np.sqrt(n + 1))

    def cross_entropy(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Bits per character of each text under each model, and the texts' lengths in letters and blanks."""
        if not len(texts) or not self.langs:
            return np.zeros((len(texts), len(self.langs))), np.zeros(len(texts), np.int64)
        codes, places, first = _codes(texts)
        h = _hashes(codes)
        at, hit = _find(self.grams[ORDER], h[ORDER][places])
        total = np.take(self.logs[ORDER], at, axis=0)
        open_ = np.nonzero(~hit)[0]
        total[open_] = 0
        for k in range(ORDER, 1, -1):
            where = places[open_]
            at, hit = _find(self.contexts[k], h[k - 1][where - 1])
            total[open_[hit]] += self.weights[k][at[hit]]
            at, hit = _find(self.grams[k - 1], h[k - 1][where])
            total[open_[hit]] += self.logs[k - 1][at[hit]]
            open_ = open_[~hit]
            if not len(open_):
                break
        total[open_] += -16.0  # a character that no model knows
        sums = np.add.reduceat(total, first, axis=0).astype(np.float64)
        lengths = np.diff(np.append(first, len(places)))
        return -sums / lengths[:, None], lengths - 1


def train(texts: dict[str, list[str]]) -> Models:
    """Models of the languages of `texts` that have any text."""
    langs = tuple(lang for lang in texts if texts[lang])
    if not langs:
        return Models((), [], [], [], [], np.zeros(0))
    stats: list[list[tuple]] = []
    for lang in langs:
        codes, at, _ = _codes(texts[lang])
        h = _hashes(codes)
        grams, first, counts = np.unique(h[ORDER][at], return_index=True, return_counts=True)
        per: list[tuple] = [()] * (ORDER + 1)
        where = at[first]
        for k in range(ORDER, 0, -1):
            per[k] = (grams, counts.astype(np.float64), h[k - 1][where - 1] if k > 1 else np.zeros(len(grams), np.uint64), h[k - 1][where])
            if k > 1:  # the next lower order counts the different characters before each n-gram
                grams, first, counts = np.unique(h[k - 1][where], return_index=True, return_counts=True)
                where = where[first]
        stats.append(per)
    m = len(langs)
    out = Models(langs, [np.zeros(0, np.uint64)], [np.zeros((0, m), np.float32)], [np.zeros(0, np.uint64)] * 2, [np.zeros((0, m), np.float32)] * 2, np.zeros(m))
    below_grams, below = None, None
    for k in range(1, ORDER + 1):
        everything = np.concatenate([s[k][0] for s in stats])
        union, first = np.unique(everything, return_index=True)
        context = np.concatenate([s[k][2] for s in stats])[first]
        suffix = np.concatenate([s[k][3] for s in stats])[first]
        contexts = np.unique(context)
        seen, weight = np.zeros((len(union), m)), np.ones((len(contexts), m))
        share, most = np.zeros((len(union), m)), np.zeros(len(union))
        in_context = np.searchsorted(contexts, context)
        for j, s in enumerate(stats):
            grams, counts, own, _ = s[k]
            ones, twos = (counts == 1).sum(), (counts == 2).sum()
            d = ones / (ones + 2 * twos) if ones and ones + 2 * twos else 0.5
            c = np.searchsorted(contexts, own)
            sums, kinds = np.bincount(c, weights=counts, minlength=len(contexts)), np.bincount(c, minlength=len(contexts))
            known = sums > 0
            weight[known, j] = d * kinds[known] / sums[known]
            i = np.searchsorted(union, grams)
            share[i, j] = np.maximum(counts - d, 0) / sums[c]
            most[i] = np.maximum(most[i], counts)
            seen[i, j] = 1
        lower = np.full((len(union), m), 1.0 / 4096) if k == 1 else below[np.searchsorted(below_grams, suffix)]
        p = share + weight[in_context] * lower
        below_grams, below = union, p
        keep = most > 1 if k >= 4 else np.ones(len(union), bool)  # n-grams seen once are left to their suffix
        out.grams.append(union[keep] if keep.any() else union)
        out.logs.append(np.log2(p[keep] if keep.any() else p).astype(np.float32))
        if k > 1:
            out.contexts.append(contexts)
            out.weights.append(np.log2(weight).astype(np.float32))
    for j, lang in enumerate(langs):
        ce, _ = out.cross_entropy(texts[lang])
        out.strange[j] = np.quantile(ce[:, j], 0.999) + 1.5
    return out


def train_labelled(rows: list[tuple[str, str]]) -> Models:
    """Models from (label language, sentence) pairs, labels partly wrong."""
    texts: dict[str, list[str]] = {lang: [] for lang in LANGS}
    for lang, sentence in rows:
        if len(sentence) >= SHORTEST:
            texts[lang].append(sentence)
    for _ in range(2):
        texts = _agreed(texts)
    models = train(texts)
    _calibrate(models, texts)
    return models


def _calibrate(models: Models, texts: dict[str, list[str]]) -> None:
    """Sets rejection limits and the slope of the confidence by models that haven't seen the sentences they judge."""
    kept = {lang: own[::KEPT_BACK] for lang, own in texts.items()}
    probe = train({lang: [t for i, t in enumerate(own) if i % KEPT_BACK] for lang, own in texts.items()})
    if not models.langs or probe.langs != models.langs:  # too few sentences to keep any back
        return
    spread, cuts, truth = np.zeros(len(models.langs)), [], []
    for j, lang in enumerate(models.langs):
        ce, n = probe.cross_entropy(kept[lang])
        models.strange[j] = np.average(ce[:, j], weights=n + 1)
        parts = [t[i % 7 : i % 7 + LENGTHS[i % len(LENGTHS)]] for i, t in enumerate(kept[lang])]
        # pieces are stranger than whole sentences and must not be rejected either; five deviations where there are few
        cut_ce, cut_n = probe.cross_entropy(parts)
        z = np.concatenate([(ce[:, j] - models.strange[j]) * np.sqrt(n + 1), (cut_ce[:, j] - models.strange[j]) * np.sqrt(cut_n + 1)])
        spread[j] = max(np.quantile(z, 1 - REJECTED), z.mean() + 5 * z.std())
        cuts += parts
        truth += [j] * len(parts)
    models.spread = np.maximum(spread, 0)
    ce, n = probe.cross_entropy(cuts)
    gap = (ce - ce.min(axis=1, keepdims=True)) * n[:, None]
    lost = [np.log2(np.exp2(-s * gap).sum(axis=1)).sum() + s * gap[np.arange(len(truth)), truth].sum() for s in SLOPES]
    models.slope = SLOPES[int(np.argmin(lost))]


def _agreed(texts: dict[str, list[str]]) -> dict[str, list[str]]:
    """Without the sentences that models of the other half of the sentences assign to another language."""
    halves = [{lang: own[i::2] for lang, own in texts.items()} for i in (0, 1)]
    out: dict[str, list[str]] = {lang: [] for lang in texts}
    for train_on, test_on in (halves, halves[::-1]):
        models = train(train_on)
        for lang, own in test_on.items():
            if lang not in models.langs or not own:
                out[lang] += own
                continue
            ce, _ = models.cross_entropy(own)
            out[lang] += [t for t, best in zip(own, ce.argmin(axis=1), strict=True) if models.langs[best] == lang]
    return out


@dataclass
class Judged:
    """Of each sentence: its language's index or -1 if rejected, and a confidence; of its document: whether it is mixed."""

    lang: np.ndarray
    confidence: np.ndarray
    mixed: np.ndarray


def judge(models: Models, texts: list[str], doc: np.ndarray, docs: int) -> Judged:
    """Judges the sentences `texts`; doc: the document (0 to docs - 1) that each stands in."""
    ce, n = models.cross_entropy(texts)
    if not ce.size:
        return Judged(np.full(len(texts), -1), np.zeros(len(texts)), np.zeros(len(texts), bool))
    every = np.arange(len(texts))
    best = ce.argmin(axis=1)
    low = ce[every, best]
    sure = 1 / np.exp2(-models.slope * (ce - low[:, None]) * n[:, None]).sum(axis=1)
    ok = (n >= SHORTEST) & (low <= models.limit(best, n))
    letters = np.zeros((docs, len(models.langs)))
    np.add.at(letters, (doc[ok], best[ok]), n[ok])
    main = letters.argmax(axis=1)[doc]
    weak = ok & (best != main) & ((ce[every, main] - low) * n < FOREIGN_BITS)
    lang = np.where(ok, np.where(weak, main, best), -1)
    present = np.zeros(letters.shape, bool)
    present[doc[ok], lang[ok]] = True
    return Judged(lang, np.where(ok, sure, 0.0), (present.sum(axis=1) > 1)[doc])


def sample_labelled(docs: DataFrame, label: str, texts: list[str], ident: str, per_language: int = PER_LANGUAGE) -> list[tuple[str, str]]:
    """(label language, sentence) of about `per_language` documents of each label, chosen by their identifier's hash."""
    lower = F.lower(F.trim(F.regexp_extract(F.trim(F.col(label)), r"^([^-_ (]+)", 1)))
    known = docs.select(lower.alias("l"), F.xxhash64(ident).alias("_h"), *texts).where(F.col("l").isin(sorted(_OF_NOTATION)))
    of = F.create_map(*[F.lit(x) for pair in sorted(_OF_NOTATION.items()) for x in pair])
    known = known.withColumn("l", of[F.col("l")])
    counts = {r.l: r.n for r in known.groupBy("l").agg(F.count("*").alias("n")).collect()}  # at most one row a language
    rate = F.create_map(*[F.lit(x) for lang, n in sorted(counts.items()) for x in (lang, min(1.0, per_language / n))]) if counts else None
    if rate is None:
        return []
    chosen = known.where(F.pmod("_h", F.lit(1_000_000)) < rate[F.col("l")] * 1_000_000).select("l", *texts)
    return [(r.l, s) for r in chosen.collect() for s in sentences(*[r[t] for t in texts])]


def detect(docs: DataFrame, models: Models, ident: str, texts: list[str], label: str | None = None) -> DataFrame:
    """(ident, label_lang, seq, lang, confidence, mixed, sentence) of each sentence.

    `lang` is null where the sentence is rejected or too short. A sentence counts towards another language than the
    document's main one (most letters) only if that language beats the main one by FOREIGN_BITS in all; otherwise it is
    given the main language. Documents without a sentence have no rows. Null texts are passed over; repeated rows give
    repeated results."""
    shared = docs.sparkSession.sparkContext.broadcast(models)
    kind = docs.schema[ident].dataType.simpleString()
    columns = [ident, *texts] + ([label] if label else [])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        names = np.array([*m.langs, None], dtype=object)
        for b in batches:
            split = [sentences(*row) for row in zip(*[b[t] for t in texts], strict=True)]
            counts = np.array([len(x) for x in split])
            doc = np.repeat(np.arange(len(b)), counts)
            flat = [s for x in split for s in x]
            found = judge(m, flat, doc, len(b))
            labels = np.array([label_language(x) for x in b[label]] if label else [None] * len(b), dtype=object)
            seq = np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts)
            yield pd.DataFrame({ident: b[ident].to_numpy()[doc], "label_lang": labels[doc], "seq": seq, "lang": names[found.lang], "confidence": found.confidence, "mixed": found.mixed, "sentence": flat})

    return docs.select(*columns).mapInPandas(run, f"{ident} {kind}, label_lang string, seq int, lang string, confidence double, mixed boolean, sentence string")


def label_errors(docs: DataFrame, models: Models, ident: str, texts: list[str], label: str) -> DataFrame:
    """(ident, lang): of the documents whose label is missing or wrong or that are mixed, each language. As detect()."""
    shared = docs.sparkSession.sparkContext.broadcast(models)
    kind = docs.schema[ident].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        names = np.array(m.langs, dtype=object)
        for b in batches:
            split = [sentences(*row) for row in zip(*[b[t] for t in texts], strict=True)]
            doc = np.repeat(np.arange(len(b)), [len(x) for x in split])
            found = judge(m, [s for x in split for s in x], doc, len(b))
            known = found.lang >= 0
            pairs, mixed = np.stack([doc[known], found.lang[known]], axis=1), found.mixed[known]
            labels = np.array([label_language(x) for x in b[label]], dtype=object)
            case = mixed | (labels[pairs[:, 0]] != names[pairs[:, 1]])
            pairs = np.unique(pairs[case], axis=0)
            yield pd.DataFrame({ident: b[ident].to_numpy()[pairs[:, 0]], "lang": names[pairs[:, 1]]})

    return docs.select(ident, *texts, label).mapInPandas(run, f"{ident} {kind}, lang string")
