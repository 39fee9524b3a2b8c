"""Text functions as JVM column expressions. Null texts count as empty unless said otherwise."""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom import registries as R

def words(*values: str) -> Column:
    return F.array(*[F.lit(v) for v in values])


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def tokens(c: Column) -> Column:
    """Lower-case runs of ASCII letters and digits, in order, repeats kept."""
    return F.regexp_extract_all(F.lower(text_or_empty(c)), F.lit("([a-z0-9]+)"), F.lit(1))


def content_tokens(c: Column) -> Column:
    """Distinct tokens of three or more characters that aren't stop words."""
    return F.array_except(F.regexp_extract_all(F.lower(text_or_empty(c)), F.lit("([a-z0-9]{3,})"), F.lit(1)), words(*R.STOPWORDS))


def is_generic(token: Column) -> Column:
    """Whether a token, or its form without a final s, is a word of analytic framing."""
    bare = F.regexp_replace(token, "s$", "")
    return token.isin(R.GENERIC) | (token.endswith("s") & bare.isin(R.GENERIC))


def subject_tokens(c: Column) -> Column:
    """Content tokens without those of analytic framing."""
    return F.filter(content_tokens(c), lambda t: ~is_generic(t))


def singular_forms(tokens_: Column) -> Column:
    """Tokens with the form without final s of each longer than four."""
    return F.array_union(tokens_, F.transform(F.filter(tokens_, lambda t: (F.length(t) > 4) & t.endswith("s")), lambda t: F.regexp_replace(t, "s$", "")))


def relevance_tokens(c: Column) -> Column:
    """Subject tokens in both numbers, widened by the vocabulary of a domain that one of them calls up."""
    own = singular_forms(subject_tokens(c))
    wide = own
    for anchors, group in R.SUBJECT_GROUPS:
        wide = F.when(F.arrays_overlap(own, words(*anchors)), F.array_union(wide, words(*group))).otherwise(wide)
    return wide


@F.pandas_udf(T.StringType())
def unescaped_batch(c: pd.Series) -> pd.Series:
    return c.map(lambda s: html.unescape(s) if isinstance(s, str) else None)


@F.pandas_udf(T.ArrayType(T.StringType()))
def _unescaped_each(c: pd.Series) -> pd.Series:
    return c.map(lambda a: [None if s is None else html.unescape(s) for s in a] if a is not None else None)


# The entities that most texts with any have.
_COMMON = (("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "'"), ("#x27", "'"), ("apos", "'"), ("nbsp", "\xa0"), ("mdash", "—"), ("ndash", "–"), ("hellip", "…"), ("amp", "&"))


def _common_entities(c: Column) -> Column:
    for name, char in _COMMON:
        c = F.replace(c, F.lit(f"&{name};"), F.lit(char))
    return c


def _has_others(raw: Column) -> Column:
    """Whether a text may hold an entity other than the common ones."""
    return raw.rlike(rf"&(?!(?:{'|'.join(n for n, _ in _COMMON)});)[#A-Za-z]|&amp;(?:#|[A-Za-z]+;)")


def unescape(c: Column) -> Column:
    """Every HTML entity resolved; the common ones without leaving the JVM."""
    others = _has_others(c)
    return F.when(others, unescaped_batch(F.when(others, c))).otherwise(_common_entities(c))


def unescape_each(c: Column, raw: Column) -> Column:
    """As unescape(), for the texts of an array that was taken out of `raw`."""
    others = _has_others(raw)
    return F.when(others, _unescaped_each(F.when(others, c))).otherwise(F.transform(c, _common_entities))


def collapse(c: Column) -> Column:
    """White space runs as one blank, none at the ends."""
    return F.trim(F.regexp_replace(c, r"[\s\x{A0}]+", " "))


def clean(c: Column) -> Column:
    """Entities resolved, tags dropped, white space collapsed; null where nothing is left."""
    bare = collapse(F.regexp_replace(unescape(c), r"<[^>]+>", " "))
    return F.when(bare != "", bare)


def any_of(*phrases: str) -> str:
    """A pattern for one of some plain phrases, white space in them of any length."""
    return "(?:" + "|".join(r"\s+".join(re.escape(w) for w in p.split()) for p in phrases) + ")"


def element(name: str) -> str:
    """A pattern for an element of a page, its inside as the first group."""
    return rf"(?is)<{name}\b[^>]*>(.*?)</{name}>"


def main_text(page: Column, most: int = R.MAX_BODY) -> Column:
    """The prose of a page: paragraphs of its first article, else of the whole page, outside scripts, menus, forms and
    comments, of MIN_PARAGRAPH or more characters; ends with the paragraph that reaches `most`, cut there."""
    bare = F.regexp_replace(text_or_empty(page), rf"(?is)<({'|'.join(R.PAGE_FURNITURE)})\b.*?</\1>", " ")
    bare = F.regexp_replace(bare, r"(?s)<!--.*?-->", " ")
    opening = F.regexp_extract(bare, r"(?is)^(.*?)<article\b", 1)
    rest = F.when(bare.rlike(r"(?i)<article\b"), F.substring(bare, F.length(opening) + 1, F.length(bare)))
    ended = F.split(rest, "(?i)</article>", 2)
    scope = F.when(F.size(ended) == 2, ended[0]).otherwise(bare)
    inside = F.regexp_extract_all(scope, F.lit(element("p")), F.lit(1))
    paragraphs = F.transform(unescape_each(F.transform(inside, lambda p: F.regexp_replace(p, r"<[^>]+>", " ")), page), collapse)
    prose = F.filter(paragraphs, lambda p: (F.length(p) >= R.MIN_PARAGRAPH) & p.contains(" "))
    # how much stands before each paragraph decides whether it is still wanted
    start = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(0).alias("held"))
    kept = F.aggregate(prose, start, lambda a, p: F.struct(F.when(a["held"] < most, F.array_append(a["kept"], p)).otherwise(a["kept"]).alias("kept"), (a["held"] + F.length(p)).alias("held")))["kept"]
    return F.substring(F.array_join(kept, " "), 1, most)


def document_text(title: Column, summary: Column) -> Column:
    """Title and summary as one text."""
    return F.when(F.length(text_or_empty(summary)) > 0, F.concat(title, F.lit(". "), summary)).otherwise(title)


def needs_text(url: Column, summary: Column) -> Column:
    """Whether a record with an address has too little text."""
    return (F.length(text_or_empty(url)) > 0) & (F.length(text_or_empty(summary)) < R.USEFUL_SUMMARY)


_NAME_WORD = r"[A-Z][\w'-]+"


def name_spans(c: Column) -> Column:
    """Capitalised spans, at most five words long, that don't begin with a function word."""
    more = rf"(?:\s+(?:{'|'.join(R.NAME_JOINERS)}|{_NAME_WORD}))"
    spans = F.transform(F.regexp_extract_all(text_or_empty(c), F.lit(rf"(?U)\b({_NAME_WORD}{more}{{0,4}})"), F.lit(1)), lambda s: F.trim(s))
    opener = lambda s: F.regexp_extract(s, r"(?U)^\S+", 0).isin(*R.SENTENCE_OPENERS)
    return F.filter(spans, lambda s: (F.length(s) >= 3) & ~opener(s))


def entity_key(name: Column, kind: Column) -> Column:
    return F.substring(F.sha2(F.concat(kind, F.lit(":"), F.lower(F.trim(name))), 256), 1, 24)


def hashed_id(prefix: Column, key: Column, n: int = 24) -> Column:
    return F.concat(prefix, F.lit(":"), F.substring(F.sha2(key, 256), 1, n))


def citation_markers(c: Column) -> Column:
    """Every token that stands in square brackets."""
    inner = F.regexp_extract_all(text_or_empty(c), F.lit(r"\[([^\]]+)\]"), F.lit(1))
    return F.filter(F.flatten(F.transform(inner, lambda s: F.split(F.trim(s), r"[,\s]+"))), lambda t: t != "")


def confidence_word(c: Column) -> Column:
    found = F.lower(F.regexp_extract(text_or_empty(c), r"(?i)\b(low|moderate|high)\b", 1))
    return F.when(found != "", found)


def _hedges() -> list[str]:
    """Patterns of what a clause may begin with and say nothing by."""
    return [
        r"we\s+assess[^,]*?that", rf"it\s+is\s+{any_of(*R.HEDGE_STATES)}\s+that", r"there\s+(?:is|are)\s+likely", r"it\s+appears\s+that", rf"reporting\s+{any_of(*R.HEDGE_REPORTS)}\s+that",
    ]


def claims(judgment: Column) -> Column:
    """The clauses of a judgment without markers and hedges, of three or more words; the whole where none is left.

    Clauses end at full stops and semicolons before white space, at commas and at words that join clauses."""
    body = F.trim(F.regexp_replace(text_or_empty(judgment), r"\s*\[[^\]]*\]", ""))
    borders = [r"[.;]\s+", rf",?\s+{any_of(*R.CLAUSE_WORDS)}\s+", r",\s+"]

    def bare(clause: Column) -> Column:
        clause = F.regexp_replace(F.trim(clause), rf"(?i)^(?:{'|'.join(_hedges())})\s+", "")
        clause = F.regexp_replace(clause, rf"(?i)^{any_of(*R.HEDGE_ADVERBS)}\s+", "")
        return F.regexp_replace(clause, "^[ ,.]+|[ ,.]+$", "")

    clauses = F.transform(F.split(body, "(?i)" + "|".join(borders)), bare)
    whole = F.filter(clauses, lambda p: F.size(F.filter(F.split(p, r"\s+"), lambda w: w != "")) >= 3)
    return F.when(F.size(whole) > 0, whole).when(body != "", F.array(body)).otherwise(F.array().cast("array<string>"))


def gap_queries(gaps: Column, most: int = 4) -> Column:
    """Capitalised spans of two or more words, each once, in order."""
    return F.slice(F.array_distinct(F.regexp_extract_all(text_or_empty(gaps), F.lit(r"(?U)\b([A-Z][\w'-]+(?:\s+[A-Z][\w'-]+)+)\b"), F.lit(1))), 1, most)


def _expansion(token: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in R.SHORT_NAMES.items() for x in pair])[F.lower(token)]


def keyword_query(query: Column) -> Column:
    """A query in which short names are written out and other words under three characters are gone; itself if none is left."""
    bare = lambda t: F.regexp_replace(t, r"^[,.;:!?()]+|[,.;:!?()]+$", "")
    kept = F.transform(F.split(F.trim(query), r"\s+"), lambda t: F.coalesce(_expansion(bare(t)), F.when(F.length(bare(t)) >= 3, t), F.lit("")))
    joined = F.array_join(F.filter(kept, lambda t: t != ""), " ")
    return F.when(joined != "", joined).otherwise(query)


def proper_noun_query(query: Column) -> Column:
    """The query's capitalised words only; null if there is none or keyword_query() is the same."""
    nouns = F.array_distinct(F.regexp_extract_all(query, F.lit(r"(?U)\b([A-Z][\w.'-]*)\b"), F.lit(1)))
    kept = F.transform(nouns, lambda t: F.coalesce(_expansion(t), F.when(F.length(t) >= 3, F.when(t == F.upper(t), F.initcap(t)).otherwise(t)), F.lit("")))
    joined = F.array_join(F.filter(kept, lambda t: t != ""), " ")
    return F.when((joined != "") & (joined != keyword_query(query)), joined)


def is_meta(query: Column) -> Column:
    """Whether a question is nothing but small talk."""
    return F.lower(F.regexp_replace(text_or_empty(query), r"^\s+|\s*[?!.]*\s*$", "")).isin(*R.META)


def asks_all_sources(query: Column) -> Column:
    return text_or_empty(query).rlike(rf"(?i)\b(?:{'|'.join(re.escape(p) for p in R.ALL_SOURCE)})\b")


def asks_attribution(query: Column) -> Column:
    """Whether a question asks who or what is behind something, or why it came about."""
    being = "(?:is|was|are|were)"
    asked = [
        rf"who\s+(?:{being})?\s*(?:really\s+)?{any_of(*R.WHO_IS)}\b", rf"who\s+{any_of(*R.WHO_DID)}\b", rf"{being}\s+.{{0,60}}\b{any_of(*R.WAS_DONE)}\b", rf"why\s+{any_of(*R.WHY)}\b",
        rf"{any_of(*R.BLAME_WORDS)}\b", any_of(*R.BLAME_STEMS),
    ]
    return text_or_empty(query).rlike(rf"(?i)\b(?:{'|'.join(asked)})")
