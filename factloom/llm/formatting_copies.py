"""Records that are equal but for formatting, collapsed with the number of their copies (problem 6).

Progressive refinement: classes by cheap invariants (source, stripped length, counts of a few letters), then
by the whole letter histogram, then by the exact key, each only for rows whose class has several members so far. Classes
are counted with map-side combine and joined back; no class is ever gathered, so a group of copies may hold any part of
all rows.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.durable import cut

_SEPARATOR = re.compile(r"(?<=\s)(?:\||::|•|–|—|-)(?=\s)")
_LETTERS = "aeinorst"
_ASCII = r"^[\x00-\x7F]*$"


def letters(text: str) -> str:
    """The letters and digits of `text`, composed and without case."""
    folded = unicodedata.normalize("NFC", unicodedata.normalize("NFC", text).casefold())
    return "".join(c for c in folded if c.isalnum())


@F.pandas_udf(T.StringType())
def _letters_of(text: pd.Series) -> pd.Series:
    return text.map(lambda t: letters(t) if isinstance(t, str) else None)


def skeleton(text: Column) -> Column:
    """letters() of a text: in JVM expressions where it is ASCII, which most texts are, in Python batches for the others
    only. Equal exact keys have equal letters, so every invariant that is made of them holds inside a class of copies."""
    plain = text.rlike(_ASCII)
    return F.when(plain, F.lower(F.regexp_replace(text, "[^A-Za-z0-9]+", ""))).otherwise(_letters_of(F.when(~plain, text)))


def exact_key(source: str, title: str) -> str:
    """Equal for two records exactly if they are equal but for formatting and the order of title fields."""
    return letters(source) + "\x1f" + "".join(sorted(filter(None, map(letters, _SEPARATOR.split(title)))))


@F.pandas_udf(T.StringType())
def _exact(source: pd.Series, title: pd.Series) -> pd.Series:
    return pd.Series([exact_key(s, t) for s, t in zip(source, title, strict=True)])


def _several(rows: DataFrame, *by: str) -> DataFrame:
    """The rows of classes that have several members."""
    classes = rows.groupBy(*by).agg(F.count("*").alias("_n")).where("_n > 1").drop("_n")
    return rows.join(classes, list(by), "left_semi")


def copy_groups(items: DataFrame, ident: str = "item_id", source: str = "source", title: str = "title") -> DataFrame:
    """(keep, copy): of each group of two or more equal records, the smallest identifier with each other one.

    Repeated rows of one identifier count once. A record without identifier, source or title is equal to none; titles
    of punctuation only are equal if their sources are."""
    rows = items.select(F.col(ident).alias("id"), F.col(source).alias("s"), F.col(title).alias("t")).where("id is not null and s is not null and t is not null")
    bare = rows.withColumns({"_k": skeleton(F.col("t")), "_o": skeleton(F.col("s"))})
    counts = [F.length("_k") - F.length(F.replace(F.col("_k"), F.lit(c), F.lit(""))) for c in _LETTERS]
    # written once: its classes are counted, then its rows are met with them
    cheap = cut(bare.select("id", "s", "t", F.xxhash64("_o", F.length("_k"), *counts).alias("h1")), "copy-classes")
    first = _several(cheap, "h1").withColumn("_k", skeleton(F.col("t")))
    spelled = cut(first.select("id", "s", "t", F.xxhash64("h1", F.array_join(F.array_sort(F.split("_k", "")), "")).alias("h2")), "copy-letters")
    second = _several(spelled, "h2")
    keyed = second.select("id", _exact("s", "t").alias("key")).distinct()
    keeps = keyed.groupBy("key").agg(F.min("id").alias("keep"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    return keyed.join(keeps, "key").where("id <> keep").select("keep", F.col("id").alias("copy"))
