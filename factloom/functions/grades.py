"""Admiralty grades, confidence and numeric coercions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom import registries as R


def lookup(values: dict, key: Column, default: object) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for pair in values.items() for x in pair])[key], F.lit(default))


def grade(reliability: Column) -> Column:
    """Upper case, F where empty."""
    return F.coalesce(F.upper(F.when(reliability != "", reliability)), F.lit("F"))


def credibility_of(sources: Column) -> Column:
    """Credibility from the number of distinct sources that report the same."""
    return F.when(sources >= 4, 1).when(sources == 3, 2).when(sources == 2, 3).when(sources == 1, 4).otherwise(6)


def rating(reliability: Column, credibility: Column) -> Column:
    """The two-character code, F6 where nothing is known."""
    return F.concat(grade(reliability), F.coalesce(F.when(credibility != 0, credibility), F.lit(6)).cast("string"))


def reliability_label(reliability: Column) -> Column:
    return lookup(R.RELIABILITY_LABELS, F.upper(F.coalesce(reliability, F.lit("F"))), R.RELIABILITY_LABELS["F"])


def credibility_label(credibility: Column) -> Column:
    return lookup(R.CREDIBILITY_LABELS, F.coalesce(F.when(credibility != 0, credibility), F.lit(6)), R.CREDIBILITY_LABELS[6])


def as_credibility(value: Column) -> Column:
    """A text or number as a grade from 1 to 6: whole-number text and truncated numbers, else null."""
    text = F.trim(value.cast("string"))
    number = F.when(text.rlike(r"^[+-]?\d{1,9}$"), text.try_cast("int"))
    return F.when(number.between(1, 6), number)


def as_reliability(value: Column) -> Column:
    letter = F.upper(F.trim(F.coalesce(value.cast("string"), F.lit(""))))
    return F.when(letter.isin(*"ABCDEF"), letter).otherwise("F")


def as_int(value: Column, default: int = 0) -> Column:
    return F.coalesce(F.when(F.trim(value).rlike(r"^[+-]?\d{1,9}$"), F.trim(value).try_cast("int")), F.lit(default))


def as_float(value: Column) -> Column:
    return F.trim(value).try_cast("double")


def low_tier(reliability: Column) -> Column:
    return F.upper(F.coalesce(reliability, F.lit("F"))).isin("D", "E", "F")


def crosses_tiers(reliability: Column) -> Column:
    """Aggregate: whether grades A-C and D-F both occur (first letter, F where empty)."""
    first = F.substring(grade(F.trim(reliability)), 1, 1)
    return F.coalesce(F.bool_or(first.isin("A", "B", "C")) & F.bool_or(~first.isin("A", "B", "C")), F.lit(False))


def exceeds(confidence: Column, cap: Column) -> Column:
    """Whether a stated confidence is above a cap; not where either is missing."""
    above = lookup(R.CONFIDENCE_RANK, confidence, 0) > lookup(R.CONFIDENCE_RANK, cap, 2)
    return F.coalesce(confidence.isNotNull() & cap.isNotNull() & above, F.lit(False))
