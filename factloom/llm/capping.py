"""At most so many records per contributor, the best by quality kept (problem 5).

Radix selection: quality rank and identifier form one order-preserving byte key. For every contributor over its limit
the cutoff key is fixed digit by digit: count rows per (contributor, digit) among the rows that still share the
cutoff's prefix, pick the digit in which the limit falls, go on inside it. Counting combines before it shuffles and no
contributor's rows are ever sorted or gathered, so one that holds most rows costs as much per row as any other.
"""

from __future__ import annotations

import os

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from factloom.durable import cut

#: Bytes fixed in one pass: at most 65,536 counters per contributor.
DIGIT = 2
WORST = 6


@F.pandas_udf(T.BinaryType())
def _common_prefix(low: pd.Series, high: pd.Series) -> pd.Series:
    return pd.Series([os.path.commonprefix([bytes(a), bytes(b)]) for a, b in zip(low, high, strict=True)])


def ranked_key(rank: str, ident: str) -> F.Column:
    """One byte of rank, then the identifier's UTF-8 bytes: compares as (rank, identifier) does."""
    return F.concat(F.unhex(F.lpad(F.hex(F.col(rank).cast("int")), 2, "0")), F.encode(F.col(ident).cast("string"), "utf-8"))


def cutoffs(rows: DataFrame, limit: int) -> DataFrame:
    """(g, prefix): of each contributor in `rows` (g, key; keys distinct, more than `limit` of each g), the shortest prefix
    such that exactly the keys up to and including it are the `limit` smallest."""
    state = cut(rows.select("g").distinct().select("g", F.lit(b"").alias("prefix"), F.lit(limit).cast("long").alias("left"), F.lit(False).alias("done")), "cap-state")
    first = True
    while not (open_ := state.where("not done")).isEmpty():
        live = rows.join(open_.select("g", "prefix", "left"), "g").where("substring(key, 1, length(prefix)) = prefix")
        if not first:  # skip what all remaining keys share
            shared = live.groupBy("g").agg(F.min("key").alias("_low"), F.max("key").alias("_high"), F.first("left").alias("left"))
            open_ = cut(shared.select("g", _common_prefix("_low", "_high").alias("prefix"), "left"), "cap-shared")
            live = rows.join(open_, "g").where("substring(key, 1, length(prefix)) = prefix")
        width = 1 if first else DIGIT
        digits = live.groupBy("g", "prefix", "left", F.expr(f"substring(key, length(prefix) + 1, {width})").alias("digit")).agg(F.count("*").alias("n"))
        ordered = digits.withColumn("before", F.sum("n").over(Window.partitionBy("g").orderBy("digit").rowsBetween(Window.unboundedPreceding, -1))).na.fill({"before": 0})
        hit = ordered.where("before < left and before + n >= left")
        step = hit.select("g", F.concat("prefix", "digit").alias("prefix"), (F.col("left") - F.col("before")).alias("left"), (F.col("before") + F.col("n") == F.col("left")).alias("done"))
        state = cut(state.where("done").unionByName(step), "cap-state")
        first = False
    return state.select("g", "prefix")


def over_cap(df: DataFrame, group: F.Column, ident: str, quality: F.Column, share: float | None = None, most: int | None = None) -> DataFrame:
    """(group_key, ident) of the records that go when each group keeps `most` records, or floor(share x distinct ident).

    `quality`: 1 is best; null and values outside 1-6 rank as 6. Ties go by ident, ascending. Repeated rows of an ident
    count once; if they disagree, the best quality holds. Rows without group key or ident are in no group and stay. A
    limit of 0 cuts everything that is in a group; an empty table gives an empty result."""
    rank = F.when(quality.between(1, WORST), quality).otherwise(WORST)
    rows = df.select(group.alias("g"), F.col(ident).alias("id"), rank.alias("rank"))
    one = rows.where("id is not null").groupBy("id", "g").agg(F.min("rank").alias("rank"))
    one = cut(one, "cap-rows")
    limit = most if most is not None else int(share * one.select("id").distinct().count() + 1e-9)
    grouped = one.where("g is not null")
    if limit <= 0:
        return grouped.select(F.col("g").alias("group_key"), F.col("id").alias(ident))
    large = grouped.groupBy("g").agg(F.count("*").alias("n")).where(F.col("n") > limit).select("g")
    keyed = cut(grouped.join(large, "g").select("g", "id", ranked_key("rank", "id").alias("key")), "cap-keys")
    gone = keyed.join(cutoffs(keyed, limit), "g").where("substring(key, 1, length(prefix)) > prefix")
    return gone.select(F.col("g").alias("group_key"), F.col("id").alias(ident))
