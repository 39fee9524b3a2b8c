"""Stretches, sliding counts and ranks in which no key's rows have to meet in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factloom.durable import cut


def stretches(rows: DataFrame, keys: list[str], at: str, width: float, out: str = "stretch") -> DataFrame:
    """`rows` with the number of the stretch they are in: a key's rows are cut wherever the next is more than `width` later.

    Two rows of one interval of that width are never cut apart, so only the intervals' first and last times have to be put
    in order, not the rows. Rows without time have no place here; filter them first."""
    held = rows.withColumn("_interval", F.floor(F.col(at) / width).cast("bigint"))
    ends = held.groupBy(*keys, "_interval").agg(F.min(at).alias("_first"), F.max(at).alias("_last"))
    order = Window.partitionBy(*keys).orderBy("_interval") if keys else Window.orderBy("_interval")
    later = F.coalesce((F.col("_first") - F.lag("_last").over(order) > width).cast("int"), F.lit(0))
    numbered = ends.withColumn("_new", later).select(*keys, "_interval", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias(out))
    return held.join(numbered, [*keys, "_interval"]).drop("_interval")


def sliding_counts(rows: DataFrame, key: str, at: str, width: int) -> DataFrame:
    """(key, at, n) of every row: how many rows of its key lie in the closed span of `width` that ends at it.

    Every row also visits the next interval of that width, where it is counted but not reported, so windows run over
    (key, interval)."""
    home = F.floor(F.col(at) / width).cast("bigint")
    visits = rows.where(F.col(at).isNotNull()).select(key, at, F.explode(F.array(F.struct(home.alias("i"), F.lit(True).alias("home")), F.struct((home + 1).alias("i"), F.lit(False).alias("home")))).alias("_v"))
    span = Window.partitionBy(key, "_v.i").orderBy(at).rangeBetween(-width, Window.currentRow)
    return visits.withColumn("n", F.count("*").over(span)).where("_v.home").select(key, at, "n")


def row_numbers(rows: DataFrame, by: str, order: str, out: str) -> DataFrame:
    """`rows` with their number, from 1, in the order of a column inside `by`; ties in any order.

    Rows are dealt to ranges of (by, order); each range is numbered on its own and lifted by what comes before it."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(rows.repartitionByRange(parts, by, order).withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = ranged.groupBy(by, "_range").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    lifted = sizes.select(F.col(by).alias("_by"), "_range", before.alias("_before"))
    here: Column = F.row_number().over(Window.partitionBy(by, "_range").orderBy(order))
    numbered = ranged.withColumn("_here", here).join(lifted.withColumnRenamed("_range", "_r"), F.col(by).eqNullSafe(F.col("_by")) & (F.col("_range") == F.col("_r")))
    return numbered.withColumn(out, F.col("_here") + F.col("_before")).drop("_here", "_before", "_by", "_r", "_range")


def competition_ranks(rows: DataFrame, by: str, score: str, out: str) -> DataFrame:
    """`rows` with the rank of their score inside `by`, highest first; equal scores share the smallest rank.

    Equal scores are counted before they are put in order, and the order is made in ranges of (by, score) that are lifted
    by what comes before them, so neither many rows of one `by` nor many of one score meet in a task. Null scores come
    last."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = rows.groupBy(F.col(by).alias("_by"), F.col(score).alias("_score")).agg(F.count("*").alias("_n"))
    ranged = cut(counts.repartitionByRange(parts, F.col("_by"), F.desc_nulls_last("_score")).withColumn("_range", F.spark_partition_id()), "scores")
    totals = ranged.groupBy("_by", "_range").agg(F.sum("_n").alias("_all"))
    before = F.coalesce(F.sum("_all").over(Window.partitionBy("_by").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    lifted = totals.select(F.col("_by").alias("_b"), F.col("_range").alias("_r"), before.alias("_before"))
    inside = F.coalesce(F.sum("_n").over(Window.partitionBy("_by", "_range").orderBy(F.desc_nulls_last("_score")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranks = ranged.withColumn("_inside", inside).join(lifted, F.col("_by").eqNullSafe(F.col("_b")) & (F.col("_range") == F.col("_r")))
    ranks = ranks.select("_by", "_score", (F.col("_inside") + F.col("_before") + 1).alias(out))
    return rows.join(ranks, F.col(by).eqNullSafe(F.col("_by")) & F.col(score).eqNullSafe(F.col("_score"))).drop("_by", "_score")
