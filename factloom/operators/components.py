"""Connected components of an edge table, without gathering links or components anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.durable import cut


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node that `edges` names; the component is its smallest node.

    Rounds of smallest-neighbour labels with pointer jumping, each cut to a written table: the number of rounds grows
    with the logarithm of the longest chain. Loops, repeated and reversed edges change nothing; edges with a null end are
    left out; an empty table gives an empty result."""
    both = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null")
    both = cut(both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "cc-edges")
    labels = cut(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("label")).select(F.col("u").alias("node"), "label"), "cc-labels")
    while True:
        near = both.join(labels.withColumnsRenamed({"node": "v", "label": "near"}), "v").groupBy(F.col("u").alias("node")).agg(F.min("near").alias("near"))
        lower = labels.join(near, "node").select("node", "label", F.least("label", "near").alias("to"))
        jump = labels.select(F.col("node").alias("to"), F.col("label").alias("far"))
        moved = cut(lower.join(jump, "to").select("node", F.least("to", "far").alias("new"), "label"), "cc-labels")
        labels = moved.select("node", F.col("new").alias("label"))
        if moved.where("new <> label").isEmpty():
            return labels.select("node", F.col("label").alias("component"))
