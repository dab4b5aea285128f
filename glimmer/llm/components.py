"""Connected components by repeated minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .workspace import Workspace


def node(least: Column, key: Column) -> Column:
    """A node that orders by ``least``, null last, then by ``key``: a component's label then holds its smallest id."""
    return F.struct(least.isNull().alias("no_id"), least.alias("least"), key.alias("of"))


def connected_components(ws: Workspace, edges: DataFrame, tag: str = "cc") -> DataFrame:
    """``edges`` (a, b) -> (node, component): the smallest node that each node reaches.

    Nodes may be of any type that Spark orders; edges with a null end and loops are
    ignored, and only nodes with an edge come back.  Each round takes the smallest
    label among a node's neighbours and then the label of that label, so that the
    number of rounds grows with the logarithm of the longest path.  Labels are written
    each round: no group of neighbours is ever collected, and a hot node is only a
    skewed join key, which Spark splits.
    """
    ends = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
    both = ws.keep(edges.select("a", "b").where("a <> b").select(ends.alias("e")).select("e.a", "e.b").distinct(), f"{tag}-edges")
    labels = ws.keep(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("component")), f"{tag}-labels-0")
    turn = 0
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        spread = labels.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        spread = ws.keep(spread, f"{tag}-spread-{turn}")
        if not spread.where("component <> old").limit(1).count():
            ws.drop(f"{tag}-spread-{turn}", f"{tag}-edges")
            return labels
        root = spread.select(F.col("node").alias("component"), F.col("component").alias("root"))
        after = ws.keep(spread.join(root, "component").select("node", F.col("root").alias("component")), f"{tag}-labels-{turn + 1}")
        ws.drop(f"{tag}-spread-{turn}", f"{tag}-labels-{turn}")
        labels = after
        turn += 1
