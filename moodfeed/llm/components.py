"""Connected components of a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moodfeed.staging import stage


def connect(edges: DataFrame) -> DataFrame:
    """Component of each node of ``edges`` (a, b): node, component (its smallest node).

    In each round every node points to the smallest of its neighbours and itself, the nodes are
    replaced by what they point to, and equal edges and loops are dropped. A component shrinks to its
    smallest node by half at least. Rounds are staged; only the number of edges reaches the driver.
    """
    edges = stage(
        edges.where("a != b").select(
            F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
        ).distinct(),
        "edges",
    )
    labels = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        points = stage(
            both.groupBy("a").agg(F.min("b").alias("b")).select(
                F.col("a").alias("node"), F.least("a", "b").alias("to")
            ),
            "points",
        )
        if labels is None:
            labels = points.select("node", F.col("to").alias("component"))
        else:
            labels = stage(
                labels.join(points, labels.component == points.node.alias("_"), "left").select(
                    labels.node, F.coalesce("to", "component").alias("component")
                ),
                "labels",
            )
        ends = points.select(F.col("node").alias("b"), F.col("to").alias("y"))
        moved = edges.join(points.withColumnRenamed("node", "a"), "a").join(ends, "b")
        edges = stage(
            moved.where("to != y")
            .select(F.greatest("to", "y").alias("a"), F.least("to", "y").alias("b"))
            .distinct(),
            "edges",
        )
        if edges.isEmpty():
            return labels
