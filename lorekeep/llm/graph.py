"""Connected components of an edge table, by contraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import durable

#: Parents that are broadcast at most; beyond that they are joined, and Spark splits the keys of hubs.
BROADCAST_IDS = 500_000


def _edges(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def components(edges: DataFrame) -> DataFrame:
    """(id, comp) for every end of an edge (a, b): comp is the least id reachable.

    In each round every node with a lesser neighbour joins the least one, and edges between joined nodes go. At least
    half of the nodes that still have edges go with them, so the rounds grow with the logarithm of the nodes and each has
    far fewer edges than the one before.
    """
    left = durable(edges.select(*_edges(F.col("a"), F.col("b"))).where("a <> b").distinct(), "components-edges")
    label = left.select(F.explode(F.array("a", "b")).alias("id")).distinct().withColumn("comp", F.col("id"))
    step = 0
    while not left.isEmpty():
        step += 1
        up = durable(left.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("p")), f"components-up{step}")
        side = F.broadcast if up.count() <= BROADCAST_IDS else (lambda df: df)
        for _ in range(2):  # a node's parent may have joined another one itself
            top = up.select(F.col("id").alias("p"), F.col("p").alias("q"))
            up = durable(up.join(side(top), "p", "left").select("id", F.coalesce("q", "p").alias("p")), f"components-up{step}")
        one = left.join(side(up.select(F.col("id").alias("a"), F.col("p").alias("pa"))), "a", "left").select(F.coalesce("pa", "a").alias("a"), "b")
        two = one.join(side(up.select(F.col("id").alias("b"), F.col("p").alias("pb"))), "b", "left").select("a", F.coalesce("pb", "b").alias("b"))
        left = durable(two.select(*_edges(F.col("a"), F.col("b"))).where("a <> b").distinct(), f"components-edges{step}")
        label = durable(label.join(side(up.select(F.col("id").alias("comp"), "p")), "comp", "left").select("id", F.coalesce("p", "comp").alias("comp")), f"components-{step}")
    return label
