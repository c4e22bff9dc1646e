"""Graph operators on edge tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.operators.joins import by_shuffle


def connected_components(edges: DataFrame, cut: Callable[[DataFrame, str], DataFrame], a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node of an undirected edge table; component is its least node.

    Minimum labels spread over edges and then jump along labels, so the rounds
    grow with the logarithm of a component's diameter in the usual case.  ``cut``
    stores a round's small result in shared storage and reads it back.
    """
    both = edges.select(F.col(a).alias("node"), F.col(b).alias("other"))
    both = cut(both.unionAll(edges.select(F.col(b).alias("node"), F.col(a).alias("other"))).distinct(), "edges")
    labels = cut(both.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("component")), "labels")
    while True:
        heard = both.join(by_shuffle(labels.select(F.col("node").alias("other"), F.col("component").alias("heard"))), "other")
        heard = heard.groupBy("node").agg(F.min("heard").alias("heard"))
        lowered = labels.join(by_shuffle(heard), "node").select("node", F.col("component").alias("old"), F.least("component", "heard").alias("component"))
        lowered = cut(lowered, "labels")
        if lowered.where("component <> old").isEmpty():
            return lowered.select("node", "component")
        jump = lowered.select(F.col("node").alias("component"), F.col("component").alias("next"))
        labels = cut(lowered.join(by_shuffle(jump), "component").select("node", F.col("next").alias("component")), "labels")
