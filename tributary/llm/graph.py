"""Connected components of a table of links, in rounds of written tables."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.llm.shared import Scratch


def components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, component) for each node of ``links`` (a, b); the component is its smallest node.

    Each round every node takes the smallest label around it and then that label's
    label, so labels travel twice as far each round. Labels are aggregated before
    their shuffle, so a node with very many links is no hot key. Nothing but the
    number of changed labels reaches the driver.
    """
    both = links.select("a", "b").where(F.col("a") != F.col("b"))
    both = scratch.save(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{name}-links")
    labels = scratch.save(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")), f"{name}-0")
    for k in count(1):  # ends: labels only become smaller
        around = both.join(labels, F.col("b") == F.col("node")).groupBy(F.col("a").alias("at")).agg(F.min("component").alias("near"))
        stepped = labels.join(around, F.col("node") == F.col("at"), "left").select("node", "component", F.least("component", "near").alias("step"))
        ahead = labels.select(F.col("node").alias("to"), F.col("component").alias("jump"))
        moved = stepped.join(ahead, F.col("step") == F.col("to"), "left").select(
            "node", F.least("step", "jump").alias("component"), (F.least("step", "jump") < F.col("component")).alias("changed")
        )
        written = scratch.save(moved, f"{name}-{k}")
        scratch.drop(f"{name}-{k - 1}")
        labels = written.select("node", "component")
        if written.where("changed").isEmpty():
            break
    return labels
