"""Connected components of a graph of links, by hooking to the smallest neighbour and contraction.

Every step is a join or an aggregate with partial sums in each task, so a node with any number of
links is no large group, and nothing is collected to the driver but counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.llm.common import discard, stored


def components(edges: DataFrame) -> DataFrame:
    """edges: a, b (long, not null). Returns node, root: each linked node's component, named by its smallest node."""
    links = edges.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    links = stored(links, "links")
    label = None
    while not links.isEmpty():
        # a node hooks to its smallest neighbour if that is smaller; chains are shortened to their roots
        parent = stored(links.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root")), "parent")
        while True:
            up = parent.select(F.col("node").alias("root"), F.col("root").alias("further"))
            jumped = stored(parent.join(up, "root", "left").select("node", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "parent")
            discard(parent)
            parent = jumped
            if jumped.where("moved").isEmpty():
                break
        names = parent.select(F.col("node").alias("old"), F.col("root").alias("new"))
        ends = links.join(names.withColumnsRenamed({"old": "a", "new": "na"}), "a", "left").join(names.withColumnsRenamed({"old": "b", "new": "nb"}), "b", "left")
        ends = ends.select(F.coalesce("na", "a").alias("x"), F.coalesce("nb", "b").alias("y")).where("x != y")
        left = stored(ends.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "links")
        own = parent.select("node", "root")
        if label is not None:
            moved = label.join(names.withColumnsRenamed({"old": "root"}), "root", "left").select("node", F.coalesce("new", "root").alias("root"))
            own = moved.unionByName(own.join(label, "node", "left_anti"))
        renamed = stored(own, "label")
        discard(links, parent, *([] if label is None else [label]))
        links, label = left, renamed
    if label is None:
        return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return label.unionByName(label.select(F.col("root").alias("node"), "root").distinct())
