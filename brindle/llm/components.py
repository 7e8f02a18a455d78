"""Connected components of a link table, in rounds of DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import Scratch


def connected_components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, comp) of every node in links (a, b); comp is the component's smallest node.

    Each round takes the smallest label among a node and its neighbours, then the label's own label, and points labels
    at each other as well, so that the number of rounds grows with the logarithm of a component's diameter. Each round
    is a written table. Nodes without links don't appear. An empty table gives an empty one.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = scratch.write(both.filter("a != b").distinct(), "edges")
    labels = scratch.write(edges.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("comp")).withColumnRenamed("a", "node"), "labels")
    while True:
        of = lambda name: labels.select(F.col("node").alias(name), F.col("comp").alias(f"{name}_comp"))
        seen = edges.join(of("b"), "b").groupBy("a").agg(F.min("b_comp").alias("near"))
        step = labels.join(seen, F.col("node") == F.col("a")).select("node", "comp", F.least("comp", "near").alias("new"))
        # A label that learns of a smaller one passes it on to the node that gives it its name.
        hooks = step.filter("new < comp").select(F.col("comp").alias("node"), "new")
        step = step.select("node", "new").unionByName(hooks).groupBy("node").agg(F.min("new").alias("new"))
        jumped = step.join(of("new"), "new", "left").select("node", F.least("new", F.coalesce("new_comp", "new")).alias("comp"))
        after = scratch.write(jumped, "labels")
        changed = after.join(labels.withColumnRenamed("comp", "old"), "node").filter("comp != old").limit(1).count()
        scratch.drop(labels)
        labels = after
        if not changed:
            scratch.drop(edges)
            return labels
