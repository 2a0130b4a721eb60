"""Connected components of an edge table, as Spark joins.

Every node takes the smallest label among itself and its neighbours, then the
label of its label (pointer jumping), until nothing changes; the number of
rounds grows with the logarithm of the longest path.  Labels are written to the
shared folder each round; only the number of changed labels reaches the
driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.llm.common import stored


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """``edges`` (a long, b long, not null) -> (node, label): the smallest node of its component."""
    both = stored(
        spark,
        edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(),
        "edges",
    )
    labels = stored(spark, both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")), "labels")
    while True:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("label").alias("m"))
        step = labels.join(near, labels.node == near.a).select("node", F.col("label").alias("old"), F.least("label", "m").alias("label"))
        # Jump: a label is itself a node, so take that node's label.
        roots = labels.select(F.col("node").alias("r"), F.col("label").alias("rl"))
        new = stored(
            spark,
            step.join(roots, step.label == roots.r, "left").select(
                "node", "old", F.least("label", F.coalesce("rl", "label")).alias("label")
            ),
            "labels",
        )
        changed = new.where("label <> old").limit(1).count()
        labels = new.select("node", "label")
        if not changed:
            return labels
