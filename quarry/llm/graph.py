"""Connected components of an undirected graph held as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.store import stored


def components(edges: DataFrame) -> DataFrame:
    """Label every node of `edges` (a, b) with the smallest node it is connected to.

    Returns (node, label). Each round lets every node take the smallest label
    among itself and its neighbours and then the label of that label, so chains
    shorten by half or better. Minima are combined before the shuffle; node
    labels and edges are read from written tables, so a node with very many
    edges is a skewed join that adaptive execution may split. No links or
    labels reach the driver, only the count of changed labels.
    """
    both = stored(edges.filter("a != b").select(F.inline(F.array(
        F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))).distinct(), "edges")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
                    .select("node", F.least("node", "m").alias("label")), "labels")
    while True:
        # the node's own row tells the label it had
        near = (both.join(labels.select(F.col("node").alias("b"), "label"), "b")
                .select(F.col("a").alias("node"), "label", F.lit(None).cast(labels.schema["label"].dataType).alias("had"))
                .unionByName(labels.select("node", "label", F.col("label").alias("had")))
                .groupBy("node").agg(F.min("label").alias("via"), F.max("had").alias("had")))
        near = stored(near, "labels")
        # a label is a node: take the label it has got itself
        jump = near.join(near.select(F.col("node").alias("via"), F.col("via").alias("far")), "via")
        now = stored(jump.select("node", F.least("via", "far").alias("label"), "had"), "labels")
        if not now.filter("label != had").agg(F.count(F.lit(1))).first()[0]:
            return now.select("node", "label")
        labels = now.select("node", "label")
