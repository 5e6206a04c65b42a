"""Connected components of an edge table, by least labels and pointer jumping; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundsearch.llm.common import materialise


def components(edges: DataFrame) -> DataFrame:
    """node, label (the least node of its component) for each node of edges (a long, b long); loops and repeats do no harm.

    A round reads only the edges of nodes whose label fell in the one before.
    """
    both = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).union(edges.select("b", "a")).distinct()
    both = materialise(both, "edges")
    labels = both.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("label"))
    labels = materialise(labels.withColumn("moved", F.col("label") < F.col("node")), "labels")
    while True:
        fallen = labels.filter("moved").select(F.col("node").alias("other"), "label")
        near = both.join(fallen, "other").groupBy("node").agg(F.min("label").alias("near"))
        lower = labels.join(near, "node", "left").select("node", "label", F.least("label", "near").alias("low"))
        jump = labels.select(F.col("node").alias("low"), F.col("label").alias("far"))
        low = F.least("low", "far")
        labels = materialise(lower.join(jump, "low").select("node", low.alias("label"), (low < F.col("label")).alias("moved")), "labels")
        if not labels.agg(F.max("moved")).first()[0]:
            return labels.select("node", "label")
