"""Connected components of a table of edges, by least labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from patronage.llm.common import stage


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for edges (a, b): the least node of each node's component.

    Each round takes the least label of a node's neighbours and then the label of that
    label, so chains halve.  The driver sees one count a round.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = stage(both.where("a <> b").distinct(), "edges")
    labels = stage(
        both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")),
        "labels",
    )
    while True:
        heard = (
            both.join(labels, F.col("b") == F.col("node"))
            .groupBy("a")
            .agg(F.min("label").alias("heard"))
        )
        hooked = labels.join(heard, F.col("node") == F.col("a")).select(
            "node", F.col("label").alias("old"), F.least("label", "heard").alias("label")
        )
        hooked = stage(hooked, "hooked")
        onward = hooked.select(F.col("node").alias("at"), F.col("label").alias("next"))
        jumped = hooked.join(onward, F.col("label") == F.col("at"), "left").select(
            "node", "old", F.least("label", "next").alias("label")
        )
        jumped = stage(jumped, "labels")
        labels = jumped.drop("old")
        if jumped.where("old <> label").isEmpty():
            return labels
