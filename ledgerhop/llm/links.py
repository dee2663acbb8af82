"""Classes of linked rows: the least label that any chain of links reaches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerhop.staging import stage, stage_counted


def classes(links: DataFrame) -> DataFrame:
    """(node, root) of every node of ``links(a, b)``; root is the least node of its component.

    Each round every node takes the least node among its neighbours and itself, and the links are
    redrawn between what their ends took; links within one go. A star is done in a round, a chain
    halves at least. Rounds are written tables; rows combine before each shuffle, so hubs do no harm.
    """
    edges = links.filter("a != b")
    labels = None
    while True:
        ends = edges.select("a", "b").union(edges.select("b", "a"))
        took = stage(ends.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("to")), "took")
        if labels is None:
            labels = took.withColumnRenamed("to", "root")
        else:
            labels = labels.join(took, labels.root == took.node, "left").select(
                labels.node, F.coalesce("to", "root").alias("root")
            )
        a, b = took.toDF("a", "to_a"), took.toDF("b", "to_b")
        edges, left = stage_counted(
            edges.join(a, "a").join(b, "b").select(F.col("to_a").alias("a"), F.col("to_b").alias("b")).filter("a != b").distinct(),
            "links",
        )
        if not left:
            return labels
