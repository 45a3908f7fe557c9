"""Connected components by labels that spread along links, on joins and partial aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import written


def components(links: DataFrame) -> DataFrame:
    """(node, root) for each end of a link (a, b): root is the smallest node that links reach.

    Each round takes the smallest label among the neighbours and then the label of that label, so the rounds grow
    with the logarithm of the longest chain. A round's labels are written to the shared folder. Nothing is
    gathered: a node with very many links is a row for each link, summed up before the shuffle.
    """
    links = written(links)
    ends = written(links.select("a", "b").union(links.select("b", "a")).where("a != b"))
    labels = written(ends.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("root")))
    while True:
        near = ends.join(labels.select(F.col("node").alias("b"), "root"), "b").select(F.col("a").alias("node"), "root")
        spread = written(near.union(labels.select("node", "root")).groupBy("node").agg(F.min("root").alias("root")))
        further = spread.select(F.col("node").alias("at"), F.col("root").alias("further"))
        jumped = spread.join(further, F.col("root") == F.col("at"), "left").select("node", F.least("root", F.coalesce("further", "root")).alias("root"))
        now = written(jumped)
        before = labels.withColumnRenamed("root", "before")
        done = now.join(before, "node").where("root != before").isEmpty()
        labels = now
        if done:
            return labels
