"""Connected components of a link table, as DataFrame steps over shared storage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.llm.support import stored, stored_with


def roots(parents: DataFrame, node: str = "a", parent: str = "b") -> DataFrame:
    """(node, label) of every node of a forest in which each node has one parent, smaller than itself.

    Parents are replaced by their parents until none changes, which halves all
    paths each time. Roots label themselves.
    """
    up = parents.select(F.col(node).alias("node"), F.col(parent).alias("label"))
    while True:
        jump = up.select(F.col("node").alias("label"), F.col("label").alias("l"))
        up, seen = stored_with(up.join(jump, "label", "left").select("node", F.coalesce("l", "label").alias("label"), F.col("l").isNotNull().alias("moved")), "roots", moved=F.count_if("moved"))
        if not seen["moved"]:
            tops = up.select(F.col("label").alias("node"), "label").distinct()
            return up.select("node", "label").unionByName(tops)
        up = up.select("node", "label")


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label) of each node of ``links``; the label is the smallest node it is connected to.

    Each round takes the smallest label among neighbours and then the label's
    label, so paths shrink by half or better. A hub's neighbours are reduced
    within tasks before they are shuffled. Loops and repeated links do no harm;
    an empty table gives an empty result.
    """
    ends = links.select(F.col(a).alias("node"), F.col(b).alias("other"))
    edges, seen = stored_with(ends.unionByName(ends.select(F.col("other").alias("node"), F.col("node").alias("other"))).distinct(), "links", n=F.count("*"))
    labels = edges.groupBy("node").agg(F.min("other").alias("m")).select("node", F.least("node", "m").alias("label"))
    if not seen["n"]:
        return labels
    labels = stored(labels, "labels")
    while True:
        near = edges.join(labels.select(F.col("node").alias("other"), F.col("label").alias("l")), "other").groupBy("node").agg(F.min("l").alias("m"))
        closer = labels.join(near, "node").select("node", F.least("label", "m").alias("label"), F.col("label").alias("was"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("l"))
        labels, seen = stored_with(closer.join(jump, "label").select("node", F.least("label", "l").alias("label"), "was"), "labels", moved=F.count_if(F.col("label") != F.col("was")))
        labels = labels.select("node", "label")
        if not seen["moved"]:
            return labels
