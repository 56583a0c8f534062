"""Connected components by joins: no group is gathered in one task, nothing goes to the driver but counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakehealth.llm.common import cut


def components(edges: DataFrame) -> DataFrame:
    """``node, label``: the smallest node of its component for every node of ``edges`` (``a, b``).

    Labels spread to neighbours by a join and a partial minimum, then every label is
    replaced by its own label, which halves the length of the paths still open. Ends when
    no label changes."""
    both = cut(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least"))
                 .select("node", F.least("node", "least").alias("label")))
    while True:
        near = (both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("label").alias("near")))
        spread = labels.join(near, labels.node == near.a).select(
            "node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        known = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        new = cut(spread.join(known, "label", "left").select(
            "node", "was", F.least("label", F.coalesce("further", "label")).alias("label")))
        changed = new.where(F.col("was") != F.col("label")).limit(1).count()
        labels = new.select("node", "label")
        if not changed:
            return labels
