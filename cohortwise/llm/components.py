"""Connected components of a table of links.

Labels are pulled down by the smallest neighbour and then by the label's own label (pointer
jumping), so the number of turns grows with the logarithm of a component's diameter. Each turn is
a table in the shared folder; nothing but the count of changes reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortwise.scratch import cut_lineage


def components(links: DataFrame) -> DataFrame:
    """node, component (its least node) for all nodes of links (a, b); none for no links."""
    both = links.where("a != b").select("a", "b").unionAll(links.where("a != b").select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = cut_lineage(both.distinct())
    label = cut_lineage(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("component")))
    while True:
        near = edges.join(label, F.col("b") == F.col("node")).groupBy(F.col("a").alias("to")).agg(F.min("component").alias("near"))
        pulled = label.join(near, F.col("node") == F.col("to")).select("node", F.col("component").alias("was"), F.least("component", "near").alias("now"))
        up = label.select(F.col("node").alias("of"), F.col("component").alias("over"))
        jumped = cut_lineage(
            pulled.join(up, F.col("now") == F.col("of")).select("node", "was", F.least("now", "over").alias("component"))
        )
        label = jumped.select("node", "component")
        if not jumped.where("component != was").limit(1).count():
            return label
