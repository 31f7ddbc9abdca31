"""Connected components as a DataFrame job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrygrid.common import drop_scratch, materialize


def min_label_components(edges: DataFrame, a: str = "a", b: str = "b", tag: str = "components") -> DataFrame:
    """(node, component): the smallest node reachable from every node that has an edge.

    Each round takes the smallest label among the neighbours and then follows that label once (pointer jumping), so the
    rounds grow with the logarithm of the diameter. Labels are written to the shared scratch folder between rounds;
    only the number of changed labels reaches the driver. Null ends and self loops are ignored.
    """
    spark = edges.sparkSession
    both = edges.select(F.col(a).alias("src"), F.col(b).alias("dst")).where("src is not null and dst is not null and src <> dst")
    both = materialize(both.unionByName(both.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct(), f"{tag}-edges")
    labels = materialize(both.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("near")).select("node", F.least("node", "near").alias("component")), f"{tag}-labels")
    while True:
        near = (
            both.join(labels, both.dst == labels.node)
            .groupBy("src").agg(F.min("component").alias("near"))
        )
        stepped = labels.join(near, labels.node == near.src).select("node", "component", F.least("component", "near").alias("next"))
        roots = labels.select(F.col("node").alias("root"), F.col("component").alias("root_component"))
        jumped = materialize(
            stepped.join(roots, stepped.next == roots.root, "left")
            .select("node", F.least("next", F.coalesce("root_component", "next")).alias("component"), (F.col("component") != F.least("next", F.coalesce("root_component", "next"))).alias("moved")),
            f"{tag}-labels",
        )
        moved = jumped.where("moved").limit(1).count()
        drop_scratch(spark, labels)
        labels = jumped.select("node", "component")
        if not moved:
            drop_scratch(spark, both)
            return labels
