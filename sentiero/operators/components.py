"""Connected components of a graph given as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import stage


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Rows (id, component) for every vertex of ``edges``; a component is named by its smallest vertex.

    Each round takes the smallest label around every vertex and then the label of that label (pointer jumping), so the
    rounds grow with the logarithm of the diameter. State is written to the shared folder after each round; partial
    minima are built before every shuffle, so a vertex with very many edges is no bottleneck. Edges with a null end and
    loops add nothing but their vertex; an empty table gives no rows.
    """
    e = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where(F.col("a").isNotNull() & F.col("b").isNotNull())
    both = stage(e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = stage(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("component")))
    while True:
        around = both.join(labels, both["b"] == labels["id"]).groupBy("a").agg(F.min("component").alias("near"))
        low = labels.join(around, labels["id"] == around["a"]).select("id", F.least("component", "near").alias("component"), F.col("component").alias("was"))
        root = low.select(F.col("id").alias("r"), F.col("component").alias("top"))
        jumped = low.join(root, low["component"] == root["r"], "left").select("id", F.least("component", F.coalesce("top", "component")).alias("component"), "was")
        jumped = stage(jumped)
        changed = jumped.where(F.col("component") != F.col("was")).limit(1).count()
        labels = jumped.select("id", "component")
        if not changed:
            return labels
