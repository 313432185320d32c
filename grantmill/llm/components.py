"""Connected components of a table of links, by least labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grantmill.llm.common import discard, release, stored


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (the least node reachable) for every node of a link. Repeated links and loops do no harm."""
    edges = stored(links.select(F.col(a).alias("u"), F.col(b).alias("v")).union(links.select(F.col(b), F.col(a))).distinct())
    labels = stored(edges.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.first("u")).alias("component")))
    before = labels
    while True:
        near = edges.join(labels, edges["v"] == labels["node"]).groupBy("u").agg(F.min("component").alias("near"))
        step = labels.join(near, labels["node"] == near["u"]).select("node", F.col("component").alias("old"), F.least("component", "near").alias("next"))
        up = labels.select(F.col("node").alias("_n"), F.col("component").alias("_c"))
        jumped = stored(step.join(up, step["next"] == up["_n"], "left").select("node", "old", F.least("next", F.coalesce("_c", "next")).alias("component")))
        done = jumped.where(F.col("old") != F.col("component")).isEmpty()
        discard(before)
        if done:
            discard(edges)
            release(links.sparkSession)
            return jumped.select("node", "component")
        before, labels = jumped, jumped.select("node", "component")
