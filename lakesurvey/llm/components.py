"""Connected components of a table of links, as a Spark job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakesurvey.llm.common import stored


def components(links: DataFrame, label: str = "components") -> DataFrame:
    """``node, component`` of every node in ``links`` (columns x, y): the smallest node reachable.

    Each step gives a node the smallest label among its neighbours, and then that label's own label, so a path of
    length n is done in about log n steps. Labels are written to the shared folder at each step; the driver sees counts only.
    """
    both = links.select("x", "y").where("x <> y").distinct()
    both = stored(both.unionByName(both.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct(), label)
    labels = stored(both.groupBy(F.col("x").alias("node")).agg(F.least(F.min("y"), F.col("x")).alias("component")), label)
    while True:
        near = both.join(labels.withColumnsRenamed({"node": "y", "component": "near"}), "y").groupBy("x").agg(F.min("near").alias("near"))
        lower = labels.join(near.withColumnRenamed("x", "node"), "node").select("node", "component", F.least("component", "near").alias("lower"))
        up = labels.select(F.col("node").alias("lower"), F.col("component").alias("up"))
        jumped = lower.join(up, "lower").select("node", F.col("component").alias("was"), F.least("lower", "up").alias("component"))
        jumped = stored(jumped, label)
        changed = jumped.where("was <> component").limit(1).count()
        labels = jumped.select("node", "component")
        if not changed:
            return labels
