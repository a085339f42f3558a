"""Connected components of a link table, by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeweave.scratch import Scratch


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, component): for every id in ``links`` (a, b) the smallest id it reaches.

    Each round takes the smallest label next door, then the label of that
    label, so chains shorten to half and stars end at once. Labels are written
    in every round; only whether any label changed reaches the driver.
    """
    both = scratch.keep(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = scratch.keep(both.groupBy("a").agg(F.least("a", F.min("b")).alias("component")).withColumnRenamed("a", "id"), "labels")
    while True:
        near = both.join(labels, both["a"] == labels["id"]).groupBy("b").agg(F.min("component").alias("component")).withColumnRenamed("b", "id")
        lower = near.union(labels.select("id", "component")).groupBy("id").agg(F.min("component").alias("component"))
        lower = scratch.keep(lower, "lower")
        jump = labels.select(F.col("id").alias("component"), F.col("component").alias("above"))
        found = lower.join(jump, "component", "left").select("id", F.least("component", F.coalesce("above", "component")).alias("component"))
        found = scratch.keep(found, "labels")
        changed = found.join(labels.withColumnRenamed("component", "old"), "id").filter("component <> old").limit(1).count()
        if not changed:
            return found
        labels = found
