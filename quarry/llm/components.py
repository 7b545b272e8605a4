"""Connected components of a graph given as a table of links, by repeated joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, hot_join, shared_table


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """id, component (the smallest id that can be reached) for every id in links (a, b).

    Each round gives every id the least label among its neighbours and then that label's own label, so the distance that a
    label travels doubles; it ends when no label changes. Self links and repeated links do no harm. A popular id's
    neighbours are reduced to their least label before the shuffle, and what joins it is dealt over several tasks.
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = shared_table(both, "links")
    labels = shared_table(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("component")).select(F.col("a").alias("id"), F.col("component").alias("was"), "component"), "labels")
    for _ in range(max_rounds):
        near = hot_join(both, labels.select(F.col("id").alias("b"), "component"), "b", "a").groupBy("a").agg(F.min("component").alias("near"))
        low = labels.join(near.withColumnRenamed("a", "id"), "id").select("id", F.col("component").alias("was"), F.least("component", "near").alias("low"))
        low = shared_table(low, "low")
        jump = labels.select(F.col("id").alias("low"), F.col("component").alias("far"))
        new = hot_join(low, jump, "low", "id", "left").select("id", "was", F.least("low", F.coalesce("far", "low")).alias("component"))
        new = shared_table(new, "labels")
        forget(labels, low)
        labels = new
        if new.filter(F.col("was") != F.col("component")).isEmpty():
            forget(both)
            return labels.select("id", "component")
    raise RuntimeError(f"components aren't settled after {max_rounds} rounds")
