"""Connected components of a table of links, in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediaquarry.storage import materialise


def connected_components(links: DataFrame) -> DataFrame:
    """(id, label) for every id in the links (a, b): label is the smallest id that can be reached.

    Each turn hooks every root to its smallest neighbouring root, halves the paths and contracts the
    links to roots, until none is left; hooks only go down, so there are no cycles. Each turn's tables
    are written to the shared folder.
    """
    links = materialise(links.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a <> b").distinct(), "links")
    labels = links.select(F.col("a").alias("id")).union(links.select("b")).distinct().withColumn("label", F.col("id"))
    while not links.isEmpty():
        both = links.union(links.select("b", "a"))
        hooks = both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("id"), F.least("a", "b").alias("up"))
        for _ in range(2):
            higher = hooks.select(F.col("id").alias("up"), F.col("up").alias("top"))
            hooks = hooks.join(higher, "up").select("id", F.col("top").alias("up"))
        hooks = materialise(hooks, "hooks")
        down = hooks.select(F.col("id").alias("label"), "up")
        labels = materialise(labels.join(down, "label", "left").select("id", F.coalesce("up", "label").alias("label")), "labels")
        a, b = hooks.select(F.col("id").alias("a"), F.col("up").alias("ra")), hooks.select(F.col("id").alias("b"), F.col("up").alias("rb"))
        links = materialise(links.join(a, "a").join(b, "b").select(F.col("ra").alias("a"), F.col("rb").alias("b")).where("a <> b").distinct(), "links")
    return labels
