"""Connected components of a table of links, by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, written


def components(links: DataFrame) -> DataFrame:
    """``links``: a, b (long). Returns node, component: the smallest node that links reach. Loops and repeated
    links change nothing; links with a null end are dropped; no links give no rows. Labels are written after each round,
    and rounds end when none changes."""
    links = links.filter("a IS NOT NULL AND b IS NOT NULL")
    both = written(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).distinct(), "links")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("component")), "labels")
    while True:
        seen = both.join(labels, both["b"] == labels["node"]).select(F.col("a").alias("node"), "component")
        low = labels.select("node", "component").union(seen).groupBy("node").agg(F.min("component").alias("component"))
        far = labels.select(F.col("node").alias("via"), F.col("component").alias("further"))
        jumped = low.join(far, low["component"] == far["via"], "left").select("node", F.least("component", F.coalesce("further", "component")).alias("component"))
        new = written(jumped, "labels")
        old = labels.select("node", F.col("component").alias("was"))
        changed = new.join(old, "node").filter("component <> was").limit(1).count()
        discard(labels)
        labels = new
        if not changed:
            discard(both)
            return labels
