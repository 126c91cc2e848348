"""Connected components of an edge table, by least labels, hooking of roots and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import few, written


def components(edges: DataFrame) -> DataFrame:
    """(id, label) for each id of edges (a, b): label is the least id of its component.

    Each round gives an id, and the id that is its label, the least label among its neighbours', and then that label's
    own label. So whole regions are hooked to lesser ones at once and labels travel over doubling distances; rounds end
    only when none changes. Every round is a written table in the shared folder."""
    both = written(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "edges")
    rows = both.count()  # no less than there are ids
    labels = written(few(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("label")), rows), "labels")
    while True:
        near = both.join(labels, both.b == labels.id).groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        roots = labels.join(near, "id").groupBy(F.col("label").alias("id")).agg(F.min("near").alias("near"))
        least = near.unionByName(roots).groupBy("id").agg(F.min("near").alias("near"))
        low = labels.join(least, "id").select("id", F.col("label").alias("was"), F.least("label", "near").alias("low"))
        jump = labels.select(F.col("id").alias("_i"), F.col("label").alias("_l"))
        later = low.join(jump, F.col("low") == F.col("_i"), "left").select("id", "was", F.least("low", F.coalesce("_l", "low")).alias("label"))
        later = written(few(later, rows), "labels")
        done = later.where("label <> was").isEmpty()
        labels = later.select("id", "label")
        if done:
            return labels
