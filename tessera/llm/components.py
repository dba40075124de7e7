"""Connected components of a table of links, on the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stash


def components(links: DataFrame) -> DataFrame:
    """(id, component) for every id in ``links`` (a, b); the component is its
    smallest id.

    Each round hangs an id on its smallest neighbour if that is smaller, follows these
    pointers to their roots by doubling, and goes on with the links between roots.
    At least half of the ids that have links are gone after a round, and so are the links
    inside a group; minima are aggregated before the shuffle, so a hub costs one row
    per task."""
    edges = stash(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    labels = None
    while True:
        ends = edges.select(F.col("a").alias("id"), F.col("b").alias("root")).union(edges.select("b", "b"))
        roots = stash(ends.groupBy("id").agg(F.min("root").alias("root")), "roots")
        while True:
            up = roots.select(F.col("id").alias("_at"), F.col("root").alias("_up"))
            farther = stash(roots.join(up, F.col("root") == F.col("_at")).select("id", F.col("_up").alias("root"), (F.col("_up") != F.col("root")).alias("moved")), "roots")
            roots = farther.select("id", "root")
            if farther.where("moved").isEmpty():
                break
        of = lambda x: roots.select(F.col("id").alias(x), F.col("root").alias(f"root_{x}"))
        if labels is None:
            labels = roots.withColumnRenamed("root", "component")
        else:
            labels = stash(labels.join(of("component"), "component", "left").select("id", F.coalesce("root_component", "component").alias("component")), "labels")
        between = edges.join(of("a"), "a").join(of("b"), "b").where("root_a <> root_b")
        edges = stash(between.select(F.greatest("root_a", "root_b").alias("a"), F.least("root_a", "root_b").alias("b")).distinct(), "links")
        if edges.isEmpty():
            return labels
