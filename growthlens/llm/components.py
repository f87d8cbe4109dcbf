"""Connected components of a table of links, by label propagation with pointer
jumping. Each round is written out, so a lost executor costs one round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for every node in
    ``links`` (a, b). Every minimum is pre-aggregated, every join has a unique
    side, so a hub's rows are split over tasks."""
    edges = materialize(
        links.select(F.col("a").alias("src"), F.col("b").alias("dst"))
        .union(links.select("b", "a")).filter("src != dst").distinct(), "edges")
    labels = materialize(
        edges.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("m"))
        .select("node", F.least("node", "m").alias("label"), F.lit(True).alias("moved")), "labels")
    while not labels.filter("moved").isEmpty():
        near = (edges.join(labels, edges["dst"] == labels["node"])
                .groupBy("src").agg(F.min("label").alias("near")))
        met = labels.join(near, labels["node"] == near["src"]).select(
            "node", F.col("label").alias("old"), F.least("label", "near").alias("own"))
        jump = labels.select(F.col("node").alias("at"), F.col("label").alias("on"))
        before, labels = labels, materialize(
            met.join(jump, F.col("own") == F.col("at")).select(
                "node", F.least("own", "on").alias("label"),
                (F.least("own", "on") < F.col("old")).alias("moved")), "labels")
        discard(before)
    discard(edges)
    return labels.select("node", F.col("label").alias("component"))
