"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gtdlens.session import write_once


def connected_components(links: DataFrame) -> DataFrame:
    """For each node of the links (a, b) the smallest node it can reach: (node, component).

    Each round a node takes the smallest label among its own and its neighbours', then the label of that label, so
    paths shorten by halves. Labels are written in the shared folder each round; only the number of changes comes to the
    driver. A hub's minimum is taken before the shuffle, so its links need no single task.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = write_once(both.where("a <> b").distinct(), "edges")
    labels = write_once(
        edges.groupBy("a").agg(F.min("b").alias("least")).select(
            F.col("a").alias("node"), F.least("a", "least").alias("component")
        ),
        "labels",
    )
    while True:
        of_neighbours = (
            edges.join(labels.withColumnRenamed("node", "b"), "b")
            .groupBy("a")
            .agg(F.min("component").alias("least"))
            .withColumnRenamed("a", "node")
        )
        lowered = labels.join(of_neighbours, "node").select(
            "node", F.col("component").alias("old"), F.least("component", "least").alias("component")
        )
        stepped = write_once(lowered, "labels")
        jump = stepped.select(F.col("node").alias("component"), F.col("component").alias("further"))
        jumped = write_once(
            stepped.join(jump, "component", "left").select(
                "node", "old", F.least("component", F.coalesce("further", "component")).alias("component")
            ),
            "labels",
        )
        labels = jumped.select("node", "component")
        if not jumped.where("component <> old").limit(1).count():
            return labels
