"""Connected components of a link table, by minimum labels with shortcuts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphledger.llm.common import discard, written


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of links (a, b); a component is named by its smallest node.

    Each round a node takes the smallest label among its neighbours' and then
    its label's label, so labels travel twice as far each time. Every round is
    a table in the shared folder. No links: no rows.
    """
    both = written(links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct())
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select("node", F.least("node", "least").alias("component")))
    while True:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("component").alias("near"))
        met = labels.join(near, labels.node == near.a, "left").select("node", F.col("component").alias("old"), F.least("component", F.coalesce("near", "component")).alias("component"))
        jump = labels.select(F.col("node").alias("via"), F.col("component").alias("further"))
        step = written(met.join(jump, met.component == jump.via, "left").select("node", "old", F.least("component", F.coalesce("further", "component")).alias("component")))
        before, labels = labels, step.select("node", "component")
        labels.written_at = step.written_at
        done = step.where("old <> component").isEmpty()
        discard(before)
        if done:
            discard(both)
            return labels


def merged(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """labels (node, component) after some more links (a, b): only the links between components are followed."""
    if labels is None:
        return connected_components(links)
    old = labels.select(F.col("node").alias("o_node"), F.col("component").alias("o_component"))
    for end in ("a", "b"):
        links = links.join(old, F.col(end) == F.col("o_node"), "left").withColumn(f"{end}_of", F.coalesce("o_component", end)).drop("o_node", "o_component")
    links = written(links)
    moved = connected_components(links.select(F.col("a_of").alias("a"), F.col("b_of").alias("b")))
    nodes = labels.union(links.select("a", "a_of")).union(links.select("b", "b_of")).distinct()
    moved = moved.select(F.col("node").alias("m_node"), F.col("component").alias("m_component"))
    return written(nodes.join(moved, nodes.component == F.col("m_node"), "left").select("node", F.coalesce("m_component", "component").alias("component")))
