"""Connected components of a distributed edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise


def connected(edges: DataFrame, label: str = "components") -> DataFrame:
    """(node, component) for every node of edges (a, b); a component's name is its smallest node.

    Every round each node takes the smallest label among its neighbours, then its label's label (which halves the depth), until a round changes
    nothing. Rounds are written to the shared folder, so the lineage stays short. Labels only meet in aggregations that combine
    before the shuffle; the joins are plain equi-joins, which adaptive execution splits where a node has very many edges.
    """
    both = materialise(
        edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter(F.col("a") != F.col("b")).distinct(), f"{label}-edges"
    )
    written = materialise(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("component")).withColumnRenamed("a", "node"), label)
    while True:
        labels = written.select("node", "component")
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("component").alias("near"))
        lower = labels.join(near, F.col("node") == F.col("a")).select("node", F.col("component").alias("was"), F.least("component", "near").alias("now"))
        jump = labels.select(F.col("node").alias("j_node"), F.col("component").alias("j_component"))
        lowest = F.least("now", "j_component")
        found = materialise(lower.join(jump, F.col("now") == F.col("j_node")).select("node", lowest.alias("component"), (lowest < F.col("was")).alias("moved")), label)
        discard(written)
        written = found
        if found.filter("moved").isEmpty():
            discard(both)
            return found.select("node", "component")
