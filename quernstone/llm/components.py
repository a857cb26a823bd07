"""Connected components of an edge list, by alternating large and small stars.

Every step is a grouped minimum over a shuffled edge list, so no component is
ever gathered in one place; a node with many edges is pre-aggregated before the
shuffle and joins as the small side's one row. Each round is written to the
shared folder, which cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def _least(edges: DataFrame) -> DataFrame:
    """For every node the least of itself and its neighbours."""
    return edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))


def connected_components(edges: DataFrame) -> DataFrame:
    """edges (u, v), any orientation, loops and repeats allowed: (node, component), the least node of each."""
    pairs = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct()
    now = materialize(pairs, "edges")
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # large star: larger neighbours move to the least one
        large = both.join(_least(both), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialize(large, "large")
        # small star: smaller neighbours and the node itself move to the least one
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = materialize(least.select("u", F.col("m").alias("v")).unionByName(moved).distinct(), "small")
        discard(large)
        same = small.count() == now.count() and small.join(now, ["u", "v"], "left_anti").isEmpty()
        discard(now)
        now = small
        if same:
            break
    roots = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))
