"""Connected components of an edge list, as alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.session import SMALL_ROWS, hot_keys, join_spread

#: Edges of a node from which it may count as a hub.
HUB = SMALL_ROWS


def _turn(edges: DataFrame, larger: bool, total: int) -> DataFrame:
    """One star step. Large: each node's larger neighbours go to the smallest
    node of its neighbourhood. Small: its smaller neighbours and itself do."""
    if larger:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:
        both = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    hubs = hot_keys(least, "u", HUB, total)
    least = least.select("u", F.least("u", "m").alias("m"))
    joined = join_spread(both, least, "u", hubs)
    if larger:
        out = joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).unionAll(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of all nodes that have an edge; the component is its
    smallest node. edges: a, b of one orderable type; loops and repeats are fine.

    Each round is cut by checkpoint(), so that a lost executor costs one round;
    rounds grow with the logarithm of the longest path. Edges of hubs are not
    shuffled to their hubs' tasks. Only a count and a checksum of the edges, and
    the few hubs, reach the driver.
    """
    edges = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select("a", "b").distinct().checkpoint()
    total, seen = 2 * edges.count(), None
    while total:
        turned = _turn(edges, True, total)
        if total > HUB:  # the other turn asks for hubs first
            turned = turned.checkpoint()
        edges = _turn(turned, False, total).checkpoint()
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen or state[0] == 0:
            break
        seen = state
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
