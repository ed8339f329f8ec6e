"""Bounded breadth-first traversal, one job per level.

The edges are dealt by the end that a step leaves from, once, and held so for
the loop. Each level joins the frontier with them and drops nodes that are
known. A frontier or a set of known nodes is broadcast while it is counted to
be small, and shuffled beyond; the edges stay where they are. Checkpoints cut
the lineage of each level. Ranking by discovery order happens only under a node
limit, which bounds its sort.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orrery.folders import checkpoint_folder
from orrery.operators.find import node_columns
from orrery.schema import DEPENDENCY_KINDS, EntityNotFound, InvalidNodeLimit, InvalidRequest


#: Ids that a broadcast may hold.
BROADCAST_NODES = 100_000


@dataclass
class Traversal:
    nodes: DataFrame  # id, depth
    relations: DataFrame
    truncated: bool
    size: int  # of nodes


def _ends(edges: DataFrame, direction: str) -> DataFrame:
    """Edges as (near, far, id), in the direction of travel."""
    out = edges.select(F.col("from_id").alias("near"), F.col("to_id").alias("far"), "id")
    into = edges.select(F.col("to_id").alias("near"), F.col("from_id").alias("far"), "id")
    if direction == "outgoing":
        return out
    if direction == "incoming":
        return into
    if direction == "both":
        return out.unionAll(into)
    raise InvalidRequest(f"direction {direction!r}")


def _small(df: DataFrame, rows: int) -> DataFrame:
    """df, to be broadcast if it has few rows."""
    return F.broadcast(df) if rows <= BROADCAST_NODES else df


def traverse(
    entities: DataFrame,
    relations: DataFrame,
    root: str,
    direction: str = "outgoing",
    max_depth: int | None = 3,
    max_nodes: int | None = 1000,
    kinds: Iterable[str] = (),
) -> Traversal:
    """Nodes reached from root with their depths, the relations met on the way
    whose ends are both reached, and whether max_nodes cut anything off. Of
    nodes beyond the limit those discovered first are taken: by their parent's
    order, then by relation id. None: no limit."""
    if max_nodes is not None and max_nodes <= 0:
        raise InvalidNodeLimit("max_nodes must be over 0")
    if entities.where(F.col("id") == root).isEmpty():
        raise EntityNotFound(root)
    spark = entities.sparkSession
    checkpoint_folder(spark)
    wanted = list(kinds)
    edges = relations.where(F.col("kind").isin(wanted)) if wanted else relations
    steps = _ends(edges, direction).withColumnRenamed("id", "edge").repartition("near").persist()
    nodes = frontier = spark.createDataFrame([(root, 0, 0)], "id string, depth int, found long").checkpoint()
    total, width, depth = 1, 1, 0
    expanded = None
    while max_depth is None or depth < max_depth:
        near = _small(frontier.select(F.col("id").alias("near"), "found"), width)
        met = steps.join(near, "near").select("far", "edge", "found")
        fresh = met.join(_small(nodes.select(F.col("id").alias("far")), total), "far", "left_anti")
        new = fresh.groupBy("far").agg(F.min(F.struct("found", "edge")).alias("by")).checkpoint()
        count = new.count()
        expanded = frontier.select("id") if expanded is None else expanded.unionAll(frontier.select("id"))
        depth += 1
        if not count:
            break
        room = None if max_nodes is None else max_nodes - total
        if room is not None and count > room:
            new = new.orderBy("by", "far").limit(room)
        # discovery order matters only under a limit, which bounds its sort
        found = F.row_number().over(W.orderBy("by", "far")).cast("long") if max_nodes is not None else F.lit(0).cast("long")
        frontier = new.select(F.col("far").alias("id"), F.lit(depth).alias("depth"), found.alias("found")).checkpoint()
        nodes = nodes.unionAll(frontier)
        width = min(count, room) if room is not None else count
        total += width
        if room is not None and count > room:
            break
    ids = nodes.select("id")
    if expanded is None:  # max_depth 0: nothing is expanded
        steps.unpersist()
        return Traversal(nodes.select("id", "depth"), relations.limit(0), False, total)
    known = _small(ids.withColumnRenamed("id", "far"), total)
    incident = steps.join(_small(expanded.withColumnRenamed("id", "near"), total), "near", "left_semi").select("edge", "far")
    inside = incident.join(known, "far", "left_semi").select(F.col("edge").alias("id")).distinct()
    cut = max_nodes is not None and not incident.join(known, "far", "left_anti").isEmpty()
    found = edges.join(inside, "id", "left_semi").checkpoint()
    steps.unpersist()
    return Traversal(nodes.select("id", "depth"), found, cut, total)


def impact(entities: DataFrame, relations: DataFrame, root: str, max_depth: int | None = 3, max_nodes: int | None = 1000) -> tuple[DataFrame, Traversal]:
    """(one row: direct, transitive, relations, truncated; the traversal) of what
    depends on root. Transitive excludes direct."""
    t = traverse(entities, relations, root, "incoming", max_depth, max_nodes, DEPENDENCY_KINDS)
    counts = t.nodes.agg(F.count_if(F.col("depth") == 1).alias("direct"), F.count_if(F.col("depth") > 1).alias("transitive"))
    return counts.withColumn("relations", F.lit(t.relations.count())).withColumn("truncated", F.lit(t.truncated)), t


def dependencies(entities: DataFrame, relations: DataFrame, root: str, direction: str = "both", max_depth: int | None = None, max_nodes: int | None = 10_000, include_scores: bool = False) -> DataFrame:
    """depth and the node's view (without edges) of every hit, root included, by
    depth and id."""
    t = traverse(entities, relations, root, direction, max_depth, max_nodes, DEPENDENCY_KINDS)
    views = entities.join(_small(t.nodes.select("id"), t.size), "id", "left_semi").select(*node_columns(include_scores))
    return t.nodes.join(views, "id").select("depth", *views.columns).orderBy("depth", "id")
