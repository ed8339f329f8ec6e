"""Entity search, location lookup, incident edges and node views."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orrery.functions.scalars import ascii_lower, exact_u32, let
from orrery.schema import DIMENSIONS, SCORE_MODEL, InvalidRequest


def of_snapshot(df: DataFrame, world: str, version: str) -> DataFrame:
    """One snapshot's rows; both columns partition the store."""
    return df.where((F.col("world") == world) & (F.col("version") == version))


def find_entities(
    entities: DataFrame,
    model: str | None = None,
    kind: str | None = None,
    label_contains: str | None = None,
    attributes: Mapping[str, str] | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Entities that meet every filter, by id. attributes: canonical JSON text."""
    keep = F.lit(True)
    if model is not None:
        keep = keep & (ascii_lower(F.col("model")) == ascii_lower(F.lit(model)))
    if kind is not None:
        keep = keep & (F.col("kind") == kind)
    if label_contains is not None:
        keep = keep & F.contains(F.lower("label"), F.lower(F.lit(label_contains)))
    for key, value in (attributes or {}).items():
        keep = keep & (F.col("attributes")[key] == value)
    found = entities.where(keep).orderBy("id")
    return found if limit is None else found.limit(limit)


def code_find(entities: DataFrame, path: str | None = None, name_contains: str | None = None, kind: str | None = None, language: str | None = None, limit: int | None = None) -> DataFrame:
    """find_entities over the code model; path and language by equality."""
    wanted = {k: json.dumps(v, ensure_ascii=False) for k, v in (("file_path", path), ("language", language)) if v is not None}
    return find_entities(entities, "code", kind, name_contains, wanted, limit)


def string_attribute(name: str) -> Column:
    """An attribute that is a JSON string, else null."""
    value = F.col("attributes")[name]
    return F.when(F.startswith(value, F.lit('"')), F.get_json_object(F.concat(F.lit('{"v":'), value, F.lit("}")), "$.v"))


def u32_attribute(name: str) -> Column:
    """An attribute that is a JSON integer of 32 bits, else null."""
    value = F.col("attributes")[name]
    number = F.expr(f"try_cast(attributes['{name}'] AS BIGINT)")
    return F.when(F.regexp_like(value, F.lit(r"^\d+$")) & (number <= 4294967295), number)


def count_measurement(name: str) -> Column:
    """The first measurement of a name, if it is a whole number of 32 bits."""
    first = F.get(F.filter("measurements", lambda m: m["name"] == name), 0)["value"]
    return exact_u32(first).cast("long")


def locations(spans: DataFrame, points: DataFrame, key: str = "path") -> DataFrame:
    """For each point (key, line, ...) the narrowest span (key, id, line_start,
    line_end) that holds it: fewest lines, then the smallest id. A span without
    end ends where it starts; without a start it holds nothing.

    The key is an equality, so that this is a hash join with a range filter."""
    own = spans.where("line_start IS NOT NULL").select(F.col(key), "id", "line_start", F.coalesce("line_end", "line_start").alias("line_end"))
    marked = points.withColumn("__p", F.monotonically_increasing_id())
    hit = marked.join(own, key).where((F.col("line_start") <= F.col("line")) & (F.col("line") <= F.col("line_end")))
    span = F.greatest(F.col("line_end") - F.col("line_start"), F.lit(0))
    order = W.partitionBy("__p").orderBy(span, "id")
    return hit.withColumn("span", span).withColumn("__r", F.row_number().over(order)).where("__r = 1").drop("__p", "__r", "line_start", "line_end")


def at_location(spans: DataFrame, path: str, line: int, key: str = "path") -> DataFrame:
    """The narrowest span of one path that holds one line; no row if none."""
    end = F.coalesce("line_end", "line_start")
    held = spans.where((F.col(key) == path) & (F.col("line_start") <= line) & (end >= line))
    return held.orderBy(F.greatest(end - F.col("line_start"), F.lit(0)), "id").limit(1)


def relations_of(relations: DataFrame, entity: str, direction: str = "both") -> DataFrame:
    """Edges at an entity, by relation id; a self-loop once."""
    sides = {"incoming": F.col("to_id") == entity, "outgoing": F.col("from_id") == entity}
    if direction not in (*sides, "both"):
        raise InvalidRequest(f"direction {direction!r}")
    keep = sides[direction] if direction in sides else sides["incoming"] | sides["outgoing"]
    return relations.where(keep).orderBy("id")


def summary(entities: DataFrame) -> DataFrame:
    """id, label, kind, path, line_start, line_end."""
    return entities.select("id", "label", "kind", string_attribute("file_path").alias("path"), u32_attribute("line_start").alias("line_start"), u32_attribute("line_end").alias("line_end"))


def avec(dimensions: tuple[str, ...] = DIMENSIONS) -> Column:
    """The profile of the ranking model: a struct of the first score in each
    dimension; null unless all are there."""

    def first(own: Column, dimension: str) -> Column:
        return F.get(F.filter(own, lambda s: s["dimension"] == dimension), F.lit(0))["value"]

    def whole(profile: Column) -> Column:
        there = F.lit(True)
        for d in dimensions:
            there = there & profile[d].isNotNull()
        return F.when(there, profile)

    own = F.filter("scores", lambda s: s["model"] == SCORE_MODEL)
    return let(let(own, lambda x: F.struct(*[first(x, d).alias(d) for d in dimensions])), whole)


def node_columns(include_scores: bool = True) -> list[Column]:
    """A node's own columns, without edges."""
    profile = avec() if include_scores else F.lit(None).cast(f"struct<{','.join(f'{d}:double' for d in DIMENSIONS)}>")
    return [
        F.col("id"),
        F.col("label"),
        F.col("kind"),
        string_attribute("language").alias("language"),
        string_attribute("namespace").alias("namespace"),
        string_attribute("signature").alias("signature"),
        string_attribute("file_path").alias("path"),
        u32_attribute("line_start").alias("line_start"),
        u32_attribute("line_end").alias("line_end"),
        count_measurement("graph.incoming_edges").alias("incoming_edges"),
        count_measurement("graph.outgoing_edges").alias("outgoing_edges"),
        profile.alias("avec"),
    ]


def node_views(entities: DataFrame, relations: DataFrame, include_scores: bool = True) -> DataFrame:
    """Entities with their profile (if asked for) and incoming and outgoing
    edges, without `contains`; a self-loop is outgoing only."""
    edges = relations.where("kind <> 'contains'")
    view = F.struct(F.col("id").alias("relation_id"), "kind", "from_id", "to_id", "weight")
    out = edges.groupBy(F.col("from_id").alias("id")).agg(F.array_sort(F.collect_list(view)).alias("outgoing"))
    into = edges.where("from_id <> to_id").groupBy(F.col("to_id").alias("id")).agg(F.array_sort(F.collect_list(view)).alias("incoming"))
    empty = F.array().cast("array<struct<relation_id:string,kind:string,from_id:string,to_id:string,weight:double>>")
    found = entities.join(out, "id", "left").join(into, "id", "left")
    return found.select(*node_columns(include_scores), F.coalesce("incoming", empty).alias("incoming"), F.coalesce("outgoing", empty).alias("outgoing"))
