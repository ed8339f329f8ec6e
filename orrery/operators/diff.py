"""Difference of two versions of a world."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.schema import DifferentWorlds


def _entries(c: str) -> Column:
    """A map as sorted entries, which compare where maps don't."""
    return F.array_sort(F.map_entries(F.coalesce(c, F.create_map().cast("map<string,string>"))))


def changes(before: DataFrame, after: DataFrame, key: list[str], content: Column) -> DataFrame:
    """key and change (added, removed, changed) of rows that differ. content is
    compared null-safely; equal rows give no row. One full outer join."""
    a = before.select(*key, content.alias("was"), F.lit(True).alias("in_a"))
    b = after.select(*key, content.alias("now"), F.lit(True).alias("in_b"))
    joined = a.join(b, key, "full_outer")
    change = F.when(F.col("in_a").isNull(), "added").when(F.col("in_b").isNull(), "removed").when(~F.col("was").eqNullSafe(F.col("now")), "changed")
    return joined.withColumn("change", change).where("change IS NOT NULL").drop("in_a", "in_b")


def entity_content() -> Column:
    """What makes entities equal; arrays compare in order."""
    return F.struct("model", "kind", "label", _entries("attributes").alias("attributes"), "measurements", "scores")


def relation_content() -> Column:
    """What makes relations equal; weights compare by their bits' text."""
    return F.struct("model", "kind", "from_id", "to_id", F.col("weight").cast("string").alias("weight"), _entries("attributes").alias("attributes"))


def diff(entities: DataFrame, relations: DataFrame, a: tuple[str, str], b: tuple[str, str]) -> DataFrame:
    """side, change, id, before and after (JSON) between snapshots a and b; a
    missing snapshot is empty."""
    if a[0] != b[0]:
        raise DifferentWorlds(f"{a[0]} and {b[0]}")
    of = lambda d, s: d.where((F.col("world") == s[0]) & (F.col("version") == s[1]))
    parts = [
        changes(of(d, a), of(d, b), ["id"], content()).select(F.lit(side).alias("side"), "change", "id", F.to_json("was").alias("before"), F.to_json("now").alias("after"))
        for side, d, content in (("entity", entities, entity_content), ("relation", relations, relation_content))
    ]
    return parts[0].unionByName(parts[1])
