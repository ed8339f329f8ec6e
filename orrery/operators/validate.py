"""Rules that a batch must keep before it is written."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def violations(entities: DataFrame, relations: DataFrame, world: str | None = None, version: str | None = None) -> DataFrame:
    """(order, rule, id): every broken rule of entities and relations.

    order is the rules' precedence: foreign snapshot, then an entity's own
    rules, then a relation's."""
    unit = lambda c: F.coalesce((c >= 0) & (c <= 1) & ~F.isnan(c), F.lit(False))
    row = lambda n, rule: (F.lit(n).alias("order"), F.lit(rule).alias("rule"), F.col("id"))
    finite = lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False))
    parts = []
    if world is not None:
        foreign = ~(F.col("world").eqNullSafe(F.lit(world)) & F.col("version").eqNullSafe(F.lit(version)))
        parts += [d.where(foreign).select(*row(1, "foreign_snapshot")) for d in (entities, relations)]
    m, s = entities.select("id", F.explode("measurements").alias("m")), entities.select("id", F.explode("scores").alias("s"))
    ids = entities.select(F.col("id").alias("known")).distinct()
    ends = relations.select("id", F.explode(F.array("from_id", "to_id")).alias("end"))
    parts += [
        entities.groupBy("id").count().where("count > 1").select(*row(2, "duplicate_entity")),
        m.where(~finite(F.col("m.value"))).select(*row(3, "measurement_not_finite")).distinct(),
        m.where(F.col("m.confidence").isNotNull() & ~unit(F.col("m.confidence"))).select(*row(4, "confidence_out_of_range")).distinct(),
        s.where(~unit(F.col("s.value"))).select(*row(5, "score_out_of_range")).distinct(),
        ends.join(ids, F.col("end") == F.col("known"), "left_anti").select(*row(6, "missing_endpoint")).distinct(),
        relations.where(~unit(F.col("weight"))).select(*row(7, "weight_out_of_range")),
        relations.groupBy("id").count().where("count > 1").select(*row(8, "duplicate_relation")),
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)
