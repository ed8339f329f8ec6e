"""Profiles, rankings, statistics and completeness."""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orrery.operators.find import avec
from orrery.schema import DIMENSIONS, REQUIRED, InvalidRequest


def _positive(limit: int) -> None:
    if limit <= 0:
        raise InvalidRequest("limit must be over 0")


def scores_pivot(entities: DataFrame, dimensions: tuple[str, ...] = DIMENSIONS) -> DataFrame:
    """id, label, kind and one column per dimension: the first score of the
    ranking model, for entities that have all of them."""
    whole = entities.select("id", "label", "kind", avec(dimensions).alias("avec")).where("avec IS NOT NULL")
    return whole.select("id", "label", "kind", *[F.col("avec")[d].alias(d) for d in dimensions])


def distance(profile: Mapping[str, float]) -> Column:
    """Euclidean, terms added from the left."""
    total = None
    for name, value in profile.items():
        gap = F.col(name) - F.lit(float(value))
        total = gap * gap if total is None else total + gap * gap
    return F.sqrt(total)


def patterns(profiles: DataFrame, profile: Mapping[str, float], threshold: float = 0.8, limit: int = 50) -> DataFrame:
    """Entities within 1 - threshold of a profile, nearest first, then by id."""
    if not 0 <= threshold <= 1:
        raise InvalidRequest("threshold must lie in 0..1")
    _positive(limit)
    near = profiles.withColumn("distance", distance(profile)).where((F.col("distance") <= F.lit(1.0 - float(threshold))) & ~F.isnan("distance"))
    return near.orderBy("distance", "id").limit(limit)


def high_friction(profiles: DataFrame, minimum: float = 0.7, limit: int = 20) -> DataFrame:
    """Entities of at least this friction, highest first, then by id."""
    _positive(limit)
    if math.isnan(minimum):
        return profiles.limit(0)
    return profiles.where(F.col("friction") >= F.lit(float(minimum))).orderBy(F.desc("friction"), "id").limit(limit)


def unstable(profiles: DataFrame, maximum: float = 0.4, limit: int = 20) -> DataFrame:
    """Entities of at most this stability, lowest first, then by id."""
    _positive(limit)
    if math.isnan(maximum):
        return profiles.limit(0)
    return profiles.where(F.col("stability") <= F.lit(float(maximum))).orderBy("stability", "id").limit(limit)


def stats(n_entities: DataFrame, profiles: DataFrame) -> DataFrame:
    """One row: entities of the model, scored ones, means (null if none)."""
    means = profiles.agg(F.count("*").alias("scored_entities"), *[F.avg(d).alias(f"mean_{d}") for d in DIMENSIONS])
    return means.select(F.lit(n_entities.count()).alias("code_entities"), "*")


def gaps(entities: DataFrame) -> DataFrame:
    """id, missing_measurements, missing_scores (both in list order) of entities
    that have lines of code but not everything; by id. Any score model counts."""
    names = F.transform("measurements", lambda m: m["name"])
    have = F.transform("scores", lambda s: s["dimension"])
    lists = lambda x: F.array(*[F.lit(v) for v in x])
    found = entities.where(F.array_contains(names, REQUIRED[0])).select(
        "id", F.array_except(lists(REQUIRED), names).alias("missing_measurements"), F.array_except(lists(DIMENSIONS), have).alias("missing_scores")
    )
    return found.where((F.size("missing_measurements") > 0) | (F.size("missing_scores") > 0)).orderBy("id")


def gaps_summary(entities: DataFrame) -> DataFrame:
    """One row: scoreable, fully_scored, with_gaps."""
    scoreable = entities.where(F.exists("measurements", lambda m: m["name"] == REQUIRED[0])).count()
    return gaps(entities).agg(F.lit(scoreable).alias("scoreable"), (F.lit(scoreable) - F.count("*")).alias("fully_scored"), F.count("*").alias("with_gaps"))


def best_measurements(evidence: DataFrame, keys: list[str]) -> DataFrame:
    """For each key the evidence (value, observer, confidence, ordinal) to use:
    highest confidence (none is 0), then the smallest observer (none is ''),
    then the last."""
    order = W.partitionBy(*keys).orderBy(F.coalesce("confidence", F.lit(0.0)).desc(), F.coalesce("observer", F.lit("")), F.desc("ordinal"))
    return evidence.withColumn("__r", F.row_number().over(order)).where("__r = 1").drop("__r")
