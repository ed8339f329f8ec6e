"""Reconciliation of what several observers say about one snapshot.

Inputs are observation frames with an integer column `observer_rank` that
gives the order of the batches. Conflicts are rows (id, rule, detail); a merge
is valid only if there are none. Hot ids are no problem: every step is an
aggregation with partial combination, or a window over one id's evidence.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.schema import ConflictError


def union_ranked(frames: list[DataFrame]) -> DataFrame:
    """Frames in batch order, as one with observer_rank."""
    ranked = [f.withColumn("observer_rank", F.lit(i)) for i, f in enumerate(frames)]
    return reduce(lambda a, b: a.unionByName(b), ranked)


@dataclass
class Batch:
    """What one observer says of one snapshot. mode: `replace` or `amend`."""

    world: str
    version: str
    entities: DataFrame
    relations: DataFrame
    observer: str = ""
    mode: str = "replace"
    coverage: str = "complete"
    provenance: list[dict] = field(default_factory=list)
    diagnostics: list[dict] = field(default_factory=list)


def joined_coverage(states: list[str]) -> str:
    """merged_coverage of a list."""
    return states[0] if len(set(states)) == 1 and states[0] in ("complete", "unavailable") else "partial"


def merge_batches(batches: list[Batch]) -> Batch:
    """One batch of all, in order. A batch of another snapshot or commit mode,
    and observations that conflict, are refused; the first batch is taken as it
    is, so that ids that it repeats are left for validation."""
    first = batches[0]
    for b in batches[1:]:
        if (b.world, b.version) != (first.world, first.version):
            raise ConflictError(f"{b.observer}: the batch is of another snapshot")
        if b.mode != first.mode:
            raise ConflictError(f"{b.observer}: the batch has another commit mode")
    entities, relations = first.entities, first.relations
    if len(batches) > 1:
        entities, relations = merge(union_ranked([b.entities for b in batches]), union_ranked([b.relations for b in batches]))
    return Batch(
        first.world, first.version, entities, relations, first.observer, first.mode, joined_coverage([b.coverage for b in batches]),
        [p for b in batches for p in b.provenance], [d for b in batches for d in b.diagnostics],
    )


def _keys(df: DataFrame) -> list[str]:
    return [c for c in ("world", "version") if c in df.columns] + ["id"]


def merge_identity(obs: DataFrame) -> DataFrame:
    """Conflicts: ids that observers give different models."""
    return obs.groupBy(*_keys(obs)).agg(F.count_distinct("model").alias("models")).where("models > 1").select(*_keys(obs), F.lit("identity").alias("rule"), F.col("models").cast("string").alias("detail"))


def merged_kind(name: str = "kind") -> Column:
    """Aggregate: `unknown` yields to a concrete kind."""
    kind = F.col(name)
    return F.coalesce(F.max(F.when(kind != "unknown", kind)), F.lit("unknown"))


def merge_kind(obs: DataFrame) -> DataFrame:
    """Each id's kind, and how many concrete kinds it has (over 1: conflict)."""
    concrete = F.when(F.col("kind") != "unknown", F.col("kind"))
    return obs.groupBy(*_keys(obs)).agg(merged_kind().alias("kind"), F.count_distinct(concrete).alias("concrete_kinds"))


def separators(label: Column) -> Column:
    """Number of `::` and `.` in a label, without overlaps."""
    return F.regexp_count(label, F.lit("::")) + F.regexp_count(label, F.lit("[.]"))


def merge_label(obs: DataFrame) -> DataFrame:
    """Each id's best label: most separators, then most bytes, then the smallest."""
    best = F.min_by("label", F.struct(-separators(F.col("label")), -F.octet_length("label"), F.col("label")))
    return obs.groupBy(*_keys(obs)).agg(best.alias("label"))


def merge_attributes(obs: DataFrame) -> DataFrame:
    """(id, key, value, n_values): the union of attributes; n_values over 1 is a conflict."""
    entries = obs.select(*_keys(obs), F.explode("attributes").alias("key", "value"))
    return entries.groupBy(*_keys(obs), "key").agg(F.min("value").alias("value"), F.count_distinct("value").alias("n_values"))


def merge_measurements(obs: DataFrame) -> DataFrame:
    """(id, name, observer, value, unit, confidence, n_values): evidence by name
    and observer (or none); equal repeats are one, n_values over 1 is a conflict."""
    rows = obs.select(*_keys(obs), "observer_rank", F.posexplode("measurements").alias("pos", "m")).select(*_keys(obs), "observer_rank", "pos", "m.*")
    own = F.struct("value", "unit", "confidence")
    return (
        rows.groupBy(*_keys(obs), "name", "observer")
        .agg(F.min(F.struct("observer_rank", "pos")).alias("at"), F.min_by(own, F.struct("observer_rank", "pos")).alias("m"), F.count_distinct(own_key(own)).alias("n_values"))
        .select(*_keys(obs), "name", "observer", "m.*", "at", "n_values")
    )


def own_key(value: Column) -> Column:
    """A struct as text, so that nulls in it count as values when told apart."""
    return F.to_json(value, {"ignoreNullFields": "false"})


def merge_scores(obs: DataFrame) -> DataFrame:
    """(id, model, version, dimension, value, n_values), by the same rule."""
    rows = obs.select(*_keys(obs), "observer_rank", F.posexplode("scores").alias("pos", "s"))
    keyed = rows.select(*_keys(obs), "observer_rank", "pos", F.col("s.model").alias("score_model"), F.col("s.version").alias("score_version"), "s.dimension", "s.value")
    return keyed.groupBy(*_keys(obs), "score_model", "score_version", "dimension").agg(
        F.min(F.struct("observer_rank", "pos")).alias("at"), F.min_by("value", F.struct("observer_rank", "pos")).alias("value"), F.count_distinct("value").alias("n_values")
    )


def merge_relations(rels: DataFrame) -> DataFrame:
    """One row per relation id; n_values over 1: its observations differ."""
    whole = F.struct("model", "kind", "from_id", "to_id", F.col("weight").cast("string").alias("weight"), F.array_sort(F.map_entries(F.coalesce("attributes", F.create_map().cast("map<string,string>")))).alias("attributes"))
    keys = _keys(rels)
    first = [F.min_by(c, "observer_rank").alias(c) for c in ("model", "kind", "from_id", "to_id", "weight", "attributes")]
    return rels.groupBy(*keys).agg(*first, F.count_distinct(own_key(whole)).alias("n_values"))


def merged_coverage(name: str = "coverage") -> Column:
    """Aggregate: all complete or all unavailable stay so, anything else is partial."""
    c = F.col(name)
    return F.when((F.min(c) == F.max(c)) & F.min(c).isin("complete", "unavailable"), F.min(c)).otherwise(F.lit("partial"))


def conflicts(obs: DataFrame, rels: DataFrame | None = None) -> DataFrame:
    """All conflicts as (keys..., rule, detail)."""
    k = _keys(obs)
    text = lambda c: F.col(c).cast("string").alias("detail")
    rule = lambda r: F.lit(r).alias("rule")
    parts = [
        merge_identity(obs),
        merge_kind(obs).where("concrete_kinds > 1").select(*k, rule("kind"), text("concrete_kinds")),
        merge_attributes(obs).where("n_values > 1").select(*k, rule("attribute"), text("key")),
        merge_measurements(obs).where("n_values > 1").select(*k, rule("measurement"), text("name")),
        merge_scores(obs).where("n_values > 1").select(*k, rule("score"), text("dimension")),
    ]
    if rels is not None:
        parts.append(merge_relations(rels).where("n_values > 1").select(*k, rule("relation"), text("n_values")))
    return reduce(lambda a, b: a.unionByName(b), parts)


def merge_entities(obs: DataFrame) -> DataFrame:
    """Merged observations: one row per id, arrays in order of observation."""
    k = _keys(obs)
    m = merge_measurements(obs).groupBy(*k).agg(F.array_sort(F.collect_list(F.struct("at", F.struct("name", "value", "unit", "observer", "confidence").alias("m")))).alias("ms"))
    s = merge_scores(obs).groupBy(*k).agg(
        F.array_sort(F.collect_list(F.struct("at", F.struct(F.col("score_model").alias("model"), F.col("score_version").alias("version"), "dimension", "value").alias("s")))).alias("ss")
    )
    a = merge_attributes(obs).groupBy(*k).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("attributes"))
    head = obs.groupBy(*k).agg(F.min("model").alias("model"), merged_kind().alias("kind"), F.min_by("label", F.struct(-separators(F.col("label")), -F.octet_length("label"), F.col("label"))).alias("label"))
    joined = head.join(a, k, "left").join(m, k, "left").join(s, k, "left")
    return joined.select(
        *k,
        "model",
        "kind",
        "label",
        F.coalesce("attributes", F.create_map().cast("map<string,string>")).alias("attributes"),
        F.coalesce(F.transform("ms", lambda x: x["m"]), F.array()).alias("measurements"),
        F.coalesce(F.transform("ss", lambda x: x["s"]), F.array()).alias("scores"),
    )


def merge(obs: DataFrame, rels: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """(entities, relations), or ConflictError with the first conflicts."""
    found = conflicts(obs, rels).limit(20).collect()
    if found:
        raise ConflictError("; ".join(f"{r['id']}: {r['rule']} {r['detail']}" for r in found))
    return merge_entities(obs), None if rels is None else merge_relations(rels).drop("n_values")
