"""The star pack: driver tables as entities, relations and measurements."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.functions.scalars import json_string
from orrery.functions.scores import METRICS, score_columns
from orrery.schema import DIMENSIONS, MEASUREMENT, REQUIRED, SCORE, SCORE_MODEL, WEIGHTS

WORLD, VERSION = "star", "v1"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _json(c: Column, kind: str) -> Column:
    """Canonical JSON text of a string or a number."""
    return json_string(c) if kind == "string" else c.cast("string")


def entity_frame(df: DataFrame, kind: str, key: str, label: str, attributes: dict[str, str]) -> DataFrame:
    types = dict(df.dtypes)
    pairs = [x for name, c in attributes.items() for x in (F.lit(name), _json(F.col(c), types[c]))]
    return df.select(
        F.lit(WORLD).alias("world"),
        F.lit(VERSION).alias("version"),
        F.concat(F.lit(f"{kind}:"), F.col(key).cast("string")).alias("id"),
        F.lit("code").alias("model"),
        F.lit(kind).alias("kind"),
        F.col(label).cast("string").alias("label"),
        (F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")).alias("attributes"),
        F.array().cast(f"array<{MEASUREMENT}>").alias("measurements"),
        F.array().cast(f"array<{SCORE}>").alias("scores"),
    )


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One kind of entity per table; a filter on kind prunes the others' scans."""
    t = lambda n: table(spark, sf_dir, n)
    parts = [
        entity_frame(t("region"), "region", "r_regionkey", "r_name", {}),
        entity_frame(t("nation"), "nation", "n_nationkey", "n_name", {}),
        entity_frame(t("customer"), "customer", "c_custkey", "c_name", {"segment": "c_mktsegment", "nation": "c_nationkey"}),
        entity_frame(t("supplier"), "supplier", "s_suppkey", "s_name", {"nation": "s_nationkey"}),
        entity_frame(t("part"), "part", "p_partkey", "p_name", {"brand": "p_brand", "type": "p_type", "size": "p_size"}),
        entity_frame(t("orders"), "order", "o_orderkey", "o_orderkey", {"status": "o_orderstatus"}),
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


def _edge(df: DataFrame, kind: str, a: tuple[str, str], b: tuple[str, str]) -> DataFrame:
    end = lambda k, c: F.concat(F.lit(f"{k}:"), F.col(c).cast("string"))
    e = df.select(end(*a).alias("from_id"), end(*b).alias("to_id"))
    name = F.concat("from_id", F.lit(f":{kind}:"), "to_id")
    return e.select(
        F.lit(WORLD).alias("world"), F.lit(VERSION).alias("version"), name.alias("id"), F.lit("code").alias("model"), F.lit(kind).alias("kind"), "from_id", "to_id", F.lit(WEIGHTS[kind]).alias("weight"), F.create_map().cast("map<string,string>").alias("attributes")
    )


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """contains: region, nation, customer and supplier; references: order to
    customer; calls: order to part; imports: part to supplier. Pairs of
    lineitem are made distinct as integers, before they become ids."""
    t = lambda n: table(spark, sf_dir, n)
    items = t("lineitem")
    parts = [
        _edge(t("nation"), "contains", ("region", "n_regionkey"), ("nation", "n_nationkey")),
        _edge(t("customer"), "contains", ("nation", "c_nationkey"), ("customer", "c_custkey")),
        _edge(t("supplier"), "contains", ("nation", "s_nationkey"), ("supplier", "s_suppkey")),
        _edge(t("orders"), "references", ("order", "o_orderkey"), ("customer", "o_custkey")),
        _edge(items.select("l_orderkey", "l_partkey").distinct(), "calls", ("order", "l_orderkey"), ("part", "l_partkey")),
        _edge(items.select("l_partkey", "l_suppkey").distinct(), "imports", ("part", "l_partkey"), ("supplier", "l_suppkey")),
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


def part_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, label, kind and the ten metrics of every part that was ordered.

    The distinct counts expand the rows, but stay in hash aggregation with
    partial combination; sets of values would fall back to sorting."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("day"), "o_orderpriority")
    n = F.count("*")
    made = (
        items.join(orders, "l_orderkey")
        .groupBy("l_partkey")
        .agg(
            n.alias("loc"),
            F.count_distinct("l_suppkey").alias("cc"),
            F.count_distinct("l_returnflag").alias("params"),
            F.count_distinct("l_orderkey").alias("incoming"),
            F.count_distinct("o_orderpriority").alias("contributors"),
            (F.max("day") - F.min("day")).alias("span"),
            (F.count_if(F.col("l_returnflag") == "N") / n).alias("line_cov"),
            (F.count_if(F.col("l_linestatus") == "F") / n).alias("branch_cov"),
        )
        .withColumn("outgoing", F.col("cc"))
        .withColumn("commits", F.col("incoming"))
        .withColumn("avg_days", F.when(F.col("commits") > 1, F.col("span") / F.lit(86400.0) / (F.col("commits") - 1)).otherwise(F.lit(0.0)))
    )
    names = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("label"))
    return made.join(names, "l_partkey").select(F.concat(F.lit("part:"), F.col("l_partkey").cast("string")).alias("id"), "label", F.lit("part").alias("kind"), *METRICS)


def part_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, label, kind and the four scores of parts."""
    m = part_metrics(spark, sf_dir)
    return m.select("id", "label", "kind", *[c.alias(d) for d, c in score_columns({k: F.col(k) for k in METRICS}).items()]).dropna(subset=list(DIMENSIONS))


def part_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts with their measurements as evidence of one observer."""
    m = part_metrics(spark, sf_dir)
    evidence = F.array(*[F.struct(F.lit(n).alias("name"), F.col(k).cast("double").alias("value"), F.lit(None).cast("string").alias("unit"), F.lit("star").alias("observer"), F.lit(1.0).alias("confidence")) for k, n in zip(METRICS, REQUIRED, strict=True)])
    return m.select(F.lit(WORLD).alias("world"), F.lit(VERSION).alias("version"), "id", F.lit("code").alias("model"), "kind", "label", F.create_map().cast("map<string,string>").alias("attributes"), evidence.cast(f"array<{MEASUREMENT}>").alias("measurements"), F.array().cast(f"array<{SCORE}>").alias("scores"))


SCORES_SQL = f"""
m AS (
  SELECT 'part:' || l_partkey AS id, any_value(p_name) AS label, count(*)::DOUBLE AS loc, count(DISTINCT l_suppkey)::DOUBLE AS cc,
         count(DISTINCT l_returnflag)::DOUBLE AS params, count(DISTINCT l_orderkey)::DOUBLE AS incoming, count(DISTINCT l_suppkey)::DOUBLE AS outgoing,
         count(DISTINCT l_orderkey)::DOUBLE AS commits, count(DISTINCT o_orderpriority)::DOUBLE AS contributors,
         CASE WHEN count(DISTINCT l_orderkey) > 1 THEN (floor(epoch(max(o_orderdate))) - floor(epoch(min(o_orderdate))))::DOUBLE / 86400.0::DOUBLE / (count(DISTINCT l_orderkey) - 1) ELSE 0 END AS avg_days,
         (count(*) FILTER (l_returnflag = 'N'))::DOUBLE / count(*) AS line_cov, (count(*) FILTER (l_linestatus = 'F'))::DOUBLE / count(*) AS branch_cov
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey GROUP BY l_partkey
), s AS (
  SELECT id, label,
    least(greatest((1.0::DOUBLE - 0.4::DOUBLE * least(commits / greatest(avg_days, 1) / 10, 1)) * (1.0::DOUBLE - 0.3::DOUBLE * least(contributors / 5, 1)) * (0.5::DOUBLE + 0.3::DOUBLE * (0.5::DOUBLE * line_cov + 0.5::DOUBLE * branch_cov)), 0), 1) AS stability,
    least(greatest(0.7::DOUBLE * (cc / greatest(loc / 10, 1)) + 0.3::DOUBLE * least(params / 5, 1), 0), 1) AS logic,
    least(greatest(0.4::DOUBLE * (0.4::DOUBLE * (incoming / greatest(incoming + outgoing, 1)) + 0.6::DOUBLE * least(incoming / 10, 1))
      + 0.3::DOUBLE * (0.7::DOUBLE * least(commits / 50, 1) + 0.3::DOUBLE * least(contributors / 10, 1)) + 0.3::DOUBLE * least(cc / 20, 1), 0), 1) AS friction,
    least(greatest(0.8::DOUBLE * (1.0::DOUBLE - outgoing / greatest(incoming + outgoing, 1)) + 0.2::DOUBLE * (1.0::DOUBLE - least(outgoing / 30, 1)), 0), 1) AS autonomy
  FROM m
)"""
