"""Function metrics from the CSV of an external analyser, as observations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.functions.scalars import contains_id, detect_language, file_id, json_string, symbol_id
from orrery.schema import MEASUREMENT, SCORE

#: Columns of the CSV, in order, if it has no header.
COLUMNS = ("NLOC", "CCN", "token", "PARAM", "length", "location", "file", "function", "long_name", "start", "end")


def read_lizard(spark: SparkSession, path: str, header: bool = False) -> DataFrame:
    """path, name, qualified_name, nloc, ccn, params, line_start, line_end; rows
    without a name are left out. Quotes double inside quotes and may span lines."""
    reader = spark.read.option("multiLine", True).option("escape", '"').option("header", header)
    df = reader.csv(path) if header else reader.schema(", ".join(f"`{c}` string" for c in COLUMNS)).csv(path)
    known = {c.lower(): c for c in df.columns}
    pick = lambda *names: F.col(f"`{next(known[n.lower()] for n in names if n.lower() in known)}`")
    name = F.trim(pick("function", "name"))
    long_name = F.trim(F.split(F.coalesce(pick("long_name", "long name"), name), r"\(")[0])
    return df.where(name != "").select(
        F.regexp_replace(pick("file", "filename"), "^/+", "").alias("path"),
        name.alias("name"),
        long_name.alias("qualified_name"),
        pick("NLOC").cast("long").alias("nloc"),
        pick("CCN", "cyclomatic_complexity").cast("long").alias("ccn"),
        pick("PARAM", "parameter_count").cast("long").alias("params"),
        pick("start", "start_line").cast("long").alias("line_start"),
        pick("end", "end_line").cast("long").alias("line_end"),
    )


def lizard_symbols(rows: DataFrame, world: str, version: str) -> tuple[DataFrame, DataFrame]:
    """(entities, relations): a symbol for each row of a known language and the
    edge from its file."""
    known = rows.withColumn("language", detect_language(F.col("path"))).where("language IS NOT NULL")
    dotted = F.contains(F.col("qualified_name"), F.lit("::")) | F.contains(F.col("qualified_name"), F.lit("."))
    kind = F.when(F.col("language") == "rust", "unknown").when(dotted, "method").otherwise("function")
    m = lambda name, c: F.struct(F.lit(name).alias("name"), F.col(c).cast("double").alias("value"), F.lit("count").alias("unit"), F.lit("lizard").alias("observer"), F.lit(0.8).alias("confidence"))
    sid = symbol_id(F.col("path"), F.col("name"), F.col("line_start"))
    fixed = (F.lit(world).alias("world"), F.lit(version).alias("version"))
    entities = known.select(
        *fixed,
        sid.alias("id"),
        F.lit("code").alias("model"),
        kind.alias("kind"),
        F.col("qualified_name").alias("label"),
        F.create_map(
            F.lit("language"), json_string(F.col("language")), F.lit("file_path"), json_string(F.col("path")), F.lit("line_start"), F.col("line_start").cast("string"), F.lit("lizard.line_end"), F.col("line_end").cast("string")
        ).alias("attributes"),
        F.array(m("code.lines_of_code", "nloc"), m("code.cyclomatic_complexity", "ccn"), m("code.parameters", "params")).cast(f"array<{MEASUREMENT}>").alias("measurements"),
        F.array().cast(f"array<{SCORE}>").alias("scores"),
    )
    relations = known.select(
        *fixed, contains_id(F.col("path"), sid).alias("id"), F.lit("code").alias("model"), F.lit("contains").alias("kind"), file_id(F.col("path")).alias("from_id"), sid.alias("to_id"), F.lit(1.0).alias("weight")
    ).distinct().withColumn("attributes", F.create_map().cast("map<string,string>"))
    return entities, relations
