"""Readers of coverage reports: LCOV and Cobertura, as (file, line, hit,
branches_covered, branches_total).

LCOV needs line order within a file, so each report is read whole as one row
and parsed by expressions; reports are many and small, and spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orrery.schema import InvalidRequest


def coverage_detect(head: str) -> str:
    """`lcov` or `cobertura`, by a report's first characters."""
    text = head.lstrip("﻿ \t\r\n")
    if text.startswith(("TN:", "SF:")):
        return "lcov"
    if text.startswith("<") and "<coverage" in text:
        return "cobertura"
    raise InvalidRequest("unknown coverage format")


def read_lcov(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """Lines of LCOV reports. Records other than SF, DA, BRDA and
    end_of_record are ignored; a DA or BRDA before SF and a count that is no
    number raise an error when the result is read."""
    reports = spark.read.text(paths, wholetext=True).select(F.monotonically_increasing_id().alias("report"), "value")
    return parse_lcov(reports)


def parse_lcov(reports: DataFrame) -> DataFrame:
    """As read_lcov, from (report, value)."""
    lines = reports.select("report", F.posexplode(F.split("value", "\r?\n")).alias("n", "t")).select("report", "n", F.trim("t").alias("t"))
    kind = F.regexp_extract("t", r"^(SF|DA|BRDA):", 1)
    mark = F.when(F.col("t") == "end_of_record", F.struct(F.lit(None).cast("string").alias("file"))).when(kind == "SF", F.struct(F.substring("t", 4, 1 << 30).alias("file")))
    order = W.partitionBy("report").orderBy("n").rowsBetween(W.unboundedPreceding, 0)
    rows = lines.withColumn("file", F.last(mark, ignorenulls=True).over(order)["file"]).withColumn("kind", kind).where("kind IN ('DA', 'BRDA')")
    body = F.split(F.regexp_replace("t", r"^\w+:", ""), ",")
    error = lambda what: F.raise_error(F.concat(F.lit(f"{what}: "), F.col("t")))
    number = lambda c: F.when(F.regexp_like(c, F.lit(r"^\s*\d+\s*$")), F.trim(c).cast("long"))
    line, taken = number(F.get(body, 0)), F.when(F.col("kind") == "DA", number(F.get(body, 1)))
    checked = rows.withColumn("line", F.when(F.col("file").isNull(), error("record before SF")).when(line.isNull(), error("bad line number")).otherwise(line))
    checked = checked.withColumn("count", F.when((F.col("kind") == "DA") & taken.isNull(), error("bad count")).otherwise(taken))
    branch = F.coalesce(number(F.get(body, 3)), F.lit(0)) > 0
    return checked.withColumn("branch", (F.col("kind") == "BRDA") & branch).groupBy("report", "file", "line").agg(
        F.coalesce(F.max(F.col("count") > 0), F.lit(False)).alias("hit"),
        F.count_if("branch").alias("branches_covered"),
        F.count_if(F.col("kind") == "BRDA").alias("branches_total"),
    ).drop("report")




def read_cobertura(spark: SparkSession, paths: str) -> DataFrame:
    """Lines of Cobertura reports; one row tag per class, so that large reports
    need no tree in memory."""
    schema = "_filename string, lines struct<line:array<struct<_number:string,_hits:string,`_condition-coverage`:string>>>"
    found = spark.read.format("xml").option("rowTag", "class").schema(schema).load(paths)
    rows = found.select(F.col("_filename").alias("file"), F.explode("lines.line").alias("x")).select("file", "x.*")
    pair = lambda i: F.coalesce(F.expr(f"try_cast(regexp_extract(`_condition-coverage`, '\\\\((\\\\d+)/(\\\\d+)\\\\)', {i}) AS BIGINT)"), F.lit(0))
    each = rows.select("file", F.col("_number").cast("long").alias("line"), (F.col("_hits").cast("long") > 0).alias("hit"), pair(1).alias("branches_covered"), pair(2).alias("branches_total"))
    return each.groupBy("file", "line").agg(F.max("hit").alias("hit"), F.max("branches_covered").alias("branches_covered"), F.max("branches_total").alias("branches_total"))
