"""Small inputs for the sources, made from the driver's tables: a repository, a
store, reports, sources and saved answers, so that SQL can say what is in them."""

from __future__ import annotations

import os
import subprocess
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.folders import shared_folder
from orrery.plans import star
from orrery.plans.star import table
from orrery.store import SnapshotStore

DAYS = ("2024-01-01", "2024-01-11", "2024-03-01")


def _git(root: str, *args: str, day: str = DAYS[0], who: str = "ada") -> None:
    said = {f"GIT_{r}_{k}": v for r in ("AUTHOR", "COMMITTER") for k, v in (("NAME", who), ("EMAIL", f"{who}@x.org"), ("DATE", f"{day}T00:00:00Z"))}
    quiet = {"GIT_CONFIG_GLOBAL": os.devnull, "GIT_CONFIG_SYSTEM": os.devnull}
    subprocess.run(["git", "-C", root, *args], check=True, capture_output=True, env=os.environ | said | quiet)


def repository(spark: SparkSession, sf_dir: str) -> str:
    """A file for each nation: Rust for the first twenty, then text. Even ones
    change once; the first is renamed at last. In a folder of the driver, as
    Git reads it there."""
    root = tempfile.mkdtemp(prefix="orrery-repository-")
    _git(root, "init", "-q", "-b", "main")
    _git(root, "remote", "add", "origin", "git@github.com:acme/fixture.git")
    rows = table(spark, sf_dir, "nation").select("n_nationkey", "n_name").orderBy("n_nationkey").collect()
    at = {k: Path(root, f"src/nation{k}.rs" if k < 20 else f"docs/nation{k}.md") for k, _ in rows}
    for k, name in rows:
        at[k].parent.mkdir(exist_ok=True)
        at[k].write_text(f"fn n{k}() {{}}\n// {name}\n")
    _git(root, "add", "-A")
    _git(root, "commit", "-qm", "one")
    for k, _ in rows:
        if k % 2 == 0:
            with at[k].open("a") as f:
                f.write("// two\n")
    _git(root, "commit", "-qam", "two", day=DAYS[1], who="grace")
    _git(root, "mv", "src/nation0.rs", "src/renamed.rs")
    _git(root, "commit", "-qm", "three", day=DAYS[2])
    return root


#: The files at the last commit, for SQL.
REPOSITORY_SQL = """
repo AS (
  SELECT n_nationkey AS k, CASE WHEN n_nationkey = 0 THEN 'src/renamed.rs' WHEN n_nationkey < 20 THEN 'src/nation' || n_nationkey || '.rs' ELSE 'docs/nation' || n_nationkey || '.md' END AS path,
         CASE WHEN n_nationkey < 20 THEN 'rust' END AS language,
         'fn n' || n_nationkey || '() {}' || chr(10) || '// ' || n_name || chr(10) || CASE WHEN n_nationkey % 2 = 0 THEN '// two' || chr(10) ELSE '' END AS content,
         CASE WHEN n_nationkey = 0 THEN 3 WHEN n_nationkey % 2 = 0 THEN 2 ELSE 1 END AS commits
  FROM nation)"""


def stored(spark: SparkSession, sf_dir: str) -> SnapshotStore:
    """A store with two snapshots of one world: regions, nations and suppliers
    with their contains edges, and an empty one."""
    store = SnapshotStore(spark, shared_folder(spark, "store"))
    entities = star.entities(spark, sf_dir).where("kind IN ('region', 'nation', 'supplier')")
    relations = star.relations(spark, sf_dir).where("kind = 'contains' AND NOT startswith(to_id, 'customer:')")
    store.ingest(star.WORLD, star.VERSION, entities, relations, provenance=[{"observer": "star", "version": "1", "configuration_digest": None, "source": None}])
    later = lambda d: d.limit(0).withColumn("version", F.lit("v2"))
    store.ingest(star.WORLD, "v2", later(entities), later(relations), "unavailable")
    return store


def lcov(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(report, value): an LCOV report of each supplier's line items."""
    items = table(spark, sf_dir, "lineitem").where("l_suppkey <= 20")
    day = F.unix_date(F.col("l_shipdate").cast("date")).cast("string")
    taken = F.when(F.col("l_linenumber") % 3 == 0, "-").otherwise((F.col("l_linenumber") % 3 - 1).cast("string"))
    records = F.concat(F.lit("DA:"), day, F.lit(","), F.when(F.col("l_returnflag") == "N", "2").otherwise("0"), F.lit("\nBRDA:"), day, F.lit(",0,"), F.col("l_linenumber").cast("string"), F.lit(","), taken, F.lit("\n"))
    each = items.groupBy("l_suppkey").agg(F.array_join(F.sort_array(F.collect_list(records)), "").alias("body"))
    return each.select(F.col("l_suppkey").alias("report"), F.concat(F.lit("TN:x\nSF:/w/s"), F.col("l_suppkey").cast("string"), F.lit(".rs\n"), "body", F.lit("LF:9\nend_of_record\n")).alias("value"))


def cobertura(spark: SparkSession, sf_dir: str) -> str:
    """A folder of Cobertura reports, one for each supplier."""
    items = table(spark, sf_dir, "lineitem").where("l_suppkey <= 20")
    day = F.unix_date(F.col("l_shipdate").cast("date"))
    lines = items.groupBy("l_suppkey", day.alias("line")).agg(F.count_if(F.col("l_returnflag") == "N").alias("hits"), F.count("*").alias("total"), F.count_if(F.col("l_linestatus") == "F").alias("covered"))
    text = F.format_string('<line number="%d" hits="%d" branch="true" condition-coverage="50%% (%d/%d)"/>', "line", "hits", "covered", "total")
    classes = lines.groupBy("l_suppkey").agg(F.array_join(F.sort_array(F.collect_list(text)), "\n").alias("body"))
    report = F.concat(F.lit('<?xml version="1.0"?><coverage><packages><package><classes><class name="S" filename="src/s'), F.col("l_suppkey").cast("string"), F.lit('.cs"><lines>'), "body", F.lit("</lines></class></classes></package></packages></coverage>"))
    folder = shared_folder(spark, "cobertura")
    classes.select(report).write.option("maxRecordsPerFile", 1).text(folder)
    return folder


def metric_csv(spark: SparkSession, sf_dir: str) -> str:
    """A folder of metric CSV: quoted names, long names over two lines."""
    p = table(spark, sf_dir, "part").where("p_partkey <= 200").withColumn("k", F.col("p_partkey"))
    ext = F.element_at(F.array(F.lit("cs"), F.lit("py"), F.lit("rs"), F.lit("txt")), (F.col("k") % 4 + 1).cast("int"))
    row = F.format_string('%d,%d,20,%d,9,"at, here","/src/p%d.%s","%s","%s( int ""a"",\n int b )",%d,%d', "p_size", (F.col("p_size") % 7 + 1), (F.col("p_size") % 4), "k", ext, F.when(F.col("k") % 10 == 0, "").otherwise(F.concat(F.lit("f"), F.col("k").cast("string"))), F.when(F.col("k") % 3 == 0, F.concat(F.lit("Box::f"), F.col("k").cast("string"))).otherwise(F.concat(F.lit("f"), F.col("k").cast("string"))), F.col("k") + 1, F.col("k") + F.col("p_size"))
    folder = shared_folder(spark, "metrics")
    p.coalesce(1).select(row).write.text(folder)
    return folder


def rust_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, language, content): a file for each region, a function for each of
    its nations; region 1's does not close, region 2's is known by extension
    only, and a text file is no source."""
    n = table(spark, sf_dir, "nation").orderBy("n_nationkey").collect()
    rows = []
    for k in sorted({r["n_regionkey"] for r in n}):
        body = f"use std::r{k};\nuse std::r{k};\n"
        for r in (r for r in n if r["n_regionkey"] == k):
            key = r["n_nationkey"]
            body += f"pub fn n{key}(a: i32, b: i32) -> i32 {{\n" + "    if (a > 0 && b > 0) == true { return 1; }\n" * (key % 3) + "    a\n}\n"
        rows.append((f"src/r{k}.rs", None if k == 2 else "rust", body + ("fn broken( {\n" if k == 1 else "")))
    rows.append(("notes.txt", None, "fn none() {}"))
    return spark.createDataFrame(rows, "path string, language string, content string")


#: Functions of those files, for SQL.
RUST_SQL = """
fns AS (
  SELECT *, CAST(3 + coalesce(sum(key % 3 + 3) OVER (PARTITION BY region ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS line_start
  FROM (SELECT n_nationkey AS key, n_regionkey AS region, 'src/r' || n_regionkey || '.rs' AS path FROM nation))"""


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, symbols): a class with one method for each supplier of a nation,
    ten lines apart."""
    s = table(spark, sf_dir, "supplier").where("s_suppkey <= 80").select("s_suppkey", "s_nationkey").orderBy("s_suppkey").collect()
    per: dict[int, list] = {}
    for r in s:
        per.setdefault(r["s_nationkey"], []).append(r["s_suppkey"])
    span = lambda a, b, c: {"start": {"line": a, "character": c}, "end": {"line": b, "character": 0}}
    import json

    rows = []
    for nation, keys in per.items():
        tree = []
        for i, k in enumerate(keys):
            run = {"name": "run", "kind": 6, "range": span(10 * i + 2, 10 * i + 4, 4), "selectionRange": span(10 * i + 2, 10 * i + 2, 8)}
            tree.append({"name": f"S{k}", "kind": 5, "detail": f"class S{k} : a.S{k - 1}<int>, IThing{k % 3}", "range": span(10 * i, 10 * i + 8, 0), "selectionRange": span(10 * i, 10 * i, 6), "children": [run]})
        rows.append((f"n{nation}.cs", json.dumps([{"name": "Star", "kind": 3, "range": span(0, 999, 0), "children": tree}])))
    return spark.createDataFrame(rows, "path string, symbols string")


#: Classes (c) and their ids, for SQL: name, path, first line from 0.
ANSWERS_SQL = """
c AS (
  SELECT *, 'S' || key AS name, 'n' || nation || '.cs' AS path, 10 * (row_number() OVER (PARTITION BY nation ORDER BY key) - 1) AS line
  FROM (SELECT s_suppkey AS key, s_nationkey AS nation FROM supplier WHERE s_suppkey <= 80)),
sym AS (
  SELECT *, 'node_' || left(sha256(lower(path || ':' || name || ':' || (line + 1))), 32) AS id, 'node_' || left(sha256(lower(path || ':run:' || (line + 3))), 32) AS method FROM c)"""
