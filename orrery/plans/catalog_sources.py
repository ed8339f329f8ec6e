"""Queries of the sources, the store and the language servers, over inputs made
from the driver's tables, with their SQL."""

from __future__ import annotations

import sys
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.functions import scalars
from orrery.operators import derive, diff, find, merge, rank, traverse
from orrery.plans import fixtures, star
from orrery.plans.catalog import _observers, registered
from orrery.plans.star import table
from orrery.schema import ENTITY_DDL, RELATION_DDL, QueryError
from orrery.session import Router
from orrery.sources import coverage, git, lizard, lsp, lsp_registry, lsp_session, runtimes, rust, syntax


def values(rows: list[tuple], names: str) -> str:
    """SQL of a few literal rows."""
    text = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(text, r)) + ')' for r in rows)}) v({names})"


# ---------------------------------------------------------------- batches

@registered("""
SELECT 'doc:' || doc_id AS id, 'text' AS model, 'document' AS kind, 'doc.' || source || '.' || lang AS label, CASE WHEN l THEN 2 ELSE 1 END AS n_attributes, CASE WHEN l THEN 2 ELSE 1 END AS n_measurements, 1 AS n_scores,
       'partial' AS coverage, 'a,b,c' AS observers
FROM (SELECT *, doc_id IN (SELECT doc_id FROM labels) AS l FROM documents WHERE doc_id % 97 <> 0)
""")
def merge_batches(spark: SparkSession, d: str) -> DataFrame:
    """Three observers' batches as one, without the documents that conflict."""
    seen = _observers(spark, d).where(F.regexp_extract("id", r"(\d+)", 1).cast("long") % 97 != 0)
    none = spark.createDataFrame([], RELATION_DDL)
    frame = lambda k: seen.where(F.col("observer_rank") == k).drop("observer_rank").select(F.lit("w").alias("world"), F.lit("v").alias("version"), "*")
    found = merge.merge_batches([merge.Batch("w", "v", frame(k), none, o, coverage=c, provenance=[{"observer": o}]) for k, (o, c) in enumerate((("a", "complete"), ("b", "complete"), ("c", "partial")))])
    size = lambda c: F.size(c).alias(f"n_{c}")
    return found.entities.select("id", "model", "kind", "label", size("attributes"), size("measurements"), size("scores"), F.lit(found.coverage).alias("coverage"), F.lit(",".join(p["observer"] for p in found.provenance)).alias("observers"))


# ---------------------------------------------------------------- store

_COUNTS = "(SELECT count(*) FROM region) + (SELECT count(*) FROM nation) + (SELECT count(*) FROM supplier)"


@registered(f"SELECT 'star' AS world, 'v1' AS version, 'complete' AS coverage, {_COUNTS} AS entity_count, (SELECT count(*) FROM nation) + (SELECT count(*) FROM supplier) AS relation_count")
def ingest(spark: SparkSession, d: str) -> DataFrame:
    return fixtures.stored(spark, d).snapshots().where("version = 'v1'").select("world", "version", "coverage", "entity_count", "relation_count")


@registered(f"SELECT 'v1' AS version, {_COUNTS} AS entity_count UNION ALL SELECT 'v2', 0")
def snapshots_list(spark: SparkSession, d: str) -> DataFrame:
    return fixtures.stored(spark, d).snapshots(star.WORLD).select("version", "entity_count")


@registered("SELECT 'v2' AS version, 'unavailable' AS coverage, 0::BIGINT AS relation_count, false AS known_other")
def snapshot_get(spark: SparkSession, d: str) -> DataFrame:
    store = fixtures.stored(spark, d)
    one = store.snapshot(star.WORLD, "v2")
    return spark.createDataFrame([(one["version"], one["coverage"], one["relation_count"], store.snapshot(star.WORLD, "v3") is not None)], "version string, coverage string, relation_count long, known_other boolean")


@registered("SELECT 'supplier:' || s_suppkey AS id, s_name AS label FROM supplier WHERE s_suppkey = 7")
def entity_lookup(spark: SparkSession, d: str) -> DataFrame:
    store = fixtures.stored(spark, d)
    return store.entity(star.WORLD, "v1", "supplier:7").unionByName(store.entity(star.WORLD, "v1", "supplier:none")).unionByName(store.entity(star.WORLD, "v9", "supplier:7")).select("id", "label")


@registered("SELECT 'region:' || r_regionkey AS id, 'region' AS kind, r_name AS label FROM region UNION ALL SELECT 'nation:' || n_nationkey, 'nation', n_name FROM nation UNION ALL SELECT 'supplier:' || s_suppkey, 'supplier', s_name FROM supplier")
def entities_scan(spark: SparkSession, d: str) -> DataFrame:
    return fixtures.stored(spark, d).entities_scan(star.WORLD, "v1").select("id", "kind", "label")


@registered("SELECT 'region:' || n_regionkey || ':contains:nation:' || n_nationkey AS id, 1.0::DOUBLE AS weight FROM nation UNION ALL SELECT 'nation:' || s_nationkey || ':contains:supplier:' || s_suppkey, 1.0 FROM supplier")
def relations_scan(spark: SparkSession, d: str) -> DataFrame:
    return fixtures.stored(spark, d).relations_scan(star.WORLD, "v1").select("id", "weight")


# ---------------------------------------------------------------- differences

def _versions(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Suppliers and their nations' edges in two versions that differ by key."""
    key = lambda c: F.regexp_extract(c, r"supplier:(\d+)$", 1).cast("long")
    e = star.entities(spark, d).where("kind = 'supplier'")
    r = star.relations(spark, d).where("kind = 'contains' AND startswith(to_id, 'supplier:')")
    k, t = key("id"), key("to_id")
    now = lambda df: df.withColumn("version", F.lit("v2"))
    late_e = now(e.where(k % 7 != 0)).withColumn("label", F.when(k % 11 == 0, F.concat("label", F.lit("!"))).otherwise(F.col("label")))
    late_r = now(r.where(t % 7 != 0)).withColumn("weight", F.when(t % 13 == 0, 0.5).otherwise(F.col("weight")))
    return e.where(k % 5 != 0).unionByName(late_e), r.where(t % 5 != 0).unionByName(late_r)


@registered("""
WITH s AS (SELECT s_suppkey AS k, s_suppkey % 5 <> 0 AS a, s_suppkey % 7 <> 0 AS b, s_name, s_nationkey FROM supplier),
x AS (SELECT *, CASE WHEN NOT a AND b THEN 'added' WHEN a AND NOT b THEN 'removed' END AS gone FROM s WHERE a OR b)
SELECT 'entity' AS side, coalesce(gone, 'changed') AS change, 'supplier:' || k AS id, CASE WHEN a THEN s_name END AS label_before, CASE WHEN b THEN s_name || CASE WHEN k % 11 = 0 THEN '!' ELSE '' END END AS label_after
FROM x WHERE gone IS NOT NULL OR k % 11 = 0
UNION ALL SELECT 'relation', coalesce(gone, 'changed'), 'nation:' || s_nationkey || ':contains:supplier:' || k, NULL, NULL FROM x WHERE gone IS NOT NULL OR k % 13 = 0
""")
def snapshot_diff(spark: SparkSession, d: str) -> DataFrame:
    """diff() of two stored versions."""
    found = diff.diff(*_versions(spark, d), (star.WORLD, "v1"), (star.WORLD, "v2"))
    label = lambda c: F.get_json_object(c, "$.label").alias(f"label_{c}")
    return found.select("side", "change", "id", label("before"), label("after"))


@registered("SELECT 'entity' AS side, 'supplier:' || s_suppkey AS id FROM supplier WHERE s_suppkey % 4 = 0 UNION ALL SELECT 'relation', 'nation:' || s_nationkey || ':contains:supplier:' || s_suppkey FROM supplier WHERE s_suppkey % 3 = 0")
def diff_equality(spark: SparkSession, d: str) -> DataFrame:
    """Attributes compare in any order, measurements in theirs, weights by bits."""
    key = lambda c: F.regexp_extract(c, r"supplier:(\d+)$", 1).cast("long")
    m = lambda n: F.struct(F.lit(n).alias("name"), F.lit(1.0).alias("value"), F.lit(None).cast("string").alias("unit"), F.lit("o").alias("observer"), F.lit(1.0).alias("confidence"))
    e = star.entities(spark, d).where("kind = 'supplier'")
    r = star.relations(spark, d).where("kind = 'contains' AND startswith(to_id, 'supplier:')")
    pairs = lambda *names: F.create_map(*[F.lit(x) for n in names for x in (n, f'"{n}"')])
    was = e.withColumn("attributes", pairs("a", "b")).withColumn("measurements", F.array(m("x"), m("y")))
    now = e.withColumn("attributes", pairs("b", "a")).withColumn("measurements", F.when(key("id") % 4 == 0, F.array(m("y"), m("x"))).otherwise(F.array(m("x"), m("y"))))
    later = lambda df: df.withColumn("version", F.lit("v2"))
    zero = r.withColumn("weight", F.lit(0.0))
    signed = r.withColumn("weight", F.concat(F.when(key("to_id") % 3 == 0, "-").otherwise(""), F.lit("0.0")).cast("double"))
    found = diff.diff(was.unionByName(later(now)), zero.unionByName(later(signed)), (star.WORLD, "v1"), (star.WORLD, "v2"))
    return found.select("side", "id")


_ERRORS = [("foreign world", "DifferentWorlds"), ("no nodes", "InvalidNodeLimit"), ("limit 0", "InvalidRequest"), ("no root", "EntityNotFound"), ("bad direction", "InvalidRequest"), ("broken batch", "InvalidBatch"), ("conflict", "ConflictError")]


@registered(values(_ERRORS, "request, error"))
def errors(spark: SparkSession, d: str) -> DataFrame:
    """The error that each kind of bad request raises."""
    e, r = star.entities(spark, d).where("kind = 'region'"), star.relations(spark, d).where("kind = 'contains' AND startswith(from_id, 'region:')")
    store = fixtures.stored(spark, d)
    other = e.withColumn("model", F.lit("other"))
    requests = {
        "foreign world": lambda: diff.diff(e, r, ("a", "v"), ("b", "v")),
        "no nodes": lambda: traverse.traverse(e, r, "region:0", max_nodes=0),
        "limit 0": lambda: rank.unstable(e, limit=0),
        "no root": lambda: traverse.traverse(e, r, "region:none"),
        "bad direction": lambda: find.relations_of(r, "region:0", "sideways"),
        "broken batch": lambda: store.ingest(star.WORLD, "v1", e.unionByName(e), r.limit(0)),
        "conflict": lambda: merge.merge(merge.union_ranked([e, other])),
    }
    rows = []
    for name, request in requests.items():
        try:
            request()
        except QueryError as error:
            rows.append((name, type(error).__name__))
    return spark.createDataFrame(rows, "request string, error string")


# ---------------------------------------------------------------- entities' parts

@registered("SELECT 'order:' || o_orderkey AS id, o_orderstatus AS label, 'order' AS kind, 'c\"' || o_custkey || '.rs' AS path, o_custkey::BIGINT AS line_start, NULL::BIGINT AS line_end FROM orders")
def summary(spark: SparkSession, d: str) -> DataFrame:
    """Orders with a place each; their last lines are no numbers."""
    path = scalars.json_string(F.concat(F.lit('c"'), F.col("o_custkey").cast("string"), F.lit(".rs")))
    e = table(spark, d, "orders").select(
        F.concat(F.lit("order:"), F.col("o_orderkey").cast("string")).alias("id"), F.col("o_orderstatus").alias("label"), F.lit("order").alias("kind"),
        F.create_map(F.lit("file_path"), path, F.lit("line_start"), F.col("o_custkey").cast("string"), F.lit("line_end"), F.lit('"9"')).alias("attributes"),
    )
    return find.summary(e)


@registered("SELECT doc_id, CASE WHEN n_chars % 2 = 0 THEN n_chars END AS n, NULL::BIGINT AS half, NULL::BIGINT AS negative FROM documents")
def count_measurement(spark: SparkSession, d: str) -> DataFrame:
    """The first measurement of a name, if it counts."""
    m = lambda n, v: F.struct(F.lit(n).alias("name"), v.cast("double").alias("value"))
    odd = F.when(F.col("n_chars") % 2 == 0, F.col("n_chars")).otherwise(F.col("n_chars") + 0.25)
    e = table(spark, d, "documents").select("doc_id", F.array(m("n", odd), m("n", F.lit(1)), m("half", F.col("n_chars") + 0.5), m("negative", -F.col("n_chars") - 1)).alias("measurements"))
    return e.select("doc_id", *[find.count_measurement(n).alias(n) for n in ("n", "half", "negative")])


@registered(values([("python",), ("rust",)], "language"))
def semantic_languages(spark: SparkSession, d: str) -> DataFrame:
    told = [("lsp.registered", "python"), ("lsp.rust-analyzer", None), ("lsp.registered", ""), ("treesitter.rust", "go"), ("lsp.other", None)]
    return spark.createDataFrame([(x,) for x in sorted(derive.semantic_languages([{"observer": o, "source": s} for o, s in told]))], "language string")


@registered("""
WITH r AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem)
SELECT 'supplier:' || s_suppkey AS id, CASE WHEN s_suppkey % 2 = 0 THEN (SELECT count(*) FROM r WHERE l_suppkey = s_suppkey) END AS incoming, CASE WHEN s_suppkey % 2 = 0 THEN 0 END AS outgoing FROM supplier
""")
def graph_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Degrees as evidence, for suppliers whose language a server covered."""
    k = F.regexp_extract("id", r"(\d+)$", 1).cast("long")
    e = star.entities(spark, d).where("kind = 'supplier'").withColumn("attributes", F.create_map(F.lit("language"), F.when(k % 2 == 0, F.lit('"python"')).otherwise(F.lit('"go"'))))
    found = derive.derive_graph_metrics(e, star.relations(spark, d), [{"observer": "lsp.registered", "source": "python"}])
    return found.select("id", *[find.count_measurement(f"graph.{n}_edges").alias(n) for n in ("incoming", "outgoing")])


@registered("""
WITH p AS (SELECT DISTINCT 'src/' || CASE WHEN s_suppkey % 3 = 0 THEN 'deep/' ELSE '' END || 's' || (s_suppkey % 40) || '.rs' AS path FROM supplier),
f AS (SELECT DISTINCT CASE s_suppkey % 4 WHEN 0 THEN '/w/src/s' WHEN 1 THEN 's' WHEN 2 THEN 'src/s' ELSE '/x/src/s' END || (s_suppkey % 60) || '.rs' AS file FROM supplier),
n AS (SELECT path, file, regexp_replace(file, '^/+', '') AS nf FROM p, f),
m AS (SELECT path, file, path = nf AS same, ends_with(nf, '/' || path) OR ends_with(path, '/' || nf) AS tail FROM n)
SELECT path, coalesce(min(file) FILTER (same), min(file) FILTER (tail)) AS file FROM m GROUP BY path HAVING count(*) FILTER (same) > 0 OR count(*) FILTER (tail) = 1
""")
def coverage_path_match(spark: SparkSession, d: str) -> DataFrame:
    s, k = table(spark, d, "supplier"), F.col("s_suppkey")
    number = lambda n: F.concat((k % n).cast("string"), F.lit(".rs"))
    paths = s.select(F.concat(F.when(k % 3 == 0, "src/deep/s").otherwise("src/s"), number(40)).alias("path")).distinct()
    files = s.select(F.concat(F.when(k % 4 == 0, "/w/src/s").when(k % 4 == 1, "s").when(k % 4 == 2, "src/s").otherwise("/x/src/s"), number(60)).alias("file"))
    return derive.coverage_path_match(paths, files)


# ---------------------------------------------------------------- Git

@registered(values([("github.com/acme/fixture", "main", False, "code.repository:remote:github.com/acme/fixture", True)], "remote, branch, dirty, world, committed"))
def git_inspect(spark: SparkSession, d: str) -> DataFrame:
    info = git.git_inspect(spark, fixtures.repository(spark, d))
    return spark.createDataFrame([(info["remote"], info["branch"], info["dirty"], info["world"], info["version"] == info["commit"] and len(info["commit"]) == 40)], "remote string, branch string, dirty boolean, world string, committed boolean")


def _tree(spark: SparkSession, d: str) -> tuple[str, DataFrame]:
    root = fixtures.repository(spark, d)
    return root, git.git_tree(spark, root, "HEAD")


@registered(f"WITH {fixtures.REPOSITORY_SQL} SELECT path, '100644' AS mode, strlen(content)::BIGINT AS size, language FROM repo")
def git_tree(spark: SparkSession, d: str) -> DataFrame:
    return _tree(spark, d)[1].select("path", "mode", "size", "language")


@registered(f"WITH {fixtures.REPOSITORY_SQL} SELECT path, sha256(content) AS digest FROM repo")
def git_blobs(spark: SparkSession, d: str) -> DataFrame:
    root, files = _tree(spark, d)
    return git.git_blobs(files, root).select("path", F.sha2("content", 256).alias("digest"))


def _history(spark: SparkSession, root: str) -> DataFrame:
    changes = git.git_changes(spark, root, "HEAD", batch=20)
    return git.git_history(changes, int(git._git(root, "show", "-s", "--format=%at", "HEAD")))


_MEASURED = "commits, least(commits, 2) AS contributors, CASE commits WHEN 1 THEN 0.0 WHEN 2 THEN 10.0 ELSE 30.0 END AS average_days, commits AS recent, CASE WHEN commits > 2 THEN 'medium' ELSE 'low' END AS frequency"


@registered(f"WITH {fixtures.REPOSITORY_SQL} SELECT path, {_MEASURED} FROM repo")
def git_history(spark: SparkSession, d: str) -> DataFrame:
    """Histories that follow a rename."""
    return _history(spark, fixtures.repository(spark, d)).select("path", "commits", "contributors", "average_days", "recent", "frequency")


@registered(f"""WITH {fixtures.REPOSITORY_SQL} SELECT 'file:' || path AS id, commits::DOUBLE AS commits, CASE WHEN commits > 1 THEN 'grace' END AS second, 4 AS n_measurements, '2024-01-01T00:00:00Z' AS created,
CASE commits WHEN 1 THEN '2024-01-01T00:00:00Z' WHEN 2 THEN '2024-01-11T00:00:00Z' ELSE '2024-03-01T00:00:00Z' END AS modified, strlen(content)::BIGINT AS size FROM repo WHERE language = 'rust'""")
def git_inventory(spark: SparkSession, d: str) -> DataFrame:
    root, files = _tree(spark, d)
    e = git.git_inventory(files, _history(spark, root), "w", "v")
    value = lambda n: F.get(F.filter("measurements", lambda m: m["name"] == n), F.lit(0))["value"]
    day = lambda n: F.replace(find.string_attribute(n), F.lit("+00:00"), F.lit("Z"))
    return e.select("id", value("git.total_commits").alias("commits"), F.when(value("git.contributors") > 1, "grace").alias("second"), F.size("measurements").alias("n_measurements"), day("git.created_at").alias("created"), day("git.last_modified_at").alias("modified"), find.u32_attribute("file.size_bytes").alias("size"))


@registered(f"WITH {fixtures.REPOSITORY_SQL} SELECT path, CASE WHEN language = 'rust' THEN 'text/x-rust' END AS media_type, CASE WHEN language = 'rust' THEN commits::VARCHAR END AS commits, CASE WHEN language = 'rust' THEN 10 ELSE 2 END AS n FROM repo")
def artifact_attributes(spark: SparkSession, d: str) -> DataFrame:
    root, files = _tree(spark, d)
    found = git.artifact_attributes(files, _history(spark, root))
    return found.select("path", "media_type", F.col("attributes")["git.total_commits"].alias("commits"), F.size("attributes").alias("n"))


@registered("""
WITH RECURSIVE s AS (SELECT n_nationkey AS k, CASE WHEN n_nationkey % 7 <> 3 THEN n_nationkey * 37 % 50 + 1 + CASE WHEN n_nationkey % 11 = 5 THEN 100 ELSE 0 END END AS size FROM nation),
g(k, grp, held) AS (
  SELECT -1::BIGINT, -1::BIGINT, NULL::BIGINT
  UNION ALL
  SELECT g.k + 1, CASE WHEN size IS NOT NULL AND size <= 60 AND held + size <= 60 THEN grp ELSE grp + 1 END,
         CASE WHEN size IS NULL OR size > 60 THEN NULL WHEN held + size <= 60 THEN held + size ELSE size END
  FROM g JOIN s ON s.k = g.k + 1)
SELECT k, grp FROM g WHERE k >= 0
""")
def read_groups(spark: SparkSession, d: str) -> DataFrame:
    keys = [r[0] for r in table(spark, d, "nation").select("n_nationkey").orderBy("n_nationkey").collect()]
    sizes = [None if k % 7 == 3 else k * 37 % 50 + 1 + (100 if k % 11 == 5 else 0) for k in keys]
    return spark.createDataFrame([(keys[i], g) for g, group in enumerate(git.read_groups(sizes, 60)) for i in group], "k long, grp long")


_EXTENSIONS = [*scalars.LANGUAGES, "md", "toml", ""]


def _named(spark: SparkSession, d: str) -> DataFrame:
    ext = F.element_at(F.array(*[F.lit(x) for x in _EXTENSIONS]), (F.col("doc_id") % len(_EXTENSIONS) + 1).cast("int"))
    ext = F.when(F.col("doc_id") % 2 == 0, F.upper(ext)).otherwise(ext)
    return table(spark, d, "documents").select("doc_id", F.concat(F.lit("a.b/f"), F.col("doc_id").cast("string"), F.lit("."), ext).alias("path"))


_LANGUAGE_SQL = f"l AS ({values([(i, e, scalars.LANGUAGES.get(e)) for i, e in enumerate(_EXTENSIONS)], 'i, ext, language')}), n AS (SELECT doc_id, language FROM documents JOIN l ON i = doc_id % {len(_EXTENSIONS)})"


@registered(f"WITH {_LANGUAGE_SQL} SELECT doc_id, language FROM n")
def detect_language(spark: SparkSession, d: str) -> DataFrame:
    return _named(spark, d).select("doc_id", scalars.detect_language(F.col("path")).alias("language"))


@registered(f"WITH {_LANGUAGE_SQL}, m AS ({values(list(scalars.MEDIA_TYPES.items()), 'name, media_type')}) SELECT doc_id, media_type FROM n LEFT JOIN m ON name = language")
def media_type(spark: SparkSession, d: str) -> DataFrame:
    return _named(spark, d).select("doc_id", scalars.media_type(scalars.detect_language(F.col("path"))).alias("media_type"))


# ---------------------------------------------------------------- reports

_DAY = "date_diff('day', DATE '1970-01-01', l_shipdate::DATE)"


@registered(f"SELECT '/w/s' || l_suppkey || '.rs' AS file, {_DAY} AS line, bool_or(l_returnflag = 'N') AS hit, count(*) FILTER (l_linenumber % 3 = 2) AS branches_covered, count(*) AS branches_total FROM lineitem WHERE l_suppkey <= 20 GROUP BY 1, 2")
def lcov_parse(spark: SparkSession, d: str) -> DataFrame:
    return coverage.parse_lcov(fixtures.lcov(spark, d))


@registered(f"SELECT 'src/s' || l_suppkey || '.cs' AS file, {_DAY} AS line, bool_or(l_returnflag = 'N') AS hit, count(*) FILTER (l_linestatus = 'F') AS branches_covered, count(*) AS branches_total FROM lineitem WHERE l_suppkey <= 20 GROUP BY 1, 2")
def cobertura_parse(spark: SparkSession, d: str) -> DataFrame:
    return coverage.read_cobertura(spark, fixtures.cobertura(spark, d))


_HEADS = [("﻿TN:\nSF:a", "lcov"), ("  SF:a", "lcov"), ('<?xml version="1.0"?>\n<coverage line-rate="1">', "cobertura"), ("<html>", "InvalidRequest"), ("DA:1,1", "InvalidRequest"), ("", "InvalidRequest")]


@registered(values([(i, k) for i, (_, k) in enumerate(_HEADS)], "i, kind"))
def coverage_detect(spark: SparkSession, d: str) -> DataFrame:
    def kind(head: str) -> str:
        try:
            return coverage.coverage_detect(head)
        except QueryError as e:
            return type(e).__name__

    return spark.createDataFrame([(i, kind(h)) for i, (h, _) in enumerate(_HEADS)], "i int, kind string")


_CSV = """f AS (SELECT *, CASE k % 4 WHEN 0 THEN 'cs' WHEN 1 THEN 'py' WHEN 2 THEN 'rs' ELSE 'txt' END AS ext, CASE WHEN k % 3 = 0 THEN 'Box::f' ELSE 'f' END || k AS qualified_name
  FROM (SELECT p_partkey AS k, p_size::BIGINT AS size FROM part WHERE p_partkey <= 200 AND p_partkey % 10 <> 0))"""


@registered(f"WITH {_CSV} SELECT 'src/p' || k || '.' || ext AS path, 'f' || k AS name, qualified_name, size AS nloc, size % 7 + 1 AS ccn, size % 4 AS params, k + 1 AS line_start, k + size AS line_end FROM f")
def lizard_csv(spark: SparkSession, d: str) -> DataFrame:
    return lizard.read_lizard(spark, fixtures.metric_csv(spark, d))


@registered(f"""WITH {_CSV}, s AS (SELECT *, 'src/p' || k || '.' || ext AS path FROM f WHERE ext <> 'txt')
SELECT 'node_' || left(sha256(lower(path || ':f' || k || ':' || (k + 1))), 32) AS id, CASE WHEN ext = 'rs' THEN 'unknown' WHEN k % 3 = 0 THEN 'method' ELSE 'function' END AS kind, qualified_name AS label, 'file:' || path AS owner, (size % 7 + 1)::DOUBLE AS complexity FROM s""")
def lizard_symbols(spark: SparkSession, d: str) -> DataFrame:
    e, r = lizard.lizard_symbols(lizard.read_lizard(spark, fixtures.metric_csv(spark, d)), "w", "v")
    value = F.get(F.filter("measurements", lambda m: m["name"] == "code.cyclomatic_complexity"), F.lit(0))["value"]
    return e.join(r.select(F.col("to_id").alias("id"), F.col("from_id").alias("owner")), "id").select("id", "kind", "label", "owner", value.alias("complexity"))


# ---------------------------------------------------------------- syntax

def _rust(spark: SparkSession, d: str) -> DataFrame:
    return fixtures.rust_files(spark, d).where("endswith(path, '.rs')")


@registered(f"WITH {fixtures.RUST_SQL} SELECT 'node_' || left(sha256(lower(path || ':n' || key || ':' || line_start)), 32) AS id, 'n' || key AS name, 'r' || region || '::n' || key AS qualified_name, 'function' AS kind, line_start, line_start + key % 3 + 2 AS line_end, 'pub fn n' || key || '(a: i32, b: i32) -> i32' AS signature, (key % 3 + 3)::BIGINT AS lines_of_code, 2::BIGINT AS parameters FROM fns")
def rust_symbols(spark: SparkSession, d: str) -> DataFrame:
    return rust.rust_symbols(_rust(spark, d)).where("name <> 'broken'").select("id", "name", "qualified_name", "kind", "line_start", "line_end", "signature", "lines_of_code", "parameters")


@registered(f"WITH {fixtures.RUST_SQL} SELECT path, 'n' || key AS name, (1 + 3 * (key % 3))::BIGINT AS complexity FROM fns")
def rust_complexity(spark: SparkSession, d: str) -> DataFrame:
    """A branch with `(a && b) == c` is a branch and two expressions."""
    return rust.rust_symbols(_rust(spark, d)).where("name <> 'broken'").select("path", "name", "complexity")


@registered("SELECT 'src/r' || r_regionkey || '.rs' AS path, 'std::r' || r_regionkey AS target, 'module_' || left(sha256('rust:std::r' || r_regionkey), 32) AS id FROM region")
def rust_imports(spark: SparkSession, d: str) -> DataFrame:
    return rust.rust_imports(_rust(spark, d)).select("path", "target", "id")


@registered(f"""WITH {fixtures.RUST_SQL} SELECT path, count(*) AS symbols, any_value(CASE WHEN region = 1 THEN 'source contains syntax errors; observations may be incomplete' END) AS problem, 'partial' AS coverage FROM fns GROUP BY path""")
def treesitter_host(spark: SparkSession, d: str) -> DataFrame:
    """Files by language or extension, their symbols, and what did not parse."""
    files = fixtures.rust_files(spark, d)
    contents = syntax.supported(files, syntax.RUST).select("path", F.encode("content", "UTF-8").alias("content"))
    s, problems = syntax.observe(contents, syntax.RUST)
    counts = s.where("name <> 'broken'").groupBy("path").agg(F.count("*").alias("symbols"))
    return counts.join(problems.select(F.col("scope").alias("path"), F.col("message").alias("problem")), "path", "left").select("path", "symbols", "problem", F.lit(syntax.COVERAGE).alias("coverage"))


# ---------------------------------------------------------------- language servers

def _catalog(spark: SparkSession, d: str) -> DataFrame:
    return lsp.lsp_symbols(fixtures.answers(spark, d))


@registered(f"""WITH {fixtures.ANSWERS_SQL}
SELECT path, 'Star' AS name, 'namespace' AS kind, false AS callable, 1::BIGINT AS line_start, 1000::BIGINT AS line_end, NULL AS namespace FROM c GROUP BY path
UNION ALL SELECT path, name, 'type', false, line + 1, line + 9, 'Star' FROM c UNION ALL SELECT path, 'run', 'method', true, line + 3, line + 5, 'Star' FROM c""")
def lsp_symbols(spark: SparkSession, d: str) -> DataFrame:
    return _catalog(spark, d).select("path", "name", "kind", "callable", "line_start", "line_end", "namespace")


def _locations(spark: SparkSession, d: str) -> DataFrame:
    """Each class is referred to from the method of the next one, by key."""
    c = _catalog(spark, d).where("kind = 'type'").select("path", "id", "line_start", F.expr("CAST(substring(name, 2) AS BIGINT)").alias("key"))
    target = c.select((F.col("key") + 1).alias("key"), F.col("id").alias("target"))
    return c.join(target, "key").select("path", (F.col("line_start") + 3).alias("line"), "target")


_REFERENCES = "SELECT a.method AS from_id, 'references' AS kind, b.id AS to_id FROM sym a JOIN sym b ON b.key = a.key - 1"
_CALLS = "SELECT id AS from_id, 'calls' AS kind, method AS to_id FROM sym"


@registered(f"WITH {fixtures.ANSWERS_SQL} {_REFERENCES}")
def lsp_references(spark: SparkSession, d: str) -> DataFrame:
    return lsp.lsp_references(_catalog(spark, d), _locations(spark, d))


def _call_rows(spark: SparkSession, d: str) -> DataFrame:
    """Each class calls its method; calls of no symbol are none."""
    c = _catalog(spark, d).where("kind = 'type'")
    met = c.select(F.col("id").alias("caller"), "path", F.lit("run").alias("name"), (F.col("sel_line") + 2).alias("sel_line"), F.lit(8).cast("long").alias("sel_char"))
    return met.unionByName(met.withColumn("sel_char", F.lit(9).cast("long")))


@registered(f"WITH {fixtures.ANSWERS_SQL} {_CALLS}")
def lsp_calls(spark: SparkSession, d: str) -> DataFrame:
    return lsp.lsp_calls(_catalog(spark, d), _call_rows(spark, d))


_BASES = """
SELECT a.id AS from_id, 'inherits' AS kind, coalesce(b.id, 'node_' || left(sha256('unresolved/csharp:s' || (a.key - 1) || ':1'), 32)) AS to_id FROM sym a LEFT JOIN sym b ON b.key = a.key - 1
UNION ALL SELECT id, 'implements', 'node_' || left(sha256('unresolved/csharp:ithing' || (key % 3) || ':1'), 32) FROM sym"""


@registered(f"WITH {fixtures.ANSWERS_SQL} {_BASES}")
def lsp_bases(spark: SparkSession, d: str) -> DataFrame:
    return lsp.lsp_bases(_catalog(spark, d), "csharp")[0]


@registered(f"""WITH {fixtures.ANSWERS_SQL}, files AS (SELECT DISTINCT path FROM c), missing AS (SELECT 'S' || (key - 1) AS label FROM c WHERE key - 1 NOT IN (SELECT key FROM c) UNION SELECT 'IThing' || (key % 3) FROM c)
SELECT 'file' AS kind, count(*) AS n FROM files UNION ALL SELECT 'namespace', count(*) FROM files UNION ALL SELECT 'method', count(*) FROM c
UNION ALL SELECT 'type', count(*) + (SELECT count(*) FROM missing) FROM c
UNION ALL SELECT '-contains', 2 * count(*) + (SELECT count(*) FROM files) FROM c UNION ALL SELECT '-inherits', count(*) FROM c UNION ALL SELECT '-implements', count(*) FROM c""")
def lsp_assemble(spark: SparkSession, d: str) -> DataFrame:
    """How many entities and relations of each kind a server's answers give."""
    c = _catalog(spark, d)
    edges, unresolved = lsp.lsp_bases(c, "csharp")
    e, r = lsp.lsp_assemble(c, edges.unionByName(edges), unresolved, "csharp", "w", "v")
    return e.groupBy("kind").agg(F.count_distinct("id").alias("n")).unionByName(r.groupBy(F.concat(F.lit("-"), "kind").alias("kind")).agg(F.count("*").alias("n")))


@registered(f"WITH {fixtures.ANSWERS_SQL}, e AS ({_REFERENCES} UNION ALL {_CALLS}) SELECT from_id || ':' || kind || ':' || to_id AS id, kind, CASE kind WHEN 'calls' THEN 0.7::DOUBLE ELSE 0.3::DOUBLE END AS weight FROM e")
def rust_analyzer(spark: SparkSession, d: str) -> DataFrame:
    return lsp.rust_analyzer(_catalog(spark, d), _locations(spark, d), _call_rows(spark, d), "w", "v").select("id", "kind", "weight")


_SERVERS = [(" py ", " Python ", "pyls", [".PY", "pyi", "py"]), ("cs", "csharp", " omni ", ["cs"]), ("py", "python", "pyright", ["py"]), ("a b", "x", "y", ["z"]), ("e", "x", "y", ["."])]


@registered(values([("py", "python", "pyright", "py"), ("error", None, None, "id must be a non-empty token"), ("error", None, None, "at least one file extension is required")], "id, language, command, extensions"))
def lsp_registry_list(spark: SparkSession, d: str) -> DataFrame:
    """A registry after registrations, two of them refused, and a removal."""
    with tempfile.TemporaryDirectory() as folder:
        known, rows = lsp_registry.Registry(f"{folder}/store"), []
        for id_, language, command, extensions in _SERVERS:
            try:
                known.upsert(lsp_registry.Registration(id_, language, command, [], extensions))
            except QueryError as e:
                rows.append(("error", None, None, str(e)))
        known.remove("cs")
        found = lsp_registry.Registry(f"{folder}/store").registrations()
    rows += [(r["id"], r["language"], r["command"], ",".join(r["extensions"])) for r in found]
    return spark.createDataFrame(rows, "id string, language string, command string, extensions string")


#: A server that knows one symbol, for the session's query.
_SERVER = """
import json, sys
def read():
    size = 0
    while (line := sys.stdin.buffer.readline()).strip():
        size = int(line.split(b":")[1])
    return json.loads(sys.stdin.buffer.read(size)) if size else None
while (m := read()) and m["method"] != "exit":
    if "id" in m:
        found = [{"name": "f", "kind": 12, "range": {"start": {"line": 3, "character": 0}, "end": {"line": 5, "character": 0}}}]
        said = {"result": found} if m["method"] == "textDocument/documentSymbol" else {"error": {"code": -32601}} if m["method"] == "nope" else {"result": None}
        body = json.dumps({"jsonrpc": "2.0", "id": m["id"], **said}).encode()
        sys.stdout.buffer.write(b"Content-Length: %d\\r\\n\\r\\n" % len(body) + body)
        sys.stdout.buffer.flush()
"""


@registered(values([("a.py", "f", "function", 4, 6), ("nope", "ServerError", None, None, None), ("absent", "ServerUnavailable", None, None, None)], "path, name, kind, line_start, line_end").replace("'function', 4, 6", "'function', 4::BIGINT, 6::BIGINT"))
def lsp_session_answers(spark: SparkSession, d: str) -> DataFrame:
    """Symbols that a server child answers with, and two errors."""
    with tempfile.TemporaryDirectory() as folder:
        Path(folder, "a.py").write_text("x = 1\n")
        command = [sys.executable, "-c", _SERVER]
        documents, rows = lsp_session.symbols_of(spark, command, folder, ["a.py"], "python"), []
        for name, line in (("nope", command), ("absent", [f"{folder}/no-server"])):
            try:
                with lsp_session.Session(line, folder) as session:
                    session.request("nope", None)
            except QueryError as e:
                rows.append((name, type(e).__name__, None, None, None))
    errors = spark.createDataFrame(rows, "path string, name string, kind string, line_start long, line_end long")
    return lsp.lsp_symbols(documents).select(*errors.columns).unionByName(errors)


_TOOL = [("managed", True, "managed_directory", "tool 1.2"), ("sibling", True, "engine_sibling", "tool 1.2"), ("override", False, "environment", None), ("nowhere", False, None, None)]


@registered(values(_TOOL, "request, available, source, version"))
def runtime_resolve(spark: SparkSession, d: str) -> DataFrame:
    """Where a program is found; an override decides alone."""
    with tempfile.TemporaryDirectory() as folder:
        for name in ("m/bin", "e"):
            at = Path(folder, name)
            at.mkdir(parents=True)
            (at / "tool-of-mine").write_text("#!/bin/sh\necho\necho tool 1.2\n")
            (at / "tool-of-mine").chmod(0o755)
        spec = runtimes.Runtime("tool", "tool-of-mine", "MY_TOOL")
        where = lambda **x: runtimes.Resolver(**{"environment": {}} | x)
        found = {
            "managed": where(managed=Path(folder, "m")),
            "sibling": where(engine=Path(folder, "e"), managed=Path(folder, "m")),
            "override": where(engine=Path(folder, "e"), environment={"MY_TOOL": f"{folder}/absent"}),
            "nowhere": where(),
        }
        rows = [(k, s.available, s.source, s.version) for k, r in found.items() for s in [r.resolve(spec)]]
    return spark.createDataFrame(rows, "request string, available boolean, source string, version string")


@registered("SELECT 'search' AS method, count(*) AS n FROM nation WHERE contains(lower(n_name), 'an') UNION ALL SELECT 'getNode', 1 UNION ALL SELECT 'error', -32601")
def rpc(spark: SparkSession, d: str) -> DataFrame:
    """Answers of the router over a stored snapshot."""
    import json

    router = Router(fixtures.stored(spark, d))
    at = {"world": star.WORLD, "version": star.VERSION}
    ask = lambda method, **p: json.loads(router.handle_line(json.dumps({"jsonrpc": "2.0", "id": 1, "method": method, "params": at | p})))
    rows = [("search", len(ask("engine.search", name="AN", kind="nation", limit=1000)["result"])), ("getNode", int(ask("getNode", id="region:0")["result"]["kind"] == "region")), ("error", ask("nothing")["error"]["code"])]
    return spark.createDataFrame(rows, "method string, n long")
