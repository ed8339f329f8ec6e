"""Queries of the graph engine over the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.functions import scalars
from orrery.operators import derive, diff, find, merge, rank, traverse, validate
from orrery.plans import star
from orrery.plans.star import table
from orrery.schema import DIMENSIONS, REQUIRED, SCORE_MODEL

QUERIES: dict = {}
SQL: dict[str, str] = {}


def registered(sql: str | None = None):
    """Register a query under its function's name, with its DuckDB SQL."""

    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return keep


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def r6(c: str | Column) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


_ROUNDED = ", ".join(f"round({d}, 6) AS {d}" for d in DIMENSIONS)


@registered(f"WITH {star.SCORES_SQL} SELECT id, label, {_ROUNDED} FROM (SELECT * FROM s WHERE friction >= 0.7::DOUBLE ORDER BY friction DESC, id LIMIT 20)")
def high_friction(spark: SparkSession, d: str) -> DataFrame:
    return rank.high_friction(star.part_profiles(spark, d)).select("id", "label", *[r6(k).alias(k) for k in DIMENSIONS])


@registered(f"WITH {star.SCORES_SQL} SELECT id, label, {_ROUNDED} FROM (SELECT * FROM s WHERE stability <= 0.4::DOUBLE ORDER BY stability, id LIMIT 20)")
def unstable(spark: SparkSession, d: str) -> DataFrame:
    return rank.unstable(star.part_profiles(spark, d)).select("id", "label", *[r6(k).alias(k) for k in DIMENSIONS])


_MEANS = ", ".join(f"round(avg({d}), 6) AS mean_{d}" for d in DIMENSIONS)


@registered(f"WITH {star.SCORES_SQL} SELECT (SELECT count(*) FROM part) AS code_entities, count(*) AS scored_entities, {_MEANS} FROM s")
def stats(spark: SparkSession, d: str) -> DataFrame:
    found = rank.stats(table(spark, d, "part"), star.part_profiles(spark, d))
    return found.select("code_entities", "scored_entities", *[r6(f"mean_{k}").alias(f"mean_{k}") for k in DIMENSIONS])


@registered(f"WITH {star.SCORES_SQL} SELECT id, label, {_ROUNDED} FROM s")
def scores_pivot(spark: SparkSession, d: str) -> DataFrame:
    """Through the store's own form: measurements, scoring, pivot."""
    return rank.scores_pivot(derive.score(star.part_entities(spark, d))).select("id", "label", *[r6(k).alias(k) for k in DIMENSIONS])


@registered(
    f"WITH {star.SCORES_SQL}, p AS (SELECT id, sqrt((stability - 0.45::DOUBLE) ** 2 + (logic - 1.0::DOUBLE) ** 2 + (friction - 0.75::DOUBLE) ** 2 + (autonomy - 0.5::DOUBLE) ** 2) AS distance FROM s) "
    "SELECT id, round(distance, 6) AS distance FROM (SELECT * FROM p WHERE distance <= 1.0::DOUBLE - 0.8::DOUBLE ORDER BY distance, id LIMIT 50)"
)
def patterns(spark: SparkSession, d: str) -> DataFrame:
    profile = {"stability": 0.45, "logic": 1.0, "friction": 0.75, "autonomy": 0.5}
    return rank.patterns(star.part_profiles(spark, d), profile).select("id", r6("distance").alias("distance"))


@registered("""
WITH e AS (SELECT doc_id, quality, toxic FROM documents LEFT JOIN (SELECT doc_id, any_value(quality) AS quality, any_value(toxic) AS toxic FROM labels GROUP BY 1) USING (doc_id))
SELECT 'doc:' || doc_id AS id, CASE WHEN quality IS NULL THEN 'code.cyclomatic_complexity' ELSE '' END AS missing FROM e WHERE quality IS NULL
""")
def gaps(spark: SparkSession, d: str) -> DataFrame:
    """Documents as entities: length always measured, complexity stands for the
    label's quality; the missing ones are those without a label."""
    labels = table(spark, d, "labels").groupBy("doc_id").agg(F.any_value("quality").alias("quality"))
    docs = table(spark, d, "documents").select("doc_id", "n_chars").join(labels, "doc_id", "left")
    m = lambda name, c: F.struct(F.lit(name).alias("name"), F.col(c).cast("double").alias("value"))
    e = docs.select(
        F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("id"),
        F.filter(F.array(m("code.lines_of_code", "n_chars"), m("code.cyclomatic_complexity", "quality")), lambda x: x["value"].isNotNull()).alias("measurements"),
        F.array().cast("array<struct<model:string,dimension:string,value:double>>").alias("scores"),
    )
    second = F.array_contains("missing_measurements", "code.cyclomatic_complexity")
    return rank.gaps(e).where(second).select("id", F.lit("code.cyclomatic_complexity").alias("missing"))


@registered("""
WITH e AS (SELECT doc_id, doc_id % 4 <> 0 AS measured, doc_id % 3 = 0 AS whole, doc_id % 5 <> 0 AS scored FROM documents)
SELECT count(*) FILTER (measured) AS scoreable, count(*) FILTER (measured AND whole AND scored) AS fully_scored, count(*) FILTER (measured AND NOT (whole AND scored)) AS with_gaps FROM e
""")
def gaps_summary(spark: SparkSession, d: str) -> DataFrame:
    """Documents of which some have no size, some all ten measurements, some all
    four scores, of whatever model."""
    m = lambda n: F.struct(F.lit(n).alias("name"), F.lit(1.0).alias("value"))
    s = lambda n: F.struct(F.lit("other").alias("model"), F.lit(n).alias("dimension"), F.lit(0.5).alias("value"))
    k = F.col("doc_id")
    some = F.array(*[m(n) for n in (REQUIRED[0], REQUIRED[3])])
    docs = table(spark, d, "documents").select(
        k.cast("string").alias("id"),
        F.when(k % 4 == 0, F.array(m(REQUIRED[3]))).when(k % 3 == 0, F.array(*[m(n) for n in REQUIRED])).otherwise(some).alias("measurements"),
        F.when(k % 5 != 0, F.array(*[s(n) for n in DIMENSIONS])).otherwise(F.array(s(DIMENSIONS[0]))).alias("scores"),
    )
    return rank.gaps_summary(docs)


@registered("""
SELECT id, value, observer FROM (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY confidence DESC, observer, ordinal DESC) AS r FROM (
    SELECT doc_id AS id, n_chars::DOUBLE AS value, 'stored' AS observer, CASE WHEN doc_id % 3 = 0 THEN 0.9 ELSE 0.8 END AS confidence, 0 AS ordinal FROM documents
    UNION ALL SELECT doc_id, length(text)::DOUBLE, 'computed', 0.9 - 0.05 * (doc_id % 4), 1 FROM documents)) WHERE r = 1
""")
def measurement_value(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    a = docs.select(F.col("doc_id").alias("id"), F.col("n_chars").cast("double").alias("value"), F.lit("stored").alias("observer"), F.when(F.col("doc_id") % 3 == 0, 0.9).otherwise(0.8).alias("confidence"), F.lit(0).alias("ordinal"))
    b = docs.select(F.col("doc_id").alias("id"), F.length("text").cast("double").alias("value"), F.lit("computed").alias("observer"), F.round(0.9 - 0.05 * (F.col("doc_id") % 4), 2).alias("confidence"), F.lit(1).alias("ordinal"))
    return rank.best_measurements(a.unionByName(b), ["id"]).select("id", "value", "observer")


@registered("SELECT 'part:' || p_partkey AS id, p_name AS label FROM part WHERE contains(lower(p_name), 'a') AND p_brand = (SELECT min(p_brand) FROM part) ORDER BY 1")
def find_entities(spark: SparkSession, d: str) -> DataFrame:
    brand = table(spark, d, "part").agg(F.min("p_brand")).first()[0]
    return find.find_entities(star.entities(spark, d), "CODE", "part", "A", {"brand": f'"{brand}"'}).select("id", "label")


@registered("SELECT 'customer:' || c_custkey AS id, c_name AS label, 'customer' AS kind FROM customer WHERE contains(lower(c_name), '1') ORDER BY 1 LIMIT 25")
def code_find(spark: SparkSession, d: str) -> DataFrame:
    return find.code_find(star.entities(spark, d), name_contains="1", kind="customer", limit=25).select("id", "label", "kind")


_SPANS = "SELECT o_custkey AS path, 'order:' || o_orderkey AS id, min(date_diff('day', DATE '1970-01-01', o_orderdate::DATE)) AS line_start, max(date_diff('day', DATE '1970-01-01', l_shipdate::DATE)) AS line_end FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2"


def _spans(spark: SparkSession, d: str) -> DataFrame:
    """Per customer: orders as intervals of day numbers."""
    items = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max(F.unix_date(F.col("l_shipdate").cast("date"))).alias("line_end"))
    orders = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("path"), F.unix_date(F.col("o_orderdate").cast("date")).alias("line_start"))
    return orders.join(items, "o_orderkey").select("path", F.concat(F.lit("order:"), F.col("o_orderkey").cast("string")).alias("id"), "line_start", "line_end")


@registered(f"""
WITH spans AS ({_SPANS}), p AS (SELECT path, min(line_start) + 10 AS line FROM spans GROUP BY path)
SELECT path, line, id, span FROM (
  SELECT p.path, p.line, s.id, greatest(line_end - line_start, 0) AS span, row_number() OVER (PARTITION BY p.path ORDER BY greatest(line_end - line_start, 0), s.id) AS r
  FROM p JOIN spans s ON s.path = p.path AND line BETWEEN line_start AND line_end) WHERE r = 1
""")
def at_location(spark: SparkSession, d: str) -> DataFrame:
    spans = _spans(spark, d)
    points = spans.groupBy("path").agg((F.min("line_start") + 10).alias("line"))
    return find.locations(spans, points).select("path", "line", "id", F.col("span").cast("long").alias("span"))


_LINES = "SELECT l_suppkey AS file, date_diff('day', DATE '1970-01-01', l_shipdate::DATE) AS line, bool_or(l_returnflag = 'N') AS hit, max(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END) AS bc, max(l_linenumber % 3) AS bt FROM lineitem GROUP BY 1, 2"


def _lines(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("file"),
        F.unix_date(F.col("l_shipdate").cast("date")).alias("line"),
        (F.col("l_returnflag") == "N").alias("hit"),
        F.when(F.col("l_linestatus") == "F", 1).otherwise(0).alias("branches_covered"),
        (F.col("l_linenumber") % 3).alias("branches_total"),
    )
    return derive.coverage_merge(items)


@registered(f"SELECT file, line, hit, bc AS branches_covered, bt AS branches_total FROM ({_LINES})")
def coverage_merge(spark: SparkSession, d: str) -> DataFrame:
    return _lines(spark, d)


_QUARTERS = "SELECT 's' || s_suppkey || ':' || q AS id, s_suppkey AS file, 8035 + 91 * q AS line_start, 8035 + 91 * q + 90 AS line_end FROM supplier, range(28) r(q)"


@registered(f"""
WITH lines AS ({_LINES}), spans AS ({_QUARTERS})
SELECT id, round(count(*) FILTER (hit) / count(*), 6) AS line_coverage, round(CASE WHEN sum(bt) > 0 THEN sum(bc) / sum(bt) ELSE 1.0 END, 6) AS branch_coverage
FROM spans JOIN lines USING (file) WHERE line BETWEEN line_start AND line_end GROUP BY id
""")
def coverage_ratios(spark: SparkSession, d: str) -> DataFrame:
    quarters = table(spark, d, "supplier").select(F.col("s_suppkey").alias("file"), F.explode(F.sequence(F.lit(0), F.lit(27))).alias("q"))
    spans = quarters.select(F.concat(F.lit("s"), F.col("file").cast("string"), F.lit(":"), F.col("q").cast("string")).alias("id"), "file", (8035 + 91 * F.col("q")).alias("line_start"), (8125 + 91 * F.col("q")).alias("line_end"))
    return derive.coverage_ratios(spans, _lines(spark, d)).select("id", r6("line_coverage").alias("line_coverage"), r6("branch_coverage").alias("branch_coverage"))


@registered("SELECT DISTINCT l_suppkey AS file FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_nationkey < 12)")
def coverage_unmatched(spark: SparkSession, d: str) -> DataFrame:
    measured = table(spark, d, "supplier").where("s_nationkey < 12").select(F.col("s_suppkey").alias("file"))
    return derive.coverage_unmatched(table(spark, d, "lineitem").select(F.col("l_suppkey").alias("file")), measured)


_EDGES = """
e AS (
  SELECT 'order:' || o_orderkey AS f, 'customer:' || o_custkey AS t, 'references' AS kind FROM orders
  UNION ALL SELECT DISTINCT 'order:' || l_orderkey, 'part:' || l_partkey, 'calls' FROM lineitem
  UNION ALL SELECT DISTINCT 'part:' || l_partkey, 'supplier:' || l_suppkey, 'imports' FROM lineitem)"""


@registered(f"WITH {_EDGES} SELECT id, CAST(sum(i) AS BIGINT) AS incoming, CAST(sum(o) AS BIGINT) AS outgoing FROM (SELECT t AS id, 1 AS i, 0 AS o FROM e UNION ALL SELECT f, 0, 1 FROM e) GROUP BY id")
def graph_degrees(spark: SparkSession, d: str) -> DataFrame:
    return derive.degrees(star.relations(spark, d))


def _reach(direction: str, root: str, depth: int) -> str:
    step = {"incoming": "SELECT t AS near, f AS far FROM e", "outgoing": "SELECT f AS near, t AS far FROM e"}
    both = " UNION ALL ".join(step.values()) if direction == "both" else step[direction]
    return f"WITH RECURSIVE {_EDGES}, st AS ({both}), r(id, depth) AS (SELECT '{root}', 0 UNION SELECT st.far, r.depth + 1 FROM r JOIN st ON st.near = r.id WHERE r.depth < {depth}), n AS (SELECT id, min(depth) AS depth FROM r GROUP BY id)"


@registered(_reach("incoming", "supplier:7", 2) + " SELECT id, depth FROM n")
def traverse_nodes(spark: SparkSession, d: str) -> DataFrame:
    t = traverse.traverse(star.entities(spark, d), star.relations(spark, d), "supplier:7", "incoming", 2, None, ("calls", "imports", "references"))
    return t.nodes


@registered(
    _reach("incoming", "supplier:7", 2)
    + " SELECT f || ':' || kind || ':' || t AS id, kind FROM e WHERE t IN (SELECT id FROM n WHERE depth < 2) AND f IN (SELECT id FROM n)"
)
def traverse_relations(spark: SparkSession, d: str) -> DataFrame:
    t = traverse.traverse(star.entities(spark, d), star.relations(spark, d), "supplier:7", "incoming", 2, None, ("calls", "imports", "references"))
    return t.relations.select("id", "kind")


def _bounded(root: str, depth: int, most: int) -> str:
    """SQL of a traversal both ways that a node limit cuts: a level at a time,
    in order of discovery; a level that does not fit is the last."""
    ctes = [f"{_EDGES}, st AS (SELECT f AS near, t AS far, f || ':' || kind || ':' || t AS edge FROM e UNION ALL SELECT t, f, f || ':' || kind || ':' || t FROM e), n0 AS (SELECT '{root}' AS id, 0 AS depth, 0::BIGINT AS found)"]
    nodes, total = "SELECT * FROM n0", "1"
    for k in range(1, depth + 1):
        ctes.append(f"m{k} AS (SELECT far, min((found, edge)) AS via FROM n{k - 1} JOIN st ON near = id WHERE far NOT IN (SELECT id FROM ({nodes})) GROUP BY far)")
        open_ = "" if k == 1 else f" AND (SELECT count(*) FROM m{k - 1}) = (SELECT count(*) FROM n{k - 1})"
        ctes.append(f"n{k} AS (SELECT * FROM (SELECT far AS id, {k} AS depth, row_number() OVER (ORDER BY via, far) AS found FROM m{k}) WHERE found <= {most} - ({total}){open_})")
        nodes, total = f"{nodes} UNION ALL SELECT * FROM n{k}", f"{total} + (SELECT count(*) FROM n{k})"
    grown = " UNION ALL ".join(f"SELECT n{k - 1}.id FROM n{k - 1}" + ("" if k == 1 else f" WHERE (SELECT count(*) FROM m{k - 1}) = (SELECT count(*) FROM n{k - 1})") for k in range(1, depth + 1))
    return f"WITH {', '.join(ctes)}, n AS ({nodes}), grown AS ({grown}) SELECT id, depth, (SELECT count(*) > 0 FROM st WHERE near IN (SELECT id FROM grown) AND far NOT IN (SELECT id FROM n)) AS truncated FROM n"


@registered(_bounded("part:7", 3, 40))
def traverse_truncated(spark: SparkSession, d: str) -> DataFrame:
    t = traverse.traverse(star.entities(spark, d), star.relations(spark, d), "part:7", "both", 3, 40, ("calls", "imports", "references"))
    return t.nodes.withColumn("truncated", F.lit(t.truncated))


@registered(_reach("incoming", "part:7", 3) + " SELECT count(*) FILTER (depth = 1) AS direct, count(*) FILTER (depth > 1) AS transitive, (SELECT count(*) FROM e WHERE t IN (SELECT id FROM n WHERE depth < 3) AND f IN (SELECT id FROM n)) AS relations, false AS truncated FROM n")
def impact(spark: SparkSession, d: str) -> DataFrame:
    return traverse.impact(star.entities(spark, d), star.relations(spark, d), "part:7", 3, 100_000)[0]


@registered(_reach("both", "part:7", 2) + " SELECT depth, id, split_part(id, ':', 1) AS kind, CASE WHEN starts_with(id, 'supplier:') THEN split_part(id, ':', 2)::DOUBLE / 1e6 END AS stability FROM n")
def dependencies(spark: SparkSession, d: str) -> DataFrame:
    """Views of what part 7 meets; suppliers have scores, by their keys."""
    k = F.regexp_extract("id", r"(\d+)$", 1).cast("double") / 1e6
    made = F.array(*[F.struct(F.lit(SCORE_MODEL).alias("model"), F.lit(1).alias("version"), F.lit(n).alias("dimension"), k.alias("value")) for n in DIMENSIONS])
    e = star.entities(spark, d).withColumn("scores", F.when(F.col("kind") == "supplier", made).otherwise(F.col("scores")))
    found = traverse.dependencies(e, star.relations(spark, d), "part:7", "both", 2, None, include_scores=True)
    return found.select("depth", "id", "kind", F.col("avec.stability").alias("stability"))


_HISTORY = """
h AS (SELECT o_custkey AS path, o_orderkey, floor(epoch(o_orderdate))::BIGINT AS ts, o_orderpriority AS author, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS seq FROM orders),
g AS (SELECT *, greatest(ts - lag(ts) OVER (PARTITION BY path ORDER BY seq), 0) / 86400.0::DOUBLE AS gap FROM h), x AS (SELECT max(ts) - 7776000 AS cutoff FROM h)"""


@registered(f"""
WITH {_HISTORY}
SELECT path, count(*) AS commits, count(DISTINCT author) AS contributors, arg_min(ts, seq) AS created_at, arg_max(ts, seq) AS modified_at,
       round(CASE WHEN count(*) > 1 THEN coalesce(sum(gap), 0) / (count(*) - 1) ELSE 0 END, 6) AS average_days, count(*) FILTER (ts >= cutoff) AS recent,
       CASE WHEN count(*) FILTER (ts >= cutoff) <= 2 THEN 'low' WHEN count(*) FILTER (ts >= cutoff) <= 9 THEN 'medium' ELSE 'high' END AS frequency
FROM g, x GROUP BY path
""")
def file_history(spark: SparkSession, d: str) -> DataFrame:
    ts = F.unix_seconds(F.col("o_orderdate").cast("timestamp"))
    orders = table(spark, d, "orders").select(F.col("o_custkey").alias("path"), ts.alias("ts"), F.struct("o_orderdate", "o_orderkey").alias("seq"), F.col("o_orderpriority").alias("author"))
    cutoff = orders.agg(F.max("ts")).first()[0] - 90 * 86400
    return derive.file_history(orders, cutoff).withColumn("average_days", r6("average_days"))


@registered("SELECT l_suppkey AS id, count(*) AS n, CASE WHEN count(*) <= 2 THEN 'low' WHEN count(*) <= 9 THEN 'medium' ELSE 'high' END AS frequency FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1")
def recent_frequency(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_suppkey").alias("id")).agg(F.count("*").alias("n"))
    return n.withColumn("frequency", scalars.recent_frequency(F.col("n")))


_CUSTOMERS = "SELECT 'customer:' || o_custkey AS id, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_orderdate < TIMESTAMP '{}' GROUP BY 1"


@registered(f"""
WITH a AS ({_CUSTOMERS.format("1995-01-01")}), b AS ({_CUSTOMERS.format("1996-01-01")})
SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN 'added' WHEN b.id IS NULL THEN 'removed' ELSE 'changed' END AS change, a.n AS was, b.n AS now
FROM a FULL JOIN b ON a.id = b.id WHERE a.id IS NULL OR b.id IS NULL OR a.n <> b.n OR a.total <> b.total
""")
def diff_entities(spark: SparkSession, d: str) -> DataFrame:
    def world(until: str) -> DataFrame:
        seen = table(spark, d, "orders").where(F.col("o_orderdate") < F.lit(until).cast("timestamp_ntz"))
        return seen.groupBy(F.concat(F.lit("customer:"), F.col("o_custkey").cast("string")).alias("id")).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))

    found = diff.changes(world("1995-01-01"), world("1996-01-01"), ["id"], F.struct("n", "total"))
    return found.select("id", "change", F.col("was.n").alias("was"), F.col("now.n").alias("now"))


_PAIRS = "SELECT DISTINCT 'part:' || l_partkey || ':imports:supplier:' || l_suppkey AS id FROM lineitem WHERE l_shipdate {}"


@registered(f"WITH a AS ({_PAIRS.format(chr(60) + ' TIMESTAMP ' + repr('1995-06-01'))}), b AS ({_PAIRS.format('>= TIMESTAMP ' + repr('1994-06-01'))}) SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN 'added' ELSE 'removed' END AS change FROM a FULL JOIN b ON a.id = b.id WHERE a.id IS NULL OR b.id IS NULL")
def diff_relations(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "lineitem")
    pair = F.concat(F.lit("part:"), F.col("l_partkey").cast("string"), F.lit(":imports:supplier:"), F.col("l_suppkey").cast("string")).alias("id")
    at = lambda s: F.lit(s).cast("timestamp_ntz")
    a = items.where(F.col("l_shipdate") < at("1995-06-01")).select(pair).distinct()
    b = items.where(F.col("l_shipdate") >= at("1994-06-01")).select(pair).distinct()
    return diff.changes(a, b, ["id"], F.lit(1)).select("id", "change")


def _observers(spark: SparkSession, d: str) -> DataFrame:
    """Three observers of documents; conflicts where doc_id % 97 = 0."""
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    odd = F.col("doc_id") % 97 == 0
    m = lambda name, v, unit: F.array(F.struct(F.lit(name).alias("name"), v.cast("double").alias("value"), F.lit(unit).alias("unit"), F.lit(None).cast("string").alias("observer"), F.lit(None).cast("double").alias("confidence")))
    s = lambda v: F.array(F.struct(F.lit("m").alias("model"), F.lit(1).alias("version"), F.lit("size").alias("dimension"), v.cast("double").alias("value")))
    base = lambda df, model, kind, label, attrs, ms, ss: df.select(F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("id"), model.alias("model"), kind.alias("kind"), label.alias("label"), attrs.alias("attributes"), ms.alias("measurements"), ss.alias("scores"))
    a = base(docs, F.lit("text"), F.lit("unknown"), F.concat(F.lit("doc."), F.col("lang")), F.create_map(F.lit("lang"), F.col("lang")), m("chars", F.col("n_chars"), "c"), s(F.col("doc_id") % 10 / 10))
    b = base(docs, F.when(odd, "other").otherwise("text"), F.when(odd, "page").otherwise("document"), F.concat(F.lit("doc."), F.col("source"), F.lit("."), F.col("lang")), F.create_map(F.lit("lang"), F.when(odd, "xx").otherwise(F.col("lang"))), m("chars", F.length("text") + F.when(odd, 1).otherwise(0), "c"), s(F.col("doc_id") % 10 / 10 + F.when(odd, 0.05).otherwise(0.0)))
    c = base(labels, F.lit("text"), F.lit("document"), F.lit("d"), F.create_map(F.lit("quality"), F.col("quality").cast("string")), m("quality", F.col("quality"), "q"), s(F.col("doc_id") % 10 / 10))
    return merge.union_ranked([a, b, c])


@registered("SELECT 'doc:' || doc_id AS id, '2' AS detail FROM documents WHERE doc_id % 97 = 0")
def merge_identity(spark: SparkSession, d: str) -> DataFrame:
    return merge.merge_identity(_observers(spark, d)).select("id", "detail")


@registered("""SELECT 'doc:' || doc_id AS id, CASE WHEN doc_id % 97 = 0 AND NOT l THEN 'page' WHEN doc_id % 97 = 0 THEN 'page' ELSE 'document' END AS kind, CASE WHEN doc_id % 97 = 0 AND l THEN 2 ELSE 1 END AS concrete_kinds
FROM (SELECT doc_id, doc_id IN (SELECT doc_id FROM labels) AS l FROM documents)""")
def merge_kind(spark: SparkSession, d: str) -> DataFrame:
    return merge.merge_kind(_observers(spark, d)).withColumn("concrete_kinds", F.col("concrete_kinds").cast("int"))


@registered("SELECT 'doc:' || doc_id AS id, 'doc.' || source || '.' || lang AS label FROM documents")
def merge_label(spark: SparkSession, d: str) -> DataFrame:
    return merge.merge_label(_observers(spark, d))


@registered("""SELECT 'doc:' || doc_id AS id, 'lang' AS key, lang AS value, CASE WHEN doc_id % 97 = 0 THEN 2 ELSE 1 END AS n_values FROM documents
UNION ALL SELECT 'doc:' || doc_id, 'quality', any_value(quality)::VARCHAR, 1 FROM labels GROUP BY doc_id""")
def merge_attributes(spark: SparkSession, d: str) -> DataFrame:
    return merge.merge_attributes(_observers(spark, d)).withColumn("n_values", F.col("n_values").cast("int"))


@registered("""SELECT 'doc:' || doc_id AS id, 'chars' AS name, n_chars::DOUBLE AS value, CASE WHEN doc_id % 97 = 0 THEN 2 ELSE 1 END AS n_values FROM documents
UNION ALL SELECT 'doc:' || doc_id, 'quality', any_value(quality)::DOUBLE, 1 FROM labels GROUP BY doc_id""")
def merge_measurements(spark: SparkSession, d: str) -> DataFrame:
    return merge.merge_measurements(_observers(spark, d)).select("id", "name", "value", F.col("n_values").cast("int").alias("n_values"))


@registered("SELECT 'doc:' || doc_id AS id, 'size' AS dimension, (doc_id % 10)::DOUBLE / 10 AS value, CASE WHEN doc_id % 97 = 0 THEN 2 ELSE 1 END AS n_values FROM documents")
def merge_scores(spark: SparkSession, d: str) -> DataFrame:
    return merge.merge_scores(_observers(spark, d)).select("id", "dimension", "value", F.col("n_values").cast("int").alias("n_values"))


@registered("""WITH r AS (SELECT DISTINCT l_partkey AS p, l_suppkey AS s FROM lineitem)
SELECT 'part:' || p || ':imports:supplier:' || s AS id, 0.5::DOUBLE AS weight, CASE WHEN p % 97 = 0 THEN 2 ELSE 1 END AS n_values FROM r""")
def merge_relations(spark: SparkSession, d: str) -> DataFrame:
    own = star.relations(spark, d).where("kind = 'imports'").drop("world", "version")
    other = own.withColumn("weight", F.when(F.regexp_extract("from_id", r"(\d+)", 1).cast("long") % 97 == 0, 0.25).otherwise(F.col("weight")))
    return merge.merge_relations(merge.union_ranked([own, other])).select("id", "weight", F.col("n_values").cast("int").alias("n_values"))


@registered("""WITH c AS (SELECT o_custkey AS id, CASE o_orderstatus WHEN 'F' THEN 'complete' WHEN 'O' THEN 'unavailable' ELSE 'partial' END AS coverage FROM orders)
SELECT id, CASE WHEN min(coverage) = max(coverage) AND min(coverage) IN ('complete', 'unavailable') THEN min(coverage) ELSE 'partial' END AS coverage FROM c GROUP BY id""")
def merge_coverage(spark: SparkSession, d: str) -> DataFrame:
    c = F.when(F.col("o_orderstatus") == "F", "complete").when(F.col("o_orderstatus") == "O", "unavailable").otherwise("partial")
    return table(spark, d, "orders").select(F.col("o_custkey").alias("id"), c.alias("coverage")).groupBy("id").agg(merge.merged_coverage().alias("coverage"))


@registered("""WITH r AS (SELECT DISTINCT l_partkey AS p, l_suppkey AS s FROM lineitem), n AS (
SELECT 'duplicate_entity' AS rule, (SELECT count(*) FROM supplier WHERE s_suppkey % 10 = 0) AS n
UNION ALL SELECT 'missing_endpoint', count(*) FROM r WHERE p % 50 = 0
UNION ALL SELECT 'weight_out_of_range', count(*) FILTER (s % 7 = 0) + count(*) FILTER (s % 7 = 0 AND p % 40 = 1) FROM r
UNION ALL SELECT 'duplicate_relation', count(*) FROM r WHERE p % 40 = 1
UNION ALL SELECT 'foreign_snapshot', (SELECT count(*) FROM part WHERE p_partkey % 60 = 2) + (SELECT count(*) FROM r WHERE p % 70 = 3) + (SELECT count(*) FROM r WHERE p % 70 = 3 AND p % 40 = 1)
UNION ALL SELECT 'measurement_not_finite', count(*) FROM part WHERE p_partkey % 80 IN (4, 5) AND p_partkey % 50 <> 0
UNION ALL SELECT 'confidence_out_of_range', count(*) FROM part WHERE p_partkey % 80 IN (6, 7) AND p_partkey % 50 <> 0
UNION ALL SELECT 'score_out_of_range', count(*) FROM part WHERE p_partkey % 80 IN (8, 9) AND p_partkey % 50 <> 0)
SELECT * FROM n WHERE n > 0""")
def validate_batch(spark: SparkSession, d: str) -> DataFrame:
    """Parts and suppliers with rows that break each rule, by key."""
    number = lambda c: F.regexp_extract(c, r"(\d+)", 1).cast("long")
    k, part = number("id"), F.col("kind") == "part"
    e = star.entities(spark, d).where("kind IN ('part', 'supplier')")
    e = e.where(~(part & (k % 50 == 0))).unionByName(e.where((F.col("kind") == "supplier") & (k % 10 == 0)))
    value = F.when(part & (k % 80 == 4), float("nan")).when(part & (k % 80 == 5), float("-inf")).otherwise(1.0)
    sure = F.when(part & (k % 80 == 6), -0.1).when(part & (k % 80 == 7), 1.5).when(k % 2 == 0, F.lit(None)).otherwise(1.0)
    score = F.when(part & (k % 80 == 8), 1.01).when(part & (k % 80 == 9), float("nan")).otherwise(1.0)
    e = e.withColumn("measurements", F.array(F.struct(F.lit("m").alias("name"), value.alias("value"), F.lit(None).cast("string").alias("unit"), F.lit("o").alias("observer"), sure.alias("confidence"))))
    e = e.withColumn("scores", F.array(F.struct(F.lit("x").alias("model"), F.lit(1).alias("version"), F.lit("y").alias("dimension"), score.alias("value"))))
    e = e.withColumn("version", F.when(part & (k % 60 == 2), "v0").otherwise(F.col("version")))
    a, b = number("from_id"), number("to_id")
    r = star.relations(spark, d).where("kind = 'imports'").withColumn("weight", F.when(b % 7 == 0, 1.5).otherwise(F.col("weight")))
    r = r.withColumn("world", F.when(a % 70 == 3, "elsewhere").otherwise(F.col("world")))
    r = r.unionByName(r.where(a % 40 == 1))
    return validate.violations(e, r, star.WORLD, star.VERSION).groupBy("rule").agg(F.count("*").alias("n"))


@registered("""WITH h AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS target FROM pages)
SELECT DISTINCT page_id, target, 'module_' || left(sha256(lower('html:' || target)), 32) AS id FROM h""")
def page_imports(spark: SparkSession, d: str) -> DataFrame:
    """Import edges of pages: the distinct targets of all their links."""
    found = table(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit(r'href="([^"]*)"'), 1)).alias("target")).distinct()
    return found.select("page_id", "target", scalars.module_id(F.lit("html"), F.col("target")).alias("id"))


@registered(r"""SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(url), '/+$', ''), '^.*?://', ''), '^[^@]*@', ''), '(\.git)+$', '') AS remote FROM pages""")
def normalize_remote(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", scalars.normalize_remote(F.col("url")).alias("remote"))


@registered(r"""SELECT page_id, regexp_replace(regexp_replace(replace(trim('./' || url), '\', '/'), '^(\./)+', ''), '^/+', '') AS path FROM pages""")
def normalize_path(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", scalars.normalize_path(F.concat(F.lit("./"), F.col("url"))).alias("path"))


@registered("SELECT doc_id, 'node_' || left(sha256(lower(source || ':' || lang || ':' || doc_id)), 32) AS id FROM documents")
def symbol_id(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", scalars.symbol_id(F.col("source"), F.col("lang"), F.col("doc_id")).alias("id"))


@registered("SELECT 'supplier:' || s_suppkey AS id, 'nation:' || s_nationkey || ':contains:supplier:' || s_suppkey AS relation FROM supplier WHERE s_suppkey = 7 UNION ALL SELECT DISTINCT 'supplier:7', 'part:' || l_partkey || ':imports:supplier:7' FROM lineitem WHERE l_suppkey = 7")
def relations_of(spark: SparkSession, d: str) -> DataFrame:
    return find.relations_of(star.relations(spark, d), "supplier:7").select(F.lit("supplier:7").alias("id"), F.col("id").alias("relation"))


@registered("SELECT 'customer:' || c_custkey AS id, c_name AS label, c_mktsegment AS segment, c_nationkey::BIGINT AS nation FROM customer")
def typed_attributes(spark: SparkSession, d: str) -> DataFrame:
    e = star.entities(spark, d).where("kind = 'customer'")
    return e.select("id", "label", find.string_attribute("segment").alias("segment"), find.u32_attribute("nation").alias("nation"))


@registered(f"""WITH {star.SCORES_SQL}, r AS (SELECT DISTINCT l_partkey AS p, l_suppkey AS s FROM lineitem), o AS (SELECT DISTINCT l_orderkey, l_partkey AS p FROM lineitem)
SELECT 'part:' || p_partkey AS id, p_name AS label, (SELECT count(*) FROM o WHERE p = p_partkey) AS incoming, (SELECT count(*) FROM r WHERE p = p_partkey) AS outgoing,
       p_size::BIGINT AS size, round(s.stability, 6) AS stability, round(s.friction, 6) AS friction
FROM part JOIN s ON s.id = 'part:' || p_partkey""")
def node_view(spark: SparkSession, d: str) -> DataFrame:
    """Parts with their profiles, and their edges to suppliers and from orders."""
    sizes = star.entities(spark, d).where("kind = 'part'").select("id", F.col("attributes").alias("own"))
    e = derive.score(star.part_entities(spark, d)).join(sizes, "id").withColumn("attributes", F.col("own")).drop("own")
    r = star.relations(spark, d).where("kind IN ('calls', 'imports', 'contains')")
    view = find.node_views(e, r).join(e.select("id", find.u32_attribute("size").alias("size")), "id")
    return view.select("id", "label", F.size("incoming").cast("long").alias("incoming"), F.size("outgoing").cast("long").alias("outgoing"), "size", r6("avec.stability").alias("stability"), r6("avec.friction").alias("friction"))
