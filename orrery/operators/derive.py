"""Evidence derived from a whole snapshot: degrees, coverage and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orrery.functions.scalars import exact_u32, let, normalize_path
from orrery.functions.scores import METRICS, Weights, score_columns
from orrery.operators.find import string_attribute, u32_attribute
from orrery.schema import CODE_MODEL, REQUIRED, SCORE, SCORE_MODEL, MEASUREMENT


def semantic_languages(provenance: list[dict]) -> set[str]:
    """Languages whose semantic servers observed the snapshot."""
    out = set()
    for p in provenance:
        if p["observer"].startswith("lsp."):
            if p.get("source"):
                out.add(p["source"])
            elif p["observer"] == "lsp.rust-analyzer":
                out.add("rust")
    return out


def degrees(relations: DataFrame) -> DataFrame:
    """id, incoming, outgoing over all edges but `contains`; a self-loop counts
    both ways, parallel edges each."""
    edges = relations.where("kind <> 'contains'")
    ends = edges.select(F.explode(F.array(F.struct(F.col("to_id").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")), F.struct(F.col("from_id").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")))).alias("e"))
    return ends.groupBy("e.id").agg(F.sum("e.i").alias("incoming"), F.sum("e.o").alias("outgoing"))


def derive_graph_metrics(entities: DataFrame, relations: DataFrame, provenance: list[dict]) -> DataFrame:
    """entities with both degrees appended, where their language is covered; 0
    for isolated ones, which is evidence, as coverage is known."""
    covered = semantic_languages(provenance)
    if not covered:
        return entities
    found = entities.join(degrees(relations), "id", "left")
    made = F.array(
        *[
            F.struct(F.lit(f"graph.{k}_edges").alias("name"), F.coalesce(k, F.lit(0)).cast("double").alias("value"), F.lit("count").alias("unit"), F.lit("code.graph.metrics").alias("observer"), F.lit(1.0).alias("confidence"))
            for k in ("incoming", "outgoing")
        ]
    ).cast(f"array<{MEASUREMENT}>")
    fits = (F.col("model") == CODE_MODEL) & (F.col("kind") != "file") & string_attribute("language").isin(sorted(covered))
    return found.withColumn("measurements", F.when(fits, F.concat("measurements", made)).otherwise(F.col("measurements"))).drop("incoming", "outgoing")


def coverage_merge(lines: DataFrame) -> DataFrame:
    """Reports of one line as one: hit by any, most branches."""
    return lines.groupBy("file", "line").agg(F.max("hit").alias("hit"), F.max("branches_covered").alias("branches_covered"), F.max("branches_total").alias("branches_total"))


def coverage_path_match(paths: DataFrame, files: DataFrame) -> DataFrame:
    """(path, file): equal after normalisation, else the only file where one
    ends with the other at a slash. Suffixes are exploded, so that both ways
    are equality joins."""
    p = paths.select("path", normalize_path(F.col("path")).alias("np")).distinct()
    f = files.select("file", normalize_path(F.col("file")).alias("nf")).distinct()
    exact = p.join(f, F.col("np") == F.col("nf")).groupBy("path").agg(F.min("file").alias("file"))
    rest = p.join(exact.select("path"), "path", "left_anti")

    def tails(c: str):
        parts = F.split(c, "/")
        return F.explode(F.transform(F.sequence(F.lit(2), F.greatest(F.size(parts), F.lit(2))), lambda i: F.array_join(F.slice(parts, i, F.greatest(F.size(parts) - i + 1, F.lit(0))), "/")))

    by_file = rest.join(f.select("file", "nf", tails("nf").alias("tail")).where("tail <> ''"), F.col("np") == F.col("tail")).select("path", "file")
    by_path = rest.select("path", tails("np").alias("tail")).where("tail <> ''").join(f, F.col("nf") == F.col("tail")).select("path", "file")
    suffix = by_file.unionAll(by_path).distinct().groupBy("path").agg(F.min("file").alias("file"), F.count("*").alias("n")).where("n = 1").drop("n")
    return exact.unionByName(suffix)


def coverage_ratios(spans: DataFrame, lines: DataFrame) -> DataFrame:
    """id, line_coverage, branch_coverage of spans (id, file, line_start,
    line_end) over instrumented lines; none, no row; no branches, 1.

    The file is an equality, so that this is a hash join with a range filter."""
    hit = spans.select("id", "file", "line_start", F.coalesce("line_end", "line_start").alias("line_end")).join(lines, "file").where("line BETWEEN line_start AND line_end")
    total = F.sum("branches_total")
    return hit.groupBy("id").agg(
        (F.count_if(F.col("hit")) / F.count("*")).alias("line_coverage"),
        F.when(total > 0, F.sum("branches_covered") / total).otherwise(F.lit(1.0)).alias("branch_coverage"),
    )


def coverage_unmatched(files: DataFrame, measured: DataFrame) -> DataFrame:
    """Report files in which nothing was measured."""
    return files.select("file").distinct().join(measured.select("file").distinct(), "file", "left_anti")


def derive_coverage(entities: DataFrame, report: DataFrame) -> DataFrame:
    """entities with coverage ratios appended (report: file, line, hit, branches_*)."""
    lines = coverage_merge(report)
    spans = entities.where(F.col("model") == CODE_MODEL).select("id", string_attribute("file_path").alias("path"), u32_attribute("line_start").alias("line_start"), u32_attribute("line_end").alias("line_end"))
    spans = spans.where("path IS NOT NULL AND line_start IS NOT NULL")
    placed = spans.join(coverage_path_match(spans.select("path"), lines.select("file")), "path")
    found = entities.join(coverage_ratios(placed, lines), "id", "left")
    made = F.array(
        *[
            F.struct(F.lit(f"test.{k}").alias("name"), F.col(k).alias("value"), F.lit("ratio").alias("unit"), F.lit("code.coverage").alias("observer"), F.lit(1.0).alias("confidence"))
            for k in ("line_coverage", "branch_coverage")
        ]
    ).cast(f"array<{MEASUREMENT}>")
    return found.withColumn("measurements", F.when(F.col("line_coverage").isNotNull(), F.concat("measurements", made)).otherwise(F.col("measurements"))).drop("line_coverage", "branch_coverage")


def metrics(measurements: str = "measurements") -> Column:
    """A struct of the ten metrics of an entity's row, each from its best
    measurement (as best_measurements picks it); counts must be whole numbers
    of 32 bits."""
    ranked = F.array_sort(
        F.transform(
            measurements,
            lambda m, i: F.struct((-F.coalesce(m["confidence"], F.lit(0.0))).alias("doubt"), F.coalesce(m["observer"], F.lit("")).alias("observer"), (-i).alias("age"), m["name"].alias("name"), m["value"].alias("value")),
        )
    )

    def first(found: Column, name: str) -> Column:
        return F.get(F.filter(found, lambda m: m["name"] == name), F.lit(0))["value"]

    def wide(found: Column) -> Column:
        best = {k: first(found, n) for k, n in zip(METRICS, REQUIRED, strict=True)}
        return F.struct(*[(let(c, exact_u32) if k in METRICS[:7] else c).alias(k) for k, c in best.items()])

    return let(ranked, wide)


def metrics_pivot(entities: DataFrame) -> DataFrame:
    """id and the ten metrics, from the row alone."""
    return entities.select("id", metrics().alias("m")).select("id", "m.*")


def score(entities: DataFrame, weights: Weights = Weights()) -> DataFrame:
    """entities with the four scores anew, where all ten metrics are there. A
    projection: what a score needs stands in the entity's own row."""

    def scored(m: Column) -> Column:
        columns = score_columns({k: m[k] for k in METRICS}, weights)
        made = F.array(*[F.struct(F.lit(SCORE_MODEL).alias("model"), F.lit(weights.formula_version).alias("version"), F.lit(d).alias("dimension"), c.alias("value")) for d, c in columns.items()])
        return made.cast(f"array<{SCORE}>")

    def replaced(made: Column) -> Column:
        fits = (F.col("model") == CODE_MODEL) & (F.col("kind") != "file") & F.get(made, F.lit(0))["value"].isNotNull()
        rest = F.filter("scores", lambda s: s["model"] != SCORE_MODEL)
        return F.when(fits, F.concat(rest, made)).otherwise(F.col("scores"))

    return entities.withColumn("scores", let(let(metrics(), scored), replaced))


def file_history(changes: DataFrame, cutoff: int, path: str = "path", also: tuple[Column, ...] = ()) -> DataFrame:
    """Per lineage of changes (path, seq, ts in unix seconds, author): commits,
    contributors, first and last ts by sequence, mean days between changes
    (negative gaps are 0; one commit: 0), recent commits since cutoff and their
    frequency. also: further aggregates."""
    from orrery.functions.scalars import recent_frequency

    order = W.partitionBy(path).orderBy("seq")
    gap = F.greatest(F.col("ts") - F.lag("ts").over(order), F.lit(0)) / F.lit(86400.0)
    rows = changes.withColumn("gap", gap)
    n = F.count("*")
    out = rows.groupBy(path).agg(
        n.alias("commits"),
        F.count_distinct("author").alias("contributors"),
        F.min_by("ts", "seq").alias("created_at"),
        F.max_by("ts", "seq").alias("modified_at"),
        F.when(n > 1, F.coalesce(F.sum("gap"), F.lit(0.0)) / (n - 1)).otherwise(F.lit(0.0)).alias("average_days"),
        F.count_if(F.col("ts") >= cutoff).alias("recent"),
        *also,
    )
    return out.withColumn("frequency", recent_frequency(F.col("recent")))
