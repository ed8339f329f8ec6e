"""Symbols, references, calls and bases from saved language-server answers.

Document symbols are trees of unknown depth: one pass in Python flattens each
document's JSON; everything after is joins. Servers themselves are external.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orrery.functions.scalars import contains_id, dependency_id, file_id, json_string, symbol_id
from orrery.schema import CODE_MODEL, MEASUREMENT, OTHER_WEIGHT, SCORE, WEIGHTS

# Symbol kind numbers of the protocol to entity kinds.
KINDS = {2: "module", 4: "module", 3: "namespace", 5: "type", 10: "type", 23: "type", 11: "interface", 6: "method", 9: "method", 12: "function", 7: "field", 8: "field", 14: "constant", 22: "constant"}
CALLABLE, NAMESPACES = (6, 9, 12), (2, 3, 4)
CATALOG = "path string, name string, kind string, callable boolean, line_start long, line_end long, namespace string, detail string, sel_line long, sel_char long"


def _flatten(symbols: list, path: str, namespace: str | None, out: list[tuple]) -> None:
    for s in symbols if isinstance(symbols, list) else []:
        name, kind = s.get("name"), s.get("kind")
        span = s.get("range") or (s.get("location") or {}).get("range")
        start = ((s.get("selectionRange") or span) or {}).get("start")
        if not isinstance(name, str) or not isinstance(kind, int) or not start:
            continue
        line = start.get("line")
        if kind in KINDS and isinstance(line, int):
            end = ((span or {}).get("end") or {}).get("line")
            out.append((path, name, KINDS[kind], kind in CALLABLE, line + 1, (end if isinstance(end, int) else line) + 1, namespace, s.get("detail"), line, start.get("character")))
        inner = (f"{namespace}.{name}" if namespace else name) if kind in NAMESPACES else namespace
        _flatten(s.get("children"), path, inner, out)


def lsp_symbols(documents: DataFrame) -> DataFrame:
    """Catalog of symbols with ids, from (path, symbols: JSON of the answer)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split(" ")[0] for c in CATALOG.split(", ")]
        for pdf in frames:
            out: list[tuple] = []
            for path, text in zip(pdf["path"], pdf["symbols"], strict=True):
                _flatten(json.loads(text), path, None, out)
            yield pd.DataFrame(out, columns=names)

    found = documents.select("path", "symbols").mapInPandas(run, CATALOG)
    return found.withColumn("id", symbol_id(F.col("path"), F.col("name"), F.col("line_start")))


def innermost(catalog: DataFrame, points: DataFrame) -> DataFrame:
    """points (path, line from 1, ...) with owner: the symbol of fewest lines around it."""
    marked = points.withColumn("__p", F.monotonically_increasing_id())
    hit = marked.join(catalog.select("path", F.col("id").alias("owner"), "line_start", "line_end"), "path").where("line BETWEEN line_start AND line_end")
    order = W.partitionBy("__p").orderBy(F.col("line_end") - F.col("line_start"), "owner")
    return hit.withColumn("__r", F.row_number().over(order)).where("__r = 1").drop("__p", "__r", "line_start", "line_end")


def lsp_references(catalog: DataFrame, locations: DataFrame) -> DataFrame:
    """Edges owner -> target of locations (target, path, line), self excluded."""
    return innermost(catalog, locations).where("owner <> target").select(F.col("owner").alias("from_id"), F.lit("references").alias("kind"), F.col("target").alias("to_id")).distinct()


def lsp_calls(catalog: DataFrame, calls: DataFrame) -> DataFrame:
    """Edges of outgoing calls (caller, path, name, sel_line, sel_char)."""
    target = catalog.where("callable").select("path", "name", "sel_line", "sel_char", F.col("id").alias("to_id"))
    return calls.join(target, ["path", "name", "sel_line", "sel_char"]).select(F.col("caller").alias("from_id"), F.lit("calls").alias("kind"), "to_id").distinct()


def base_names(detail: Column) -> Column:
    """Names after the first colon of a detail: generics, qualifiers and
    punctuation off, capitals only; none if a parenthesis follows."""
    rest = F.regexp_extract(detail, r"(?s)^[^:]*:(.*)$", 1)
    part = lambda p: F.regexp_replace(F.regexp_replace(F.trim(F.split(p, "<")[0]), r"^[^A-Za-z0-9_.]+|[^A-Za-z0-9_.]+$", ""), r"^.*\.", "")
    names = F.filter(F.transform(F.split(rest, ","), part), lambda n: F.regexp_like(n, F.lit(r"^\p{Lu}")))
    return F.when(~F.contains(rest, F.lit("(")), names)


def lsp_bases(catalog: DataFrame, language: str) -> tuple[DataFrame, DataFrame]:
    """(edges, unresolved types): a base is a symbol of its name in the same
    file, else in any, else an unresolved type. In C# `I` and a capital mark
    an interface, which is implemented; all else is inherited."""
    own = catalog.where("kind IN ('type', 'interface')").select("id", "path", F.explode(base_names(F.col("detail"))).alias("base"))
    c = catalog.select(F.col("name").alias("base"), F.col("path").alias("found_in"), F.col("id").alias("target"), "line_start")
    order = W.partitionBy("id", "base").orderBy((F.col("found_in") == F.col("path")).desc_nulls_last(), "found_in", "line_start", "target")
    best = own.join(c, "base", "left").withColumn("r", F.row_number().over(order)).where("r = 1")
    missing = symbol_id(F.lit(f"unresolved/{language}"), F.col("base"), F.lit(1))
    csharp = F.lit(language.lower() == "csharp") & F.regexp_like("base", F.lit(r"^I\p{Lu}"))
    edges = best.select(F.col("id").alias("from_id"), F.when(csharp, "implements").otherwise("inherits").alias("kind"), F.coalesce("target", missing).alias("to_id")).where("from_id <> to_id").distinct()
    return edges, best.where("target IS NULL").select(missing.alias("id"), F.col("base").alias("label")).distinct()


def _entity(df: DataFrame, fixed: tuple[Column, ...], kind: Column, label: Column, attributes: dict[str, Column]) -> DataFrame:
    pairs = F.create_map(*[x for k, c in attributes.items() for x in (F.lit(k), c)])
    empty = lambda t: F.array().cast(f"array<{t}>")
    return df.select(
        *fixed, "id", F.lit(CODE_MODEL).alias("model"), kind.alias("kind"), label.alias("label"),
        F.map_filter(pairs, lambda k, v: v.isNotNull()).alias("attributes"), empty(MEASUREMENT).alias("measurements"), empty(SCORE).alias("scores"),
    )


def dependency_edges(edges: DataFrame, world: str, version: str) -> DataFrame:
    """Relations of edges (from_id, kind, to_id), each once, weighed by kind."""
    weight = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in WEIGHTS.items() for x in kv]), F.col("kind")), F.lit(OTHER_WEIGHT))
    return edges.select("from_id", "kind", "to_id").distinct().select(
        F.lit(world).alias("world"), F.lit(version).alias("version"), dependency_id(F.col("from_id"), F.col("kind"), F.col("to_id")).alias("id"), F.lit(CODE_MODEL).alias("model"), "kind", "from_id", "to_id", weight.alias("weight"),
        F.create_map().cast("map<string,string>").alias("attributes"),
    )


def lsp_assemble(catalog: DataFrame, edges: DataFrame, unresolved: DataFrame, language: str, world: str, version: str) -> tuple[DataFrame, DataFrame]:
    """(entities, relations) of a language server's view: an entity for each
    file and symbol of the catalog and for each unresolved type (id, label) that
    an edge leads to, contains edges, and edges (from_id, kind, to_id)."""
    fixed, lang = (F.lit(world).alias("world"), F.lit(version).alias("version")), json_string(F.lit(language))
    path = json_string(F.col("path"))
    files = _entity(catalog.select("path", file_id(F.col("path")).alias("id")).distinct(), fixed, F.lit("file"), F.col("path"), {"language": lang, "file_path": path})
    qualified = F.when(F.col("namespace") != "", F.concat("namespace", F.lit("."), "name")).otherwise(F.col("name"))
    symbols = _entity(
        catalog, fixed, F.col("kind"), F.col("name"),
        {
            "language": lang, "qualified_name": json_string(qualified), "file_path": path, "line_start": F.col("line_start").cast("string"), "line_end": F.col("line_end").cast("string"),
            "namespace": json_string(F.col("namespace")), "signature": json_string(F.col("detail")),
        },
    )
    met = unresolved.select("id", "label").distinct().join(edges.select(F.col("to_id").alias("id")).distinct(), "id", "left_semi").join(catalog.select("id"), "id", "left_anti")
    types = _entity(met, fixed, F.lit("type"), F.col("label"), {"language": lang, "resolution": json_string(F.lit("unresolved")), "qualified_name": json_string(F.col("label"))})
    held = catalog.select("path", "id").distinct().select(
        *fixed, contains_id(F.col("path"), F.col("id")).alias("id"), F.lit(CODE_MODEL).alias("model"), F.lit("contains").alias("kind"), file_id(F.col("path")).alias("from_id"), F.col("id").alias("to_id"), F.lit(WEIGHTS["contains"]).alias("weight"),
        F.create_map().cast("map<string,string>").alias("attributes"),
    )
    return files.unionByName(symbols).unionByName(types), held.unionByName(dependency_edges(edges, world, version))


def rust_analyzer(catalog: DataFrame, locations: DataFrame, calls: DataFrame, world: str, version: str) -> DataFrame:
    """Relations only: the references and calls that rust-analyzer answers with,
    between symbols that the syntax analyser found."""
    return dependency_edges(lsp_references(catalog, locations).unionByName(lsp_calls(catalog, calls)), world, version)
