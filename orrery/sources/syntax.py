"""A host for syntax analysers: which files they read, one observation per
file, and what could not be parsed.

An analyser is a name, a language, extensions and a function of (path, bytes)
that returns (rows of SYMBOL, whether the source is whole). Files are read by
language or by extension; each is observed alone, so that this is a map over
rows. Files that are not whole still give what was found, and a diagnostic; the
coverage of such a host is always partial.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.functions.scalars import contains_id, symbol_id
from orrery.sources import rust

NO_TREE = "the source gave no syntax tree"
BROKEN = "source contains syntax errors; observations may be incomplete"
COVERAGE = "partial"


@dataclass(frozen=True)
class Syntax:
    observer: str
    language: str
    extensions: tuple[str, ...]
    observe: Callable[[str, bytes], tuple[list[tuple], bool] | None]


def supported(files: DataFrame, syntax: Syntax) -> DataFrame:
    """files (path, language, ...) of the language or with an extension of it."""
    extension = F.regexp_extract("path", r"[^/.][^/]*\.([^./]+)$", 1)
    return files.where((F.col("language") == syntax.language) | extension.isin(*syntax.extensions))


def observe(contents: DataFrame, syntax: Syntax) -> tuple[DataFrame, DataFrame]:
    """(symbols with id and contains_id, diagnostics) of contents (path,
    content: binary)."""
    names = [c.split(" ")[0] for c in rust.SYMBOL.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for path, raw in zip(pdf["path"], pdf["content"], strict=True):
                found = syntax.observe(path, b"" if raw is None else bytes(raw))
                symbols, whole = ([], True) if found is None else found
                rows += [(*r, None) for r in symbols]
                if found is None or not whole:
                    rows.append((path, *[None] * (len(names) - 1), NO_TREE if found is None else BROKEN))
            yield pd.DataFrame(rows, columns=[*names, "problem"])

    found = contents.select("path", "content").mapInPandas(run, rust.SYMBOL + ", problem string")
    symbols = found.where("problem IS NULL").drop("problem").withColumn("id", symbol_id(F.col("path"), F.col("name"), F.col("line_start")))
    problems = found.where("problem IS NOT NULL").select(F.lit("warning").alias("severity"), F.lit(syntax.observer).alias("observer"), F.col("problem").alias("message"), F.col("path").alias("scope"))
    return symbols.withColumn("contains_id", contains_id(F.col("path"), F.col("id"))), problems


def observe_rust(path: str, raw: bytes) -> tuple[list[tuple], bool] | None:
    """Symbols of a Rust file; whole if its text is UTF-8 and brackets close."""
    try:
        source = raw.decode()
    except UnicodeDecodeError:
        return None
    return rust.symbols(path, source), rust.balanced(source)


RUST = Syntax("treesitter.rust", "rust", ("rs",), observe_rust)
