"""Scalar functions as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# File extension to language.
LANGUAGES = {
    "cs": "csharp",
    "ts": "typescript",
    "tsx": "typescript",
    "js": "javascript",
    "jsx": "javascript",
    "mjs": "javascript",
    "cjs": "javascript",
    "py": "python",
    "go": "go",
    "rs": "rust",
    "java": "java",
    "cpp": "cpp",
    "cc": "cpp",
    "cxx": "cpp",
    "hpp": "cpp",
    "hh": "cpp",
    "hxx": "cpp",
    "c": "c",
    "h": "c",
    "rb": "ruby",
    "php": "php",
    "swift": "swift",
    "kt": "kotlin",
    "kts": "kotlin",
    "scala": "scala",
    "sc": "scala",
    "lua": "lua",
    "pl": "perl",
    "pm": "perl",
    "sol": "solidity",
}
# Language to media type.
MEDIA_TYPES = {
    "rust": "text/x-rust",
    "csharp": "text/x-csharp",
    "typescript": "text/typescript",
    "javascript": "text/javascript",
    "python": "text/x-python",
    "go": "text/x-go",
    "java": "text/x-java-source",
    "c": "text/x-c",
    "cpp": "text/x-c++",
}


#: For str.translate: A-Z folded only.
ASCII_LOWER = {c: c + 32 for c in range(65, 91)}


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once for a row, however often body
    names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def json_string(c: Column) -> Column:
    """A string as JSON text, escaped; null for null."""
    return F.when(c.isNotNull(), F.regexp_extract(F.to_json(F.struct(c.cast("string").alias("v"))), r'(?s)^\{"v":(.*)\}$', 1))


def ascii_lower(c: Column) -> Column:
    """A-Z folded only, unlike lower()."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def hashed_id(prefix: str, *parts: Column) -> Column:
    """prefix and the first 16 bytes, in hex, of SHA-256 of the lower-cased
    parts joined by colons."""
    whole = F.lower(F.concat_ws(":", *[p.cast("string") for p in parts]))
    return F.concat(F.lit(prefix), F.substring(F.sha2(whole, 256), 1, 32))


def symbol_id(path: Column, name: Column, line: Column) -> Column:
    return hashed_id("node_", path, name, line)


def module_id(language: Column, target: Column) -> Column:
    return hashed_id("module_", language, target)


def file_id(path: Column) -> Column:
    return F.concat(F.lit("file:"), path)


def contains_id(path: Column, symbol: Column) -> Column:
    return F.concat(F.lit("contains:"), path, F.lit(":"), symbol)


def dependency_id(source: Column, kind: Column, target: Column) -> Column:
    return F.concat(source, F.lit(":"), kind, F.lit(":"), target)


def normalize_path(c: Column) -> Column:
    """Trimmed, slashes forward, without leading ./ and then without leading /."""
    slashed = F.translate(F.trim(c), "\\", "/")
    return F.regexp_replace(F.regexp_replace(slashed, r"^(?:\./)+", ""), r"^/+", "")


def normalize_remote(c: Column) -> Column:
    """host/path of a remote: scheme, user and .git endings gone; null if empty."""
    bare = F.regexp_replace(F.trim(c), r"/+$", "")
    scp = F.regexp_replace(F.substring(bare, 5, 1 << 30), r"^([^:]*):", r"$1/")
    rest = F.regexp_replace(bare, r"^.*?://", "")
    url = F.when(F.contains(bare, F.lit("://")), F.regexp_replace(rest, r"^[^@]*@", "")).otherwise(bare)
    out = F.when(F.startswith(bare, F.lit("git@")), scp).otherwise(url)
    return F.when(bare != "", F.regexp_replace(out, r"(?:\.git)+$", ""))


def detect_language(path: Column) -> Column:
    """Language of a path by its last extension; null if unknown."""
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    extension = F.regexp_extract(name, r"^.+\.([^.]*)$", 1)
    return _lookup(LANGUAGES, ascii_lower(extension))


def media_type(language: Column) -> Column:
    return _lookup(MEDIA_TYPES, language)


def clamp01(c: Column) -> Column:
    return F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))


def recent_frequency(count: Column) -> Column:
    """low under 3, medium under 10, else high."""
    return F.when(count <= 2, "low").when(count <= 9, "medium").otherwise("high")


def exact_u32(c: Column) -> Column:
    """c if it is a whole number of 32 bits, else null."""
    return F.when((c >= 0) & (c <= 4294967295.0) & (F.floor(c) == c) & ~F.isnan(c), c)
