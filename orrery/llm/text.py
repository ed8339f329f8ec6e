"""Word expressions that all operators share.

A word is a run of characters other than space and U+0009..U+000D. Null texts
have no words.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that part words, as a string for trim() and as a regex class.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_CLASS = r"[ \t-\r]+"


def words(text: Column) -> Column:
    """array<string> of a text's words; empty for null, empty or blank texts."""
    bare = F.btrim(text, F.lit(BLANKS))
    return F.when(F.length(bare) > 0, F.split(bare, BLANK_CLASS)).otherwise(F.array().cast("array<string>"))


def word_count(text: Column) -> Column:
    """Number of words as long; 0 for null."""
    bare = F.btrim(text, F.lit(BLANKS))
    return F.when(F.length(bare) > 0, F.regexp_count(bare, F.lit(BLANK_CLASS)) + 1).otherwise(0).cast("long")


def free_prefix(columns: list[str]) -> str:
    """A prefix that no column begins with, for columns of an operator's own."""
    prefix = "__"
    while any(c.lower().startswith(prefix) for c in columns):
        prefix += "_"
    return prefix
