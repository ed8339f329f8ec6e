"""Quality rules as a bitmask ledger, in Spark expressions only.

Every rule is evaluated once per document. The ledger keeps the measurements
and one bit per failed rule; policies are versioned masks over those bits, so
that applying another policy, or asking what each rule alone costs, never
reads a text again.

Defined results: a null or empty text has no words and fails ``too_short``.
Repeated rows each get their own verdict. Extra columns pass through
``ledger``; those whose names clash with its own are replaced by them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.llm.text import free_prefix, words

#: Words in a window for repetition.
WINDOW = 5
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """A name, the bit it owns for good, and the SQL condition of failure."""

    name: str
    bit: int
    fails: str


#: Bits are never reused; a changed threshold is a new rule.
RULES = (
    Rule("too_short", 0, "n_words < 10"),
    Rule("repeated_windows", 1, "100 * n_repeat_words > 20 * n_words"),
    Rule("symbol_heavy", 2, "10 * n_symbols > n_words"),
    Rule("duplicate_lines", 3, "2 * n_dup_lines > n_lines"),
    Rule("short_words", 4, "word_chars < 2 * n_words"),
    Rule("long_words", 5, "word_chars > 20 * n_words"),
)
#: Policy versions: the rules that count.
POLICIES = {
    "v1": ("too_short", "repeated_windows"),
    "v2": tuple(r.name for r in RULES),
}
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def mask(policy: str) -> int:
    """The bits that a policy counts."""
    return sum(1 << r.bit for r in RULES if r.name in POLICIES[policy])


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the measurements and fail_bits (long)."""
    own = (*MEASURES, "fail_bits")
    kept = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in own])
    prefix = free_prefix(kept.columns)
    w, lines, h, s, p = (prefix + name for name in ("w", "lines", "h", "s", "p"))
    step = kept.withColumn(w, words(F.col(text)))
    step = step.withColumn(lines, F.filter(F.split(F.col(text), "\n"), lambda x: F.length(F.btrim(x, F.lit(" \t\n\x0b\x0c\r"))) > 0))
    step = step.withColumn(
        h,
        F.expr(f"""
        CASE WHEN size({w}) > {WINDOW} THEN
          transform(sequence(0, size({w}) - {WINDOW}), i -> xxhash64({', '.join(f'{w}[i + {k}]' for k in range(WINDOW))}))
        ELSE CAST(array() AS array<bigint>) END"""),
    )
    # (hash, position), sorted, only where some hash comes twice
    step = step.withColumn(
        s,
        F.expr(f"CASE WHEN size({h}) > size(array_distinct({h})) THEN array_sort(transform({h}, (h, i) -> struct(h, i))) END"),
    )
    # positions of windows that have an equal neighbour, in text order
    step = step.withColumn(
        p,
        F.expr(f"""
        array_sort(filter(
          transform({s}, (x, k) -> CASE WHEN x.h = get({s}, k - 1).h OR x.h = get({s}, k + 1).h THEN x.i ELSE -1 END),
          i -> i >= 0))"""),
    )
    # each covers WINDOW words, less what the next one covers again
    step = step.withColumn(
        "n_repeat_words",
        F.expr(f"coalesce(aggregate(transform({p}, (p, k) -> least({WINDOW}, coalesce(get({p}, k + 1) - p, {WINDOW}))), 0L, (a, x) -> a + x), 0L)"),
    )
    step = (
        step.withColumn("n_words", F.size(w).cast("long"))
        .withColumn("word_chars", F.length(F.array_join(w, "")).cast("long"))
        .withColumn("n_symbols", F.coalesce(F.regexp_count(F.col(text), F.lit(r"[#*$%&|<>]")), F.lit(0)).cast("long"))
        .withColumn("n_lines", F.coalesce(F.size(lines), F.lit(0)).cast("long"))
        .withColumn("n_dup_lines", F.when(F.col("n_lines") > 0, F.size(lines) - F.size(F.array_distinct(lines))).otherwise(0).cast("long"))
        .drop(w, lines, h, s, p)
    )
    bits = " + ".join(f"CASE WHEN {r.fails} THEN {1 << r.bit}L ELSE 0L END" for r in RULES)
    # The partition's number keeps a filter on the bits from being pushed below:
    # put in place of its columns, the rules would be evaluated for every word.
    return step.withColumn("fail_bits", F.expr(bits) + F.lit(0) * F.spark_partition_id())


def verdict(policy: str = "v2") -> Column:
    """True where no rule of the policy failed."""
    return F.col("fail_bits").bitwiseAND(F.lit(mask(policy))) == 0


def apply_policy(docs: DataFrame, policy: str = "v2", text: str = "text") -> DataFrame:
    """The documents that pass, with their own columns and values only."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    entries = ledger(docs.select(F.col(f"`{text}`").alias("text"), whole.alias("row")))
    return entries.where(verdict(policy)).select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def ablations(entries: DataFrame, policy: str = "v2") -> DataFrame:
    """Per rule of the policy: documents that fail it, that fail it alone, and
    that would be kept without it. One row per pattern of bits is shuffled."""
    whole = mask(policy)
    bits = entries.groupBy("fail_bits").agg(F.count("*").alias("n"))
    rules = [r for r in RULES if r.name in POLICIES[policy]]
    sums = bits.agg(
        *[
            F.coalesce(F.sum(F.when(F.expr(cond), F.col("n"))), F.lit(0)).alias(f"{r.name}_{k}")
            for r in rules
            for k, cond in (
                ("failed", f"fail_bits & {1 << r.bit} != 0"),
                ("alone", f"fail_bits & {whole} = {1 << r.bit}"),
                ("kept", f"fail_bits & {whole & ~(1 << r.bit)} = 0"),
            )
        ]
    )
    return sums.select(
        F.explode(
            F.array(*[F.struct(F.lit(r.name).alias("rule"), *[F.col(f"{r.name}_{k}").alias(k) for k in ("failed", "alone", "kept")]) for r in rules])
        ).alias("x")
    ).select("x.*")
