"""Mixing sources to target weights over fixed-length blocks.

The words of a source, its documents laid end to end in a pseudorandom order,
are cut into blocks of 32 words. Sources share the words of the whole mix by
weight; a target stops at 3 times its source, and what it can't take is shared
out again. Each output shard draws its source counts from a multinomial that
is conditioned on the sources' quotas over all shards: a source's quota is
dealt to the shards by a multinomial of its own, with a seed of its own, so
that counts given a shard's length are multinomial, the whole mix meets its
targets to a block, and shards differ in length by about the square root of it.
Slots of a source number on through the shards; a keyed permutation of the
source's block indices, another for each pass over it, maps slots to blocks,
and blocks are joined by index. A target of r times a source uses each block
floor(r) or ceil(r) times, hence at most 3.

Long or hot sources are laid out in a fixed number of buckets of their
documents, with two-level prefix sums. Sources are rows of a table throughout:
ranks come from a range sort and prefix sums, targets from a few aggregations,
draws from tasks. The driver gets sums by weight, and nothing per source, block
or slot.

Defined results: null, empty and blank texts have size 0 and take nothing; the
null source is one source, ordered last; repeated rows are documents of their
own; an empty table gives an empty result; other columns are ignored. The
draw depends on the rows and the seed only, not on the session's settings.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orrery.llm import kernels
from orrery.llm.session import partitions, prepare
from orrery.llm.text import word_count, words
from orrery.llm.workers import lean

BLOCK, CAP = 32, 3
#: Shards at most, and slots that a shard holds about, at least.
SHARDS, LEAST_SLOTS = 2000, 4096
#: Buckets that a source's documents are dealt to.
BUCKETS = 4096
#: Slots that one row of a task's input stands for, at most.
RUN = 1 << 16


def targets(sizes: list[int], weight: list[float], cap: float = CAP) -> list[float]:
    """Words for each source, of lists: shares of all words by weight, none
    above cap times its size, the excess shared again by weight among the
    others. The plain form of levels()."""
    out = [0.0] * len(sizes)
    free = {k for k, s in enumerate(sizes) if s > 0}
    left = float(sum(sizes))
    while free:
        level = left / sum(weight[k] for k in free)
        over = {k for k in free if level * weight[k] > cap * sizes[k]}
        for k in over or free:
            out[k] = float(cap * sizes[k]) if over else level * weight[k]
            left -= out[k]
        free = free - over if over else set()
    return out


def weight_of(number: Column) -> Column:
    """1, 2, 3, repeating, by the number of the source."""
    return (1 + F.pmod(number, F.lit(3))).cast("double")


def levels(sources: DataFrame, cap: float = CAP) -> float:
    """Words for each unit of weight: sources (source_size, weight) share all
    words by weight, none above cap times its size, the excess shared again by
    weight among the others. Infinite if all are at their caps. A round is one
    aggregation, and there are as many as the sharing out takes."""
    total = sources.agg(F.sum("source_size").cast("double")).first()[0] or 0.0
    # a source is at its cap from this level on
    limit = cap * F.col("source_size") / F.col("weight")
    level = 0.0
    while True:
        over = limit < level
        held = sources.agg(
            F.sum(F.when(over, cap * F.col("source_size")).otherwise(0.0)).alias("capped"),
            F.sum(F.when(over | (F.col("source_size") == 0), 0.0).otherwise(F.col("weight"))).alias("free"),
        ).first()
        if not held["free"]:
            return math.inf
        found = (total - held["capped"]) / held["free"]
        if found <= level:
            return level
        level = found


def ranked(sources: DataFrame) -> DataFrame:
    """sources (source, ...) with source_no: their order by code point from 0,
    null last. A range sort, and prefix sums of its partitions' counts."""
    null_last = [F.col("source").isNull(), F.col("source")]
    placed = sources.repartitionByRange(*null_last).sortWithinPartitions(*null_last).withColumn("at", F.monotonically_increasing_id()).checkpoint()
    part = F.shiftright("at", 33)
    counts = placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()
    starts, total = [], 0
    for row in sorted(counts):
        starts.append((row["part"], total))
        total += row["n"]
    known = sources.sparkSession.createDataFrame(starts, "part long, before long")
    return placed.join(F.broadcast(known), part == F.col("part")).withColumn("source_no", F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).drop("at", "part", "before")


def permute(i: np.ndarray, n: int, key: int) -> np.ndarray:
    """A keyed permutation of 0..n-1: a Feistel network over the next power of
    four, walked on until it falls below n."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    low, shift = np.uint64((1 << half) - 1), np.uint64(half)

    def once(x: np.ndarray) -> np.ndarray:
        a, b = x >> shift, x & low
        for r in range(4):
            salt = np.uint64((key * 4 + r + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
            a, b = b, a ^ (kernels.mix(b + salt) & low)
        return a << shift | b

    out = once(i.astype(np.uint64))
    while (far := np.flatnonzero(out >= n)).size:
        out[far] = once(out[far])
    return out.astype(np.int64)


@lean
def _draws(batches: Iterator[pa.RecordBatch], seed: int, shards: int) -> Iterator[pa.RecordBatch]:
    """Runs of slots: each source's quota dealt to the shards, in order."""
    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
    for batch in batches:
        for source, quota, n in zip(*(batch.column(c).to_pylist() for c in ("source_no", "quota", "blocks")), strict=True):
            counts = np.random.default_rng([seed, source]).multinomial(quota, np.full(shards, 1 / shards))
            first = np.cumsum(counts) - counts
            shard = np.flatnonzero(counts)
            runs = -(-counts[shard] // RUN)
            shard = np.repeat(shard, runs)
            step = (np.arange(len(shard)) - np.repeat(np.cumsum(runs) - runs, runs)) * RUN
            size = np.minimum(RUN, counts[shard] - step)
            columns = (shard, np.full(len(shard), source), first[shard] + step, size, np.full(len(shard), n))
            yield pa.RecordBatch.from_arrays([pa.array(c).cast(k) for c, k in zip(columns, kinds, strict=True)], names=["shard", "source_no", "first", "count", "blocks"])


@lean
def _slots(batches: Iterator[pa.RecordBatch], seed: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for shard, source, first, count, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            slot = np.arange(first, first + count)
            index = np.empty(count, np.int64)
            for e in np.unique(slot // n):
                own = slot // n == e
                index[own] = permute(slot[own] % n, n, seed + 7919 * source + 104729 * int(e))
            fixed = [pa.array(np.full(count, v), t) for v, t in ((shard, pa.int32()), (source, pa.int64()))]
            yield pa.RecordBatch.from_arrays(
                [*fixed, pa.array(slot), pa.array((slot // n).astype(np.int32)), pa.array(index)], names=["shard", "source_no", "slot", "pass", "block"]
            )


class Mix:
    """The parts of one mix. docs: doc_id, text, source; carry: further columns."""

    def __init__(self, docs: DataFrame, seed: int = 1, block: int = BLOCK, cap: float = CAP):
        prepare(docs.sparkSession)
        self.docs, self.seed, self.block, self.cap = docs, seed, block, cap
        self._plan()

    def _sized(self, carry: tuple[str, ...]) -> DataFrame:
        # the source as a key that is never null, and a bucket of its documents
        key = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")).alias("sk")
        h = F.xxhash64("doc_id", "text")
        bucket = F.pmod(h, F.lit(BUCKETS)).cast("int").alias("bucket")
        return self.docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), key, bucket, h.alias("h"), *carry)

    def _plan(self) -> None:
        sums = self._sized(()).groupBy("sk", "bucket").agg(F.sum("size").alias("words")).checkpoint()
        named = F.when(F.col("sk") != "", F.expr("substring(sk, 2)")).alias("source")
        sources = ranked(sums.groupBy("sk").agg(F.sum("words").alias("source_size")).select("*", named))
        sources = sources.withColumn("weight", weight_of(F.col("source_no"))).checkpoint()
        level = levels(sources, self.cap)
        most = (self.cap * F.col("source_size")).cast("double")
        share = F.least(F.lit(level) * F.col("weight"), most) if math.isfinite(level) else most
        target = F.when(F.col("source_size") > 0, share).otherwise(0.0)
        blocks = F.ceil(F.col("source_size") / self.block)
        quota = F.when(F.col("source_size") > 0, F.round(target * blocks / F.col("source_size"))).otherwise(0).cast("long")
        self.sources = sources.select("sk", "source_no", "source_size", target.alias("target"), blocks.alias("blocks"), quota.alias("quota")).checkpoint()
        self.total = self.sources.agg(F.sum("quota")).first()[0] or 0
        before = F.coalesce(F.sum("words").over(W.partitionBy("sk").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        known = self.sources.drop("blocks", "quota")
        self.starts = sums.select("sk", "bucket", before.alias("base")).join(known, "sk").checkpoint()

    def layout(self, carry: tuple[str, ...] = ()) -> DataFrame:
        """Each row with source_no, source_size, target and start: the number of
        its source's words before it."""
        order = W.partitionBy("sk", "bucket").orderBy("h", "doc_id", "size").rowsBetween(W.unboundedPreceding, 0)
        placed = self._sized(carry).withColumn("upto", F.sum("size").over(order)).join(self.starts, ["sk", "bucket"])
        return placed.withColumn("start", F.col("base") + F.col("upto") - F.col("size")).drop("sk", "bucket", "base", "upto", "h")

    def slots(self) -> DataFrame:
        """shard, source_no, slot, pass, block: every draw of the mix."""
        shards = min(SHARDS, max(1, math.ceil(self.total / LEAST_SLOTS)))
        runs = self.sources.where("quota > 0").select("source_no", "quota", "blocks").mapInArrow(
            partial(_draws, seed=self.seed, shards=shards), "shard int, source_no long, first long, count long, blocks long"
        )
        dealt = runs.repartition(partitions(self.docs.sparkSession), "source_no", "first")
        return dealt.mapInArrow(partial(_slots, seed=self.seed), "shard int, source_no long, slot long, pass int, block long")

    def pieces(self, layout: DataFrame) -> DataFrame:
        """source_no, block, start, skip, words: the stretch of words that each
        document has in each block; skip: the document's words before it."""
        b = self.block
        whole = layout.where("size > 0").select(
            "source_no", "start", "size", F.explode(F.expr(f"sequence(start div {b}, (start + size - 1) div {b})")).alias("block")
        )
        lo, hi = F.greatest(F.col("start"), F.col("block") * b), F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * b)
        return whole.select("source_no", "block", "start", (lo - F.col("start")).alias("skip"), (hi - lo).alias("words"))

    def drawn(self, layout: DataFrame) -> DataFrame:
        """pieces joined by block index with the slots that draw them. Both sides
        come from few small rows, by whose size Spark would judge them small enough
        to broadcast through the driver; the hint has them merged."""
        return self.pieces(layout).join(self.slots().hint("merge"), ["source_no", "block"])


def taken_words(docs: DataFrame, seed: int = 1) -> DataFrame:
    """doc_id, source, size, source_size, target, taken for every row."""
    mix = Mix(docs, seed)
    layout = mix.layout().checkpoint()
    taken = mix.drawn(layout).groupBy("source_no", "start").agg(F.sum("words").alias("taken")).withColumnsRenamed({"source_no": "n", "start": "at"})
    on = (F.col("source_no") == F.col("n")) & (F.col("start") == F.col("at")) & (F.col("size") > 0)
    return layout.join(taken, on, "left").select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, seed: int = 1) -> DataFrame:
    """The mix as documents: for each document and pass over its source, the
    words that the pass draws from it, with the document's other columns. Text
    is as it was if the pass draws all of it, else words joined by one space."""
    rows = docs.select("doc_id", "source", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"))
    mix = Mix(rows, seed)
    spans = (
        mix.drawn(mix.layout())
        .groupBy("source_no", "start", "pass")
        .agg(F.array_sort(F.collect_list(F.struct("skip", "words"))).alias("spans"), F.sum("words").alias("got"))
        .withColumnsRenamed({"source_no": "n", "start": "at"})
    )
    on = (F.col("source_no") == F.col("n")) & (F.col("start") == F.col("at")) & (F.col("size") > 0)
    found = mix.layout(("__row",)).join(spans, on)
    # The words are bound once, as a lambda's argument: as a column they would be
    # put in place of their name, and split anew for every span.
    cut = lambda w: F.array_join(F.transform("spans", lambda s: F.array_join(F.slice(w, (s["skip"] + 1).cast("int"), s["words"].cast("int")), " ")), " ")
    parts = F.get(F.transform(F.array(words(F.col("__row.text"))), cut), 0)
    text = F.when(F.col("got") == F.col("size"), F.col("__row.text")).otherwise(parts)
    out = found.select("__row", text.alias("__text"))
    fresh = {"text": F.col("__text"), "n_chars": F.length("__text").cast("long")}
    return out.select(*[fresh.get(c, F.col("__row")[c]).alias(c) for c in docs.columns])
