"""Removal of repeated passages by fixed-block anchors.

Every document is cut into consecutive, non-overlapping blocks of 18 words;
their hashes are the index. Every rolling window of 18 words probes it. Two
equal passages of 35 words or more (2 * 18 - 1) each hold a whole block of
their own document, so that each passage is hit through the other's blocks,
whatever their alignment. Hits are extended to the 35-word windows around
them, and the windows that come twice are joined to maximal exact repeats.

Texts are dealt into chunks by a hash of the row and its partition; a chunk is
the unit that asks and is answered. Per chunk, a hash goes out once: windows
that repeat inside a chunk need no answer. Questions are 4 bytes per window
besides the part that their hash selects; false answers only add candidates.
Those are decided by 128 bits, two hashes that are computed independently from
the bytes of the words. The chunked texts are shuffled once; all three steps
read that shuffle.

What a task holds is a chunk's texts, the distinct blocks of one part's index
(PART bytes of text make a part), or the candidates of one part's sequel
(SETTLE bytes). Chunks and parts of both kinds grow in number with the data.

Defined results: null, empty and blank texts have no words; windows are judged
on the input; repeated rows are documents of their own, and so repeat each
other's windows; a null doc_id is an id like others; texts under 35 words keep
all; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from functools import partial
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orrery.llm import kernels
from orrery.llm.session import nullable, partitions, prepare
from orrery.llm.workers import lean

WINDOW = 35
#: Bytes of text that a chunk holds about, and whose blocks or candidate
#: windows one part takes.
CHUNK, PART, SETTLE = 3 << 20, 256 << 20, 16 << 20
#: What kinds of message a part gets; an index comes before its questions.
INDEX, ASK = 0, 1


def block_words(window: int) -> int:
    """The longest block of which every window holds a whole one."""
    return (window + 1) // 2


class Chunk:
    """The texts of one chunk, sorted, with their words' hashes end to end."""

    def __init__(self, table: pa.Table):
        self.table = table
        self.data, self.first = kernels.separated(*kernels.text_buffers(table.column("text")))
        self.words, starts = self._hashed(0)
        #: Index of each text's first word, and one past the last.
        self.cut = np.searchsorted(starts, self.first)

    def _hashed(self, lane: int) -> tuple[np.ndarray, np.ndarray]:
        """(hashes, starts) of all words."""
        words, starts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for part in kernels.blocks(np.diff(self.first), 1 << 20):
            lo, hi = self.first[part.start], self.first[part.stop]
            at, _, hashes = kernels.word_hashes(self.data[lo:hi], lower=False, lane=lane)
            words.append(hashes)
            starts.append(at + lo)
        return np.concatenate(words), np.concatenate(starts)

    def windows(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(positions, hashes) of the windows that lie within one text."""
        n = len(self.words)
        if n < width:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        inside = np.ones(n - width + 1, bool)
        for edge in self.cut[1:-1]:
            inside[max(0, edge - width + 1) : edge] = False
        at = np.flatnonzero(inside)
        return at, _runs(self.words, width)[at]

    def second(self, at: np.ndarray, width: int) -> np.ndarray:
        """The windows at these positions by the other hash of the words."""
        return _runs(self._hashed(1)[0], width)[at] if len(at) else np.zeros(0, np.uint64)

    def offsets(self, at: np.ndarray) -> np.ndarray:
        """Positions counted from the start of their own texts."""
        return at - self.cut[np.searchsorted(self.cut, at, "right") - 1]


def _runs(words: np.ndarray, width: int, step: int = 1 << 18) -> np.ndarray:
    """Hashes of all windows, a stretch at a time."""
    n = len(words)
    return np.concatenate([np.zeros(0, np.uint64)] + [kernels.window_hashes(words[a : min(a + step + width - 1, n)], width) for a in range(0, n - width + 1, step)])


def _sorted_chunk(table: pa.Table) -> Chunk:
    """Row order within a chunk is made the same in every step."""
    return Chunk(table.sort_by([("doc_id", "ascending"), ("text", "ascending")]))


def _dealt(hashes: np.ndarray, parts: int) -> np.ndarray:
    """The part of a hash, from other bits than messages hold."""
    return (kernels.mix(hashes ^ np.uint64(0x6A09E667F3BCC909)) >> np.uint64(33)) % np.uint64(parts)


def _alone(*hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the first occurrence of each distinct value, mask of which come once)."""
    order = np.argsort(hashes[0], kind="stable") if len(hashes) == 1 else np.lexsort(hashes)
    new = np.zeros(len(order), bool)
    new[:1] = True
    for h in hashes:
        ranked = h[order]
        new[1:] |= ranked[1:] != ranked[:-1]
    heads = np.flatnonzero(new)
    once = np.diff(np.concatenate((heads, [len(order)]))) == 1
    return order[heads], once


def _stretches(part: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """(order by part, where each part begins and ends in it)."""
    order = np.argsort(part.astype(np.uint32), kind="stable")
    edges = np.flatnonzero(np.diff(part[order], prepend=np.uint64(1 << 60), append=np.uint64(1 << 60)))
    return order, [*zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]


MESSAGE = "part int, kind int, chunk int, hashes binary, positions binary"
_TYPES = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary())


def _message_table(rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) if rows else [()] * 5
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True)], names=["part", "kind", "chunk", "hashes", "positions"])


def _delta(at: np.ndarray) -> bytes:
    """Ascending positions as gaps, seven bits to a byte, low bits first; the
    last byte of a gap has its high bit clear."""
    gaps = np.diff(at, prepend=-1) - 1
    size = 1 + sum((gaps >= 1 << k).astype(np.int64) for k in (7, 14, 21, 28))
    stop = np.cumsum(size)
    out = np.empty(int(stop[-1]) if len(stop) else 0, np.uint8)
    for k in range(5):
        has = size > k
        out[(stop - size)[has] + k] = (gaps[has] >> 7 * k & 127) | np.where(size[has] > k + 1, 128, 0)
    return out.tobytes()


def _undelta(packed: bytes) -> np.ndarray:
    code = np.frombuffer(packed, np.uint8)
    if not len(code):
        return np.zeros(0, np.int64)
    stop = np.flatnonzero(code < 128)
    start = np.concatenate(([0], stop[:-1] + 1))
    place = np.arange(len(code)) - np.repeat(start, stop - start + 1)
    gaps = np.add.reduceat((code & 127).astype(np.int64) << 7 * place, start)
    return np.cumsum(gaps + 1) - 1


def _ask_blocks(key: tuple, table: pa.Table, window: int, parts: int) -> pa.Table:
    """A chunk's blocks for the index and its rolling windows as questions."""
    own, chunk, width = _sorted_chunk(table), key[0].as_py(), block_words(window)
    at, hashes = own.windows(width)
    aligned = own.offsets(at) % width == 0
    heads, once = _alone(hashes)
    rows = []
    blocks = np.unique(hashes[aligned])
    part = _dealt(blocks, parts)
    order, each = _stretches(part)
    for a, b in each:
        rows.append((int(part[order[a]]), INDEX, chunk, blocks[order[a:b]].astype(np.uint32).tobytes(), None))
    # Of windows that come once here: where, and whether they are a block (odd).
    single = np.sort(heads[once])
    part = _dealt(hashes[single], parts)
    order, each = _stretches(part)
    for a, b in each:
        pick = single[order[a:b]]
        rows.append((int(part[order[a]]), ASK, chunk, hashes[pick].astype(np.uint32).tobytes(), _delta(at[pick] * 2 + aligned[pick])))
    return _message_table(rows)


@lean
def _answer(batches):
    """For each part, index first: positions of the questions that are hit.

    A question that is a block itself is hit if another chunk has the block."""
    part, index, counts, held = None, None, None, []
    for batch in batches:
        chunks, hits = [], []
        for p, kind, chunk, hashes, positions in zip(*(batch.column(c).to_pylist() for c in ("part", "kind", "chunk", "hashes", "positions")), strict=True):
            if p != part:
                part, index, held = p, None, []
            values = np.frombuffer(hashes, np.uint32)
            if kind == INDEX:
                held.append(values)
                if len(held) >= 64:  # keep memory to distinct hashes, each twice at most
                    held = [_twice(held)]
                continue
            if index is None:
                index, counts = np.unique(_twice(held), return_counts=True) if held else (np.zeros(0, values.dtype), np.zeros(0, np.int64))
            if not len(index):
                continue
            coded = _undelta(positions)
            found = np.searchsorted(index, values)
            found[found == len(index)] = 0
            least = 1 + coded % 2
            hit = (index[found] == values) & (counts[found] >= least)
            if hit.any():
                chunks.append(chunk)
                hits.append(_delta(coded[hit] // 2))
        yield pa.RecordBatch.from_arrays([pa.array(chunks, pa.int32()), pa.array(hits, pa.binary())], names=["chunk", "hits"])


def _twice(held: list[np.ndarray]) -> np.ndarray:
    """The values of all lists, each as often as it came, but twice at most."""
    flat = np.sort(np.concatenate(held))
    return flat[np.concatenate(([True, True], flat[2:] != flat[:-2]))[: len(flat)]]


def _marked(answers: pa.Table, size: int) -> np.ndarray:
    out = np.zeros(size, bool)
    for packed in answers.column("hits").to_pylist():
        out[_undelta(packed)] = True
    return out


def _candidates(own: Chunk, answers: pa.Table, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(positions, hashes, other hashes) of the windows that hold a hit."""
    width = block_words(window)
    hit = _marked(answers, len(own.words))
    at, hashes = own.windows(width)
    heads, once = _alone(hashes)
    repeated = np.ones(len(at), bool)
    repeated[heads[once]] = False
    hit[at[repeated]] = True
    upto = np.concatenate(([0], np.cumsum(hit)))
    at, hashes = own.windows(window)
    held = upto[at + window - width + 1] > upto[at]
    return at[held], hashes[held], own.second(at[held], window)


def _ask_windows(key: tuple, texts: pa.Table, answers: pa.Table, window: int, parts: int) -> pa.Table:
    """Both hashes of a chunk's candidate windows, each once; those that come
    once here wait for an answer."""
    own, chunk = _sorted_chunk(texts), key[0].as_py()
    at, hashes, others = _candidates(own, answers, window)
    heads, once = _alone(hashes, others)
    rows = []
    for kind, pick in ((INDEX, heads[~once]), (ASK, np.sort(heads[once]))):
        part = _dealt(hashes[pick], parts)
        order, each = _stretches(part)
        for a, b in each:
            some = pick[order[a:b]]
            both = np.stack((hashes[some], others[some])).tobytes()
            rows.append((int(part[order[a]]), kind, chunk, both, _delta(at[some]) if kind == ASK else None))
    return _message_table(rows)


@lean
def _settle(batches):
    """For each part: of windows that come once in their chunks, the positions
    of those that another chunk has too. Messages of a part are gathered."""
    part, held = None, []

    def flush():
        chunks, hits = [], []
        if held:
            first, second = (np.concatenate([v[k] for _, v, _ in held]) for k in (0, 1))
            heads, once = _alone(first, second)
            many = np.ones(len(first), bool)
            many[heads[once]] = False
            begin = 0
            for chunk, values, positions in held:
                own, begin = many[begin : begin + values.shape[1]], begin + values.shape[1]
                if positions is not None and own.any():
                    chunks.append(chunk)
                    hits.append(_delta(_undelta(positions)[own]))
        return pa.RecordBatch.from_arrays([pa.array(chunks, pa.int32()), pa.array(hits, pa.binary())], names=["chunk", "hits"])

    for batch in batches:
        for p, chunk, hashes, positions in zip(*(batch.column(c).to_pylist() for c in ("part", "chunk", "hashes", "positions")), strict=True):
            if p != part:
                yield flush()
                part, held = p, []
            held.append((chunk, np.frombuffer(hashes, np.uint64).reshape(2, -1), positions))
    yield flush()


def _covered(at: np.ndarray, size: int, window: int) -> np.ndarray:
    """Mask of the words that windows starting at these positions cover."""
    steps = np.zeros(size + 1, np.int64)
    np.add.at(steps, at, 1)
    np.add.at(steps, at + window, -1)
    return np.cumsum(steps)[:size] > 0


def _remove(key: tuple, texts: pa.Table, hits: pa.Table, window: int, with_text: bool, carry: bool) -> pa.Table:
    """Each text's words outside repeats, and the repeats as spans of words."""
    own = _sorted_chunk(texts)
    blocks = hits.filter(pc.equal(hits.column("step"), 0))
    settled = hits.filter(pc.equal(hits.column("step"), 1))
    at, hashes, others = _candidates(own, blocks, window)
    heads, once = _alone(hashes, others)
    local = np.ones(len(at), bool)
    local[heads[once]] = False
    twice = _marked(settled, len(own.words))
    twice[at[local]] = True
    starts = np.flatnonzero(twice)
    gone = _covered(starts, len(own.words), window)
    texts = own.table.column("text").to_pylist() if with_text else []
    counts, removed, digests, kept, spans = [], [], [], [], []
    for i in range(len(own.cut) - 1):
        out = gone[own.cut[i] : own.cut[i + 1]]
        words = own.data[own.first[i] : own.first[i + 1]].tobytes().split()
        edges = np.flatnonzero(np.diff(out.view(np.int8), prepend=0, append=0))
        text = b" ".join(compress(words, (~out).tolist()) if len(edges) else words)
        counts.append(len(words))
        removed.append(int(out.sum()))
        digests.append(hashlib.sha256(text).hexdigest())
        kept.append((text.decode() if len(edges) else texts[i]) if with_text else None)
        spans.append(edges.tolist())
    made = {
        "n_words": pa.array(counts, pa.int64()),
        "n_removed": pa.array(removed, pa.int64()),
        "kept_sha256": pa.array(digests, pa.string()),
        "kept_text": pa.array(kept, pa.string()),
        "spans": pa.array(spans, pa.list_(pa.int64())),
    }
    names = ["doc_id", *(["__row"] if carry else [])]
    return pa.Table.from_arrays([*(own.table.column(c) for c in names), *made.values()], names=[*names, *made])


def remove_repeats(docs: DataFrame, window: int = WINDOW, with_text: bool = False, with_row: bool = False) -> DataFrame:
    """For each row of docs (doc_id, text): doc_id, n_words, n_removed,
    kept_sha256 (of kept words joined by one space), kept_text (if asked for;
    as it was where nothing goes), spans (array: begin and end of each removed
    run of words, by turns), and if asked for the row itself as `__row`."""
    spark = docs.sparkSession
    prepare(spark)
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks, parts, ends = (max(1, -(-total // size)) for size in (CHUNK, PART, SETTLE))
    parts = max(parts, partitions(spark))  # enough for all cores
    rest = T.StructType([T.StructField(f.name, nullable(f.dataType)) for f in docs.schema if f.name != "text"])
    row = F.struct(*[F.col(f"`{f.name}`") for f in rest]).cast(rest) if with_row else None
    dealt = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce("text", F.lit("")).alias("text"),
        # copies of one row are dealt by the partition that they lie in
        F.pmod(F.xxhash64("doc_id", F.length("text"), F.spark_partition_id()), F.lit(chunks)).cast("int").alias("chunk"),
        *([row.alias("__row")] if with_row else []),
    )
    grouped = dealt.groupBy("chunk")
    route = lambda m: m.repartition("part").sortWithinPartitions("part", "kind")
    asked = grouped.applyInArrow(_by(_ask_blocks, window=window, parts=parts), MESSAGE)
    hits = route(asked).mapInArrow(_answer, "chunk int, hits binary")
    whole = grouped.cogroup(hits.groupBy("chunk")).applyInArrow(_by2(_ask_windows, window=window, parts=max(ends, parts)), MESSAGE)
    settled = route(whole).mapInArrow(_settle, "chunk int, hits binary")
    both = hits.withColumn("step", F.lit(0)).unionByName(settled.withColumn("step", F.lit(1)))
    made = T.StructType().add("doc_id", "long")
    made = made.add("__row", rest) if with_row else made
    made = made.add("n_words", "long").add("n_removed", "long").add("kept_sha256", "string").add("kept_text", "string").add("spans", T.ArrayType(T.LongType()))
    return grouped.cogroup(both.groupBy("chunk")).applyInArrow(_by2(_remove, window=window, with_text=with_text, carry=with_row), made)


def deduplicated(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs with repeated passages cut from their texts (and n_chars set anew,
    if there). A null text becomes an empty one."""
    found = remove_repeats(docs, window, with_text=True, with_row=True)
    fresh = {"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}
    return found.select(*[(fresh[c] if c in fresh else F.col("__row")[c]).alias(c) for c in docs.columns])


def _by(f, **fixed):
    def run(key, table):
        return f(key, table, **fixed)

    return run


def _by2(f, **fixed):
    def run(key, left, right):
        return f(key, left, right, **fixed)

    return run
