"""Packing of tokenised documents by Karmarkar-Karp multiway differencing.

A document is tokenised whole and closed by an end id. Whole windows are cut
from its front; the rest, under a window, is cut into pieces of 512 tokens at
most. Pieces of a group of documents are then partitioned into k windows: the
two partial partitions of greatest imbalance are merged again and again, the
fullest windows of one on the emptiest of the other, until one is left. k
starts at the least number that could hold the tokens, and rises whenever a
window exceeds its capacity.

Each task numbers its documents off into portions; portions of one number from
TOGETHER neighbouring tasks are a group. So groups are bounded whatever the
size of the corpus, and depend on no value that many rows could share. Only
lengths and checksums are shuffled unless ids are asked for. A worker encodes
each distinct word once, as long as it remembers it, and knows words by their
bytes.

Defined results: a null or empty text is the end id alone; repeated rows are
packed each; very long texts become many whole windows; null doc_ids are
packed like others; other columns are ignored; an empty table gives an empty
result. Which documents share a sequence depends on how docs are partitioned.
"""

from __future__ import annotations

import heapq
import os
import zlib
from collections.abc import Iterator
from functools import lru_cache, partial
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.kernels import blocks, same_spans, separated, span_hashes, text_buffers, word_spans
from orrery.llm.session import prepare
from orrery.llm.workers import keeps, lean

CAPACITY, PIECE, END_ID = 2048, 512, 1
#: Documents and tokens that fill a portion; tasks whose portions form a group.
PORTION, PORTION_TOKENS, TOGETHER = 256, 1 << 19, 8
#: Bytes of text tokenised at once; words that a worker remembers; words that
#: one call encodes, as a call's cost a word grows with them.
CHUNK, REMEMBER, LESSON = 1 << 21, 250_000, 1000
#: Signs of ASCII that are a pre-token of their own after a letter: all but the
#: apostrophe, which some pre-tokens begin with.
_SIGNS = np.isin(np.arange(256), np.frombuffer(b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~", np.uint8))


def _split_points(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words cut before a last run of signs, if a small Latin letter stands before
    it: pre-tokens part there anyway, and fewer are distinct."""
    stop = ends.copy()
    live = np.arange(len(stop))
    for _ in range(8):
        live = live[_SIGNS[data[stop[live] - 1]] & (stop[live] - starts[live] > 1)]
        stop[live] -= 1
    last, before = data[np.maximum(stop - 1, 0)], data[np.maximum(stop - 2, 0)]
    plain = (last >= 0x61) & (last <= 0x7A)
    accented = (before == 0xC3) & (last >= 0xA0) & (last <= 0xBF) & (last != 0xB7) & (stop - starts > 1)
    cut = (stop < ends) & (plain | accented)
    order = np.argsort(np.concatenate((starts, stop[cut])), kind="stable")
    return np.concatenate((starts, stop[cut]))[order], np.concatenate((np.where(cut, stop, ends), ends[cut]))[order]


class _Numbers(dict):
    """Numbers words by when they were first asked for."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


class WordTokenizer:
    """Token ids of texts, encoding each distinct word once.

    For lower-casing tokenizers whose pre-tokens never cross white space: a
    text's ids are then those of its words in order. Words are remembered up to
    a bound."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self._forget()

    def _forget(self) -> None:
        #: Each word's number; words' ids end to end, by number.
        self.number = _Numbers()
        self.ids = np.zeros(0, np.uint32)
        self.at = np.zeros(1, np.int64)

    def _learn(self, fresh: list[bytes]) -> None:
        ids, counts = [self.ids], []
        for first in range(0, len(fresh), LESSON):
            texts = [w.decode() for w in fresh[first : first + LESSON]]
            done = self.model.encode(" ".join(texts), add_special_tokens=False)
            ids.append(np.array(done.ids, np.uint32))
            begin = np.array([o[0] for o in done.offsets], np.int64)
            starts = np.cumsum([0, *(len(t) + 1 for t in texts)])
            counts.append(np.diff(np.searchsorted(begin, starts)))
        self.ids = np.concatenate(ids)
        self.at = np.concatenate((self.at, self.at[-1] + np.cumsum(np.concatenate(counts))))

    def encode(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts end to end, where each begins) for the texts of an
        Arrow buffer."""
        data, first = separated(raw, at)
        starts, ends = word_spans(data)
        whole = data.tobytes()
        if b"<|" not in whole:  # special tokens are told apart by case
            whole = whole.lower()
            data = np.frombuffer(whole, np.uint8)
            starts, ends = _split_points(data, starts, ends)
        if len(self.number) > REMEMBER:
            self._forget()
        # words that look alike by hash are looked up once, if they are the same
        _, where, alike = np.unique(span_hashes(data, starts, ends, False), return_index=True, return_inverse=True)
        odd = np.flatnonzero(~same_spans(data, starts, ends, where[alike]))
        if len(odd):
            alike[odd], where = len(where) + np.arange(len(odd)), np.concatenate((where, odd))
        known = len(self.number)
        each = (whole[a:b] for a, b in zip(starts[where].tolist(), ends[where].tolist(), strict=True))
        words = np.fromiter(map(self.number.__getitem__, each), np.int64, len(where))[alike]
        if fresh := len(self.number) - known:
            self._learn([*islice(reversed(self.number), fresh)][::-1])
        begin, size = self.at[words], self.at[words + 1] - self.at[words]
        stop = np.concatenate(([0], np.cumsum(size)))
        ids = self.ids[np.arange(stop[-1]) + np.repeat(begin - stop[:-1], size)]
        return ids, stop[np.searchsorted(starts, first)]


@lru_cache(maxsize=1)
def _kept(path: str, version: tuple) -> WordTokenizer:
    return WordTokenizer(path)


keeps(__name__, _kept.cache_clear)


def tokenizer_of(path: str) -> WordTokenizer:
    """The file's tokenizer, which a worker keeps from task to task with the
    words that it knows, until the file is another or a task of another module
    begins."""
    now = os.stat(path)
    return _kept(path, (now.st_mtime_ns, now.st_size, now.st_ino))


def cuts(n: int, capacity: int, piece: int) -> list[int]:
    """Where the pieces of n tokens begin, and n."""
    whole = n // capacity * capacity
    return [*range(0, whole, capacity), *range(whole, n, piece), n] if n > whole else [*range(0, whole, capacity), n]


def differencing(lengths: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(window of each item, sums) of the k-way differencing method.

    A partial partition is its windows' sums in descending order, without the
    empty ones, and a node for each; nodes join two nodes or are items."""
    n = len(lengths)
    left, right = [], []
    heap = [(-int(s), i, np.array([s], np.int64), np.array([i], np.int64)) for i, s in enumerate(lengths)]
    heapq.heapify(heap)
    for turn in range(n, 2 * n - 1):
        _, _, a, na = heapq.heappop(heap)
        _, _, b, nb = heapq.heappop(heap)
        over = len(a) + len(b) - k
        if over > 0:
            head, both = len(a) - over, a[len(a) - over :] + b[::-1][:over]
            first = n + len(left)
            left.extend(na[head:].tolist())
            right.extend(nb[::-1][:over].tolist())
            sums = np.concatenate((a[:head], both, b[: len(b) - over]))
            nodes = np.concatenate((na[:head], np.arange(first, first + over), nb[: len(b) - over]))
        else:
            sums, nodes = np.concatenate((a, b)), np.concatenate((na, nb))
        order = np.argsort(-sums, kind="stable")
        sums, nodes = sums[order], nodes[order]
        low = int(sums[-1]) if len(sums) == k else 0
        heapq.heappush(heap, (low - int(sums[0]), turn, sums, nodes))
    _, _, sums, nodes = heap[0]
    window = np.empty(n + len(left), np.int64)
    window[nodes] = np.arange(len(nodes))
    for j in range(len(left) - 1, -1, -1):
        window[left[j]] = window[right[j]] = window[n + j]
    return window[:n], sums


def pack(lengths: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """The window of each item; items of full length get their own."""
    out = np.empty(len(lengths), np.int64)
    full = lengths >= capacity
    out[full] = np.arange(int(full.sum()))
    rest = np.flatnonzero(~full)
    if len(rest):
        own = lengths[rest]
        k = -(-int(own.sum()) // capacity)
        while True:
            window, sums = differencing(own, k)
            if sums[0] <= capacity:
                break
            k += 1
        out[rest] = int(full.sum()) + window
    return out


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary"
_NAMES = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids", "grp")
_KINDS = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64())


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches of little text together, up to about CHUNK bytes; larger ones alone."""
    held: list[pa.RecordBatch] = []
    total = 0
    for batch in batches:
        if held and total + batch.nbytes > CHUNK:
            yield pa.Table.from_batches(held)
            held, total = [], 0
        held.append(batch)
        total += batch.nbytes
    if held:
        yield pa.Table.from_batches(held)


@lean
def _pieces(batches: Iterator[pa.RecordBatch], path: str, capacity: int, piece: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    """The pieces of every document with the group that they go to."""
    from pyspark import TaskContext

    tokenizer = tokenizer_of(path)
    group = TaskContext.get().partitionId() // TOGETHER << 24
    held = tokens = 0
    for batch in _gathered(batches):
        docs = batch.column("doc_id").to_pylist()
        raw, at = text_buffers(batch.column("text"))
        for part in blocks(np.diff(at), CHUNK):
            rows: list[tuple] = []
            flat, stop = tokenizer.encode(raw, at[part.start : part.stop + 1])
            for i, doc in enumerate(docs[part]):
                ids = np.append(flat[stop[i] : stop[i + 1]], np.uint32(END_ID)).astype("<u4")
                edge = cuts(len(ids), capacity, piece)
                for a, b in zip(edge[:-1], edge[1:], strict=True):
                    own = ids[a:b].tobytes()
                    rows.append((doc, a, b - a, zlib.crc32(own), len(ids), own if with_ids else None, group))
                held, tokens = held + 1, tokens + len(ids)
                if held >= PORTION or tokens >= PORTION_TOKENS:
                    group, held, tokens = group + 1, 0, 0
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _KINDS, strict=True)], names=_NAMES)


def _pack_group(key: tuple, table: pa.Table, capacity: int) -> pa.Table:
    """A group's pieces in sequences."""
    table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
    lengths = table.column("length").to_numpy()
    window = pack(lengths, capacity)
    order = np.argsort(window, kind="stable")
    window, lengths = window[order], lengths[order]
    before = np.cumsum(lengths) - lengths
    new = np.diff(window, prepend=-1) > 0
    offset = before - before[new][np.cumsum(new) - 1]
    own = table.take(pa.array(order)).drop_columns(["grp"])
    return own.append_column("sequence_id", pa.array((key[0].as_py() << 20) + window)).append_column("offset", pa.array(offset))


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, piece: int = PIECE, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, ids
    (little-endian uint32, if asked for), sequence_id, offset. tokenizer: path
    of a tokenizer file that every worker can read."""
    prepare(docs.sparkSession)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    cut = own.mapInArrow(partial(_pieces, path=tokenizer, capacity=capacity, piece=piece, with_ids=with_ids), PIECES + ", grp long")

    def run(key, table):
        return _pack_group(key, table, capacity)

    return cut.groupBy("grp").applyInArrow(run, PIECES + ", sequence_id long, offset long")
