"""Vectorised word hashing for Python workers.

Words are found and hashed for a whole batch of texts at once: eight bytes of
every word at a time go through a chain of bijections of 64 bits, and words of
more than LONG bytes through BLAKE2. Hashes of runs of 1, 2, 4, ... words are
joined pairwise, and those of a window from the binary digits of its width.
No step is linear in what it reads, so that no pair of texts made of repeated
patterns collides by construction. A lane is an independent hash: two lanes
are 128 bits.
"""

from __future__ import annotations

import hashlib

import numpy as np

_ODD = np.uint64(0x9E3779B97F4A7C15)
#: Bytes of a word up to which it is hashed by arrays.
LONG = 64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every input bit (xor-shift-multiply)."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def lowered(data: np.ndarray) -> np.ndarray:
    """A buffer of bytes with A-Z as a-z."""
    return data + ((data - np.uint8(65)) < 26).view(np.uint8) * np.uint8(32)


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the words in a buffer of bytes."""
    gap = np.ones(len(data) + 2, bool)
    gap[1:-1] = (data == 0x20) | ((data - np.uint8(0x09)) < 5)
    edge = np.flatnonzero(gap[1:] != gap[:-1])
    return edge[::2], edge[1::2]


def _padded(data: np.ndarray) -> np.ndarray:
    """The buffer with zeros up to a whole cell of eight bytes, and one more."""
    out = np.zeros((len(data) // 8 + 2) * 8, np.uint8)
    out[: len(data)] = data
    return out


def _cell(cells: np.ndarray, at: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The next bytes from each place, `left` of them and eight at most."""
    cell, shift = at >> 3, ((at & 7) << 3).astype(np.uint64)
    x = cells[cell] >> shift
    x |= (cells[cell + 1] << (np.uint64(63) - shift)) << np.uint64(1)
    unused = (np.maximum(8 - left, 0) << 3).astype(np.uint64)
    x <<= unused
    x >>= unused
    return x


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool, lane: int = 0) -> np.ndarray:
    """Hashes of stretches of a buffer, none of them empty."""
    padded = _padded(lowered(data) if lower else data)
    cells = padded.view("<u8")
    size = ends - starts
    seed = np.uint64(int(_ODD) * (lane + 1) % (1 << 64))
    out = mix(mix(size.astype(np.uint64) + seed) ^ _cell(cells, starts, size))
    live = np.flatnonzero((size > 8) & (size <= LONG))
    at, left = starts[live] + 8, size[live] - 8
    while len(live):
        out[live] = mix(out[live] ^ _cell(cells, at, left))
        more = np.flatnonzero(left > 8)
        live, at, left = live[more], at[more] + 8, left[more] - 8
    for i in np.flatnonzero(size > LONG).tolist():
        digest = hashlib.blake2b(padded[starts[i] : ends[i]].tobytes(), digest_size=8, salt=bytes([lane]))
        out[i] = int.from_bytes(digest.digest(), "little")
    return out


def same_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Whether each stretch has the bytes of the stretch that other names."""
    padded, size = _padded(data), ends - starts
    cells = padded.view("<u8")
    out = size == size[other]
    live = np.flatnonzero(out & (size <= LONG))
    at, to, left = starts[live], starts[other[live]], size[live]
    while len(live):
        out[live] &= _cell(cells, at, left) == _cell(cells, to, left)
        more = np.flatnonzero(left > 8)
        live, at, to, left = live[more], at[more] + 8, to[more] + 8, left[more] - 8
    for i in np.flatnonzero(out & (size > LONG)).tolist():
        out[i] = np.array_equal(data[starts[i] : ends[i]], data[starts[other[i]] : ends[other[i]]])
    return out


def word_hashes(data: np.ndarray, lower: bool, lane: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, hashes) of the words in a buffer of bytes."""
    starts, ends = word_spans(data)
    return starts, ends, span_hashes(data, starts, ends, lower, lane)


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of runs a followed by runs b."""
    x = a * _ODD
    x += b
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of width consecutive words; empty if there are fewer."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    run, size, out, have = words, 1, None, 0
    while True:
        if width & size:
            part = run[have : have + n]
            out, have = part if out is None else _joined(out, part), have + size
        if 2 * size > width:
            return mix(out + np.uint64(width))
        run, size = _joined(run[:-size], run[size:]), 2 * size


def blocks(lengths: np.ndarray, most: int) -> list[slice]:
    """Slices of consecutive items with at most `most` units each (or one item)."""
    out, first, total = [], 0, 0
    for i, k in enumerate(lengths):
        if i > first and total + k > most:
            out.append(slice(first, i))
            first, total = i, 0
        total += k
    if first < len(lengths):
        out.append(slice(first, len(lengths)))
    return out


def text_buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string column without copying; null is empty."""
    import pyarrow as pa
    import pyarrow.compute as pc

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    if column.null_count:
        column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, at


def separated(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts laid end to end with one space after each: (bytes, start of each)."""
    sizes = np.diff(at)
    starts = np.concatenate(([0], np.cumsum(sizes + 1)))
    out = np.full(starts[-1], 0x20, np.uint8)
    keep = np.ones(starts[-1], bool)
    keep[starts[1:] - 1] = False
    out[keep] = raw[at[0] : at[-1]]
    return out, starts


def binaries(values: np.ndarray, offsets: np.ndarray):
    """Arrow binary array whose i-th item is values[offsets[i]:offsets[i+1]]."""
    import pyarrow as pa

    width = values.dtype.itemsize
    return pa.Array.from_buffers(
        pa.large_binary(),
        len(offsets) - 1,
        [None, pa.py_buffer(np.ascontiguousarray(offsets.astype(np.int64) * width)), pa.py_buffer(np.ascontiguousarray(values))],
    ).cast(pa.binary())
