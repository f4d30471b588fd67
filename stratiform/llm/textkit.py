"""Vectorised text helpers that run inside Arrow tasks.

A batch of texts is one byte buffer with offsets. A word's symbol is made of its bytes, or of their xxh3 hash
where there are more than eight. The hash of a run of symbols is built by doubling: the hashes of two halves
are mixed into one, level by level, so that, unlike in a polynomial hash modulo 2**64, no text
of a regular build (Thue-Morse words, say) collides with another by algebra.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

SLICE_BYTES = 1 << 20
#: Symbols hashed at once, so that their arrays stay in the cache.
CHUNK = 1 << 15

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: All ASCII but letters and digits.
NOT_ALNUM = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def slices(batches: Iterator[pa.RecordBatch], text: int = 1, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each holds about `limit` text bytes, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0), dtype=np.int64))
        start = 0
        while start < batch.num_rows:
            done = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, done + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop
    batch = None
    give_back()


def give_back() -> None:
    """Return freed memory to the system: a worker waits for its next task with what that needs, beside the executor's heap."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def buffer_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null is an empty text."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def lowered(data: np.ndarray) -> np.ndarray:
    """ASCII lower case, byte for byte."""
    return _LOWER[data]


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def pair(a: np.ndarray, b: np.ndarray, salt: np.ndarray | int) -> np.ndarray:
    """Hash of two hashed parts in this order; parts may overlap if `salt` tells by how much."""
    return mix(a * np.uint64(0x9E3779B97F4A7C15) + b + np.asarray(salt).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def window_hashes(symbols: np.ndarray, *sizes: int) -> list[np.ndarray]:
    """For each size the hash of every run of so many symbols, bytes or 64-bit numbers; runs may cross texts, callers mask them."""
    top, n = max(sizes), len(symbols)
    out = [np.zeros(max(n - size + 1, 0), np.uint64) for size in sizes]
    for begin in range(0, n, CHUNK):
        part = symbols[begin : begin + CHUNK + top - 1]
        level, length = _BYTE[part] if part.dtype == np.uint8 else mix(part + np.uint64(0x2545F4914F6CDD1D)), 1
        while True:
            for size, whole in zip(sizes, out):
                stop = min(CHUNK, len(part) - size + 1)
                if length <= size < 2 * length and stop > 0:
                    whole[begin : begin + stop] = level[:stop] if size == length else pair(level[:stop], level[size - length :][:stop], size)
            if 2 * length > top:
                break
            level = pair(level[:-length], level[length:], 2 * length)
            length *= 2
    return out


def run_hash(windows: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hash of all symbols of the windows first..last, which must overlap or touch."""
    return pair(windows[first], windows[last], last - first + 1)


def word_spans(data: np.ndarray, offsets: np.ndarray, between: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of each run of bytes other than those `between` words, ASCII white space by default."""
    word = ~between[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    starts = np.flatnonzero(word & (first[:-1] | ~np.concatenate(([False], word[:-1]))))
    ends = np.flatnonzero(word & (first[1:] | ~np.concatenate((word[1:], [False])))) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def byte_strings(column: pa.LargeBinaryArray) -> list[bytes]:
    """The values of a column without nulls; quicker than to_pylist()."""
    data, offsets = buffer_of(column)
    raw, cuts = data.tobytes(), offsets.tolist()
    return [raw[a:b] for a, b in zip(cuts, cuts[1:])]


_LOW_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def byte_column(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.LargeBinaryArray:
    """The given spans, in order and without overlaps, as a column."""
    cuts = np.concatenate(([0], np.cumsum(ends - starts)))
    at = np.repeat(starts - cuts[:-1], ends - starts) + np.arange(cuts[-1])
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(cuts), pa.py_buffer(data[at])])


def word_symbols(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit symbol for each word: the mixed bytes themselves up to eight, else the xxh3 hash, taken once for each distinct word."""
    sizes = ends - starts
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))[starts]
    out = mix(mix(eight & _LOW_BYTES[np.minimum(sizes, 8)]) + sizes.astype(np.uint64))
    long = np.flatnonzero(sizes > 8)
    if len(long):
        found = byte_column(data, starts[long], ends[long]).dictionary_encode()
        out[long] = np.fromiter(map(xxhash.xxh3_64_intdigest, byte_strings(found.dictionary)), np.uint64, len(found.dictionary))[np.asarray(found.indices)]
    return out


def signed(h: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's long."""
    return h.view(np.int64)


def merge_spans(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of half-open spans as maximal runs; touching spans join."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate(([True], starts[1:] > ends[:-1]))
    return starts[new], ends[np.concatenate((np.flatnonzero(new)[1:] - 1, [len(ends) - 1]))]
