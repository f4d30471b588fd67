"""Suffix-array dedup: bytes of 100-byte strings that also start earlier.

The corpus is sampled by anchors (see repeats.py); where runs of an anchor differ, their
bytes are put into one enhanced suffix array; an anchor with too many such runs for that is split by
window, and equal windows meet by their hash. A stack scan of the common-prefix intervals
finds each interval of at least `size` bytes, tests whether its occurrences
have different bytes on their left, and puts out the maximal repeat groups with all
their occurrences. Every occurrence but the earliest is a repeat.

Defined results: a null or empty text has 0 bytes; matches never cross documents;
rows that repeat an id are one document (their spans are pooled), so identical repeated rows are no
copies of each other; rows with a null id neither match nor lose bytes; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from . import repeats as rp
from . import textkit as tk

SIZE, GRAM = 100, 24


#: Suffixes whose common prefixes are compared at once.
ROWS = 1 << 15


def suffix_array(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes data[begin:end] in order of their bytes, and the common prefix of each with the one before."""
    sizes = end - begin
    width = int(sizes.max()) if len(sizes) else 1
    padded = np.concatenate((data, np.zeros(width, np.uint8)))
    rows = np.lib.stride_tricks.sliding_window_view(padded, width)[begin]
    rows[np.arange(width) >= sizes[:, None]] = 0
    # of suffixes that are equal but for the zeros at their ends, the shorter one is first
    by_size = np.argsort(sizes, kind="stable")
    order = by_size[np.argsort(rows.view(f"S{width}")[by_size, 0], kind="stable")]
    common = np.zeros(len(order), np.int64)
    for at in range(1, len(order), ROWS):
        one, two = order[at - 1 : at - 1 + ROWS][: len(order) - at], order[at : at + ROWS]
        differ = rows[one] != rows[two]
        first = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
        common[at : at + ROWS] = np.minimum(first, np.minimum(sizes[one], sizes[two]))
    return order, common


def maximal_repeats(order: np.ndarray, lcp: np.ndarray, left: np.ndarray, size: int):
    """(begin, end, length) of intervals order[begin:end] that share `length` >= size symbols, are right-maximal and have different left symbols.

    left[p] is the symbol before suffix p; negative values differ from everything. The scan keeps the open intervals
    of the common-prefix interval tree on a stack; stretches without any difference on the left are passed over.
    """
    n = len(order)
    deep = lcp >= size
    edge = np.diff(np.concatenate(([False], deep, [False])).astype(np.int8))
    before = left[order]
    # changes[i]: places up to i where the left symbol differs from the one before, or is unlike all others
    changes = np.cumsum(np.concatenate(([0], (before[1:] != before[:-1]) | (before[1:] < 0) | (before[:-1] < 0))))[:n].tolist()
    depths = np.where(deep, lcp, 0).tolist()
    for start, stop in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()):
        if changes[stop - 1] == changes[start - 1]:
            continue
        stack = [(depths[start], start - 1)]  # open intervals: depth and first place
        for i in range(start + 1, stop + 1):
            depth = depths[i] if i < stop else 0
            begin = i - 1
            while stack and stack[-1][0] > depth:
                length, begin = stack.pop()
                if changes[i - 1] > changes[begin]:
                    yield begin, i, length
            if depth and (not stack or stack[-1][0] < depth):
                stack.append((depth, begin))


def repeat_groups(contexts: list[bytes], docs: np.ndarray, firsts: np.ndarray, size: int):
    """Maximal repeat groups of the contexts: (document numbers, starts, length), occurrences in corpus order.

    A context starts at the first window of its run and ends with the last, so each window of a
    document starts one suffix here. Where a context starts, the left symbol counts as different.
    A suffix whose first `size` bytes start no other one is in no group and is left out before the sort.
    """
    lengths = np.array([len(c) for c in contexts])
    data = np.frombuffer(b"".join(contexts), np.uint8)
    ends = np.cumsum(lengths)
    counts = lengths - size + 1
    owner = np.repeat(np.arange(len(contexts)), counts)
    inner = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    at = (ends - lengths)[owner] + inner
    _, which, times = np.unique(tk.window_hashes(data, size)[0][at], return_inverse=True, return_counts=True)
    several = times[which] > 1
    owner, inner, at = owner[several], inner[several], at[several]
    order, lcp = suffix_array(data, at, ends[owner])
    left = np.where(inner > 0, data[at - 1].astype(np.int64), -1)
    place = firsts[owner] + inner
    for begin, end, length in maximal_repeats(order, lcp, left, size):
        found = order[begin:end]
        d, p = docs[owner[found]], place[found]
        ranked = np.lexsort((p, d))
        yield d[ranked], p[ranked], length


def _split_repeats(table: pa.Table, size: int):
    """(documents, starts, stops) of the rows that come split by window: told spans, and all occurrences of a window but the earliest."""
    key, d, p, stop = (np.asarray(table[n]).astype(np.int64) for n in ("anchor", "doc_id", "first", "stop"))
    told = stop >= 0
    yield d[told], p[told], stop[told]
    key, d, p = key[~told], d[~told], p[~told]
    order = np.lexsort((p, d, key))
    key, d, p = key[order], d[order], p[order]
    again = np.flatnonzero((key[1:] == key[:-1]) & ((d[1:] != d[:-1]) | (p[1:] != p[:-1]))) + 1
    yield d[again], p[again], p[again] + size


def _compare(size: int):
    def run(batches):
        for table in rp.anchor_groups(batches):
            whole = table.filter(pc.is_null(table["stop"]))
            found = list(_split_repeats(table.filter(pc.is_valid(table["stop"])), size)) if len(whole) < len(table) else []
            if len(whole):
                docs, firsts = (np.asarray(whole[n]).astype(np.int64) for n in ("doc_id", "first"))
                for d, p, n in repeat_groups(whole["windows"].to_pylist(), docs, firsts, size):
                    later = (d > d[0]) | (p > p[0])  # repeated rows of one document are the same occurrence
                    found.append((d[later], p[later], p[later] + n))
            d, p, stop = (np.concatenate(x) for x in zip(*found)) if found else ([], [], [])
            if len(d):
                yield rp.span_batch(*rp.joined_spans(d, p, stop))

    return run


def repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, gram: int = GRAM) -> DataFrame:
    """doc_id, packed text and the byte spans to remove."""
    narrow = rp.narrow(docs, id_col, text_col)
    texts = rp.packed_texts(narrow)
    runs = rp.anchored_runs(narrow, rp.byte_symbols, size, gram)
    return rp.with_spans(texts, rp.repeat_spans(runs, size, True, lambda settled: rp.in_anchor_groups(rp.opened_runs(settled, texts, rp.byte_symbols, size, True), _compare(size))))


def digest(found: DataFrame) -> DataFrame:
    def run(batches):
        for batch, raw in rp.unpacked_slices(batches):
            rows = []
            for text, (starts, stops) in zip(raw, rp.merged_spans(batch.column("spans"))):
                stops = np.minimum(stops, len(text))
                sha, done = hashlib.sha256(), 0
                for a, b in zip(starts.tolist(), stops.tolist()):
                    sha.update(text[done:a])
                    done = max(done, b)
                sha.update(text[done:])
                rows.append((len(text), int((stops - starts).sum()), len(starts), sha.hexdigest()))
            n, removed, spans, sha = zip(*rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(sha)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return found.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
