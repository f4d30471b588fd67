"""Repeated windows of a corpus, found through content-placed anchors.

A window is `size` consecutive symbols (bytes or words) of one document. Its anchor is the
`gram` symbols inside it with the smallest hash (the last of equals), so equal windows have equal
anchors at the same place, and neighbouring windows mostly share one. All windows of
one anchor occurrence make a run; the corpus is thus described by about
2 / (size - gram + 2) rows a symbol instead of one.

Runs meet by anchor hash. Runs of equal content are settled whole. Where an anchor has
runs of different content (the edges of repeats), one run of each content is
opened, and its windows are compared one by one. Groups are streamed in
sorted order, so no task holds a group of copies in memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .shared import columns, stored

#: Windows handled at once: bounds memory for a text of any length.
PIECE = 1 << 19
#: Open runs of one anchor that are compared as one group; more are split by window.
MOST = 4096
_AT = np.uint64((1 << 24) - 1)
_NONE = np.uint64((1 << 64) - 1)

#: state of a run: OPEN to comparison, COUNTED (a copy stands in the same slice, the run still speaks for its content) or DONE (a copy that is settled already).
OPEN, COUNTED, DONE = 0, 1, 2
RUNS = "anchor long, content long, doc_id long, first int, last int, state int"


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    step, low = 1, values
    while 2 * step <= width:
        low = np.minimum(low[:-step], low[step:])
        step *= 2
    return np.minimum(low[: len(values) - width + 1], low[width - step :][: len(values) - width + 1])


def runs_of(symbols: np.ndarray, bounds: np.ndarray, size: int, gram: int, able: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """anchor hash, content hash, text number, first and last window start (in the text) of each run.

    With `able`, a flag for each place, only grams that start at such places are anchors; windows without one are left out.
    """
    parts = []
    doc_of = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    total = len(symbols) - size + 1
    for begin in range(0, max(total, 0), PIECE):
        end = min(begin + PIECE, total)
        at = np.arange(begin, end + size - gram)
        grams, windows = tk.window_hashes(symbols[begin : end + size - 1], gram, size)
        order = (grams & ~_AT) | (~(at - begin).astype(np.uint64) & _AT)
        if able is not None:
            order[~able[at]] = _NONE
        low = sliding_min(order, size - gram + 1)
        anchor = begin + (~low & _AT).astype(np.int64)
        window = np.arange(begin, end)
        inside = doc_of[window] == doc_of[window + size - 1]
        if able is not None:
            inside &= low != _NONE
        window, anchor = window[inside], anchor[inside]
        if not len(window):
            continue
        new = np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (doc_of[window[1:]] != doc_of[window[:-1]])))
        first = window[new]
        last = window[np.concatenate((np.flatnonzero(new)[1:] - 1, [len(window) - 1]))]
        doc = doc_of[first]
        parts.append((grams[anchor[new] - begin], tk.run_hash(windows, first - begin, last - begin), doc, first - bounds[doc], last - bounds[doc]))
    if not parts:
        none = np.zeros(0, np.int64)
        return none.view(np.uint64), none.view(np.uint64), none, none, none
    return tuple(np.concatenate(x) for x in zip(*parts))


def byte_symbols(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return tk.buffer_of(column)


def word_symbols(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = tk.buffer_of(column)
    starts, ends, doc = tk.word_spans(data, offsets)
    return tk.word_symbols(data, starts, ends), np.concatenate(([0], np.cumsum(np.bincount(doc, minlength=len(offsets) - 1))))


def _states(anchor: np.ndarray, content: np.ndarray, doc_id: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of a slice's runs by content and place, without repeated rows, and the state of each.

    One run of each content goes on to the shuffle; its copies in the slice are settled here, so a
    content that fills many documents does not fill one task.
    """
    order = np.lexsort((first, doc_id, content, anchor))
    a, c, d, f = anchor[order], content[order], doc_id[order], first[order]
    same = np.concatenate(([False], (a[1:] == a[:-1]) & (c[1:] == c[:-1])))
    repeated = same & np.concatenate(([False], (d[1:] == d[:-1]) & (f[1:] == f[:-1])))
    order, same = order[~repeated], same[~repeated]
    state = np.where(same, DONE, OPEN)
    state[:-1][~same[:-1] & same[1:]] = COUNTED
    return order, state


def run_batch(doc_ids: np.ndarray, runs: tuple[np.ndarray, ...]) -> pa.RecordBatch:
    """The runs of a slice as rows; doc_ids has the id of each of its texts."""
    anchor, content, doc, first, last = runs
    ids = doc_ids[doc]
    order, state = _states(anchor, content, ids, first)
    return pa.RecordBatch.from_arrays([pa.array(tk.signed(anchor[order])), pa.array(tk.signed(content[order])), pa.array(ids[order]), pa.array(first[order].astype(np.int32)), pa.array(last[order].astype(np.int32)), pa.array(state.astype(np.int32))], names=["anchor", "content", "doc_id", "first", "last", "state"])


def anchored_runs(docs: DataFrame, symbols_of, size: int, gram: int) -> DataFrame:
    def run(batches):
        for batch in tk.slices(batches):
            runs = runs_of(*symbols_of(batch.column(1)), size, gram)
            if len(runs[0]):
                yield run_batch(np.asarray(batch.column(0)), runs)

    return docs.filter("doc_id is not null").mapInArrow(run, RUNS)


SETTLED = "doc_id long, first int, last int, anchor long, open boolean"


def _settle(batches: Iterator[pa.RecordBatch], keep_first: bool) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by anchor, content, document and start. `open` rows must be compared window by window."""
    names = ["anchor", "content", "doc_id", "first", "last"]

    def told(dd, ff, ll, aa, is_open):
        return pa.RecordBatch.from_arrays([pa.array(dd), pa.array(ff.astype(np.int32)), pa.array(ll.astype(np.int32)), pa.array(aa), pa.array(np.full(len(dd), is_open))], names=["doc_id", "first", "last", "anchor", "open"])

    carry = None  # the last row of the batch before, as five values
    head = None  # (doc_id, first, last) of the first row of the anchor's first content, while that is its only one
    for batch in batches:
        if not batch.num_rows:
            continue
        state = np.asarray(batch.column("state"))
        a, c, d, f, l = (np.asarray(batch.column(n)).astype(np.int64) for n in names)
        sure = (state == DONE) | ((state == COUNTED) & (not keep_first))
        if sure.any():
            yield told(d[sure], f[sure], l[sure], a[sure], False)
        rest = state != DONE
        if not rest.any():
            continue
        a, c, d, f, l = a[rest], c[rest], d[rest], f[rest], l[rest]
        before = carry or (a[0] + 1, 0, 0, 0, 0)
        pa_, pc_, pd, pf, pl = (np.concatenate(([x], y[:-1])) for x, y in zip(before, (a, c, d, f, l)))
        if carry is None:
            pa_[0] = ~a[0]
        same_anchor = pa_ == a
        same = same_anchor & (pc_ == c)
        again = same & (pd == d) & (pf == f)  # a repeated row of one document is the same occurrence
        out = [(d[same & ~again], f[same & ~again], l[same & ~again], a[same & ~again], False)]
        if not keep_first:
            # the first of a run is repeated too, as soon as a second one follows
            second = np.flatnonzero(same & ~again)
            out.append((pd[second], pf[second], pl[second], a[second], False))
        changed = same_anchor & ~same
        start_of = np.maximum.accumulate(np.where(~same_anchor, np.arange(len(a)), -1))  # first row of the anchor in this batch, or -1
        out.append((d[changed], f[changed], l[changed], a[changed], True))
        # the anchor's first content is opened when a second one shows up
        firsts = np.flatnonzero(changed)
        owner = start_of[firsts]
        here = np.unique(owner[owner >= 0])
        out.append((d[here], f[here], l[here], a[here], True))
        if head is not None and len(firsts) and owner[0] < 0:
            out.append((*(np.array([x]) for x in head), a[firsts[:1]], True))
            head = None
        if start_of[-1] >= 0:
            i = start_of[-1]
            head = None if i in here else (d[i], f[i], l[i])
        carry = (a[-1], c[-1], d[-1], f[-1], l[-1])
        for dd, ff, ll, aa, is_open in out:
            if len(dd):
                yield told(dd, ff, ll, aa, is_open)


def settled_runs(runs: DataFrame, keep_first: bool) -> DataFrame:
    """Runs whose windows all are repeats, and the runs to open. With `keep_first` an earliest occurrence is none."""
    deal = F.when(F.col("state") == DONE, F.xxhash64("doc_id", "first")).otherwise(F.col("anchor"))
    dealt = runs.withColumn("deal", deal).repartition("deal").drop("deal").sortWithinPartitions("anchor", "content", "doc_id", "first")
    return dealt.mapInArrow(lambda batches: _settle(batches, keep_first), SETTLED)


def packed_texts(docs: DataFrame) -> DataFrame:
    """Texts compressed one by one, for they are shuffled."""

    def run(batches):
        squeeze = zstandard.ZstdCompressor(level=3)
        for batch in tk.slices(batches):
            packed = [squeeze.compress(t) for t in pc.fill_null(batch.column(1).cast(pa.binary()), b"").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], names=["doc_id", "packed"])

    return docs.mapInArrow(run, "doc_id long, packed binary")


def unpacked(column: pa.Array) -> list[bytes]:
    expand = zstandard.ZstdDecompressor()
    return [expand.decompress(x) for x in column.to_pylist()]


def unpacked_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Record batches with a `packed` column in slices of bounded text size."""
    for batch in batches:
        start, packed = 0, batch.column("packed")
        sizes = [zstandard.frame_content_size(x.as_buffer()) for x in packed]
        while start < batch.num_rows:
            stop, size = start + 1, sizes[start]
            while stop < batch.num_rows and size + sizes[stop] <= tk.SLICE_BYTES:
                size += sizes[stop]
                stop += 1
            yield batch.slice(start, stop - start), unpacked(packed.slice(start, stop - start))
            start = stop


def split_windows(symbols: np.ndarray, begin: np.ndarray, end: np.ndarray, doc_id: np.ndarray, shift: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
    """Rows (key, doc_id, first, stop) of the windows that start in begin:end; `shift` is where their texts begin.

    One occurrence of each window goes on under its own hash, stop -1, to meet equal windows of other
    slices. Later ones of this slice are repeats already and go on as joined spans.
    """
    count = end - begin
    at = np.repeat(begin + count - np.cumsum(count), count) + np.arange(count.sum())
    doc, place = np.repeat(doc_id, count), at - np.repeat(shift, count)
    key = tk.window_hashes(symbols, size)[0][at]
    order = np.lexsort((place, doc, key))
    key, doc, place = key[order], doc[order], place[order]
    # a repeated row of one document is the same occurrence
    new = np.concatenate(([True], (key[1:] != key[:-1]) | (doc[1:] != doc[:-1]) | (place[1:] != place[:-1])))
    key, doc, place = key[new], doc[new], place[new]
    again = np.concatenate(([False], key[1:] == key[:-1]))
    d, first, stop = joined_spans(doc[again], place[again], place[again] + size) if again.any() else (doc[:0], place[:0], place[:0])
    keys = np.concatenate((key[~again], tk.mix(d.view(np.uint64) ^ tk.mix(first.astype(np.uint64)))))
    return tk.signed(keys), np.concatenate((doc[~again], d)), np.concatenate((place[~again], first)), np.concatenate((np.full((~again).sum(), -1), stop))


def opened_windows(symbols: np.ndarray, bounds: np.ndarray, doc_ids: list[int], wanted: list[list[dict]], size: int, contexts: bool) -> Iterator[pa.RecordBatch]:
    """The windows of each text's wanted runs (see opened_runs)."""
    hashed = None if contexts else tk.window_hashes(symbols, size)[0]
    anchors, ids, starts, windows, large = [], [], [], [], []
    for i, (doc_id, runs) in enumerate(zip(doc_ids, wanted)):
        for x in runs:
            first, last = int(bounds[i]) + x["first"], int(bounds[i]) + x["last"]
            if last + size > bounds[i + 1]:
                continue  # a run of another text with the same id
            if contexts and x["large"]:
                large.append((first, last + 1, doc_id, int(bounds[i])))
                continue
            anchors.append(x["anchor"])
            ids.append(doc_id)
            starts.append(x["first"])
            if contexts:
                windows.append(symbols[first : last + size].tobytes())
            else:
                windows.append(hashed[first : last + 1].tobytes())
    columns = [pa.array(anchors, pa.int64()), pa.array(ids, pa.int64()), pa.array(starts, pa.int32()), pa.array(windows, pa.binary())]
    names = ["anchor", "doc_id", "first", "windows"]
    if contexts:
        columns, names = [*columns, pa.nulls(len(ids), pa.int32())], [*names, "stop"]
    yield pa.RecordBatch.from_arrays(columns, names=names)
    if large:
        key, doc, first, stop = split_windows(symbols, *(np.array(x, np.int64) for x in zip(*large)), size)
        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(doc), pa.array(first.astype(np.int32)), pa.nulls(len(key), pa.binary()), pa.array(stop.astype(np.int32))], names=names)


def opened_runs(settled: DataFrame, texts: DataFrame, symbols_of, size: int, contexts: bool, most: int = MOST) -> DataFrame:
    """The open runs with their windows: as hashes, or (`contexts`) as the symbols they cover.

    With `contexts`, an anchor of more than `most` open runs is split by window: such rows have no
    symbols, but a `stop` (see split_windows).
    """

    def run(batches):
        for batch, raw in unpacked_slices(batch.filter(pc.is_valid(batch.column("wanted"))) for batch in batches):
            yield from opened_windows(*symbols_of(pa.array(raw, pa.large_binary())), batch.column("doc_id").to_pylist(), batch.column("wanted").to_pylist(), size, contexts)

    opened, fields = settled.filter("open"), ["anchor", "first", "last"]
    if contexts:
        # at most one row for `most` open runs
        large = opened.groupBy("anchor").agg(F.count("*").alias("n")).filter(F.col("n") > most).select("anchor", F.lit(True).alias("large"))
        opened, fields = opened.join(F.broadcast(large), "anchor", "left").withColumn("large", F.coalesce("large", F.lit(False))), [*fields, "large"]
    wanted = opened.groupBy("doc_id").agg(F.collect_list(F.struct(*fields)).alias("wanted"))
    # a left join like that of with_spans, so that Spark shuffles the texts once for both
    return texts.join(wanted, "doc_id", "left").mapInArrow(run, "anchor long, doc_id long, first int, windows binary" + (", stop int" if contexts else ""))


def anchor_groups(batches: Iterator[pa.RecordBatch], enough: int = 1 << 19) -> Iterator[pa.Table]:
    """Tables of whole anchor groups, of about `enough` bytes or one group."""
    held, size = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        anchor = np.asarray(batch.column(0))
        cuts = np.flatnonzero(anchor[1:] != anchor[:-1]) + 1
        if held and np.asarray(held[-1].column(0))[-1] != anchor[0]:
            cuts = np.concatenate(([0], cuts))
        done = 0
        for cut in cuts.tolist():
            if size + batch.slice(done, cut - done).nbytes < enough:
                continue
            if cut > done:
                held.append(batch.slice(done, cut - done))
            if held:
                yield pa.Table.from_batches(held)
            held, size, done = [], 0, cut
        held.append(batch.slice(done))
        size += held[-1].nbytes
    if held:
        yield pa.Table.from_batches(held)


def in_anchor_groups(opened: DataFrame, compare) -> DataFrame:
    return opened.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(compare, SPANS)


def shared_only(rows: DataFrame, *key: str, once: bool = False) -> DataFrame:
    """Rows whose key, their first columns, two or more rows have; streamed in key order after one shuffle. With `once`, equal rows are one."""

    def run(batches):
        held, told = None, True  # the last row so far, and whether it is put out
        for batch in batches:
            if once and batch.num_rows:
                values = [np.asarray(x) for x in batch.columns]
                again = np.logical_and.reduce([x[1:] == x[:-1] for x in values])
                start = held is not None and all(held.column(i)[0].as_py() == x[0] for i, x in enumerate(values))
                batch = batch.filter(pa.array(~np.concatenate(([start], again))))
            if not batch.num_rows:
                continue
            keys = [np.asarray(batch.column(i)) for i in range(len(key))]
            same = np.logical_and.reduce([k[1:] == k[:-1] for k in keys])
            before = np.concatenate(([held is not None and all(held.column(i)[0].as_py() == k[0] for i, k in enumerate(keys))], same))
            after = np.concatenate((same, [False]))
            if before[0] and not told:
                yield held
            yield batch.filter(pa.array(before | after))
            held, told = batch.slice(batch.num_rows - 1), bool(before[-1])

    return rows.repartition(*key).sortWithinPartitions(*(rows.columns if once else key)).mapInArrow(run, rows.schema)


SPANS = "doc_id long, start int, stop int"


def span_batch(doc: np.ndarray, start: np.ndarray, stop: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(doc.astype(np.int64)), pa.array(start.astype(np.int32)), pa.array(stop.astype(np.int32))], names=["doc_id", "start", "stop"])


def joined_spans(doc: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of each document that touch or overlap as one: nested repeat groups name the same bytes many times."""
    order = np.lexsort((start, doc))
    doc, start, stop = doc[order], start[order], stop[order]
    base = np.cumsum(np.concatenate(([0], (doc[1:] != doc[:-1]).astype(np.int64)))) << 32
    begin, end = tk.merge_spans(base + start, base + stop)
    which = np.searchsorted(base, begin >> 32 << 32)
    return doc[which], begin & 0xFFFFFFFF, end & 0xFFFFFFFF


def repeat_spans(runs: DataFrame, size: int, keep_first: bool, edges) -> DataFrame:
    """doc_id, start, stop: symbols covered by repeated windows of the runs; spans may overlap. `edges` gives those of the open runs."""
    settled = stored(settled_runs(runs, keep_first), "runs")
    whole = settled.filter("not open").select("doc_id", F.col("first").alias("start"), (F.col("last") + size).alias("stop"))
    return whole.unionByName(edges(settled))


def with_spans(texts: DataFrame, spans: DataFrame) -> DataFrame:
    """Packed texts with all their spans, one row each."""
    return texts.join(gathered_spans(spans), "doc_id", "left")


def gathered_spans(spans: DataFrame) -> DataFrame:
    return spans.groupBy("doc_id").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))


def merged_spans(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Maximal runs of each row's spans."""
    none = np.zeros(0, np.int64)
    for i in range(len(column)):
        value = column[i].values
        if value is None or not len(value):
            yield none, none
        else:
            yield tk.merge_spans(np.asarray(value.field(0)).astype(np.int64), np.asarray(value.field(1)).astype(np.int64))


def narrow(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return columns(docs, id_col, text_col)
