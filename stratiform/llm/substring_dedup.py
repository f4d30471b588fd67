"""Substring dedup: words of 35-word passages that stand anywhere else too.

Reference blocks are the words 0-17, 18-35, ... of each document: any passage of 35 words
holds one whole block. They are indexed, and every rolling window of 18 words
probes the index. A hit is a block that is indexed and found at two places or
more; that depends on its words alone, so equal passages have equal hits. Hits are
extended to maximal exact repeats (see repeats.py, with hits as anchors).

Probes are not shuffled as rows: a slice of documents sends each bucket of the index the
sorted hashes of its own probes, packed, once for each distinct hash, and gets back one bit for
each. A block that fills a third of the corpus thus counts once a slice. Of the
hash, 32 bits and the bucket are compared; a false hit costs a comparison and changes no result.

Texts are never shuffled. Slices are stored once, in buckets by part, a few slices of one task; answers,
runs to open and spans are brought to them by part.

Defined results: a null or empty text has no words; windows never cross documents;
rows that repeat an id are one document, so identical repeated rows are no
copies of each other; rows with a null id neither match nor lose words; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import repeats as rp
from . import textkit as tk
from .shared import stored_by

SIZE, BLOCK = 35, 18
#: Text bytes of a slice, buckets of the index for each shuffle partition, and probes a bucket should not exceed.
SLICE, SPREAD, BUCKET = 1 << 20, 4, 1 << 22
#: Slices are dealt to so many parts at once, so that small tables are spread too; a part is full at 1 << DEPTH slices.
PARTS, DEPTH = 8, 4
_KEY = np.uint64(0xFFFFFFFF)
#: Flags of a probe: its block is a reference block; it stands at several places of the slice.
INDEXED, SEVERAL = 1, 2


def text_slices(docs: DataFrame) -> DataFrame:
    """part, slice, n_words, and the ids, sizes and joined bytes of its documents, compressed. The number of a slice begins with that of its part."""

    def run(batches):
        squeeze, number, task = zstandard.ZstdCompressor(level=3), 0, TaskContext.get().partitionId() << 32
        for batch in tk.slices(batches, limit=SLICE):
            data, offsets = tk.buffer_of(batch.column(1))
            n_words = len(tk.word_spans(data, offsets)[0])
            level, at = divmod(number, PARTS)
            part = task + (level >> DEPTH) * PARTS + at
            yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([part << DEPTH | level % (1 << DEPTH)]), pa.array([n_words]), pa.ListArray.from_arrays([0, batch.num_rows], batch.column(0)), pa.array([np.diff(offsets)], pa.list_(pa.int64())), pa.array([squeeze.compress(data.tobytes())], pa.binary())], names=["part", "slice", "n_words", "ids", "sizes", "packed"])
            number += 1

    return docs.mapInArrow(run, "part long, slice long, n_words long, ids array<long>, sizes array<long>, packed binary")


def brought(rows: DataFrame, slices: DataFrame, name: str, how: str = "inner") -> DataFrame:
    """The slices, each with its own of `rows` (by `slice`) as an array of structs; only `rows` are shuffled."""
    by_part = rows.groupBy(F.shiftright("slice", DEPTH).alias("part")).agg(F.collect_list(F.struct(*rows.columns)).alias("all"))
    own = F.filter("all", lambda x: x["slice"] == F.col("slice"))
    return slices.join(by_part, "part", how).select("slice", "ids", "sizes", "packed", own.alias(name))


def placed(rows: DataFrame, slices: DataFrame) -> DataFrame:
    """Rows by doc_id, each for every slice that holds its document."""
    return rows.join(slices.select(F.explode("ids").alias("doc_id"), "slice").distinct().hint("merge"), "doc_id")


def _slice_words(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Row number, word symbols and document bounds of each slice."""
    for i, raw in enumerate(rp.unpacked(batch.column("packed"))):
        cuts = np.concatenate(([0], np.cumsum(np.asarray(batch.column("sizes")[i].values))))
        yield i, *rp.word_symbols(pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(raw)]))


def _probes(symbols: np.ndarray, bounds: np.ndarray, block: int, buckets: int):
    """Places of the rolling windows, whether each is a reference block, and its bucket and hash in one number."""
    at = np.arange(max(len(symbols) - block + 1, 0))
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    at = at[doc[at] == doc[at + block - 1]]
    grams = tk.window_hashes(symbols, block)[0][at]
    return at, (at - bounds[doc[at]]) % block == 0, (grams >> np.uint64(32)) % np.uint64(buckets) << np.uint64(32) | grams & _KEY


def _squeezed(keys: np.ndarray, flags: np.ndarray) -> bytes:
    steps = np.diff(keys, prepend=np.uint32(0)).astype(np.uint32)
    return zstandard.compress(steps.view(np.uint8).reshape(-1, 4).T.tobytes() + flags.tobytes(), 1)


def _expanded(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(zstandard.decompress(packed), np.uint8)
    planes = raw.reshape(5, -1)
    return np.cumsum(np.ascontiguousarray(planes[:4].T).view(np.uint32)[:, 0], dtype=np.uint32), planes[4]


def rolling_probes(slices: DataFrame, block: int, buckets: int) -> DataFrame:
    """bucket, slice and the packed distinct hashes, with flags, of the slice's rolling windows."""

    def run(batches):
        for batch in batches:
            for i, symbols, bounds in _slice_words(batch):
                _, indexed, codes = _probes(symbols, bounds, block, buckets)
                if not len(codes):
                    continue
                order = np.argsort(codes)
                codes, indexed = codes[order], indexed[order]
                first = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))
                flags = (np.logical_or.reduceat(indexed, first) * INDEXED + (np.diff(first, append=len(codes)) > 1) * SEVERAL).astype(np.uint8)
                codes = codes[first]
                bucket, keys = (codes >> np.uint64(32)).astype(np.int32), (codes & _KEY).astype(np.uint32)
                cuts = np.concatenate(([0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, [len(bucket)])).tolist()
                packed = [_squeezed(keys[a:b], flags[a:b]) for a, b in zip(cuts, cuts[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(bucket[cuts[:-1]]), pa.repeat(batch.column("slice")[i], len(packed)), pa.array(packed, pa.binary())], names=["bucket", "slice", "probes"])

    return slices.select("slice", "sizes", "packed").mapInArrow(run, "bucket int, slice long, probes binary")


def _answers(bucket: int, slices: list[int], probes: list[bytes]) -> pa.RecordBatch:
    """One bit for each probe of a bucket: whether it is a hit."""
    parts = [_expanded(p) for p in probes]
    keys, flags = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(keys, kind="stable")
    first = np.flatnonzero(np.concatenate(([True], np.diff(keys[order]) != 0)))
    flags = flags[order]
    hit = (np.bitwise_or.reduceat(flags, first) & INDEXED > 0) & ((np.diff(first, append=len(keys)) > 1) | (np.bitwise_or.reduceat(flags, first) & SEVERAL > 0))
    hits = np.zeros(len(keys), bool)
    hits[order] = np.repeat(hit, np.diff(first, append=len(keys)))
    masks = np.split(hits, np.cumsum([len(k) for k, _ in parts])[:-1])
    found = [(s, np.packbits(m).tobytes()) for s, m in zip(slices, masks) if m.any()]
    return pa.RecordBatch.from_arrays([pa.array([s for s, _ in found], pa.int64()), pa.array([bucket] * len(found), pa.int32()), pa.array([m for _, m in found], pa.binary())], names=["slice", "bucket", "mask"])


def probe_answers(probes: DataFrame) -> DataFrame:
    """slice, bucket, mask: the index, bucket by bucket, against all its probes."""

    def run(batches):
        now, slices, held = None, [], []
        for batch in batches:
            for bucket, number, packed in zip(*(batch.column(n).to_pylist() for n in ("bucket", "slice", "probes"))):
                if bucket != now and held:
                    yield _answers(now, slices, held)
                    slices, held = [], []
                now = bucket
                slices.append(number)
                held.append(packed)
        if held:
            yield _answers(now, slices, held)

    return probes.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "slice long, bucket int, mask binary")


def hit_runs(slices: DataFrame, size: int, block: int) -> DataFrame:
    """The runs of windows around hits; all windows without a hit inside stand nowhere else."""
    words = slices.agg(F.sum("n_words")).first()[0] or 0
    buckets = max(SPREAD * int(slices.sparkSession.conf.get("spark.sql.shuffle.partitions")), words // BUCKET)

    def run(batches):
        for batch in batches:
            for i, symbols, bounds in _slice_words(batch):
                at, _, codes = _probes(symbols, bounds, block, buckets)
                distinct, which = np.unique(codes, return_inverse=True)
                hits = np.zeros(len(distinct), bool)
                answered, masks = (batch.column("answers")[i].values.field(n) for n in ("bucket", "mask"))
                first = np.asarray(answered).astype(np.uint64)
                starts, ends = (np.searchsorted(distinct, x << np.uint64(32)).tolist() for x in (first, first + np.uint64(1)))
                for a, b, mask in zip(starts, ends, masks.to_pylist()):
                    hits[a:b] = np.unpackbits(np.frombuffer(mask, np.uint8), count=b - a)
                able = np.zeros(len(symbols), bool)
                able[at] = hits[which]
                runs = rp.runs_of(symbols, bounds, size, block, able)
                if len(runs[0]):
                    yield rp.run_batch(np.asarray(batch.column("ids")[i].values), runs)

    answers = probe_answers(rolling_probes(slices, block, buckets))
    return brought(answers, slices, "answers").mapInArrow(run, rp.RUNS)


def opened_runs(settled: DataFrame, slices: DataFrame, size: int) -> DataFrame:
    """The open runs with the hashes of their windows."""

    def run(batches):
        for batch in batches:
            for i, symbols, bounds in _slice_words(batch):
                wanted = {x["doc_id"]: x["runs"] for x in batch.column("wanted")[i].as_py()}
                if wanted:
                    ids = batch.column("ids")[i].as_py()
                    yield from rp.opened_windows(symbols, bounds, ids, [wanted.get(d, ()) for d in ids], size, False)

    wanted = settled.filter("open").groupBy("doc_id").agg(F.collect_list(F.struct("anchor", "first", "last")).alias("runs"))
    return brought(placed(wanted, slices), slices, "wanted").mapInArrow(run, "anchor long, doc_id long, first int, windows binary")


def _compare(opened: DataFrame, size: int) -> DataFrame:
    """Spans of windows that two or more open runs share, streamed in order of their hash: an open run is the only one of its content.

    Windows are equal if their hashes and those of their anchors are, 128 bits in all. Repeated rows of one document open the same window, which counts once.
    """

    def split(batches):
        for batch in batches:
            raw = batch.column("windows").to_pylist()
            counts = np.array([len(x) // 8 for x in raw], np.int64)
            owner = np.repeat(np.arange(len(raw)), counts)
            inner = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
            start = np.asarray(batch.column("first")).astype(np.int64)[owner] + inner
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(b"".join(raw), np.int64)), batch.column("anchor").take(pa.array(owner)), batch.column("doc_id").take(pa.array(owner)), pa.array(start.astype(np.int32))], names=["window", "anchor", "doc_id", "start"])

    def join(batches):
        for batch in batches:
            doc, start = (np.asarray(batch.column(n)).astype(np.int64) for n in ("doc_id", "start"))
            if len(doc):
                yield rp.span_batch(*rp.joined_spans(doc, start, start + size))

    windows = opened.select("anchor", "doc_id", "first", "windows").mapInArrow(split, "window long, anchor long, doc_id long, start int")
    return rp.shared_only(windows, "window", "anchor", once=True).mapInArrow(join, rp.SPANS)


def _merged(spans: DataFrame) -> DataFrame:
    """slice, doc_id, starts and stops: the maximal runs of each document's spans."""

    def run(batches):
        for batch in batches:
            starts, stops = zip(*rp.merged_spans(batch.column("spans"))) if batch.num_rows else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column("slice"), batch.column("doc_id"), pa.array(starts, pa.list_(pa.int32())), pa.array(stops, pa.list_(pa.int32()))], names=["slice", "doc_id", "starts", "stops"])

    return spans.mapInArrow(run, "slice long, doc_id long, starts array<int>, stops array<int>")


def repeated_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, block: int = BLOCK) -> DataFrame:
    """Slices of documents, with the word spans to remove from each that has any."""
    narrow = rp.narrow(docs, id_col, text_col)
    slices = stored_by(text_slices(narrow.filter("doc_id is not null")), "slices", "part")
    spans = rp.repeat_spans(hit_runs(slices, size, block), size, False, lambda settled: _compare(opened_runs(settled, slices, size), size))
    found = brought(_merged(placed(rp.gathered_spans(spans), slices)), slices, "spans", "left")
    nameless = text_slices(narrow.filter("doc_id is null"))
    return found.unionByName(nameless.select("slice", "ids", "sizes", "packed"), allowMissingColumns=True)


def kept_words(found: DataFrame, digest: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed and the kept words joined by blanks, or their digest."""
    name = "kept_sha256" if digest else "kept"

    def run(batches):
        for batch in batches:
            for i, raw in enumerate(rp.unpacked(batch.column("packed"))):
                cuts = np.concatenate(([0], np.cumsum(np.asarray(batch.column("sizes")[i].values))))
                starts, ends, doc = tk.word_spans(np.frombuffer(raw, np.uint8), cuts)
                bounds = np.searchsorted(doc, np.arange(len(cuts)))
                ids, spans = batch.column("ids")[i].values, {x["doc_id"]: x for x in batch.column("spans")[i].as_py() or ()}
                rows = []
                for k, doc_id in enumerate(ids.to_pylist()):
                    own = slice(bounds[k], bounds[k + 1])
                    stay = np.ones(bounds[k + 1] - bounds[k], bool)
                    if doc_id in spans:
                        for a, b in zip(spans[doc_id]["starts"], spans[doc_id]["stops"]):
                            stay[a:b] = False
                    words = [raw[a:b] for a, b in zip(starts[own][stay].tolist(), ends[own][stay].tolist())]
                    kept = b" ".join(words)
                    rows.append((len(stay), len(stay) - len(words), hashlib.sha256(kept).hexdigest() if digest else kept.decode()))
                n, removed, kept = zip(*rows)
                yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", name])

    return found.mapInArrow(run, f"doc_id long, n_words long, n_removed long, {name} string")
