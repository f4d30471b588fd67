"""Line dedup with levelled sorted runs of line hashes.

Documents come in batches from the largest ids down, so the first batch that holds a key holds the
document that keeps it. A run is a sorted table of line keys, each with the document that keeps its
line and the number of documents that hold it. Each new batch is merge-anti-joined with the runs: keys that
no run has make up the batch's own run, with their keeper; of keys that a run has, the batch adds only
its count. Runs and counts of one level are compacted into one table of the next as soon as there are
`fanout` of them, and no key is in two runs. After the last batch the runs say who keeps each key and how many hold it.

Batches double in size, so their number grows with the logarithm of the table, and
all joins with the runs together cost a few passes over the keys. Lines are dropped by a join in which
keys of very many documents are broadcast. Keys are 128-bit hashes of the stripped, lower-cased line.

Defined results: a null or empty text is one empty line and is never dropped; a line
counts once for each document id, however often a document or a repeated row
holds it; rows with a null id neither count nor lose lines; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .shared import columns, hot_join, stored

MIN_CHARS, MIN_DOCS = 40, 5
#: Documents of the first batch; each later one is as large as all before it together. Tables of a level before it is compacted.
FIRST_BATCH, FANOUT = 25_000, 3
BLANK = " \t\n\x0b\x0c\r"
KEY = ["hi", "lo"]


def _keys(text: pa.Array):
    """Lines of a string array, the row of each, and which are long enough; keys as 128-bit digests."""
    lines = pc.split_pattern(text, "\n")
    row = np.repeat(np.arange(len(text)), pc.list_value_length(lines).to_numpy(zero_copy_only=False))
    flat = pc.list_flatten(lines)
    keys = pc.ascii_lower(pc.ascii_trim(flat, characters=BLANK))
    return flat, keys, row


def _digests(keys: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(b"".join(xxhash.xxh3_128_digest(k) for k in keys.to_pylist()), ">i8").reshape(-1, 2)
    return raw[:, 0].astype(np.int64), raw[:, 1].astype(np.int64)


def _texts(column: pa.Array) -> pa.Array:
    return pc.fill_null(column, "")


def batch_ends(docs: DataFrame, first: int) -> list[int]:
    """Smallest document id of each batch but the last, from the largest batch number of ids down."""
    n = docs.count()
    sizes = [first << k for k in range(64) if first << k < n]
    if not sizes:
        return []
    shares = ", ".join(f"{1 - size / n:.12f}D" for size in sizes)
    found = docs.agg(F.expr(f"percentile_approx(doc_id, array({shares}), 10000)").alias("ends")).first()[0]
    return sorted(set(found or []), reverse=True)


def line_keys(docs: DataFrame, ends: list[int], min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, hi, lo, batch: each key once for each document of a record batch."""
    limits = np.array([-e for e in ends], np.int64)

    def run(source):
        for batch in tk.slices(source):
            _, keys, row = _keys(_texts(batch.column(1)))
            long = pc.greater_equal(pc.utf8_length(keys), min_chars)
            row = row[long.to_numpy(zero_copy_only=False)]
            hi, lo = _digests(keys.filter(long))
            table = pa.table({"doc_id": np.asarray(batch.column(0))[row], "hi": hi, "lo": lo}).group_by(["doc_id", "hi", "lo"]).aggregate([])
            number = np.searchsorted(limits, -np.asarray(table["doc_id"]))
            yield from table.append_column("batch", pa.array(number.astype(np.int32))).to_batches()

    return docs.filter("doc_id is not null").select("doc_id", "text").mapInArrow(run, "doc_id long, hi long, lo long, batch int")


def counted(keys: DataFrame) -> DataFrame:
    """One batch's keys: documents that hold each, and the largest id."""
    return keys.dropDuplicates(["doc_id", *KEY]).groupBy(*KEY).agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("keeper"))


def merged(tables: list[DataFrame]) -> DataFrame:
    """One table of runs and counts; a key has its keeper in one run alone."""
    return reduce(DataFrame.unionByName, tables).groupBy(*KEY).agg(F.sum("n_docs").alias("n_docs"), F.max("keeper").alias("keeper"))


class LevelledRuns:
    """Runs and counts by level in the shared folder. Batches come from the largest document ids down, all rows of a document in one."""

    def __init__(self, fanout: int = FANOUT):
        self.fanout, self.levels = fanout, [[]]

    def tables(self) -> list[DataFrame]:
        return [table for level in self.levels for table in level]

    def _write(self, table: DataFrame) -> DataFrame:
        return stored(table.sortWithinPartitions(*KEY), "line-run")

    def add(self, batch: DataFrame) -> None:
        """Add what counted() gives for a batch: new keys as a run with their keepers, known keys as counts."""
        if self.tables():
            batch = stored(batch, "line-batch")
            known = reduce(DataFrame.unionByName, [t.filter("keeper is not null").select(*KEY) for t in self.tables()])
            new = batch.join(known.hint("merge"), KEY, "left_anti")
            again = batch.join(known.hint("merge"), KEY, "left_semi").withColumn("keeper", F.lit(None).cast("long"))
            batch = new.unionByName(again)
        self.levels[0].append(self._write(batch))
        self.compact()

    def compact(self) -> None:
        for depth, level in enumerate(self.levels):
            if len(level) >= self.fanout:
                if depth + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[depth + 1].append(self._write(merged(level)))
                self.levels[depth] = []

    def frequent(self, min_docs: int) -> DataFrame:
        return merged(self.tables()).filter(F.col("n_docs") >= min_docs)


def frequent_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, first_batch: int = FIRST_BATCH, fanout: int = FANOUT) -> tuple[DataFrame, DataFrame]:
    """Stored line keys of all documents, and the keys found in enough of them with their keeper and count."""
    ends = batch_ends(docs.select("doc_id"), first_batch)
    keys = stored(line_keys(docs, ends, min_chars), "line-keys", "batch")
    runs = LevelledRuns(fanout)
    for number in range(len(ends) + 1):
        runs.add(counted(keys.filter(F.col("batch") == number)))
    return keys, stored(runs.frequent(min_docs), "frequent-lines")


def drops(docs: DataFrame, **options) -> DataFrame:
    """doc_id, dropped: for each document that loses lines, the packed keys of those lines."""
    keys, frequent = frequent_lines(docs, **options)
    lost = hot_join(keys.select("doc_id", *KEY), frequent, KEY, "n_docs").filter(F.col("doc_id") < F.col("keeper"))
    return lost.groupBy("doc_id").agg(F.collect_set(F.struct(*KEY)).alias("dropped"))


REWRITTEN = "n_lines long, n_dropped long, kept string"


def rewritten(docs_with_drops: DataFrame, passed: list[str], min_chars: int = MIN_CHARS, digest: bool = False) -> DataFrame:
    """Drop the listed lines of `text`; the columns `passed` go through unchanged."""
    kept_name = "kept_sha256" if digest else "kept"

    def run(source):
        for batch in tk.slices(source, text=0):
            text = _texts(batch.column(0))
            flat, keys, row = _keys(text)
            n_lines = np.bincount(row, minlength=len(text))
            kept, n_dropped = text.to_pylist(), np.zeros(len(text), np.int64)
            ends = np.cumsum(n_lines)
            for i, lost in enumerate(batch.column(1).to_pylist()):
                if lost:
                    lost = {(x["hi"], x["lo"]) for x in lost}
                    own = slice(int(ends[i] - n_lines[i]), int(ends[i]))
                    mine = keys[own]
                    hi, lo = _digests(mine)
                    # the keys listed are of long lines only, so no shorter line can match
                    stay = [line for line, key in zip(flat[own].to_pylist(), zip(hi.tolist(), lo.tolist())) if key not in lost]
                    n_dropped[i] = n_lines[i] - len(stay)
                    kept[i] = "\n".join(stay)
            if digest:
                kept = [hashlib.sha256(k.encode()).hexdigest() for k in kept]
            yield pa.RecordBatch.from_arrays([*batch.columns[2:], pa.array(n_lines, pa.int64()), pa.array(n_dropped), pa.array(kept, pa.string())], names=[*passed, "n_lines", "n_dropped", kept_name])

    schema = docs_with_drops.select(*passed).schema.add("n_lines", "long").add("n_dropped", "long").add(kept_name, "string")
    return docs_with_drops.select("text", "dropped", *passed).mapInArrow(run, schema)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: bool = False, **options) -> DataFrame:
    """doc_id, n_lines, n_dropped and the kept text (or its digest) of every document."""
    narrow = columns(docs, id_col, text_col)
    return rewritten(narrow.join(drops(narrow, **options), "doc_id", "left"), ["doc_id"], digest=digest)


def dedup_lines_in_place(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The same rows and columns, each text without its dropped lines; a null text stays null."""
    lost = drops(columns(docs, id_col, text_col), **options).select(F.col("doc_id").alias("__ld_id"), F.col("dropped").alias("__ld_dropped"))
    rest = [c for c in docs.columns if c != text_col]
    joined = docs.join(lost, F.col(f"`{id_col}`") == F.col("__ld_id"), "left")
    packed = joined.select(F.col(f"`{text_col}`").cast("string").alias("text"), F.col("__ld_dropped").alias("dropped"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    out = rewritten(packed, ["row"])
    kept = F.when(F.col(f"row.`{text_col}`").isNull(), None).otherwise(F.col("kept"))
    return out.select(*[kept.alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns]) if rest else out.select(kept.alias(text_col))
