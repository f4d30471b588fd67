"""Packing: token pieces of whole documents into sequences of a fixed length.

Shortest-pack-first over the length histogram: lengths are placed longest first,
each into the open pattern that is shortest so far, and only the counts
of patterns change. The histogram has at most `max_tokens` rows whatever the
corpus, so the driver handles patterns alone; documents meet their
pattern by length and rank in a join.

Defined results: a null or empty text is its end id alone; repeated rows are
packed once each; a null id is kept and packed; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textkit as tk
from .shared import columns, stored
from .token_pieces import PieceEncoder, byte_bpe_encoder, encoder_for

MAX_TOKENS = 2048
END_ID = 1
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def token_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_tokens: int = MAX_TOKENS, end_id: int = END_ID, vocabulary: str = "byte_bpe_50k.json", ranks: str | None = "byte_bpe_50k.tiktoken", with_ids: bool = False) -> DataFrame:
    """Encode each document, add the end id and cut it every `max_tokens` ids. `with_ids` adds the ids themselves."""

    def run(batches):
        encoder = encoder_for((vocabulary, ranks), lambda: PieceEncoder(byte_bpe_encoder(vocabulary, ranks), keep_space=True, keep_ids=True))
        for batch in tk.slices(batches):
            data, offsets = tk.buffer_of(batch.column(1))
            counts, rows = encoder.slice(data, offsets)
            ids = encoder.gather(rows)
            # the end id follows each document
            at = np.cumsum(counts)
            ids = np.insert(ids, at, end_id).astype("<u4")
            sizes = counts + 1
            cuts = -(-sizes // max_tokens)
            doc = np.repeat(np.arange(len(sizes)), cuts)
            start = (np.arange(len(doc)) - np.repeat(np.cumsum(cuts) - cuts, cuts)) * max_tokens
            length = np.minimum(max_tokens, sizes[doc] - start)
            begin = (np.cumsum(sizes) - sizes)[doc] + start
            crc = [zlib.crc32(ids[b : b + n].data) for b, n in zip(begin.tolist(), length.tolist())]
            out = [batch.column(0).take(pa.array(doc)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(sizes[doc])]
            if with_ids:
                out.append(pa.ListArray.from_arrays(pa.array(np.concatenate((begin, [len(ids)])).astype(np.int32)), pa.array(ids.astype(np.int32))))
            yield pa.RecordBatch.from_arrays(out, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"][: len(out)])

    return columns(docs, id_col, text_col).mapInArrow(run, PIECES + (", ids array<int>" if with_ids else ""))


def shortest_pack_first(histogram: dict[int, int], size: int) -> list[tuple[list[int], int]]:
    """Patterns (lengths in one sequence) and how often each is used; works on counts only."""
    open_: dict[int, list[tuple[int, list[int]]]] = defaultdict(list)  # room left -> (count, lengths)
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            room = max((r for r, packs in open_.items() if packs and r >= length), default=0)
            if not room:
                each = min(size // length, left)
                packs, over = divmod(left, each)
                for count, n in ((packs, each), (1 if over else 0, over)):
                    if count:
                        open_[size - n * length].append((count, [length] * n))
                break
            count, lengths = open_[room].pop()
            used = min(count, left)
            if count > used:
                open_[room].append((count - used, lengths))
            open_[room - length].append((used, [*lengths, length]))
            left -= used
    return [(lengths, count) for _, packs in sorted(open_.items()) for count, lengths in packs]


def slots_of(patterns: list[tuple[list[int], int]]) -> list[tuple[int, int, int, int, int]]:
    """For each length: ranks first..last go to sequence base + (rank - first), at the given offset."""
    taken: dict[int, int] = defaultdict(int)
    slots, base = [], 0
    for lengths, count in patterns:
        offset = 0
        for length in lengths:
            slots.append((length, taken[length], taken[length] + count - 1, base, offset))
            taken[length] += count
            offset += length
        base += count
    return slots


#: Pieces of one length that are ranked in one group.
RANKED = 250_000


def pack(pieces: DataFrame, max_tokens: int = MAX_TOKENS, ranked: int = RANKED) -> DataFrame:
    """Add sequence_id and offset to stored pieces. The pieces of a length are ranked in groups of about `ranked`."""
    spark = pieces.sparkSession
    histogram = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    salts = 8 + max(histogram.values(), default=0) // ranked
    names = ["length", "first", "last", "base", "offset"]
    rows = np.array(slots_of(shortest_pack_first(histogram, max_tokens)), np.int64).reshape(-1, len(names))
    # an Arrow table: tuples would go through Python workers of their own kind, which stay beside the others
    slots = spark.createDataFrame(pa.table(dict(zip(names, rows.T.copy()))), ", ".join(f"{n} long" for n in names))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start"), F.lit(salts)))
    counts = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    own = Window.partitionBy("length", "salt").orderBy("doc_id", "start", "ids_crc32")
    ranked = salted.withColumn("rank", F.row_number().over(own)).join(counts, ["length", "salt"]).withColumn("rank", F.col("rank") - 1 + F.col("before"))
    # at most max_tokens lengths and a bounded number of patterns: the slots fit a broadcast at any corpus size
    placed = ranked.alias("r").join(F.broadcast(slots).alias("s"), (F.col("r.length") == F.col("s.length")) & F.col("r.rank").between(F.col("s.first"), F.col("s.last")))
    return placed.select(*[F.col(f"r.{c}") for c in pieces.columns], (F.col("s.base") + F.col("r.rank") - F.col("s.first")).alias("sequence_id"), F.col("s.offset").alias("offset"))


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_tokens: int = MAX_TOKENS, **options) -> DataFrame:
    """All documents as packed pieces; the pieces are stored once, so texts are encoded once."""
    return pack(stored(token_pieces(docs, id_col, text_col, max_tokens, **options), "pieces"), max_tokens)
