"""Vector code compression: product codes whose codebooks are kept up by delta-maintained Lloyd rounds.

A vector's components become integers, floor(scale * x), and are cut into equal consecutive parts. Each part position has a codebook.
A round assigns every part to its nearest entry and stores the codes beside those of the round before. Only parts whose code
has changed are contributions: minus at the old entry, plus at the new one, summed within each task before the shuffle, so that at
most parts * entries rows leave a task. Running sums and counts, exact integers, take them up, and an entry becomes
floor(sum / count). Codebooks and running sums are parts * entries rows whatever the table; nothing else reaches the driver.

Defined results: rows whose vector is null, or holds a null or a component that is not finite, are dropped. Vectors shorter than the longest
are padded with zeros, and so is a length that the number of parts doesn't divide. Integers beyond +-2^31 count as that bound, and an error
beyond a long as the largest long. Repeated rows are coded each; of rows with one id the least vector can start a codebook; null ids come after all
others. With fewer ids than entries a codebook is shorter. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from .shared import hot_join, stored

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
BOUND, LONG_MAX = 1 << 31, (1 << 63) - 1
#: Vectors that are compared with the codebooks at once.
CHUNK = 2048


@dataclass
class Codebooks:
    """entries[part, entry, place], with the running sums and counts of the parts assigned to each."""

    entries: np.ndarray
    sums: np.ndarray
    counts: np.ndarray

    @classmethod
    def starting(cls, vectors: np.ndarray, parts: int) -> "Codebooks":
        entries = vectors.reshape(len(vectors), parts, -1).transpose(1, 0, 2).copy()
        return cls(entries, np.zeros(entries.shape, object), np.zeros(entries.shape[:2], object))

    def moved(self, rows) -> "Codebooks":
        """Take up contributions (part, entry, count, sums) and move the entries to floor(sum / count); unused ones stay."""
        sums, counts, entries = self.sums.copy(), self.counts.copy(), self.entries.copy()
        for row in rows:
            sums[row["part"], row["entry"]] += np.array(row["sums"], object)
            counts[row["part"], row["entry"]] += row["n"]
        for part, entry in zip(*np.nonzero(counts)):
            entries[part, entry] = [s // counts[part, entry] for s in sums[part, entry]]
        return Codebooks(entries, sums, counts)

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def integer_vectors(vectors: DataFrame, id_col: str, vector_col: str, scale: float, keep: list[str]) -> DataFrame:
    """vec_id, the columns `keep` and the integers of every vector that is whole; lengths are still those of the table."""

    def run(batches):
        for batch in batches:
            column = batch.column(0)
            values = np.asarray(pc.fill_null(column.flatten(), np.nan), np.float64)
            sizes = np.asarray(pc.fill_null(pc.list_value_length(column), 0), np.int64)
            ends = np.cumsum(sizes)
            bad = np.concatenate(([0], np.cumsum(~np.isfinite(values))))
            rows = np.flatnonzero(np.asarray(column.is_valid()) & (bad[ends] == bad[ends - sizes]))
            with np.errstate(over="ignore", invalid="ignore"):
                whole = np.clip(np.nan_to_num(np.floor(values * scale), nan=0, posinf=BOUND, neginf=-BOUND), -BOUND, BOUND).astype(np.int64)
            whole = whole[np.isin(np.repeat(np.arange(len(sizes)), sizes), rows)]
            cuts = np.concatenate(([0], np.cumsum(sizes[rows]))).astype(np.int32)
            rest = [c.take(pa.array(rows)) for c in batch.columns[1:]]
            yield pa.RecordBatch.from_arrays([*rest, pa.ListArray.from_arrays(pa.array(cuts), pa.array(whole))], names=["vec_id", *keep, "vector"])

    narrow = vectors.select(F.col(vector_col).cast("array<double>").alias("__vector"), F.col(id_col).cast("long").alias("vec_id"), *keep)
    schema = narrow.drop("__vector").schema.add("vector", ArrayType(LongType()))
    return narrow.mapInArrow(run, schema)


def matrix_of(column: pa.Array, width: int) -> np.ndarray:
    """Rows of integers, padded with zeros to `width`."""
    sizes = np.asarray(pc.list_value_length(column), np.int64)
    values, out = np.asarray(column.flatten(), np.int64), np.zeros((len(sizes), width), np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out


def nearest(vectors: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code of each part, ties to the lower entry, and each vector's squared distance to its entries. Exact: in doubles where no number can pass 2^53, else in longs, else in Python's integers."""
    parts, _, length = entries.shape
    most = int(max(np.abs(vectors).max(initial=0), np.abs(entries).max(initial=0)))
    reach = 4 * max(length, 1) * parts * most * most
    kind = np.float64 if reach < 1 << 53 else np.int64 if reach < 1 << 62 else object
    x, c = vectors.reshape(len(vectors), parts, length).transpose(1, 0, 2).astype(kind), entries.astype(kind)
    distance = (x * x).sum(2)[:, :, None] - 2 * np.matmul(x, c.transpose(0, 2, 1)) + (c * c).sum(2)[:, None, :]
    codes = distance.argmin(2)
    least = np.take_along_axis(distance, codes[:, :, None], 2)[:, :, 0].sum(0)
    return codes.T.astype(np.uint8), np.array([min(int(e), LONG_MAX) for e in least], np.int64) if kind is object else least.astype(np.int64)


def assigned(vectors: DataFrame, books: Codebooks, keep: list[str]) -> DataFrame:
    """Every vector with its new codes, the codes of the round before (null in the first), and its error."""
    entries, width = books.entries, books.entries.shape[0] * books.entries.shape[2]
    columns = ["vec_id", *keep, "vector"]
    before = vectors.codes if "codes" in vectors.columns else F.lit(None).cast("binary")
    source = vectors.select(*columns, before.alias("before"))

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                cut = batch.slice(at, CHUNK)
                codes, error = nearest(matrix_of(cut.column(len(keep) + 1), width), entries)
                raw = pa.array([row.tobytes() for row in codes], pa.binary())
                yield pa.RecordBatch.from_arrays([*cut.columns, raw, pa.array(error)], names=[*columns, "before", "codes", "error"])

    return source.mapInArrow(run, source.select("*").schema.add("codes", "binary").add("error", "long"))


def contributions(coded: DataFrame, books: Codebooks) -> DataFrame:
    """part, entry, n, sums: what changed parts take from their old entries and bring to their new ones."""
    parts, n_entries, length = books.entries.shape

    def run(batches):
        sums, counts = np.zeros((parts, n_entries, length), np.int64), np.zeros((parts, n_entries), np.int64)
        touched = np.zeros((parts, n_entries), bool)
        for batch in batches:
            x = matrix_of(batch.column(0), parts * length).reshape(-1, parts, length)
            new = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(-1, parts)
            known = np.asarray(batch.column(2).is_valid())
            old = np.frombuffer(b"".join(b or bytes(parts) for b in batch.column(2).to_pylist()), np.uint8).reshape(-1, parts)
            row, part = np.nonzero((new != old) | ~known[:, None])
            for codes, sign in ((new, 1), (old, -1)):
                own = slice(None) if sign > 0 else known[row]
                at = part[own], codes[row, part][own]
                np.add.at(sums, at, sign * x[row, part][own])
                np.add.at(counts, at, sign)
                touched[at] = True
        part, entry = np.nonzero(touched)
        yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(entry.astype(np.int32)), pa.array(counts[part, entry]), pa.array(list(sums[part, entry]), pa.list_(pa.int64()))], names=["part", "entry", "n", "sums"])

    changed = coded.filter(~F.col("codes").eqNullSafe(F.col("before"))).select("vector", "codes", "before")
    partial = changed.mapInArrow(run, "part int, entry int, n long, sums array<long>")
    total = partial.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(length)])
    return total.select("part", "entry", "n", F.array(*[f"s{i}" for i in range(length)]).cast("array<long>").alias("sums"))


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", keep: list[str] = [], parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: float = SCALE) -> tuple[DataFrame, Codebooks | None]:
    """vec_id, the columns `keep`, codes and error of every whole vector, and the codebooks (None if there is no vector)."""
    if not 1 <= entries <= 256:
        raise ValueError("a code is one byte: 1 to 256 entries")
    table = stored(integer_vectors(vectors, id_col, vector_col, scale, keep), "vectors")
    length = table.agg(F.max(F.size("vector"))).first()[0]
    if length is None:
        return table.select("vec_id", *keep, F.lit(None).cast("binary").alias("codes"), F.lit(None).cast("long").alias("error")), None
    width = -(-max(length, 1) // parts) * parts
    # a row for each of the smallest ids, with its least vector
    ids = table.select("vec_id").distinct().orderBy(F.col("vec_id").asc_nulls_last()).limit(entries)
    firsts = table.join(F.broadcast(ids.withColumnRenamed("vec_id", "__id")), F.col("vec_id").eqNullSafe(F.col("__id"))).groupBy("vec_id").agg(F.min("vector").alias("vector")).collect()
    firsts.sort(key=lambda r: (r.vec_id is None, r.vec_id or 0))
    books = Codebooks.starting(matrix_of(pa.array([r.vector for r in firsts], pa.list_(pa.int64())), width), parts)
    for _ in range(rounds):
        table = stored(assigned(table, books, keep), "codes")
        # at most parts * entries rows
        books = books.moved(contributions(table, books).collect())
    return assigned(table, books, keep).select("vec_id", *keep, "codes", "error"), books


def decoded(coded: DataFrame, books: Codebooks, scale: float = SCALE) -> DataFrame:
    """vec_id and the vector that the codes stand for: the middle of each integer's interval."""
    entries = books.entries

    def run(batches):
        for batch in batches:
            codes = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(-1, len(entries))
            values = (entries[np.arange(len(entries)), codes].reshape(len(codes), -1) + 0.5) / scale
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(values), pa.list_(pa.float64()))], names=["vec_id", "vector"])

    return coded.select("vec_id", "codes").mapInArrow(run, "vec_id long, vector array<double>")


def label_errors(vectors: DataFrame, label_col: str = "label", **options) -> DataFrame:
    """Hex codes, error, error of all vectors with the same label (nulls together), and the digest of the codebooks."""
    labelled = vectors.withColumns({"__has": F.col(label_col).isNotNull(), "__label": F.coalesce(F.col(label_col).cast("string"), F.lit(""))})
    coded, books = compress(labelled, keep=["__has", "__label"], **options)
    coded = stored(coded, "coded")
    # a long at most: sums beyond it are null, not a failure
    sums = stored(coded.groupBy("__has", "__label").agg(F.try_sum("error").alias("label_error"), F.count("*").alias("rows")), "label-errors")
    digest = F.lit(books.sha256() if books else None).cast("string")
    return hot_join(coded, sums, ["__has", "__label"], "rows").select("vec_id", F.lower(F.hex("codes")).alias("code"), "error", "label_error", digest.alias("codebooks_sha256"))
