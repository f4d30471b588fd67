"""Source divergence audit: how far the word distributions of sources lie from each other and from their language.

Terms are counted once per (lang, source, term) and the terms of enough documents of a language are kept. A group (lang, source)
gives each kept term p = 1 + floor(10^9 * (count + a) / (N + a * V)), so a term that it lacks has the group's floor p0. The distance of two groups
is the sum over all kept terms of |p - q|, split into a heavy and a light part:

* Heavy terms stand in more than `light` groups. They fill dense numpy tiles of terms by two blocks of groups, so a
  term's pairs of groups are never rows. A tile adds what its terms change against the two floors.
* Light terms are sparse. As if no term were in both groups, a pair's sum follows from how often each count occurs in either group and from the
  two floors. Terms in both are then put right from their posting lists, which have at most `light` entries.

All are integers, and the partial sums are added. A term's p against its language's gives the terms that stand out most.

Defined results: null text, lang and source count as ''; every row is a document, repeated ones too; groups without terms keep their rows; a language with
one source has no pairs; with no kept term all distances are 0; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import textkit as tk
from .shared import hot_join, stored

MIN_DOCS, ADDED, TOP = 30, 5, 50
#: Most groups of a light term; terms of a tile and groups of one of its sides.
LIGHT, TILE_TERMS, TILE_GROUPS = 8, 512, 256

#: All ASCII but letters.
_BETWEEN = np.array([b < 128 and not chr(b).isalpha() for b in range(256)])


def term_counts(docs: DataFrame, lang_col: str, source_col: str, text_col: str) -> DataFrame:
    """lang, source, term, n, df: occurrences and documents of each term in each group; a null term counts the group's documents."""

    def run(batches):
        for batch in tk.slices(batches, text=2):
            keys = pa.table({"lang": batch.column(0), "source": batch.column(1), "row": pa.array(np.arange(batch.num_rows))}).group_by(["lang", "source"]).aggregate([("row", "min"), ("row", "count")])
            first = {(a, b): i for i, (a, b) in enumerate(zip(keys["lang"].to_pylist(), keys["source"].to_pylist()))}
            group = np.array([first[k] for k in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())], np.int64)
            data, offsets = tk.buffer_of(batch.column(2))
            data = tk.lowered(data)
            starts, ends, doc = tk.word_spans(data, offsets, _BETWEEN)
            terms = tk.byte_column(data, starts, ends).dictionary_encode()
            code, size = np.asarray(terms.indices).astype(np.int64), max(len(terms.dictionary), 1)
            held, times = np.unique(doc * size + code, return_counts=True)
            cell, at = np.unique(group[held // size] * size + held % size, return_inverse=True)
            n = np.bincount(at, weights=times, minlength=len(cell)).astype(np.int64)
            df = np.bincount(at, minlength=len(cell)).astype(np.int64)
            own = np.concatenate((cell // size, np.arange(len(first))))
            words = pa.concat_arrays([terms.dictionary.take(pa.array(cell % size)).cast(pa.large_string()) if len(cell) else pa.array([], pa.large_string()), pa.nulls(len(first), pa.large_string())])
            yield pa.RecordBatch.from_arrays(
                [pc.take(keys["lang"].combine_chunks(), pa.array(own)), pc.take(keys["source"].combine_chunks(), pa.array(own)), words.cast(pa.string()), pa.array(np.concatenate((n, np.zeros(len(first), np.int64)))), pa.array(np.concatenate((df, np.asarray(keys["row_count"], np.int64))))],
                names=["lang", "source", "term", "n", "df"],
            )

    narrow = docs.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(n) for n, c in (("lang", lang_col), ("source", source_col), ("text", text_col))])
    partial = narrow.mapInArrow(run, "lang string, source string, term string, n long, df long")
    return partial.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))


def probability(count: Column, mass: Column) -> Column:
    """1 + floor(10^9 * count / mass), three digits at a time so that longs hold every step."""
    digits, rest = F.lit(0), count
    for _ in range(3):
        step = F.call_function("div", rest * 1000, mass)
        digits, rest = digits * 1000 + step, rest * 1000 - step * mass
    return (digits + 1).cast("long")


def scaled(counts: np.ndarray, mass: int, added: int) -> np.ndarray:
    """probability() of count + added for an array of counts."""
    return np.array([1 + 10**9 * (int(c) + added) // mass for c in counts], np.int64)


class Audit:
    """The stored tables of one audit: groups with their masses, and postings of kept terms with p and q."""

    def __init__(self, docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", min_docs: int = MIN_DOCS, added: int = ADDED, light: int = LIGHT):
        self.light, self.added = light, added
        counts = stored(term_counts(docs, lang_col, source_col, text_col), "term-counts")
        terms = counts.filter("term is not null").groupBy("lang", "term").agg(F.sum("df").alias("df"), F.sum("n").alias("n_lang"), F.count("*").alias("n_groups"))
        kept = stored(terms.filter(F.col("df") >= min_docs).drop("df"), "kept-terms")
        postings = stored(counts.filter("term is not null").drop("df").join(kept, ["lang", "term"]), "postings")
        langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("n_lang").alias("mass_lang"), F.sum((F.col("n_groups") > light).cast("long")).alias("v_heavy"))
        sums = postings.groupBy("lang", "source").agg(F.sum("n").alias("mass"), F.count("*").alias("rows"))
        groups = counts.filter("term is null").select("lang", "source").join(langs, "lang", "left").join(sums, ["lang", "source"], "left").na.fill(0)
        number = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
        whole = {c: F.col(c) + added * F.col("v") for c in ("mass", "mass_lang")}
        floor = F.when(F.col("v") > 0, probability(F.lit(added).cast("long"), F.greatest(F.col("mass"), F.lit(1)))).otherwise(0)
        self.groups = stored(groups.withColumns({"gid": number, "sources": F.count("*").over(Window.partitionBy("lang"))}).withColumns(whole).withColumn("p0", floor), "groups")
        placed = hot_join(postings, self.groups.select("lang", "source", "gid", "mass", "mass_lang", "p0", "v_heavy", "sources", "rows"), ["lang", "source"], "rows")
        p, q = (probability(F.col(n) + added, F.col(m)) for n, m in (("n", "mass"), ("n_lang", "mass_lang")))
        self.postings = stored(placed.select("lang", "source", "gid", "term", "n", "n_groups", p.alias("p"), q.alias("q"), "p0", "v_heavy", "sources"), "placed")

    def heavy_sums(self, tile_terms: int = TILE_TERMS, tile_groups: int = TILE_GROUPS) -> DataFrame:
        """lang, g, h, value (g < h): what heavy terms add to the distance of the floors, from dense tiles."""
        tiles, last, block = (F.ceil(F.col("v_heavy") / tile_terms), F.floor((F.col("sources") - 1) / tile_groups), F.floor(F.col("gid") / tile_groups))
        # every tile holds the floors of its groups (a null term), and the entries of its terms
        floors = self.groups.filter("v_heavy > 0").repartition("lang", "gid").select("lang", "gid", F.explode(F.sequence(F.lit(0).cast("long"), tiles - 1)).alias("tile"), F.lit(None).cast("string").alias("term"), F.col("p0").alias("p"), last.alias("last"))
        entries = self.postings.filter(F.col("n_groups") > self.light).select("lang", "gid", F.pmod(F.xxhash64("term"), tiles).alias("tile"), "term", "p", last.alias("last"))
        sides = F.transform(F.sequence(F.lit(0).cast("long"), F.col("last")), lambda o: F.struct(F.least(o, block).alias("a"), F.greatest(o, block).alias("b")))
        placed = floors.unionByName(entries).withColumn("side", F.explode(sides)).select("lang", "tile", "side.a", "side.b", "gid", "term", "p")
        return placed.groupBy("lang", "tile", "a", "b").applyInArrow(tile_sums(tile_groups), PAIRS)

    def light_floors(self) -> DataFrame:
        """All terms as if no group had any, and light terms as if none were in both groups: each group's counts against every other group's floor."""
        light, added = self.light, self.added
        own = self.postings.filter(F.col("n_groups") <= light).groupBy("lang", "gid", "n").agg(F.count("*").alias("times"))
        own = own.groupBy("lang", "gid").agg(F.collect_list(F.struct("n", "times")).alias("counts"))
        floors = self.groups.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("gid", "p0"))).alias("floors"))
        each = self.groups.select("lang", "gid", "mass", "v", "p0").join(own, ["lang", "gid"], "left").join(floors, "lang")

        def run(batches):
            for batch in batches:
                for row in batch.to_pylist():
                    h = np.array([f["gid"] for f in row["floors"]], np.int64)
                    other = np.array([f["p0"] for f in row["floors"]], np.int64)
                    counts = row["counts"] or []
                    p = scaled([c["n"] for c in counts], row["mass"], added)
                    times = np.array([c["times"] for c in counts], np.int64)
                    apart = np.abs(row["p0"] - other)
                    order = np.argsort(p)
                    p, times = p[order], times[order]
                    # the sum of |p - floor| over sorted p, from running sums
                    number, total = np.concatenate(([0], np.cumsum(times))), np.concatenate(([0], np.cumsum(p * times)))
                    at = np.searchsorted(p, other)
                    value = other * number[at] - total[at] + (total[-1] - total[at]) - other * (number[-1] - number[at]) - apart * number[-1]
                    value += np.where(h > row["gid"], row["v"] * apart, 0)
                    away = h != row["gid"]
                    g, h = np.minimum(h, row["gid"])[away], np.maximum(h, row["gid"])[away]
                    yield pa.RecordBatch.from_arrays([pa.array([row["lang"]] * len(g), pa.string()), pa.array(g), pa.array(h), pa.array(value[away])], names=["lang", "g", "h", "value"])

        return each.mapInArrow(run, PAIRS)

    def light_corrections(self) -> DataFrame:
        """What terms in both groups of a pair change, from posting lists of at most `light` entries; summed in each batch."""
        shared = self.postings.filter((F.col("n_groups") <= self.light) & (F.col("n_groups") > 1))
        lists = shared.groupBy("lang", "term").agg(F.collect_list(F.struct("gid", "p", "p0")).alias("entries")).select("lang", "entries")

        def run(batches):
            for batch in batches:
                column = batch.column(1)
                sizes = np.asarray(pc.list_value_length(column), np.int64)
                gid, p, p0 = (np.asarray(column.flatten().field(i), np.int64) for i in range(3))
                start = np.cumsum(sizes) - sizes
                parts = []
                for size in np.unique(sizes):
                    rows = np.flatnonzero(sizes == size)
                    for i in range(size):
                        for j in range(i + 1, size):
                            a, b = start[rows] + i, start[rows] + j
                            value = np.abs(p[a] - p[b]) - np.abs(p[a] - p0[b]) - np.abs(p[b] - p0[a]) + np.abs(p0[a] - p0[b])
                            parts.append((rows, np.minimum(gid[a], gid[b]), np.maximum(gid[a], gid[b]), value))
                if parts:
                    rows, g, h, value = map(np.concatenate, zip(*parts))
                    table = pa.table({"lang": batch.column(0).take(pa.array(rows)), "g": g, "h": h, "value": value})
                    yield from table.group_by(["lang", "g", "h"]).aggregate([("value", "sum")]).rename_columns(["lang", "g", "h", "value"]).to_batches()

        return lists.mapInArrow(run, PAIRS)

    def pairs(self) -> DataFrame:
        """lang, g, h, value: the distance of every two groups of a language, by their numbers."""
        parts = self.light_floors().unionByName(self.light_corrections()).unionByName(self.heavy_sums())
        return parts.groupBy("lang", "g", "h").agg(F.sum("value").alias("value"))

    def distances(self) -> DataFrame:
        """lang, source, item (the other source), value: each pair both ways."""
        ends = F.explode(F.array(F.struct(F.col("g").alias("own"), F.col("h").alias("other")), F.struct(F.col("h").alias("own"), F.col("g").alias("other"))))
        both = self.pairs().withColumn("e", ends)
        name = lambda at, to: self.groups.select(F.col("lang"), F.col("gid").alias(at), F.col("source").alias(to))
        return both.select("lang", "e.own", "e.other", "value").join(name("own", "source"), ["lang", "own"]).join(name("other", "item"), ["lang", "other"]).select("lang", "source", "item", "value")

    def standing_out(self) -> DataFrame:
        """lang, source, item (a term that the group uses more than its language), value."""
        more = self.postings.filter(F.col("p") > F.col("q"))
        return more.select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))

    def report(self, top: int = TOP) -> DataFrame:
        """Distances with all ranks, terms up to rank `top`."""
        rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
        pairs = self.distances().withColumn("part", F.lit("pair")).withColumn("rank", rank)
        terms = self.standing_out().withColumn("part", F.lit("term")).withColumn("rank", rank).filter(F.col("rank") <= top)
        return pairs.unionByName(terms).select("lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank"))


PAIRS = "lang string, g long, h long, value long"


def tile_sums(tile_groups: int):
    """For applyInArrow: by how much one tile's terms bring the groups of block a and those of block b further apart than their floors."""

    def run(key, table):
        lang, _, a, b = (k.as_py() for k in key)
        missing = np.asarray(pc.is_null(table["term"]))
        all_gids, all_p = np.asarray(table["gid"]), np.asarray(table["p"])
        order = np.argsort(all_gids[missing])
        gids, floors = all_gids[missing][order], all_p[missing][order]
        terms = pc.drop_null(table["term"]).combine_chunks().dictionary_encode()
        dense = np.repeat(floors[:, None], len(terms.dictionary), axis=1)
        dense[np.searchsorted(gids, all_gids[~missing]), np.asarray(terms.indices)] = all_p[~missing]
        # within a block each pair once; between two blocks every group with every other
        split = int(np.searchsorted(gids, (a + 1) * tile_groups))
        starts = range(len(gids)) if a == b else range(split)
        g, h, value = [], [], []
        for i in starts:
            first = i + 1 if a == b else split
            g.append(np.full(len(gids) - first, gids[i]))
            h.append(gids[first:])
            value.append(np.abs(dense[first:] - dense[i]).sum(axis=1) - len(terms.dictionary) * np.abs(floors[first:] - floors[i]))
        g, h, value = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (g, h, value))
        return pa.table({"lang": pa.array([lang] * len(g), pa.string()), "g": g, "h": h, "value": value})

    return run


def audit(docs: DataFrame, **options) -> DataFrame:
    """lang, source, part, item, value, rank."""
    top = options.pop("top", TOP)
    return Audit(docs, **options).report(top)
