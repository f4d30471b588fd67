"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Words are runs of letters, digits and non-ASCII bytes, in ASCII lower case. The
n-grams of a test item are its seeds. A first pass over the corpus counts the documents that hold each seed. From the score asked
for follows how many of an item's seeds an alignment shares at least (see `bounds`): `need` of m. So it surely
shares `hits` of the m - need + hits rarest, about half of `need`; the more frequent ones never join. A second
pass joins by these rare seeds, and a document meets an item only where `hits` places of rare seeds lie within the span of an alignment,
which leaves next to none of the pairs that share a common phrase or two. Of each document and item that meet it cuts out the words around clusters of `need` seeds,
rare or not, and aligns each such passage locally with the item. No alignment that
reaches the score is lost, whatever the copies of an item do to its seeds' frequencies. The score is the share of the best possible, 1 for a
verbatim copy, so edited copies score high and shared phrases do not.

Test items are broadcast in parts of at most `part_bytes`, however many there are; each part costs two passes, after which it is given up.

Defined results: null or empty texts and items match nothing; repeated items (same id) keep the best score; repeated documents
are scored once for each id; null ids never match; empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .shared import columns, stored

#: Longest seed; shorter ones are taken where the score asked for allows more edits.
SEED_WORDS, MIN_SCORE = 5, 0.6
PART_BYTES = 16 << 20
MATCH, MISMATCH, GAP = 2, -1, -1


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes and the text number of each."""
    data = tk.lowered(data)
    starts, ends, doc = tk.word_spans(data, offsets, tk.NOT_ALNUM)
    return tk.word_symbols(data, starts, ends), doc


def bounds(n: int, min_score: float, seed_words: int) -> tuple[int, int, int, int]:
    """Seed length, least shared seeds, least shared words and greatest span in a document of an alignment that reaches `min_score` with an item of n words.

    Of the best score 2n, 2n(1 - min_score) may be lost. A word put in costs 1 and breaks k - 1
    seeds of k words; one changed or left out costs 3 and breaks k; one cut off at an end costs 2 and
    breaks 1. So a unit lost breaks at most k - 1 seeds (half a seed for k = 1), and half a word.
    """
    lost = int(MATCH * n * (1 - min_score) + 1e-9)
    need_words = max(1, n - lost // 2)
    for k in range(min(n, seed_words), 1, -1):
        need = n - k + 1 - (k - 1) * lost
        if need >= 1:
            return k, need, need_words, n + lost
    return 1, need_words, need_words, n + lost


class Items:
    """A part of the test items: their words, the seeds of each, and an index of seeds in hash order for each seed length."""

    def __init__(self, ids: list[int], texts: list[str], n: int, min_score: float):
        self.ids = np.array(ids, np.int64)
        words, doc = _words(*tk.buffer_of(pa.array(texts, pa.large_string())))
        cuts = np.searchsorted(doc, np.arange(len(ids) + 1))
        self.words = [words[a:b] for a, b in zip(cuts[:-1], cuts[1:])]
        limits = np.zeros((len(ids), 4), np.int64)
        self.own, self.places = [], []  # of each item: its seeds, and at how many places each stands
        for i, w in enumerate(self.words):
            limits[i] = bounds(len(w), min_score, n) if len(w) else 0
            seeds, places = np.unique(tk.window_hashes(w, int(limits[i, 0]))[0], return_counts=True) if len(w) else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            self.own.append(seeds)
            self.places.append(places)
        self.size, self.need, self.need_words, self.span = limits.T
        self.hits = np.minimum(self.need, 1)
        self.index(self.own)

    def index(self, seeds_of: list[np.ndarray]) -> None:
        """Let the given seeds of each item join documents to it."""
        self.seeds: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for size in np.unique(self.size[self.size > 0]).tolist():
            items = np.flatnonzero(self.size == size)
            hashes, owner = np.concatenate([seeds_of[i] for i in items]), np.repeat(items, [len(seeds_of[i]) for i in items])
            order = np.argsort(hashes, kind="stable")
            self.seeds[size] = hashes[order], owner[order]

    def some(self) -> np.ndarray:
        """How many rare seeds of each item a document is asked for: about half of what an alignment shares."""
        return np.maximum(np.minimum(self.need, 2), (self.need + 1) // 2)

    def keep_rare(self, frequency: dict[int, int], hits: np.ndarray | None = None) -> None:
        """Ask for `hits` (one) rare seeds of each item and leave out its most frequent ones, at need - hits places at most; seeds that no document holds are of no use either."""
        rare = []
        self.hits = self.hits if hits is None else hits
        for own, places, spare in zip(self.own, self.places, (self.need - self.hits).tolist()):
            df = np.array([frequency.get(x, 0) for x in tk.signed(own).tolist()], np.int64)
            order = np.lexsort((own, -df))
            joins = (np.cumsum(places[order]) > spare) & (df[order] > 0)
            rare.append(own[order][joins])
        self.index(rare)


def align(item: np.ndarray, passage: np.ndarray) -> float:
    """Smith-Waterman score of the best local alignment, as a share of the item's own."""
    if not len(item) or not len(passage):
        return 0.0
    at = np.arange(len(passage)) * -GAP
    row, best = np.zeros(len(passage) + 1, np.int64), 0
    for word in item:
        here = np.maximum(row[:-1] + np.where(passage == word, MATCH, MISMATCH), row[1:] + GAP)
        here = np.maximum(here, 0)
        row = np.concatenate(([0], np.maximum.accumulate(here + at) - at))
        best = max(best, int(row.max()))
    return best / (MATCH * len(item))


def shared_words(item: np.ndarray, passage: np.ndarray, span: int) -> int:
    """The most words of the item that stand in any `span` words of the passage."""
    held = np.concatenate(([0], np.cumsum(np.isin(passage, item))))
    return int((held[span:] - held[:-span]).max()) if len(passage) > span else int(held[-1])


def _seed_hits(words: np.ndarray, doc: np.ndarray, items: Items):
    """For each seed length: the hashes of all runs of so many words, whether each lies in one text, and the place and first index entry of those that are seeds."""
    for size, (seeds, _) in items.seeds.items():
        grams = tk.window_hashes(words, size)[0]
        inside = doc[: len(grams)] == doc[size - 1 :][: len(grams)]
        low = np.searchsorted(seeds, grams)
        at = np.flatnonzero(inside & (seeds[np.minimum(low, len(seeds) - 1)] == grams)) if len(seeds) else np.zeros(0, np.int64)
        yield size, grams, at, low[at]


def seed_frequencies(docs: DataFrame, items) -> DataFrame:
    """seed, df: rows of documents that hold each seed. `items` is a broadcast."""

    def run(batches):
        part = items.value
        for batch in tk.slices(batches):
            words, doc = _words(*tk.buffer_of(batch.column(1)))
            for _, grams, at, _ in _seed_hits(words, doc, part):
                if len(at):
                    order = np.lexsort((doc[at], grams[at]))
                    seed, holder = grams[at][order], doc[at][order]
                    new = np.concatenate(([True], (seed[1:] != seed[:-1]) | (holder[1:] != holder[:-1])))
                    seed, n = np.unique(seed[new], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(tk.signed(seed)), pa.array(n.astype(np.int64))], names=["seed", "n"])

    return docs.filter("doc_id is not null").mapInArrow(run, "seed long, n long").groupBy("seed").agg(F.sum("n").alias("df"))


def clusters(at: np.ndarray, need: int, size: int, span: int) -> list[tuple[int, int]]:
    """First and last place of each cluster of seed hits: `need` of them within the span of an alignment, joined while no gap is longer than a span."""
    if len(at) < need:
        return []
    dense = np.flatnonzero(at[need - 1 :] - at[: len(at) - need + 1] <= span - size)
    change = np.zeros(len(at) + 1, np.int64)
    np.add.at(change, dense, 1)
    np.add.at(change, dense + need, -1)
    at = at[np.cumsum(change[:-1]) > 0]
    if not len(at):
        return []
    gaps = np.flatnonzero(np.diff(at) > span)
    return list(zip(at[np.concatenate(([0], gaps + 1))].tolist(), at[np.concatenate((gaps, [len(at) - 1]))].tolist()))


def meetings(doc: np.ndarray, at: np.ndarray, low: np.ndarray, size: int, items: Items) -> np.ndarray:
    """Text numbers and items (two rows) that share enough rare seeds within the span of an alignment; `at` and `low` are the seed hits of one length."""
    seeds, owner = items.seeds[size]
    many = np.searchsorted(seeds, seeds[low], side="right") - low
    place = np.repeat(at, many)
    item = owner[np.repeat(low + many - np.cumsum(many), many) + np.arange(many.sum())]
    order = np.lexsort((place, item, doc[place]))
    place, item = place[order], item[order]
    text = doc[place]
    first = np.arange(len(place))
    last = np.minimum(first + items.hits[item] - 1, len(place) - 1)
    enough = (last - first == items.hits[item] - 1) & (text[last] == text) & (item[last] == item) & (place[last] - place <= items.span[item] - size)
    return np.unique(np.stack((text[enough], item[enough])), axis=1)


PASSAGES = "doc_id long, item int, words binary"


def passages(docs: DataFrame, items) -> DataFrame:
    """A row for each cluster of seed hits of one item in one document that may hold a copy, with the words around it. `items` is a broadcast whose index holds rare seeds."""

    def run(batches):
        part = items.value
        for batch in tk.slices(batches):
            words, doc = _words(*tk.buffer_of(batch.column(1)))
            bounds_of = np.searchsorted(doc, np.arange(batch.num_rows + 1))
            found = []
            for size, grams, at, low in _seed_hits(words, doc, part):
                for d, i in meetings(doc, at, low, size, part).T.tolist():
                    first, stop, span = int(bounds_of[d]), int(bounds_of[d + 1]), int(part.span[i])
                    own = first + np.flatnonzero(np.isin(grams[first : stop - size + 1], part.own[i]))
                    for a, b in clusters(own, int(part.need[i]), size, span):
                        cut = words[max(a - span, first) : min(b + span + 1, stop)]
                        if shared_words(part.words[i], cut, span) >= part.need_words[i]:
                            found.append((d, i, cut.tobytes()))
            if found:
                d, item, raw = zip(*found)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(d, pa.int64())), pa.array(item, pa.int32()), pa.array(raw, pa.binary())], names=["doc_id", "item", "words"])

    return docs.filter("doc_id is not null").mapInArrow(run, PASSAGES)


def _scores(found: DataFrame, items) -> DataFrame:
    def run(batches):
        part = items.value
        for batch in batches:
            scores = [align(part.words[i], np.frombuffer(w, np.uint64)) for i, w in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            ids = part.ids[np.asarray(batch.column(1))] if batch.num_rows else part.ids[:0]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids), pa.array(scores, pa.float64())], names=["doc_id", "item_id", "score"])

    return found.select("doc_id", "item", "words").mapInArrow(run, "doc_id long, item_id long, score double")


def _parts(benchmark: DataFrame, part_bytes: int):
    """Test items in parts of bounded size, streamed to the driver one partition at a time."""
    ids, texts, size = [], [], 0
    for row in benchmark.toLocalIterator():
        if row.doc_id is None or not row.text:
            continue
        ids.append(row.doc_id)
        texts.append(row.text)
        size += len(row.text)
        if size >= part_bytes:
            yield ids, texts
            ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", seed_words: int = SEED_WORDS, min_score: float = MIN_SCORE, part_bytes: int = PART_BYTES) -> DataFrame:
    """doc_id, item_id, score of every document that holds a copy of an item, verbatim or edited."""
    spark = docs.sparkSession
    narrow = columns(docs, id_col, text_col)
    parts = []
    for ids, texts in _parts(columns(benchmark, item_col, item_text_col), part_bytes):
        part = Items(ids, texts, seed_words, min_score)
        # no more rows than the part has seeds
        items = spark.sparkContext.broadcast(part)
        part.keep_rare({r.seed: r.df for r in seed_frequencies(narrow, items).toLocalIterator()}, part.some())
        items.unpersist()
        items = spark.sparkContext.broadcast(part)
        # a stage of its own for the scores: two Python operators in a stage take two workers for each task
        parts.append(stored(_scores(stored(passages(narrow, items), "passages"), items), "scores"))
        items.unpersist()
    if not parts:
        return spark.createDataFrame([], "doc_id long, item_id long, score double")
    return reduce(DataFrame.unionByName, parts).groupBy("doc_id", "item_id").agg(F.max("score").alias("score")).filter(F.col("score") >= min_score)


def without_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of documents that hold no copy of a test item."""
    bad = contaminated(docs, benchmark, id_col, text_col, **options).select(F.col("doc_id").alias("__dc_id")).distinct()
    return docs.join(bad, F.col(f"`{id_col}`") == F.col("__dc_id"), "left_anti")
