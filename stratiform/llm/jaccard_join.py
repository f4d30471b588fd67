"""N-gram Jaccard join with a token-group matrix.

A document's set is its distinct word shingles. Documents of equal sets are one class and
one document stands for it. Similar classes are put into one group; the matrix holds, for each token, the groups whose
token union has it, with the range of set sizes there. A query class and a group that
could hold a partner must meet in the matrix, at a size that allows the
threshold; only such groups are opened, and only pairs from different groups are compared.

The matrix holds of each set the tokens that a partner can't avoid. Tokens are ordered: those that are
frequent in a bounded sample last, and otherwise by hash. Of n tokens a partner lacks
at most n - ceil(t*n), so the first n - ceil(t*n) + k surely hold k shared ones; and since the order is
random, the first 64 hold k shared ones but for a chance of 2**-64 a pair, as rare as two shingles
with one 64-bit hash. The shorter prefix is taken, or with `exact` always the one that is sure. Of a pair whose first shared token stands at some places
of the two sets, at most what follows in either can be shared: classes that don't meet k tokens of
others, and pairs that can't reach the threshold by this bound, are left out.
The sample only decides the order: any order gives the same links.

Groups form in rounds: in every token's list, each class is compared with one leader of
another group; classes that link are merged. Lists of copies thus shrink to one group without
pairs among the copies, and what is left in several groups is opened at the end.

Defined results: a null or empty text, or one of white space, has an empty set and links with
nothing; fewer words than a shingle make one token; rows that repeat an id are each returned,
and linked as documents of that id; a row with a null id links with nothing and has
no component; an empty table gives no rows.
"""

from __future__ import annotations

import math
from functools import cache, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textkit as tk
from .components import components
from .repeats import packed_texts, shared_only, unpacked_slices
from .shared import columns, hot_join, stored

WORDS, PERCENT = 5, 75
#: Documents of the sample that frequent tokens are read off, the documents there that make a token
#: frequent, and the most such tokens that are broadcast (they only set the order).
SAMPLE_DOCS, SAMPLE_DF, FREQUENT = 4000, 4, 200_000
ROUNDS, LEADERS = 2, 2
#: Leading tokens of a large set, the chance of losing a link as a power of two, and the shared tokens asked of a small set.
PREFIX, CHANCE_BITS, NEED = 64, 64, 8
#: Members of an opened group that are met together.
BLOCK = 256


def shingles(column: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray, dict[int, bytes]]:
    """Distinct shingle hashes of each text in ascending order, their bounds, and the words of the texts that have fewer than a shingle."""
    data, offsets = tk.buffer_of(column)
    data = tk.lowered(data)
    starts, ends, doc = tk.word_spans(data, offsets)
    word = tk.word_symbols(data, starts, ends)
    grams = tk.window_hashes(word, words)[0]
    whole = doc[: len(grams)] == doc[words - 1 :][: len(grams)]
    grams, owner = grams[whole], doc[: len(grams)][whole]
    counts = np.bincount(doc, minlength=len(offsets) - 1)
    first = np.cumsum(counts) - counts
    short = {}
    for i in np.flatnonzero((counts > 0) & (counts < words)).tolist():
        own = slice(first[i], first[i] + counts[i])
        short[i] = b" ".join(data[a:b].tobytes() for a, b in zip(starts[own].tolist(), ends[own].tolist()))
    if short:
        grams = np.concatenate([grams, np.fromiter(map(xxhash.xxh3_64_intdigest, short.values()), np.uint64, len(short))])
        owner = np.concatenate([owner, list(short)])
    order = np.lexsort((grams, owner))
    grams, owner = grams[order], owner[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
    grams, owner = grams[new], owner[new]
    return grams, np.searchsorted(owner, np.arange(len(offsets))), short


def prefix_length(n: int, rare: int, percent: int = PERCENT, exact: bool = False) -> tuple[int, int]:
    """Leading tokens of a set of n, `rare` of them ordered before all frequent ones, and how many of them any partner shares.

    A partner lacks at most n - ceil(t*n) tokens, so n - ceil(t*n) + k leading tokens hold k shared
    ones. Of PREFIX rare tokens in random order, fewer than k are shared with a chance below
    2**-CHANCE_BITS, for k from the binomial tail. Of two prefixes that hold k and l shared tokens, both hold the first min(k, l).
    """
    lacking = n - -(-n * percent // 100)
    need = max(1, min(NEED, n - lacking))
    if exact or lacking + need <= PREFIX or rare < PREFIX:
        return lacking + need, need
    shared = _shared_of(round(lacking / rare, 3) + 0.001)
    return (PREFIX, shared) if shared else (lacking + need, need)


@cache
def _shared_of(miss: float) -> int:
    """Largest k with P(Binomial(PREFIX, 1 - miss) < k) <= 2**-CHANCE_BITS; 0 if there is none."""
    if not 0 < miss < 1:
        return 0
    tail, k = 0.0, 0
    while k < PREFIX:
        tail += math.comb(PREFIX, k) * (1 - miss) ** k * miss ** (PREFIX - k)
        if tail > 2.0**-CHANCE_BITS:
            return k
        k += 1
    return k


def frequent_tokens(docs: DataFrame, words: int, sample_docs: int, sample_df: int, most: int) -> np.ndarray:
    """Tokens of several documents of a bounded sample."""
    share = min(1.0, sample_docs / max(1, docs.count()))

    def run(batches):
        for batch in tk.slices(batches, text=0):
            grams, _, _ = shingles(batch.column(0), words)
            yield pa.RecordBatch.from_arrays([pa.array(tk.signed(grams))], names=["token"])

    picked = docs.select("text", "doc_id").filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
    counts = picked.select("text").mapInArrow(run, "token long").groupBy("token").count().filter(F.col("count") >= sample_df)
    rows = counts.orderBy(F.desc("count"), "token").limit(most).collect()
    return np.sort(np.array([r.token for r in rows], np.int64).view(np.uint64))


SETS = "doc_id long, n_shingles long, hi long, lo long, need int, prefix array<long>"


def signatures(docs: DataFrame, frequent, words: int, percent: int, exact: bool = False) -> DataFrame:
    """Size, 128-bit set hash and leading tokens of each document. `frequent` is a broadcast of sorted tokens."""

    def run(batches):
        common = frequent.value
        for batch in tk.slices(batches):
            grams, bounds, short = shingles(batch.column(1), words)
            is_common = np.zeros(len(grams), bool)
            if len(common):
                is_common = common[np.minimum(np.searchsorted(common, grams), len(common) - 1)] == grams
            n = np.diff(bounds)
            keys = [tk.signed(np.add.reduceat(np.append(tk.mix(grams ^ np.uint64(salt)), np.uint64(0)), bounds[:-1])) * (n > 0) for salt in (0x1234567, 0x89ABCDEF01)]
            # the only shingle of a short text has 64 bits: the text itself gives the key
            for i, text in short.items():
                digest = xxhash.xxh3_128_digest(text)
                keys[0][i], keys[1][i] = (int.from_bytes(x, "big", signed=True) for x in (digest[:8], digest[8:]))
            prefixes, needs = [], []
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                own, late = grams[a:b], is_common[a:b]
                size, need = prefix_length(b - a, b - a - int(late.sum()), percent, exact) if b > a else (0, 0)
                needs.append(need)
                early = own[~late][:size]
                prefixes.append(np.concatenate((early, own[late][: size - len(early)])))
            cuts = np.concatenate(([0], np.cumsum([len(p) for p in prefixes]))).astype(np.int32)
            tokens = tk.signed(np.concatenate(prefixes)) if prefixes else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(keys[0]), pa.array(keys[1]), pa.array(needs, pa.int32()), pa.ListArray.from_arrays(pa.array(cuts), pa.array(tokens))], names=["doc_id", "n_shingles", "hi", "lo", "need", "prefix"])

    return docs.mapInArrow(run, SETS)


def _sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """doc_id and the whole set, packed, of the wanted documents."""

    def run(batches):
        for batch, raw in unpacked_slices(batches):
            grams, bounds, _ = shingles(pa.array(raw, pa.large_binary()), words)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([grams[a:b].tobytes() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())], pa.binary())], names=["doc_id", "tokens"])

    # merged, not broadcast, however small: two Python operators in a stage take two workers for each task
    return packed_texts(docs).join(wanted.hint("merge"), "doc_id", "left_semi").mapInArrow(run, "doc_id long, tokens binary").dropDuplicates(["doc_id"])


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs a, b whose sets reach the threshold."""

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                n, m = len(x) // 8, len(y) // 8
                both = np.concatenate((np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)))
                both.sort()
                shared = int((both[1:] == both[:-1]).sum())
                keep.append(100 * shared >= percent * (n + m - shared))
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = sets.select(F.col("doc_id").alias("a"), F.col("tokens").alias("x"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("tokens").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _may_link(most: str, percent: int):
    """Whether sets of n and n2 tokens can reach the threshold when they share at most `most` and `most`2."""
    return _reaches(F.least(F.col(most), F.col(f"{most}2")), percent)


def _reaches(shared, percent: int):
    return 100 * shared >= percent * (F.col("n") + F.col("n2") - shared)


class JaccardJoin:
    """The stages of the join over one table; `memberships()` is the result."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT, exact: bool = False):
        self.docs, self.words, self.percent = columns(docs, id_col, text_col), words, percent
        frequent = frequent_tokens(self.docs, words, SAMPLE_DOCS, SAMPLE_DF, FREQUENT)
        self.signatures = stored(signatures(self.docs, docs.sparkSession.sparkContext.broadcast(frequent), words, percent, exact), "sets")
        self.rows = self.signatures.filter("n_shingles > 0 and doc_id is not null")
        self.classes = stored(self.rows.groupBy("hi", "lo").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "classes")
        self.tokens = stored(self._shared_tokens(), "tokens")
        self.sets = stored(_sets(self.docs, self.tokens.select(F.col("rep").alias("doc_id")).distinct(), words), "token-sets")

    def _shared_tokens(self) -> DataFrame:
        """token, pos, rep, n, need, copies: leading tokens that two or more classes have, of classes that can have a partner."""
        # a set of one or two links with equal sets alone
        reps = self.signatures.filter("n_shingles > 2").alias("s").join(self.classes.alias("c"), (F.col("s.doc_id") == F.col("c.rep")) & (F.col("s.hi") == F.col("c.hi")) & (F.col("s.lo") == F.col("c.lo")))
        reps = reps.select(F.col("c.rep").alias("rep"), F.col("s.n_shingles").alias("n"), "s.need", "c.copies", "s.prefix").dropDuplicates(["rep"])
        rows = reps.select(F.posexplode("prefix").alias("pos", "token"), "rep", "n", "need", "copies").select("token", "pos", "rep", "n", "need", "copies")
        rows = stored(shared_only(rows, "token"), "tokens")
        for _ in range(2):
            able = rows.groupBy("rep").agg(F.count("*").alias("met"), F.first("need").alias("asked")).filter("met >= asked").select("rep")
            rows = stored(shared_only(rows.join(able, "rep", "left_semi").select(*rows.columns), "token"), "tokens")
        return rows

    def _grouped(self, edges: list[DataFrame]) -> DataFrame:
        """Shared tokens with the group of each class, the smallest class that its links reach."""
        # first: what a class can share with another if this token is the first that they share
        tokens = self.tokens.withColumn("first", F.col("n") - F.col("pos")).withColumn("all", F.col("n"))
        if not edges:
            return tokens.withColumn("grp", F.col("rep"))
        groups = components(reduce(DataFrame.unionByName, edges)).select(F.col("node").alias("rep"), F.col("component").alias("grp"))
        return tokens.join(groups, "rep", "left").withColumn("grp", F.coalesce("grp", "rep"))

    def _leader_pairs(self, grouped: DataFrame, number: int) -> DataFrame:
        """Each class with the leaders, of other groups, that most of its token lists have."""
        who = F.struct("rep", "n", "first", "grp")
        lead = F.min_by(who, F.struct((-F.col("copies")).alias("copies"), "rep")) if number == 0 else F.min_by(who, F.xxhash64(F.lit(number), "rep"))
        leaders = grouped.groupBy("token").agg(lead.alias("lead"), F.count("*").alias("members"), F.min("grp").alias("low"), F.max("grp").alias("high")).filter("low != high").select("token", "members", F.col("lead.rep").alias("b"), F.col("lead.n").alias("n2"), F.col("lead.first").alias("first2"), F.col("lead.grp").alias("lead_grp"))
        met = hot_join(grouped, leaders, ["token"], "members").filter((F.col("grp") != F.col("lead_grp")) & _may_link("first", self.percent))
        votes = met.groupBy(F.col("rep").alias("a"), "b").agg(F.count("*").alias("votes"))
        best = Window.partitionBy("a").orderBy(F.desc("votes"), "b")
        return votes.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= LEADERS).select("a", "b")

    def matrix(self, grouped: DataFrame) -> DataFrame:
        """The token-group matrix: token, grp, and of its members with the token the least size and need, the most they can share and their number; only tokens of two or more groups."""
        cells = grouped.groupBy("token", "grp").agg(F.min("n").alias("n2"), F.max("all").alias("all2"), F.max("first").alias("first2"), F.min("need").alias("need2"), F.count("*").alias("held"))
        several = cells.groupBy("token").agg(F.count("*").alias("groups")).filter("groups > 1").select("token")
        return cells.join(several, "token")

    def _opened_pairs(self, grouped: DataFrame) -> DataFrame:
        """Class pairs of different groups that the matrix can't rule out. The smaller group asks, the larger one is opened.

        A class asks a group only if enough of its tokens lie in the group's union at sizes that could
        link, and in an opened group only members whose first shared token allows the threshold. Members of a group of near
        copies have most tokens of the class in common. Where they would be met at more tokens than there are members, each is met once instead,
        with its tokens as an array.
        """
        sizes = stored(grouped.groupBy("grp", "rep").agg(F.count("*").alias("cells")).groupBy("grp").agg(F.count("*").alias("size"), F.sum("cells").alias("cells")), "group-sizes")
        other = self.matrix(grouped).join(sizes.drop("cells"), "grp").withColumnRenamed("grp", "target").withColumnRenamed("size", "size2")
        asking = hot_join(grouped, sizes, ["grp"], "cells").select("token", "rep", "n", "all", "first", "need", "grp", "size").join(other, "token")
        asks = (F.col("size") < F.col("size2")) | ((F.col("size") == F.col("size2")) & (F.col("grp") < F.col("target")))
        # the k-th token that a linking pair shares has at least as many tokens after it, itself counted, as the pair must share, less k - 1
        counted = _reaches(F.least(F.least("first", "first2") + F.col("need") - 1, "all", "all2"), self.percent)
        asking = asking.filter((F.col("grp") != F.col("target")) & asks & counted).withColumn("opens", _may_link("first", self.percent))
        by_tokens = F.sum(F.when(F.col("opens"), F.col("held")))
        overlap = asking.groupBy("rep", "target").agg(F.count("*").alias("shared"), F.min(F.least("need", "need2")).alias("asked"), F.max("opens").alias("opens"), (by_tokens > F.first("size2")).alias("whole"), F.first("size2").alias("size2"))
        qualifying = stored(overlap.filter(F.col("opens") & (F.col("shared") >= F.col("asked"))).select("rep", "target", "whole", "size2"), "qualifying")
        queries = asking.filter("opens").select("rep", "n", "first", "target", "token").join(qualifying.filter("not whole").select("rep", "target"), ["rep", "target"], "left_semi")
        members = grouped.select("token", F.col("grp").alias("target"), F.col("rep").alias("b"), F.col("n").alias("n2"), F.col("first").alias("first2"))
        few = queries.join(members, ["token", "target"]).filter(_may_link("first", self.percent)).select(F.col("rep").alias("a"), "b").distinct()
        return few.unionByName(self._met_once(grouped, qualifying.filter("whole")))

    def _met_once(self, grouped: DataFrame, asked: DataFrame) -> DataFrame:
        """Pairs a, b of classes (rep) and members of groups (target, of size2 members): those that share as many leading tokens as a linking pair does, the first of them at places that allow the threshold.

        The members of a group are dealt to blocks of about BLOCK, so that a large one is no single key.
        """
        # tokens in the order of their places, each with what can be shared from there on; n is the same for all of a class
        tokens = F.array_sort(F.collect_list(F.struct(F.col("pos"), F.col("token"), F.col("first"))))
        blocks = F.ceil(F.col("size2") / BLOCK).cast("int")
        targets = asked.groupBy("target").agg(F.max(blocks).alias("blocks"))
        askers = asked.select("rep").distinct()
        member = grouped.join(targets, grouped["grp"] == targets["target"], "left_semi").groupBy("grp", "rep").agg(tokens.alias("own"), F.first("n").alias("n2"), F.first("need").alias("need2"))
        member = member.join(targets, F.col("grp") == F.col("target")).select("target", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int").alias("block"), F.col("rep").alias("b"), "n2", "need2", F.col("own.token").alias("tokens2"), F.col("own.first").alias("first2"))
        asker = grouped.join(askers, "rep", "left_semi").groupBy("rep").agg(tokens.alias("own"), F.first("n").alias("n"), F.first("need").alias("need")).select("rep", "n", "need", F.col("own.token").alias("tokens"), F.col("own.first").alias("first"))
        asker = asked.withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1))).select("rep", "target", "block").join(asker, "rep")
        met = asker.join(member, ["target", "block"])
        at = lambda name: F.get(F.col(f"first{name}"), (F.array_position(f"tokens{name}", F.get("common", F.lit(0))) - 1).cast("int"))
        met = met.withColumn("common", F.array_intersect("tokens", "tokens2")).filter(F.size("common") >= F.least("need", "need2"))
        return met.filter(_reaches(F.least(at(""), at("2")), self.percent)).select(F.col("rep").alias("a"), "b")

    def links(self) -> DataFrame:
        """Links between classes that give the same components as all links do."""
        edges: list[DataFrame] = []
        for number in range(ROUNDS):
            pairs = self._leader_pairs(self._grouped(edges), number)
            edges.append(stored(_linked(pairs, self.sets, self.percent), "links"))
        edges.append(stored(_linked(self._opened_pairs(self._grouped(edges)), self.sets, self.percent), "links"))
        return reduce(DataFrame.unionByName, edges)

    def memberships(self) -> DataFrame:
        """doc_id, n_shingles, component_id for every row."""
        found = components(self.links())
        reps = stored(self.classes.join(found, F.col("rep") == F.col("node"), "left").select("hi", "lo", "copies", F.coalesce("component", "rep").alias("component")), "class-components")
        linked = hot_join(self.rows.select("doc_id", "n_shingles", "hi", "lo"), reps, ["hi", "lo"], "copies").select("doc_id", "n_shingles", F.col("component").alias("component_id"))
        alone = self.signatures.filter("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
        return linked.unionByName(alone)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT, exact: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id; `exact` leaves no link to chance, for twice the tokens in the matrix."""
    return JaccardJoin(docs, id_col, text_col, words, percent, exact).memberships()


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of the document with the smallest id in each component; rows with a null id stay."""
    found = near_duplicates(docs, id_col, text_col, **options).filter("component_id < doc_id").select(F.col("doc_id").alias("__jj_id")).distinct()
    return docs.join(found, F.col(f"`{id_col}`") == F.col("__jj_id"), "left_anti")
