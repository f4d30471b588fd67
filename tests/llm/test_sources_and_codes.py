"""Vector codes, source mixing and divergence audit against brute force and on awkward rows; white space beyond ASCII; terms within matches."""

import math
import random
from collections import Counter, defaultdict

import brute
import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_llm_operators import held

from stratiform.llm import oracles, packing, pii, queries, source_divergence, source_mix, textkit, token_pieces, vector_codes

CODES = ["code", "error", "label_error", "codebooks_sha256"]


def vectors(rows, spark):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)


def test_vector_codes(spark):
    rng = random.Random(5)
    rows = [(i, [float(np.float32(rng.gauss(k % 3, 0.2))) for k in range(32)], rng.choice([0, 0, 0, 1, None])) for i in range(400)]
    rows += [(1000 + i, rows[i % 3][1], 7) for i in range(200)]  # a third are copies
    rows += [(2000, None, 0), (2001, [None] + [0.0] * 31, 0), (2002, [math.nan] * 32, 0), (2003, [math.inf] + [0.0] * 31, None), (2004, [-0.001] * 32, None)]
    held(vector_codes.label_errors(vectors(rows, spark)), brute.vector_codes(rows), CODES, "vec_id")


@pytest.mark.parametrize("size", [3e4, 1e8])
def test_large_components_stay_exact(spark, size):
    """Beyond what doubles, and beyond what longs can hold of the squares; the largest error is told as the largest long."""
    rng = random.Random(6)
    rows = [(i, [float(np.float32(rng.uniform(-size, size))) for _ in range(16)], 0) for i in range(90)]
    bound = vector_codes.BOUND
    clipped = [(i, [max(-bound, min(bound, math.floor(256 * x))) / 256 for x in v], n) for i, v, n in rows]
    want = brute.vector_codes(clipped)
    got = {r.vec_id: r for r in vector_codes.label_errors(vectors(rows, spark)).collect()}
    for i, (code, error, _, digest) in want.items():
        assert (got[i].code, got[i].error, got[i].codebooks_sha256) == (code, min(error, vector_codes.LONG_MAX), digest)


def test_only_changed_parts_contribute(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=16).tolist(), 0) for i in range(300)]
    table = vector_codes.integer_vectors(vectors(rows, spark), "vec_id", "embedding", 256, []).orderBy("vec_id")
    ints = np.array([r.vector for r in table.collect()])
    books = vector_codes.Codebooks.starting(ints[:8], 16)
    first = vector_codes.assigned(table, books, []).cache()
    assert sum(r.n for r in vector_codes.contributions(first, books).collect()) == 300 * 16
    books = books.moved(vector_codes.contributions(first, books).collect())
    second = vector_codes.assigned(first, books, []).cache()
    changed = second.filter("codes <> before").count()
    moves = vector_codes.contributions(second, books).collect()
    assert 0 < changed < 300 and sum(r.n for r in moves) == 0 and sum(abs(r.n) for r in moves) <= 2 * 16 * changed
    # running sums equal sums from scratch
    books = books.moved(moves)
    codes = np.array([list(r.codes) for r in second.orderBy("vec_id").collect()])
    for part in range(16):
        for entry in range(8):
            assert books.counts[part, entry] == (codes[:, part] == entry).sum()
            assert books.sums[part, entry].tolist() == ints[codes[:, part] == entry, part : part + 1].sum(0).tolist()


def test_vector_codes_of_awkward_tables(spark):
    schema = "vec_id long, embedding array<double>, label string, codes string, error string"
    assert vector_codes.label_errors(spark.createDataFrame([], schema)).collect() == []
    assert vector_codes.label_errors(spark.createDataFrame([(1, None, "a", "x", "y")], schema)).collect() == []
    rows = [(1, [1.0] * 20, "a", "x", "y"), (1, [1.0] * 20, "a", "x", "y"), (None, [2.0], None, "x", "y"), (3, [], None, "x", "y"), (4, [1e300, 1.0], "b", "x", "y")]
    found = vector_codes.label_errors(spark.createDataFrame(rows, schema)).collect()
    assert sorted((-1 if r.vec_id is None else r.vec_id) for r in found) == [-1, 1, 1, 3, 4]
    # every vector starts an entry of its own, so all are coded without error
    assert {r.error for r in found} == {0} and len({r.code for r in found if r.vec_id == 1}) == 1


def test_decoded_vectors_are_near(spark):
    rng = np.random.default_rng(4)
    rows = [(i, (rng.normal(size=32) + 5 * (i % 4)).tolist(), 0) for i in range(500)]
    coded, books = vector_codes.compress(vectors(rows, spark))
    back = {r.vec_id: r.vector for r in vector_codes.decoded(coded, books).collect()}
    off = np.array([np.subtract(back[i], v) for i, v, _ in rows])
    assert len(back) == 500 and (off**2).sum() < 0.1 * np.var([v for _, v, _ in rows]) * off.size


def mix_rows():
    rng = random.Random(8)
    rows = [(i, " ".join(["w"] * int(rng.paretovariate(1.1) * 10)), rng.choice(["hot"] * 8 + ["b", "c", "Ü", "z", None, ""])) for i in range(3000)]
    return rows + [(5000, None, "only nulls"), (5001, None, "only nulls"), (5002, "x " * 60_000, "long"), (5003, "x " * 50_000, "long"), (5004, "x " * 40_000, "long"), (1, "again and again", "b"), (1, "again and again", "b"), (None, "no id", None)]


def test_source_mix(spark):
    rows = mix_rows()
    docs = spark.createDataFrame([(*r, "x", 3) for r in rows], "doc_id long, text string, source string, target string, size long").repartition(7)
    found = source_mix.plan(docs).collect()
    assert len(found) == len(rows)
    sizes, want = Counter(), Counter((d, len((t or "").split())) for d, t, _ in rows)
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    assert Counter((r.doc_id, r.size) for r in found) == want
    targets = brute.mix_targets(sizes)
    assert sum(targets.values()) == pytest.approx(1.5 * sum(sizes.values()))
    source, taken = {(d, len((t or "").split())): s for d, t, s in rows}, Counter()
    for r in found:
        s = source[r.doc_id, r.size]
        assert r.source_size == sizes[s] and r.target == pytest.approx(targets[s]) and r.taken == r.copies * r.size <= 2 * r.size
        assert r.copies - math.floor(r.target / max(sizes[s], 1)) in (0, 1)
        taken[s] += r.taken
    largest = {s: max(len((t or "").split()) for _, t, x in rows if x == s) for s in sizes}
    for s in sizes:
        # of whole copies: no nearer than half the longest document can be asked for
        assert abs(taken[s] - targets[s]) <= max(0.02 * targets[s], 0.25 * largest[s])
    again = source_mix.plan(docs.repartition(2)).collect()
    assert Counter(map(tuple, found)) == Counter(map(tuple, again))
    mixed = source_mix.mixed(docs)
    assert mixed.columns == [*docs.columns, "copy_number"]
    assert Counter((r.doc_id, r.text) for r in mixed.collect()) == +Counter({k: n for k, n in Counter((d, t) for (d, t, _) in rows for r in [next(f for f in found if (f.doc_id, f.size) == (d, len((t or "").split())))] for _ in range(r.copies)).items()})


def test_mix_of_empty_and_wordless_tables(spark):
    schema = "doc_id long, text string, source string"
    assert source_mix.plan(spark.createDataFrame([], schema)).collect() == []
    found = source_mix.plan(spark.createDataFrame([(1, None, "a"), (2, " ", None)], schema)).collect()
    assert {(r.size, r.target, r.taken) for r in found} == {(0, 0.0, 0)}


def test_full_sources_pass_their_excess_on(spark):
    """Filled one after another: what one can't take fills the next."""
    rows = [(i, "w " * n, s) for i, (s, n) in enumerate([("a", 1), ("b", 30), ("c", 70), ("d", 400), ("e", 3000), ("f", 9)])]
    found = {r.source_size: r.target for r in source_mix.plan(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    want = brute.mix_targets({"a": 1, "b": 30, "c": 70, "d": 400, "e": 3000, "f": 9})
    assert found == pytest.approx({1: want["a"], 30: want["b"], 70: want["c"], 400: want["d"], 3000: want["e"], 9: want["f"]})


def divergence_rows(langs=("en", "fr", None), sources=13, n=700):
    rng = random.Random(11)
    words = [f"{a}{b}" for a in ("Über", "word", "日本", "x", "Te") for b in "abcdefghij"]
    rows = []
    for i in range(n):
        lang, source = rng.choice(langs), rng.choice(["hot"] * 5 + [f"s{k}" for k in range(sources)])
        own = words[: 20 + hash_of(source) % 30]
        # rare terms stand in few sources, but in enough documents
        rows.append((lang, source, " ".join(rng.choices(own, k=rng.randrange(0, 40)) + ([f"only{source}"] * 3 if source in ("hot", "s1") else []) + (["shared9two"] if source in ("s2", "s3", "hot") else []))))
    return rows + [("en", "silent", None), ("en", "silent", "1 2 3"), ("xx", "alone", "few words here"), (None, None, "word")]


def hash_of(text):
    return sum(map(ord, text or ""))


@pytest.mark.parametrize("light", [0, 3, 1000])
def test_source_divergence(spark, light):
    """All terms dense, both kinds, and all terms sparse."""
    rows = divergence_rows()
    docs = spark.createDataFrame([(*r, i, 1) for i, r in enumerate(rows)], "lang string, source string, text string, item long, value int").repartition(5)
    found = source_divergence.audit(docs, light=light)
    assert sorted(map(tuple, found.collect())) == sorted(brute.divergence(rows))
    assert found.dtypes == [("lang", "string"), ("source", "string"), ("part", "string"), ("item", "string"), ("value", "bigint"), ("rank", "int")]


def test_tiles_of_several_blocks(spark):
    rows = divergence_rows(langs=("en",), sources=9, n=500)
    docs = spark.createDataFrame(rows, "lang string, source string, text string").repartition(4)
    audit = source_divergence.Audit(docs, light=2)
    whole = {(r.g, r.h): r.value for r in audit.heavy_sums().groupBy("g", "h").agg(F.sum("value").alias("value")).collect()}
    tiled = {(r.g, r.h): r.value for r in audit.heavy_sums(tile_terms=5, tile_groups=4).groupBy("g", "h").agg(F.sum("value").alias("value")).collect()}
    assert whole == tiled and len(whole) == 11 * 10 // 2


def test_divergence_of_awkward_tables(spark):
    schema = "lang string, source string, text string"
    assert source_divergence.audit(spark.createDataFrame([], schema)).collect() == []
    few = [("en", "a", "some words"), ("en", "b", None), (None, None, "x" * 100_000)]
    found = source_divergence.audit(spark.createDataFrame(few, schema)).collect()
    assert sorted(map(tuple, found)) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]


def test_probability_is_exact_beyond_longs(spark):
    rng = random.Random(2)
    pairs = [(c, c + rng.randrange(1, 10**15)) for c in (rng.randrange(1, 8 * 10**15) for _ in range(300))] + [(5, 5), (1, 9 * 10**15)]
    found = spark.createDataFrame(pairs, "c long, m long").select("c", "m", source_divergence.probability(F.col("c"), F.col("m")).alias("p")).collect()
    assert all(r.p == 1 + 10**9 * r.c // r.m for r in found)


@pytest.mark.parametrize("name", ["op11_vector_codes", "op12_source_mix", "op13_source_divergence"])
def test_queries_against_sql(spark, tiny_dir, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tiny_dir}/{t}.parquet'")
    df = queries.queries()[name](spark, tiny_dir)
    rel = con.sql(oracles.oracle_sql()[name])
    assert sorted(rel.columns) == sorted(df.columns)
    want = [tuple(dict(zip(rel.columns, r))[c] for c in df.columns) for r in rel.fetchall()]
    assert Counter(map(tuple, df.collect())) == Counter(want)


def test_white_space_beyond_ascii_is_cut_as_the_library_does():
    blanks = [b.decode() for b in token_pieces._BLANKS]
    encoder = token_pieces.PieceEncoder(token_pieces.byte_bpe_encoder("byte_bpe_50k.json", "byte_bpe_50k.tiktoken"), keep_space=True, keep_ids=True)
    library, rng = token_pieces.library_tokenizer("byte_bpe_50k.json"), random.Random(3)
    texts = [f"{a}{x}{b}{y}{c}" for x in blanks for y in (" ", "\n", *blanks[:3]) for a in ("", "a", "! ", " ") for b in ("", " ", "!") for c in ("", " ", "b")]
    texts += ["".join(rng.choice([*blanks, " ", " ", "\n", "\t", "a", "!", "é", "7", "'s", "\x1c", "​"]) for _ in range(rng.randrange(10))) for _ in range(20_000)]
    data, offsets = textkit.buffer_of(pa.array(texts, pa.large_string()))
    counts, rows = encoder.slice(data, offsets)
    ids, ends = encoder.gather(rows), np.cumsum(counts)
    for text, n, end, want in zip(texts, counts, ends, library.encode_batch(texts, add_special_tokens=False)):
        assert ids[end - n : end].tolist() == want.ids, repr(text)


def test_packing_of_white_space_beyond_ascii(spark):
    texts = {1: "Price! \xa0 \xa0", 2: "　 \n x \x85 ", 3: " \xa0", 4: "a\xa0 b   c"}
    library = token_pieces.library_tokenizer("byte_bpe_50k.json")
    found = packing.pack_documents(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    assert {r.doc_id: r.doc_tokens for r in found} == {d: len(library.encode(t, add_special_tokens=False).ids) + 1 for d, t in texts.items()}


def test_terms_count_where_they_stand_outside_matches(spark):
    rows = [(i, "contact someone@host.org about Zanzibar today") for i in range(5)]
    rows += [(100 + i, f"write or contact us about prices today zanzibar@host{i}.org") for i in range(295)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = {r.doc_id: [tuple(x) for x in r.terms or []] for r in pii.findings(docs).collect()}
    want = brute.pii_terms(rows)
    assert found == {d: w for (d, _), w in zip(rows, want)}
    start = rows[0][1].index("Zanzibar")
    assert found[0] == [(start, start + 8, "remove")]
    assert "Zanzibar" not in {r.doc_id: r.text for r in pii.sanitised(docs).collect()}[0]


def test_generalised_terms_take_a_class_that_does_not_disclose(spark):
    """Half of a name's documents hold the address; its beginning is shared with a frequent word."""
    rows = [(i, f"ask somebody montgomery {'m@corp.example' if i < 6 else 'nobody'}") for i in range(12)]
    rows += [(100 + i, "mountain view of monthly things") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r for r in pii.findings(docs).collect()}
    action = {rows[0][1][x.start : x.end]: x.action for x in found[0].terms}
    assert action["montgomery"] == "generalise" and found[0].classes["montgomery"] == "mont"
    assert "[TERM mont..]" in {r.doc_id: r.text for r in pii.sanitised(docs).collect()}[0]
