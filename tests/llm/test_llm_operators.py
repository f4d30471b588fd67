"""The ten operators against brute force, on the small tables and on awkward rows."""

import random

import brute
import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from stratiform.llm import chat_format, components, decontamination, jaccard_join, line_dedup, packing, pii, quality_rules, queries, repeats, substring_dedup, suffix_dedup, token_counts
from stratiform.llm.token_pieces import library_tokenizer

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def awkward() -> list[tuple[int, str | None]]:
    """Nulls, empty and blank texts, ties, exact and near copies, long and non-ASCII texts."""
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6))) for _ in range(300)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base = prose(120)
    near = base.split()
    near[60] = "CHANGED"
    line = "This very line is longer than forty characters, indeed"
    texts = [None, "", "   \n\t ", "one", "one two", base, base, " ".join(near), base.upper(), prose(40) + "\n" + base[100:500], "ab " * 400, "a" * 500, "\n".join([line] * 3 + [prose(5)])]
    texts += [f"{prose(4)}\n  {line.upper()}\t\n{prose(3)}" for _ in range(6)]
    texts += ["ünïcödé 日本語 " * 30, "mail a.b@c.de, x@y, 10.1.2.300 10.1.2.30 4111 1111 1111 1111 +49 (30) 1234-5678 a@b@c.d", "x <|endoftext|> y<|startoftext|>  z\n\n \x1c\x85  end ", prose(9000)]
    return list(enumerate(texts))


@pytest.fixture(scope="module")
def rows(tiny_dir):
    table = duckdb.sql(f"SELECT doc_id, text FROM '{tiny_dir}/documents.parquet' WHERE doc_id % 4 = 0").fetchall()
    return table + [(100_000 + i, t) for i, t in awkward()]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def odd(spark):
    """Repeated rows, a null id, and columns with clashing names."""
    long = "w " * 60
    data = [(1, long, 7, "a", "x"), (1, long, 7, "a", "x"), (None, long, 7, "a", "x"), (2, None, 7, "a", "x")]
    return spark.createDataFrame(data, "doc_id long, text string, n_words long, sequence_id string, dropped string")


def held(df, want, columns, key="doc_id"):
    got = {r[key]: tuple(r[c] for c in columns) for r in df.collect()}
    assert set(got) == set(want)
    assert {k: (want[k][: len(columns)], got[k]) for k in want if want[k][: len(columns)] != got[k]} == {}


def test_packing(docs, rows):
    found = [r.asDict() for r in packing.pack_documents(docs).collect()]
    tokenizer = library_tokenizer("byte_bpe_50k.json")
    faults, padding = brute.packing_faults(rows, found, lambda t: tokenizer.encode(t, add_special_tokens=False).ids)
    assert faults == [] and padding < 0.05


def test_shortest_pack_first_places_everything():
    histogram = {2048: 3, 1500: 4, 700: 9, 300: 11, 10: 500, 1: 3}
    patterns = packing.shortest_pack_first(histogram, 2048)
    placed = {}
    for lengths, count in patterns:
        assert sum(lengths) <= 2048
        for n in lengths:
            placed[n] = placed.get(n, 0) + count
    assert placed == histogram


def test_suffix_dedup(docs, rows):
    held(suffix_dedup.digest(suffix_dedup.repeated_bytes(docs)), brute.suffix_dedup(rows), ["n_bytes", "n_removed", "n_spans", "kept_sha256"])


def test_anchors_with_many_contexts_are_split(spark):
    """A phrase of 60 bytes with different text around it, and longer passages that hold it at different depths."""
    rng = random.Random(9)
    fresh = lambda n: "".join(rng.choice("abcdefghij") for _ in range(n))
    phrase = fresh(60)
    left, right = fresh(70), fresh(70)
    rows = [(i, fresh(90) + left[len(left) - i % 71 :] + phrase + right[: i * 7 % 71] + fresh(90)) for i in range(200)]
    rows += [(300, phrase * 5), (301, fresh(50) + left + phrase + right), (302, left + phrase + right)]
    narrow = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    texts, most = repeats.packed_texts(narrow), 8
    settled = repeats.settled_runs(repeats.anchored_runs(narrow, repeats.byte_symbols, 100, 24), True)
    assert settled.filter("open").groupBy("anchor").count().agg(F.max("count")).head()[0] > 100
    opened = repeats.opened_runs(settled, texts, repeats.byte_symbols, 100, True, most).cache()
    assert opened.filter("windows is not null").groupBy("anchor").count().agg(F.max("count")).head()[0] <= most
    edges = repeats.in_anchor_groups(opened, suffix_dedup._compare(100))
    whole = settled.filter("not open").select("doc_id", F.col("first").alias("start"), (F.col("last") + 100).alias("stop"))
    held(suffix_dedup.digest(repeats.with_spans(texts, whole.unionByName(edges))), brute.suffix_dedup(rows), ["n_bytes", "n_removed", "n_spans", "kept_sha256"])


def test_maximal_repeats_name_all_occurrences():
    data = np.frombuffer(b"xbananaybanana$zbanan#", np.uint8)
    begin = np.arange(len(data))
    order, lcp = suffix_dedup.suffix_array(data, begin, np.full(len(data), len(data)))
    assert [bytes(data[i:]) for i in order] == sorted(bytes(data[i:]) for i in begin)
    data = data.astype(np.int64)
    left = np.concatenate(([-1], data[:-1]))
    found = {(n, tuple(sorted(order[a:b].tolist()))) for a, b, n in suffix_dedup.maximal_repeats(order, lcp, left, 4)}
    assert found == {(6, (1, 8)), (5, (1, 8, 16))}


def test_quality_rules(docs, rows):
    report = quality_rules.report(docs)
    held(report, brute.quality(rows), ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"])
    kept = {r.doc_id for r in report.filter("kept").collect()}
    assert kept == {r.doc_id for r in quality_rules.keep_good(docs).collect()}
    assert quality_rules.keep_good(docs).columns == docs.columns


def test_rejected_documents_are_not_measured_further(spark):
    """Rules in a given order: what one rejects has no measures of the rules behind it; the order changes no verdict."""
    prose = " ".join(f"word{chr(97 + i)}" for i in range(26)) + " "
    texts = {"symbols": prose * 3 + "###x $$$y %%%z " * 6, "few_letters": prose * 2 + " ".join(map(str, range(100, 160))), "list_items": "\n".join(f"- {prose}" for _ in range(1)) + "\n* " + prose.upper(), "cut_off_lines": prose * 2 + "...", "frequent_word": prose * 2 + "same " * 30, None: prose * 3}
    docs = spark.createDataFrame(list(enumerate(texts.values())), "doc_id long, text string")
    rules = [r for r in quality_rules.RULES if r.name in texts]
    for order in (rules, rules[::-1]):
        df = quality_rules.measured(quality_rules.with_text(docs), ["n_words", "word_chars", "n_symbols", "n_dup_lines"], done := set())
        found = {r["doc_id"]: r for r in quality_rules.cascade(df, order, done).collect()}
        names = [r.name for r in order]
        for i, name in enumerate(texts):
            row = found[i]
            assert row["__qr_rejected_by"] == name
            for rule in order:
                for measure in set(rule.needs) & {"n_letter_words", "n_bullets", "n_cut_off", "top_word"}:
                    assert (row["__qr_" + measure] is None) == (name is not None and names.index(rule.name) > names.index(name))
    costs = {rule.name: seconds for rule, seconds, _ in quality_rules.estimates(docs, tuple(rules))}
    assert set(costs) == {r.name for r in rules}


def test_decontamination(spark, tiny_dir):
    bench = spark.read.parquet(f"{tiny_dir}/benchmark.parquet")
    items = [(r.item_id, r.text) for r in bench.collect()]
    words = items[0][1].split()
    edited = " ".join("edited" if i % 9 == 4 else w for i, w in enumerate(words))
    texts = [(1, "before " + items[0][1].upper() + " after"), (2, f"some {edited} words"), (3, "nothing of the kind here at all"), (4, None), (None, items[0][1])]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    found = {(r.doc_id, r.item_id): r.score for r in decontamination.contaminated(docs, bench).collect()}
    assert set(found) == {(1, items[0][0]), (2, items[0][0])} and found[1, items[0][0]] == 1.0 > found[2, items[0][0]]
    assert {r.doc_id for r in decontamination.without_contaminated(docs, bench).collect()} == {3, 4, None}
    parts = decontamination.contaminated(docs, bench, part_bytes=300)
    assert {(r.doc_id, r.item_id): r.score for r in parts.collect()} == found


def test_edited_copies_beside_verbatim_ones(spark):
    """A copy with 6 of 38 words changed, whose few seeds all verbatim copies hold too."""
    words = [f"w{i}" for i in range(38)]
    edited = ["x" if i in (5, 11, 17, 23, 29, 35) else w for i, w in enumerate(words)]
    for copies in (1, 40):
        docs = spark.createDataFrame([*((i, " ".join(words)) for i in range(1, copies + 1)), (0, " ".join(edited))], "doc_id long, text string")
        bench = spark.createDataFrame([(7, " ".join(words))], "item_id long, text string")
        found = {r.doc_id: r.score for r in decontamination.contaminated(docs, bench).collect()}
        assert set(found) == set(range(copies + 1)) and found[0] == (2 * 32 - 6) / 76


def test_decontamination_finds_what_plain_alignment_finds(spark):
    """Copies with words changed, put in, left out or cut off, down to the score asked for, against alignment of all pairs."""
    rng = random.Random(11)
    items = [[rng.choice("the of a".split()) if rng.random() < 0.4 else f"w{rng.randrange(300)}" for _ in range(n)] for n in (1, 2, 3, 4, 5, 6, 8, 11, 15, 15, 24, 38, 59)]
    fill = lambda n: [rng.choice([*"the of a".split(), f"w{rng.randrange(300)}"]) for _ in range(n)]
    texts = []
    for w in items:
        for step in (2, 3, 4, 5, 9):
            texts.append(fill(20) + ["x" if i % step == step - 1 else v for i, v in enumerate(w)] + fill(20))
            texts.append(fill(9) + [u for i, v in enumerate(w) for u in ([v, "x"] if i % step else [v])] + fill(9))
            texts.append(fill(9) + [v for i, v in enumerate(w) if i % step] + fill(9))
        texts += [w[len(w) // 3 :], fill(5) + w[: 2 * len(w) // 3] + fill(50), w + fill(3) + w, []]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    hashed = lambda w: np.array([hash(x) for x in w], np.int64)
    scores = {(d, i): decontamination.align(hashed(w), hashed(t)) for d, t in enumerate(texts) for i, w in enumerate(items)}
    for least in (0.3, 0.6, 0.9):
        found = {(r.doc_id, r.item_id): r.score for r in decontamination.contaminated(docs, bench, min_score=least).collect()}
        assert found == {k: s for k, s in scores.items() if s >= least}


def test_only_rare_seeds_join(spark):
    """Of an item's seeds, those that most documents hold don't join; a document with these alone is no candidate."""
    words = [f"w{i}" for i in range(30)]
    stem = " ".join(words[:12])
    docs = spark.createDataFrame([*((i, f"{stem} other {i}") for i in range(50)), (90, " ".join(words)), (91, " ".join(words[:14] + ["x"] + words[14:22] + ["y"] + words[23:]))], "doc_id long, text string")
    part = decontamination.Items([7], [" ".join(words)], 5, 0.8)
    every = set(part.own[0].tolist())
    need = int(part.need[0])
    df = {r.seed: r.df for r in decontamination.seed_frequencies(docs, spark.sparkContext.broadcast(part)).collect()}
    assert max(df.values()) == 52 and len(df) == len(every)
    part.keep_rare(df)
    size = int(part.size[0])
    joins = set(part.seeds[size][0].tolist())
    assert len(joins) == len(every) - need + 1 and joins < every
    assert min(df[int(np.uint64(x).astype(np.int64))] for x in every - joins) >= max(df[int(np.uint64(x).astype(np.int64))] for x in joins)
    bench = spark.createDataFrame([(7, " ".join(words))], "item_id long, text string")
    assert {r.doc_id for r in decontamination.contaminated(docs, bench, min_score=0.8).collect()} == {90, 91}


def test_alignment_against_full_table():
    rng = np.random.default_rng(3)
    for _ in range(20):
        a, b = rng.integers(0, 5, 12).astype(np.uint64), rng.integers(0, 5, 30).astype(np.uint64)
        h = np.zeros((13, 31), int)
        for i in range(1, 13):
            for j in range(1, 31):
                h[i, j] = max(0, h[i - 1, j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
        assert decontamination.align(a, b) == h.max() / 24


def test_jaccard_join(docs, rows):
    held(jaccard_join.near_duplicates(docs), brute.jaccard_join(rows), ["n_shingles", "component_id"])


def test_jaccard_join_keeps_links_of_extended_texts(spark):
    """A text and the same with a third more words: close to the threshold, and all that differs lies on one side."""
    rng = random.Random(5)
    prose = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    rows = []
    for k in range(60):
        base = prose(60 + 20 * (k % 12))
        words = len(base.split())
        rows += [(2 * k, base), (2 * k + 1, f"{prose(int((words - 4) / 3) - k % 3)} {base}" if k % 2 else f"{base} {prose(int((words - 4) / 3) + 1)}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute.jaccard_join(rows)
    assert 20 <= sum(c != d for d, (_, c) in want.items()) <= 40
    held(jaccard_join.near_duplicates(docs), want, ["n_shingles", "component_id"])


@pytest.mark.parametrize("exact", [False, True])
def test_jaccard_join_near_the_threshold(spark, exact):
    """Pairs of 150 to 400 shingles with words changed at random, about half of them just above 0.75: no link is lost."""
    rng = random.Random(17)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    rows = []
    for k in range(150):
        base = [word() for _ in range(rng.randrange(154, 404))]
        other = list(base)
        for at in rng.sample(range(len(base)), round(len(base) * rng.uniform(0.024, 0.034))):
            other[at] = word()
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(other))]
    want = brute.jaccard_join(rows)
    assert 40 <= sum(c != d for d, (_, c) in want.items()) <= 110
    held(jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), exact=exact), want, ["n_shingles", "component_id"])


def thue_morse(n: int, letters: str) -> str:
    return "".join(letters[bin(i).count("1") & 1] for i in range(n))


@pytest.mark.parametrize("length", [1024, 4096])
def test_regular_words_are_told_apart(spark, length):
    """A Thue-Morse word and its complement collide under any polynomial hash modulo 2**64."""
    rows = [(i, thue_morse(length, x)) for i, x in enumerate(("ox", "xo", "th", "ht"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(1)
    tokenizer = library_tokenizer("word_bpe_49k.json")
    held(token_counts.token_counts(docs), {d: (len(t), len(tokenizer.encode(t, add_special_tokens=False).ids)) for d, t in rows}, ["n_bytes", "n_tokens"])
    byte_bpe = library_tokenizer("byte_bpe_50k.json")
    found = [r.asDict() for r in packing.pack_documents(docs).collect()]
    assert brute.packing_faults(rows, found, lambda t: byte_bpe.encode(t, add_special_tokens=False).ids)[0] == []
    held(jaccard_join.near_duplicates(docs), {d: (1, d) for d, _ in rows}, ["n_shingles", "component_id"])
    held(suffix_dedup.digest(suffix_dedup.repeated_bytes(docs)), brute.suffix_dedup(rows), ["n_bytes", "n_removed", "n_spans", "kept_sha256"])
    words = [(d, " ".join([t] * 20 + [f"{d}"] + [t] * 20)) for d, t in rows]
    held(substring_dedup.kept_words(substring_dedup.repeated_words(spark.createDataFrame(words, "doc_id long, text string")), True), brute.substring_dedup(words), ["n_words", "n_removed", "kept_sha256"])
    items = spark.createDataFrame([(7, rows[0][1])], "item_id long, text string")
    assert [(r.doc_id, r.score) for r in decontamination.contaminated(docs, items).collect()] == [(0, 1.0)]


def test_components(spark):
    edges = [(5, 4), (4, 3), (3, 2), (2, 1), (10, 11), (12, 11), (7, 7)]
    found = components.components(spark.createDataFrame(edges, "a long, b long"))
    assert {r.node: r.component for r in found.collect()} == {2: 1, 3: 1, 4: 1, 5: 1, 11: 10, 12: 10}


def test_token_counts(docs, rows):
    tokenizer = library_tokenizer("word_bpe_49k.json")
    want = {d: (len((t or "").encode()), len(tokenizer.encode(t or "", add_special_tokens=False).ids)) for d, t in rows}
    held(token_counts.token_counts(docs), want, ["n_bytes", "n_tokens"])
    held(token_counts.token_counts(docs, chunk_chars=300, overlap_chars=8), want, ["n_bytes", "n_tokens"])


def test_substring_dedup(docs, rows):
    held(substring_dedup.kept_words(substring_dedup.repeated_words(docs), digest=True), brute.substring_dedup(rows), ["n_words", "n_removed", "kept_sha256"])


def test_reference_blocks_catch_passages_at_every_offset(spark):
    """Passages of 35 and 34 words that stand at all offsets against the blocks, in the same document, overlapping, and at its very ends."""
    rng = random.Random(3)
    fresh = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    whole, short = fresh(35), fresh(34)
    texts = [whole, fresh(7) + short, whole[:34], [*whole[1:], "x"], fresh(40) + whole * 2, ["a"] * 37, ["b"] * 35, fresh(18) + ["a"] * 35]
    texts += [fresh(k) + whole + fresh(3) for k in range(18)] + [fresh(k) + short + fresh(3) for k in range(18)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    want = brute.substring_dedup(rows)
    held(substring_dedup.kept_words(substring_dedup.repeated_words(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)), True), want, ["n_words", "n_removed", "kept_sha256"])
    assert want[0][1] == 35 and want[1][1] == 0 and want[5][1] == 37 and want[6][1] == 0


def test_texts_are_shuffled_by_no_join(spark, docs, monkeypatch, capsys):
    """No shuffle of the substring dedup, stored steps included, carries the texts; they are stored once."""
    whole, limit = repeats.stored, spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    monkeypatch.setattr(repeats, "stored", lambda df, *a: df.explain("formatted") or whole(df, *a))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        substring_dedup.kept_words(substring_dedup.repeated_words(docs)).explain("formatted")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    shuffles = [x for x in capsys.readouterr().out.split("\n\n") if x.strip().split("\n")[0].endswith(") Exchange")]
    assert len(shuffles) >= 8 and [x for x in shuffles if "packed#" in x] == []


def test_texts_of_suffix_dedup_are_shuffled_once(spark, docs):
    """Both joins with the texts share one shuffle."""
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        narrow = docs.select("doc_id", "text")
        texts = repeats.packed_texts(narrow)
        settled = repeats.settled_runs(repeats.anchored_runs(narrow, repeats.byte_symbols, 100, 24), True).cache()
        edges = repeats.in_anchor_groups(repeats.opened_runs(settled, texts, repeats.byte_symbols, 100, True), suffix_dedup._compare(100))
        found = repeats.with_spans(texts, edges)
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        plan = found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert "ReusedExchange [doc_id" in plan and "packed" in plan.split("ReusedExchange")[1].split("\n")[0]


def test_repeated_rows_of_opened_runs_are_one_document(spark):
    """A document in three equal rows, whose passage others share in parts, so that its windows are compared one by one."""
    rng = random.Random(9)
    fresh = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    p = fresh(120)
    rows = [(i, " ".join(t)) for i, t in enumerate([fresh(5) + p[:80] + fresh(60), fresh(9) + p[20:70] + fresh(50), fresh(40) + p[30:] + fresh(7), fresh(200)])]
    docs = spark.createDataFrame(rows + rows[:1] * 2 + rows[3:], "doc_id long, text string").repartition(5)
    held(substring_dedup.kept_words(substring_dedup.repeated_words(docs), True), brute.substring_dedup(rows), ["n_words", "n_removed", "kept_sha256"])
    held(suffix_dedup.digest(suffix_dedup.repeated_bytes(docs)), brute.suffix_dedup(rows), ["n_bytes", "n_removed", "n_spans", "kept_sha256"])


def test_slices_of_one_task_in_many_parts(spark, rows, monkeypatch):
    """Small slices, so that a task fills its first parts and starts more of them."""
    monkeypatch.setattr(substring_dedup, "SLICE", 3000)
    monkeypatch.setattr(substring_dedup, "PARTS", 3)
    monkeypatch.setattr(substring_dedup, "DEPTH", 1)
    few = rows[-120:]
    docs = spark.createDataFrame(few, "doc_id long, text string").coalesce(1)
    slices = [(r.part, r.slice, len(r.ids)) for r in substring_dedup.text_slices(docs).collect()]
    assert len({s for _, s, _ in slices}) == len(slices) > 12 and sum(n for _, _, n in slices) == len(few)
    assert len({p for p, _, _ in slices}) > 6 and all(p == s >> 1 for p, s, _ in slices)
    held(substring_dedup.kept_words(substring_dedup.repeated_words(docs), True), brute.substring_dedup(few), ["n_words", "n_removed", "kept_sha256"])


def test_packed_probes_round_trip():
    rng = random.Random(5)
    keys = np.array(sorted(rng.sample(range(1 << 32), 1000)), dtype="uint32")
    flags = np.array([rng.randrange(4) for _ in keys], dtype="uint8")
    back = substring_dedup._expanded(substring_dedup._squeezed(keys, flags))
    assert (back[0] == keys).all() and (back[1] == flags).all()


def test_pii(docs, rows):
    held(pii.digest(pii.findings(docs)), brute.pii(rows), ["n_email", "n_ip", "n_card", "n_phone", "base_sha256"])


def test_disclosing_terms(spark):
    texts = [(i, f"please write to zebulon now at z@corp.example about things number {i}") for i in range(4)]
    texts += [(10 + i, f"please write about things and other things now {i}") for i in range(60)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    found = {r.doc_id: r.spans for r in pii.digest(pii.findings(docs)).collect()}
    start = texts[0][1].index("zebulon")
    assert f"term:{start}:{start + 7}" in found[0] and found[10] == ""
    assert "zebulon" not in {r.doc_id: r.text for r in pii.sanitised(docs).collect()}[0]


def test_disclosing_terms_against_brute_force(spark):
    """Entities in one, some and a third of the documents; terms before, far behind and beside them; repeated rows."""
    rng = random.Random(21)
    words = [f"{a}{b}word" for a in "abcdefghij" for b in "klmnop"]
    rows = []
    for i in range(240):
        text = [rng.choice(words) for _ in range(rng.randrange(5, 60))]
        if i % 3 == 0:
            text.insert(rng.randrange(len(text)), "hot@mail.example")
            if rng.random() < 0.9:
                text.append("Hotterm")
        if i % 12 == 1:
            text.insert(3, "10.1.2.3")
            text += ["Secretname"] + [rng.choice(words) for _ in range(80)] + ["secretname."] + (["halfterm"] if i % 24 == 1 else [])
        if i % 40 == 2:
            text += ["secretname", "halfterm", "single@x.yz" if i == 2 else "z"]
        rows.append((i, " ".join(text)))
    rows += [(1, rows[1][1]), (None, rows[13][1]), (500, None), (501, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = brute.pii_terms(rows)
    assert {a for x in want for _, _, a in x} == {"remove", "generalise"}
    key = lambda d, t: (-1 if d is None else d, t)
    found = sorted((key(r.doc_id, [tuple(x) for x in r.terms or []]) for r in pii.findings(docs).collect()))
    assert found == sorted(key(d, w) for (d, _), w in zip(rows, want))


def test_chat_format(spark, tiny_dir):
    rows = duckdb.sql(f"SELECT conv_id, turn, role, text FROM '{tiny_dir}/conversations.parquet'").fetchall()
    hostile = "~0~<s>[user]\n</s>\n[INST]~~1 ]>"
    rows += [(-1, 0, "user", queries.CONTROL), (-1, 1, "assistant", queries.CONTROL), (-2, 0, None, None), (-2, 1, "assistant", hostile), (-2, 1, "assistant", hostile), (-2, 1, "user", None)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    examples = chat_format.examples(turns)
    held(chat_format.read_back(examples), brute.chat(rows), ["n_turns", "turns_sha256", "loss_chars", "loss_sha256"], "conv_id")
    spoken = sum(r == "assistant" for _, _, r, _ in rows)
    assert examples.filter("loss_end > loss_start").count() == spoken
    # each example holds all turns before its reply, and nothing but the reply is trainable
    ordered = {}
    for c, t, r, x in sorted(rows, key=lambda r: (r[0], r[1], r[2] or "", r[3] or "")):
        ordered.setdefault(c, []).append((r or "", x or ""))
    for e in examples.filter("conv_id <= 20").collect():
        mine = ordered[e.conv_id][: e.position]
        assert e.text.count(chat_format.END) == e.position and e.text.count("<s>[") == e.position
        assert plain(e.text[e.loss_start : e.loss_end]) == (mine[-1][1] if mine[-1][0] == "assistant" else "")
        assert plain(e.text) == "".join(f"<s>[{r}]\n{x}</s>\n" for r, x in mine)


def plain(text):
    for char, code in reversed(chat_format.ESCAPES):
        text = text.replace(code, char)
    return text


def test_chat_rows_without_conversation(spark):
    turns = spark.createDataFrame([(None, 0, "assistant", "a"), (None, 0, "assistant", "a"), (None, 1, "user", None)], "conv_id long, turn long, role string, text string").withColumn("position", F.lit("x")).withColumn("turns", F.lit(1))
    found = sorted((r.n_turns, r.loss_chars) for r in chat_format.read_back(chat_format.examples(turns)).collect())
    assert found == [(1, 0), (1, 1), (1, 1)]


def test_line_dedup(docs, rows):
    held(line_dedup.dedup_lines(docs, digest=True), brute.line_dedup(rows), ["n_lines", "n_dropped", "kept_sha256"])
    kept = {r.doc_id: r.text for r in line_dedup.dedup_lines_in_place(docs).collect()}
    want = brute.line_dedup(rows)
    assert all(brute.sha(kept[d] or "") == want[d][2] for d, _ in rows)
    assert kept[100_000] is None


def test_line_runs_hold_each_key_once(docs, rows):
    """Small batches, so that runs are joined and compacted: keepers come from the anti-joined keys alone."""
    narrow = docs.select("doc_id", "text")
    held(line_dedup.dedup_lines(docs, digest=True, first_batch=5, fanout=2), brute.line_dedup(rows), ["n_lines", "n_dropped", "kept_sha256"])
    ends = line_dedup.batch_ends(narrow.select("doc_id"), 5)
    assert len(ends) >= 3 and ends == sorted(ends, reverse=True)
    keys, runs = line_dedup.line_keys(narrow, ends).cache(), line_dedup.LevelledRuns(fanout=100)
    for number in range(len(ends) + 1):
        runs.add(line_dedup.counted(keys.filter(F.col("batch") == number)))
    tables = [t.collect() for t in runs.tables()]
    new = [(r.hi, r.lo) for t in tables for r in t if r.keeper is not None]
    again = [(r.hi, r.lo) for t in tables[1:] for r in t if r.keeper is None]
    assert len(new) == len(set(new)) and again and set(again) <= set(new)
    keeper = {(r.hi, r.lo): r.keeper for t in tables for r in t if r.keeper is not None}
    assert keeper == {(r.hi, r.lo): r.last for r in keys.groupBy("hi", "lo").agg(F.max("doc_id").alias("last")).collect()}


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_empty_tables(spark, tiny_dir, tmp_path, name):
    for table in ("documents", "benchmark", "conversations"):
        spark.read.parquet(f"{tiny_dir}/{table}.parquet").limit(0).write.parquet(f"{tmp_path}/{table}.parquet")
    rows = queries.queries()[name](spark, str(tmp_path)).collect()
    assert len(rows) == (1 if name.startswith("op9") else 0)


OPERATORS = {
    "packing": (packing.pack_documents, 4),
    "suffix": (lambda d: suffix_dedup.digest(suffix_dedup.repeated_bytes(d)), 4),
    "quality": (quality_rules.report, 4),
    "jaccard": (jaccard_join.near_duplicates, 4),
    "tokens": (token_counts.token_counts, 4),
    "substring": (lambda d: substring_dedup.kept_words(substring_dedup.repeated_words(d)), 4),
    "pii": (lambda d: pii.digest(pii.findings(d)), 4),
    "lines": (line_dedup.dedup_lines, 4),
    "contaminated": (lambda d: decontamination.contaminated(d, d.select(F.col("doc_id").alias("item_id"), "text")), 1),
    "without_contaminated": (lambda d: decontamination.without_contaminated(d, d.select(F.lit(5).alias("item_id"), F.lit("nothing of this kind").alias("text"))), 4),
    "keep_good": (quality_rules.keep_good, 0),
    "lines_in_place": (line_dedup.dedup_lines_in_place, 4),
    "one_of_each": (jaccard_join.one_of_each, 4),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_repeated_rows_null_ids_and_clashing_names(odd, name):
    operator, count = OPERATORS[name]
    found = operator(odd).collect()
    assert len(found) == count
    assert count == 0 or name == "contaminated" or None in {r.doc_id for r in found}


def test_counted_pieces_are_encoded_once():
    """A worker keeps the counts of many more pieces than it keeps ids of, so texts of many words don't go to the library again."""
    from stratiform.llm.token_pieces import PieceEncoder

    seen = []
    encoder = PieceEncoder(lambda pieces: seen.extend(pieces) or [[7] * len(p) for p in pieces], keep_space=False, keep_ids=False)
    texts = [" ".join(f"w{i:06d}" for i in range(begin, begin + 100_000)).encode() for begin in range(0, 400_000, 100_000)]
    for text in texts * 2:
        counts, _ = encoder.slice(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
        assert counts.tolist() == [700_000]
    assert len(seen) == 400_000


def test_members_of_an_opened_group_are_met_once(spark, monkeypatch):
    """Two groups of near copies whose texts share two thirds of their shingles: a class meets each member of the other group once, not at every token that they share; the links are those of brute force."""
    rng = random.Random(4)
    core = [f"c{i}" for i in range(600)]
    texts = []
    for side in range(2):
        own = core[:480] + [f"s{side}x{i}" for i in range(120)]
        texts += [" ".join(own[:k] + [f"v{side}y{k}"] + own[k + 1 :]) for k in rng.sample(range(5, 590), 30)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    met, whole = [], jaccard_join.JaccardJoin._met_once

    def seen(self, grouped, asked):
        met.append(sum(r.size2 for r in asked.collect()))
        return whole(self, grouped, asked)

    monkeypatch.setattr(jaccard_join.JaccardJoin, "_met_once", seen)
    monkeypatch.setattr(jaccard_join, "BLOCK", 7)
    join = jaccard_join.JaccardJoin(docs)
    got = {r.doc_id: r.component_id for r in join.memberships().collect()}
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)]
    root = list(range(len(texts)))
    for _ in texts:
        root = [min(root[b] for b, y in enumerate(sets) if 100 * len(x & y) >= 75 * len(x | y)) for x in sets]
    assert got == dict(enumerate(root)) and len(set(root)) == 2
    assert sum(met) == 900
    # two groups of which no pair is linked: opened in blocks, each pair once
    grouped = join._grouped([spark.createDataFrame([(0, k) for k in range(1, 30)] + [(30, k) for k in range(31, 60)], "a long, b long")])
    met.clear()
    pairs = [tuple(r) for r in join._opened_pairs(grouped).collect()]
    assert len(pairs) == len(set(pairs)) and sum(met) == 900 and 0 < len({p for p in pairs if {p[0] // 30, p[1] // 30} == {0, 1}})
