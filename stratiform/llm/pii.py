"""Personal data: pattern matches, and terms that give protected entities away.

Every e-mail address, IP address, card and phone number is a protected entity. Corpus
co-occurrence says how strongly a term reveals it: with counts of documents that hold the term, the entity and both,
wherever they stand in the text, PMI(entity, term) = log(co * N / (df_entity * df_term)), and the entity's
information is IC = log(N / df_entity). A term whose PMI reaches `remove` of IC is removed, one
that reaches `generalise` is generalised, at every place of every document that
holds the entity; both need `support` documents that hold the pair, so a term that met one address by chance stays.
A term is a word of at least TERM_CHARS letters, and counts only where it stands outside all pattern matches.

As co <= df_entity, no term of more than N * (df_entity / N) ** generalise documents can disclose an entity. So a document's entities
meet only its terms within that bound, and not all its terms. The same bound says how a term is generalised: it is
replaced by its longest beginning that it shares with a term beyond the bound, whose class is then too frequent to disclose.

Defined results: a null or empty text has no spans; every row counts as a document, repeated ones too, and
each gets its spans; a null id is kept; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from itertools import accumulate

import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .shared import hot_join, stored

# fixed values: kinds in the order of the digest
KINDS = ("email", "ip", "card", "phone")
#: Least letters of a term; support and thresholds.
TERM_CHARS, SUPPORT, REMOVE, GENERALISE = 4, 3, 0.9, 0.8

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match can't begin within a run of digits when it fails at the run's start
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_TERM = re.compile(rf"[^\W\d_]{{{TERM_CHARS},}}")


def _emails(text: str) -> list[tuple[int, int]]:
    found, done, at = [], 0, text.find("@")
    while at >= 0:
        domain, start = _DOMAIN.match(text, at + 1), at
        if domain:
            while start > done and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                found.append((start, domain.end()))
                done = domain.end()
        at = text.find("@", max(at + 1, done))
    return found


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, kind number, end as kind order demands) of all pattern matches, sorted by start, then kind."""
    found = [(s, 0, e) for s, e in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        found += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and _luhn(digits):
                found.append((m.start(), 2, m.end()))
        if "+" in text:
            found += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= sum(map(str.isdigit, m[0])) <= 15]
    return sorted(found)


def term_places(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[str, int, int]]:
    """(term, start, end) of every term that stands outside the spans, which are sorted by start."""
    out, done = [], 0
    for start, _, end in [*spans, (len(text), 0, len(text))]:
        # a match within done:start is a whole word unless letters go on inside a span
        for m in _TERM.finditer(text, done, max(start, done)):
            whole = (m.start() > done or done == 0 or not text[done - 1].isalpha()) and (m.end() < start or start == len(text) or not text[start].isalpha())
            if whole:
                out.append((m[0].lower(), m.start(), m.end()))
        done = max(done, end)
    return out


FOUND = "doc_id long, text_key binary, n_email long, n_ip long, n_card long, n_phone long, base array<struct<start:int,kind:int,end:int>>, base_sha256 string, entities array<string>, places array<struct<term:string,start:int,end:int>>"


def joined_spans(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def text_key(text: str) -> bytes:
    """Tells the texts of rows with one id apart."""
    return xxhash.xxh3_128_digest(text.encode("utf-8", "replace"))


def pattern_matches(docs: DataFrame) -> DataFrame:
    """Base spans of each document, its distinct entities and, if it has any, all places of terms."""

    def run(batches):
        for batch in tk.slices(batches):
            rows = {name: [] for name in ("key", "base", "sha", "entities", "places")}
            for text in pc.fill_null(batch.column(1), "").to_pylist():
                spans = base_spans(text)
                rows["key"].append(text_key(text))
                rows["base"].append([{"start": s, "kind": k, "end": e} for s, k, e in spans])
                rows["sha"].append(hashlib.sha256(joined_spans(spans).encode()).hexdigest())
                rows["entities"].append(list({f"{KINDS[k]}:{text[s:e].lower()}" for s, k, e in spans}))
                rows["places"].append(term_places(text, spans) if spans else [])
            counts = [[sum(x["kind"] == k for x in base) for base in rows["base"]] for k in range(4)]
            span = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())])
            terms, starts, ends = zip(*(p for own in rows["places"] for p in own)) if any(rows["places"]) else ((), (), ())
            place = pa.StructArray.from_arrays([pa.array(terms, pa.string()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], names=["term", "start", "end"])
            cuts = pa.array([0, *accumulate(map(len, rows["places"]))], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(rows["key"], pa.binary()), *(pa.array(c, pa.int64()) for c in counts), pa.array(rows["base"], pa.list_(span)), pa.array(rows["sha"]), pa.array(rows["entities"], pa.list_(pa.string())), pa.ListArray.from_arrays(cuts, place)],
                names=["doc_id", "text_key", *(f"n_{k}" for k in KINDS), "base", "base_sha256", "entities", "places"],
            )

    return docs.mapInArrow(run, FOUND)


def term_frequencies(docs: DataFrame, support: int, room: int = 200_000) -> DataFrame:
    """term, df: documents of the whole corpus that hold each term outside pattern matches, if enough do; counted in each task before the shuffle."""

    def run(batches):
        counts: Counter[str] = Counter()
        flush = lambda: pa.RecordBatch.from_arrays([pa.array(list(counts)), pa.array(list(counts.values()), pa.int64())], names=["term", "n"])
        for batch in tk.slices(batches):
            for text in pc.fill_null(batch.column(1), "").to_pylist():
                spans = base_spans(text)
                counts.update({t for t, _, _ in term_places(text, spans)} if spans else {t.lower() for t in set(_TERM.findall(text))})
            if len(counts) > room:
                yield flush()
                counts.clear()
        if counts:
            yield flush()

    return docs.mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("df")).filter(F.col("df") >= support)


def entity_frequencies(found: DataFrame, support: int) -> DataFrame:
    """entity, df_entity of the entities that enough documents hold."""
    return found.select(F.explode("entities").alias("entity")).groupBy("entity").agg(F.count("*").alias("df_entity")).filter(F.col("df_entity") >= support)


def disclosable_pairs(found: DataFrame, entities: DataFrame, terms: DataFrame, n: int, generalise: float = GENERALISE) -> DataFrame:
    """row, entity, df_entity, bound, term, df: of each document the entities and those of its terms that are rare enough to disclose them. All three are stored tables."""
    bound = n * F.pow(F.col("df_entity") / n, generalise) * (1 + 1e-9)
    entities = entities.filter(F.col("df_entity") < n).withColumn("bound", bound)
    most = entities.agg(F.max("bound")).first()[0] or 0.0
    holding = found.filter(F.size("entities") > 0)
    own = hot_join(holding.select("row", F.explode("entities").alias("entity")), entities, ["entity"], "df_entity")
    words = holding.select("row", F.explode(F.array_distinct(F.transform("places", lambda p: p["term"]))).alias("term"))
    rare = hot_join(words, terms.filter(F.col("df") <= most), ["term"], "df")
    return own.join(rare, "row").filter(F.col("df") <= F.col("bound")).select("row", "entity", "df_entity", "bound", "term", "df")


def disclosures(pairs: DataFrame, n: int, support: int = SUPPORT, remove: float = REMOVE, generalise: float = GENERALISE) -> DataFrame:
    """entity, term, co, bound, action for each term that discloses an entity beyond a threshold."""
    counted = pairs.groupBy("entity", "df_entity", "bound", "term", "df").agg(F.count("*").alias("co")).filter(F.col("co") >= support)
    ratio = F.log(F.col("co") * F.lit(float(n)) / (F.col("df_entity") * F.col("df"))) / F.log(F.lit(float(n)) / F.col("df_entity"))
    action = F.when(ratio >= remove, "remove").when(ratio >= generalise, "generalise")
    return counted.select("entity", "term", "co", "bound", action.alias("action")).filter("action is not null")


def classes(told: DataFrame, terms: DataFrame) -> DataFrame:
    """entity, term, class: the longest beginning of a term to be generalised that a term beyond the entity's bound has too."""
    beginnings = lambda: F.explode(F.transform(F.sequence(F.lit(1), F.length("term")), lambda k: F.substring("term", F.lit(1), k))).alias("class")
    wanted = told.filter("action = 'generalise'").select("entity", "term", "bound", beginnings())
    least = told.agg(F.min("bound")).first()[0] or 0.0
    frequent = terms.filter(F.col("df") > least).select("df", beginnings()).groupBy("class").agg(F.max("df").alias("most"))
    return wanted.join(frequent, "class").filter(F.col("most") > F.col("bound")).groupBy("entity", "term").agg(F.max_by("class", F.length("class")).alias("class"))


def findings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: int = SUPPORT, remove: float = REMOVE, generalise: float = GENERALISE) -> DataFrame:
    """Every document's pattern matches, the places of its disclosing terms (start, end, action), and the classes of those to be generalised."""
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found = stored(pattern_matches(narrow).withColumn("row", F.monotonically_increasing_id()), "pii")
    n = found.count()
    entities = stored(entity_frequencies(found, support), "pii-entities")
    terms = stored(term_frequencies(narrow, support), "pii-frequencies")
    pairs = stored(disclosable_pairs(found, entities, terms, n, generalise), "pii-pairs")
    told = stored(disclosures(pairs, n, support, remove, generalise), "pii-told")
    told = stored(told.join(classes(told, terms), ["entity", "term"], "left").select("entity", "term", "co", "action", "class"), "pii-terms")
    # where two entities share a term, the stricter action and the wider class hold
    own = hot_join(pairs.select("row", "entity", "term"), told, ["entity", "term"], "co").groupBy("row", "term").agg(F.max("action").alias("action"), F.min_by("class", F.length("class")).alias("class"))
    entry = lambda value: F.map_from_entries(F.collect_list(F.struct("term", value)))
    own = own.groupBy("row").agg(entry("action").alias("actions"), entry("class").alias("classes"))
    joined = found.join(own, "row", "left")
    places = F.filter("places", lambda p: F.map_contains_key(F.col("actions"), p["term"]))
    spans = F.transform(places, lambda p: F.struct(p["start"].alias("start"), p["end"].alias("end"), F.try_element_at(F.col("actions"), p["term"]).alias("action")))
    return joined.withColumn("terms", F.when(F.col("actions").isNotNull(), F.sort_array(spans))).drop("row", "actions", "places")


def digest(found: DataFrame) -> DataFrame:
    """The columns of the registered query."""
    base = F.transform("base", lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))
    terms = F.array_distinct(F.transform(F.coalesce("terms", F.array().cast("array<struct<start:int,end:int,action:string>>")), lambda x: F.struct(x["start"].alias("start"), F.lit(len(KINDS)).alias("kind"), x["end"].alias("end"))))
    names = F.array(*map(F.lit, (*KINDS, "term")))
    text = F.transform(F.array_sort(F.concat(base, terms)), lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string")))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", F.array_join(text, ",").alias("spans"))


def sanitised(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **thresholds) -> DataFrame:
    """doc_id and the text with entities and removed terms replaced by their kind, generalised terms by their class if they have one."""
    found = findings(docs, id_col, text_col, **thresholds).select("doc_id", "text_key", "base", "terms", "classes").groupBy("doc_id", "text_key").agg(*[F.first(c).alias(c) for c in ("base", "terms", "classes")])
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def key(batches):
        for batch in tk.slices(batches):
            keys = [text_key(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.binary())], names=["doc_id", "text", "text_key"])

    def rewrite(batches):
        for batch in tk.slices(batches):
            out = []
            for text, base, terms, classes in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3, 4))):
                text, done, parts, classes = text or "", 0, [], dict(classes or [])
                spans = [(x["start"], x["end"], f"[{KINDS[x['kind']].upper()}]") for x in base or []]
                for x in terms or []:
                    wide = classes.get(text[x["start"] : x["end"]].lower()) if x["action"] == "generalise" else None
                    spans.append((x["start"], x["end"], f"[TERM {wide}..]" if wide else "[TERM]"))
                for start, end, mark in sorted(spans):
                    if start >= done:
                        parts += [text[done:start], mark]
                    done = max(done, end)
                out.append("".join([*parts, text[done:]]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["doc_id", "text"])

    keyed = narrow.mapInArrow(key, "doc_id long, text string, text_key binary")
    same = F.col("d.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("d.text_key") == F.col("f.text_key"))
    return keyed.alias("d").join(found.alias("f"), same, "left").select("d.doc_id", "d.text", "f.base", "f.terms", "f.classes").mapInArrow(rewrite, "doc_id long, text string")
