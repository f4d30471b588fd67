"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Each rule's cost and share of rejected documents are estimated on a bounded sample;
the rules then run in order of rejection per cost, and a document that one rule
rejects is not measured for the later ones: a rule's measures are null there. The verdict is the same in any order.
Measures that are known anyway cost a rule nothing, so `report`, which tells the base measures of every document, orders
the rules by what each still has to measure.

Defined results: a null or empty text has no words and all counts 0; repeated rows
are judged once each; a null id is kept as it is; an empty table gives no rows.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import stored

SPACE = r"\x20\x09-\x0D"
SYMBOLS = "[#*$%&|<>]"
# fixed values: an ASCII letter or any character beyond ASCII; a line that starts as a list item; one that is cut off
LETTER, BULLET, CUT_OFF = r"[^\x00-@\[-`{-\x7F]", r"^[\x20\x09-\x0D]*[-*\u2022]", r"(\.\.\.|\u2026)[\x20\x09-\x0D]*$"
#: Rows of the sample that costs and selectivities are estimated on.
SAMPLE_ROWS = 200

_PRIVATE = "__qr_"


def _c(name: str) -> Column:
    return F.col(_PRIVATE + name)


def _word_steps() -> list[tuple[str, Column]]:
    return [("words", F.array_remove(F.split(_c("text"), f"[{SPACE}]+"), ""))]


def _repeat_steps() -> list[tuple[str, Column]]:
    """Words in a run of three that the text holds twice or more, from the sorted hashes of all runs."""
    n = F.size(_c("words"))
    grams = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.struct(F.xxhash64(F.get(_c("words"), i), F.get(_c("words"), i + 1), F.get(_c("words"), i + 2)).alias("h"), i.alias("at")))
    run = _c("runs")
    same = lambda x, k: x["h"].eqNullSafe(F.get(run, k - 1)["h"]) | x["h"].eqNullSafe(F.get(run, k + 1)["h"])
    places = F.sort_array(F.transform(F.filter(run, same), lambda x: x["at"]))
    gaps = F.transform(_c("places"), lambda p, k: F.least(F.lit(3), F.coalesce(F.get(_c("places"), k + 1) - p, F.lit(3))))
    none = F.array().cast("array<int>")
    return [
        ("runs", F.when(n >= 4, F.sort_array(grams))),
        ("places", F.when(run.isNotNull(), places).otherwise(none)),
        ("n_repeat_words", F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x)),
    ]


def _line_steps() -> list[tuple[str, Column]]:
    lines = F.filter(F.split(_c("text"), "\n"), lambda x: F.length(F.trim(x, F.lit(" \t\n\x0b\f\r"))) > 0)
    return [("lines", lines), ("n_lines", F.size(_c("lines")).cast("long")), ("n_dup_lines", F.size(_c("lines")).cast("long") - F.size(F.array_distinct(_c("lines"))))]


def _word_count_steps() -> list[tuple[str, Column]]:
    """Times that the most frequent word stands there, from the sorted hashes of all words."""
    start = F.struct(F.lit(None).cast("long").alias("word"), F.lit(0).alias("run"), F.lit(0).alias("most"))

    def step(a: Column, word: Column) -> Column:
        run = F.when(a["word"] == word, a["run"] + 1).otherwise(1)
        return F.struct(word.alias("word"), run.alias("run"), F.greatest(a["most"], run).alias("most"))

    return [("hashes", F.array_sort(F.transform(_c("words"), lambda w: F.xxhash64(w)))), ("top_word", F.aggregate(_c("hashes"), start, step, lambda a: a["most"].cast("long")))]


def _count_of(array: str, pattern: str):
    return F.size(F.filter(_c(array), lambda x: x.rlike(pattern))).cast("long")


#: Measures by name: the measures they need, and the columns that make them.
MEASURES = {
    "words": ([], _word_steps),
    "n_words": (["words"], lambda: [("n_words", F.size(_c("words")).cast("long"))]),
    "word_chars": (["words"], lambda: [("word_chars", F.length(F.array_join(_c("words"), "")).cast("long"))]),
    "n_symbols": ([], lambda: [("n_symbols", (F.length(_c("text")) - F.length(F.regexp_replace(_c("text"), SYMBOLS, ""))).cast("long"))]),
    "n_repeat_words": (["words"], _repeat_steps),
    "n_dup_lines": ([], _line_steps),
    "n_letter_words": (["words"], lambda: [("n_letter_words", _count_of("words", LETTER))]),
    "n_bullets": (["n_dup_lines"], lambda: [("n_bullets", _count_of("lines", BULLET))]),
    "n_cut_off": (["n_dup_lines"], lambda: [("n_cut_off", _count_of("lines", CUT_OFF))]),
    "top_word": (["words"], _word_count_steps),
}


@dataclass(frozen=True)
class Rule:
    """Rejects a document by some measures. `reject` takes a function from measure to column."""

    name: str
    needs: tuple[str, ...]
    reject: object


BASE_RULES = (
    Rule("few_words", ("n_words",), lambda m: m("n_words") < 50),
    Rule("repeated_words", ("n_words", "n_repeat_words"), lambda m: 100 * m("n_repeat_words") > 50 * m("n_words")),
)
RULES = (
    Rule("symbols", ("n_symbols", "word_chars"), lambda m: 10 * m("n_symbols") > m("word_chars")),
    Rule("word_length", ("n_words", "word_chars"), lambda m: (m("word_chars") > 25 * m("n_words")) | (m("word_chars") < 2 * m("n_words"))),
    Rule("repeated_lines", ("n_dup_lines",), lambda m: 2 * m("n_dup_lines") > m("n_lines")),
    Rule("few_letters", ("n_words", "n_letter_words"), lambda m: 100 * m("n_letter_words") < 70 * m("n_words")),
    Rule("list_items", ("n_bullets",), lambda m: 10 * m("n_bullets") > 9 * m("n_lines")),
    Rule("cut_off_lines", ("n_cut_off",), lambda m: 10 * m("n_cut_off") > 3 * m("n_lines")),
    Rule("frequent_word", ("n_words", "top_word"), lambda m: 100 * m("top_word") > 20 * m("n_words")),
)


def measured(df: DataFrame, names: list[str], done: set[str], live: Column | None = None) -> DataFrame:
    """Add the measures, and those they need, as private columns; only for rows where `live` holds."""
    for name in names:
        needs, steps = MEASURES[name]
        if name in done:
            continue
        df = measured(df, needs, done, live)
        for column, value in steps():
            df = df.withColumn(_PRIVATE + column, value if live is None else F.when(live, value))
        done.add(name)
    return df


def settled(df: DataFrame, name: str) -> DataFrame:
    """Count the rows that get here. No filter is pushed below the count, so each measure is worked out once, as a column."""
    return df.observe(f"quality {name}", F.count(F.lit(1)).alias("measured"))


def with_text(docs: DataFrame, text_col: str = "text") -> DataFrame:
    return docs.withColumn(_PRIVATE + "text", F.coalesce(F.col(text_col).cast("string"), F.lit("")))


def sampled(docs: DataFrame, known: list[str], text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """At most `sample_rows` texts from all over the table with the measures that are known, stored in the shared folder."""
    share = min(1.0, 2 * sample_rows / max(1, docs.count()))
    picked = with_text(docs.select(text_col).sample(share, seed=7).limit(sample_rows), text_col)
    return stored(measured(picked, known, set()).drop(text_col).coalesce(1), "quality-sample")


def estimates(docs: DataFrame, rules: tuple[Rule, ...], text_col: str = "text", sample_rows: int = SAMPLE_ROWS, known: list[str] | None = None) -> list[tuple[Rule, float, float]]:
    """Each rule with its seconds on the sample, `known` measures given, and the share it rejects there."""
    sample = sampled(docs, known or [], text_col, sample_rows)
    done = {name for name in MEASURES if _PRIVATE + name in sample.columns}
    sample = sample.select("*", F.explode(F.array(*map(F.lit, range(4)))).alias(_PRIVATE + "again"))
    out = []
    for rule in rules:
        job = measured(sample, list(rule.needs), set(done)).agg(F.avg(rule.reject(_c).cast("double")))
        job.collect()  # compiles the code
        start = time.perf_counter()
        share = job.collect()[0][0] or 0.0
        out.append((rule, time.perf_counter() - start, share))
    return out


def ordered(docs: DataFrame, rules: tuple[Rule, ...], text_col: str = "text", sample_rows: int = SAMPLE_ROWS, known: list[str] | None = None) -> list[Rule]:
    """Rules by rejections per second, most first."""
    return [rule for rule, cost, share in sorted(estimates(docs, rules, text_col, sample_rows, known), key=lambda x: (-x[2] / max(x[1], 1e-6), x[1], x[0].name))]


def cascade(df: DataFrame, rules: list[Rule], done: set[str] | None = None, live: Column | None = None) -> DataFrame:
    """Add __qr_rejected_by: the first rule that rejects, or null. `df` comes from with_text(). Rows that are rejected have no measures of later rules."""
    done = set() if done is None else done
    live = F.lit(True) if live is None else live
    df = df.withColumn(_PRIVATE + "rejected_by", F.lit(None).cast("string"))
    for rule in rules:
        now = live & _c("rejected_by").isNull()
        before = len(done)
        df = measured(df, list(rule.needs), done, now)
        if len(done) > before:
            df = settled(df, rule.name)
        df = df.withColumn(_PRIVATE + "rejected_by", F.coalesce(_c("rejected_by"), F.when(now & rule.reject(_c), F.lit(rule.name))))
    return df


def keep_good(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = BASE_RULES + RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows that no rule rejects, with their own columns. A rejected row is not measured for later rules."""
    df, done = with_text(docs, text_col), set()
    for rule in ordered(docs, rules, text_col, sample_rows):
        df = settled(measured(df, list(rule.needs), done), rule.name).filter(~rule.reject(_c))
    return df.select(*[F.col(f"`{c}`") for c in docs.columns])


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """All base measures of every document, the base verdict and the cascade's."""
    base = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    rules = ordered(docs, RULES, text_col, sample_rows, base)
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    done: set[str] = set()
    df = settled(measured(with_text(narrow), base, done), "base")
    df = df.withColumn(_PRIVATE + "base_failed", BASE_RULES[0].reject(_c) | BASE_RULES[1].reject(_c))
    df = cascade(df, rules, done, ~_c("base_failed"))
    df = settled(df, "cascade")
    return df.select("doc_id", *[_c(m).alias(m) for m in base], _c("base_failed").alias("base_failed"), (~_c("base_failed") & _c("rejected_by").isNull()).alias("kept"))
