"""Chat formatting by prefix-target expansion, in DataFrame functions only.

Every assistant turn becomes one example: a row whose text holds all preceding turns as context and then
that reply, and whose loss range covers the reply alone. A conversation that does not end with a reply has one more
row, which holds all its turns and an empty loss range, so that the output tells every conversation whole.

Template: `<s>` + [ROLE] + newline + text + `</s>` + newline for each turn. Inside texts and roles
the escape sign and every control string are escaped, so no text can end a turn:
~ -> ~0, < -> ~1, > -> ~2, [ -> ~3, ] -> ~4.

Defined results: a null text or role is empty; turns with the same number are
ordered by role, then text; repeated rows are repeated turns; null turns come
first; each row with a null conv_id is a conversation of one turn; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: the escape table, escape sign first
ESCAPES = (("~", "~0"), ("<", "~1"), (">", "~2"), ("[", "~3"), ("]", "~4"))
ASSISTANT = "assistant"
END = "</s>\n"
SEGMENT = r"(?s)^<s>\[(.*?)\]\n(.*)$"


def escaped(text: Column) -> Column:
    for plain, code in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescaped(text: Column) -> Column:
    for plain, code in reversed(ESCAPES):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def _transcripts(turns: DataFrame) -> DataFrame:
    """conv_id and its turns in order, each with its role, escaped text and rendered segment."""
    turn = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("turn"))
    whole = rows.filter("conv_id is not null").groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    apart = rows.filter("conv_id is null").select("conv_id", F.array("turn").alias("turns"))
    coded = F.transform("turns", lambda t: F.struct((t["role"] == ASSISTANT).alias("spoken"), escaped(t["role"]).alias("role"), escaped(t["text"]).alias("text")))
    segment = lambda t: F.struct(t["spoken"].alias("spoken"), F.length(t["text"]).alias("chars"), F.concat(F.lit("<s>["), t["role"], F.lit("]\n"), t["text"], F.lit(END)).alias("segment"))
    return whole.unionByName(apart).select("conv_id", coded.alias("turns")).select("conv_id", F.transform("turns", segment).alias("turns"))


def examples(turns: DataFrame) -> DataFrame:
    """conv_id, position, text, loss_start, loss_end, last: one row for each assistant turn, with all turns before it.

    Only the characters loss_start:loss_end of the text are trainable. `last` marks the row that holds the whole conversation.
    """
    found = _transcripts(turns)
    n = F.size("turns")
    targets = F.filter(F.sequence(F.lit(1), n), lambda i: F.get("turns", i - 1)["spoken"] | (i == n))
    found = found.select("conv_id", "turns", F.explode(targets).alias("position"))
    target = F.get("turns", F.col("position") - 1)
    text = F.array_join(F.transform(F.slice("turns", 1, F.col("position")), lambda t: t["segment"]), "")
    found = found.select("conv_id", F.col("position").cast("long").alias("position"), text.alias("text"), target["spoken"].alias("spoken"), target["chars"].alias("chars"), (F.col("position") == n).alias("last"))
    end = F.length("text").cast("long") - len(END)
    return found.select("conv_id", "position", "text", F.when(F.col("spoken"), end - F.col("chars")).otherwise(end).alias("loss_start"), end.alias("loss_end"), "last")


def read_back(rows: DataFrame) -> DataFrame:
    """Turns and trainable text as parsed from the examples alone: turns from the text of the last one, trainable text by all loss ranges.

    formatted_chars adds up the characters of all examples. The rows of a conversation meet in one group, for its
    digests are of all its turns in order; of the contexts only the last one is sent there.
    """
    loss = unescaped(F.substring(F.col("text"), (F.col("loss_start") + 1).cast("int"), (F.col("loss_end") - F.col("loss_start")).cast("int")))
    seen = rows.select("conv_id", "position", loss.alias("loss"), F.when(F.col("last"), F.col("text")).alias("whole"), F.length("text").cast("long").alias("chars"))
    grouped = seen.filter("conv_id is not null").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("position", "loss"))).alias("losses"), F.max("whole").alias("whole"), F.sum("chars").alias("formatted_chars"))
    apart = seen.filter("conv_id is null").select("conv_id", F.array(F.struct("position", "loss")).alias("losses"), "whole", F.col("chars").alias("formatted_chars"))
    segments = F.slice(F.split("whole", END), 1, F.size(F.split("whole", END)) - 1)
    found = grouped.unionByName(apart).select("conv_id", segments.alias("segments"), F.array_join(F.transform("losses", lambda x: x["loss"]), "").alias("loss"), "formatted_chars")
    turn = lambda x: F.concat(unescaped(F.regexp_extract(x, SEGMENT, 1)), F.lit("\n"), unescaped(F.regexp_extract(x, SEGMENT, 2)), F.lit("\n"))
    text = F.array_join(F.transform("segments", turn), "")
    return found.select("conv_id", F.size("segments").cast("long").alias("n_turns"), F.sha2(text, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")
