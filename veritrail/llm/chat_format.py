"""Conversations as training text, with Spark expressions only.

A conversation is ``<s>`` and a block for each run of turns of one role:
``[ROLE]role[/ROLE]text</s>``, where merged turns are set apart by ``[NEXT]``.  Control
strings inside roles and texts get a backslash after their first character, and a
backslash that already follows such a character is doubled, so texts come back exactly.
Loss spans are code-point ranges [start, end) of the assistant's texts.

Defined results: a null role or text is empty; turns of equal number are ordered by role
and text and repeated rows stay; a null turn sorts first; rows with a null conversation
id are one conversation; an empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BEGIN, END, ROLE, ROLE_END, NEXT = "<s>", "</s>", "[ROLE]", "[/ROLE]", "[NEXT]"
#: Control strings of this template and those that chat models commonly reserve.
CONTROL = (BEGIN, END, ROLE, ROLE_END, NEXT, "[INST]", "[/INST]")
LEARNED_ROLE = "assistant"


def _steps() -> list[tuple[str, str]]:
    openers = sorted({c[0] for c in CONTROL})
    return [(f"{o}\\", f"{o}\\\\") for o in openers] + [(c, f"{c[0]}\\{c[1:]}") for c in CONTROL]


def escape(text: Column) -> Column:
    return reduce(lambda t, s: F.replace(t, F.lit(s[0]), F.lit(s[1])), _steps(), text)


def unescape(text: Column) -> Column:
    return reduce(lambda t, s: F.replace(t, F.lit(s[1]), F.lit(s[0])), reversed(_steps()), text)


def format_conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss_spans) from turns (conv_id, turn, role, text).

    A conversation becomes one row, so its turns meet in one task; its size is bounded by
    what a string can hold.
    """
    clean = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("role", "text")]
    grouped = turns.select("conv_id", F.struct("turn", *clean).alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))

    block = "struct<role:string,texts:array<string>>"

    def merge(blocks: Column, t: Column) -> Column:
        last = F.element_at(blocks, -1)
        grown = F.struct(t["role"].alias("role"), F.concat(last["texts"], F.array(t["text"])).alias("texts")).cast(block)
        fresh = F.struct(t["role"].alias("role"), F.array(t["text"]).alias("texts")).cast(block)
        same = (F.size(blocks) > 0) & (F.try_element_at(blocks, F.lit(-1))["role"] == t["role"])
        return F.when(same, F.concat(F.slice(blocks, 1, F.size(blocks) - 1), F.array(grown))).otherwise(F.concat(blocks, F.array(fresh)))

    merged = grouped.select("conv_id", F.aggregate("turns", F.array().cast(f"array<{block}>"), merge).alias("blocks"))

    def piece(text: Column, learned: Column) -> Column:
        return F.struct(text.alias("text"), learned.alias("learned"))

    def pieces(b: Column) -> Column:
        spoken = F.transform(
            b["texts"],
            lambda x, i: F.array(piece(F.when(i > 0, F.lit(NEXT)).otherwise(""), F.lit(False)), piece(escape(x), b["role"] == LEARNED_ROLE)),
        )
        head = piece(F.concat(F.lit(ROLE), escape(b["role"]), F.lit(ROLE_END)), F.lit(False))
        return F.concat(F.array(head), F.flatten(spoken), F.array(piece(F.lit(END), F.lit(False))))

    split = merged.select("conv_id", F.flatten(F.transform("blocks", pieces)).alias("pieces"))
    state = "struct<at:long,spans:array<struct<start:long,end:long>>>"

    def measure(acc: Column, p: Column) -> Column:
        to = acc["at"] + F.length(p["text"])
        spans = F.when(p["learned"], F.concat(acc["spans"], F.array(F.struct(acc["at"].alias("start"), to.alias("end"))))).otherwise(acc["spans"])
        return F.struct(to.alias("at"), spans.alias("spans")).cast(state)

    start = F.struct(F.lit(len(BEGIN)).cast("long").alias("at"), F.array().cast("array<struct<start:long,end:long>>").alias("spans")).cast(state)
    return split.select(
        "conv_id",
        F.concat(F.lit(BEGIN), F.array_join(F.transform("pieces", lambda p: p["text"]), "")).alias("formatted"),
        F.aggregate("pieces", start, measure, lambda acc: acc["spans"]).alias("loss_spans"),
    )


def parse(formatted: Column) -> Column:
    """The turns array<struct<role, text, block>> of a formatted conversation."""
    body = F.substr(formatted, F.lit(len(BEGIN) + 1))
    blocks = F.split(body, "\\Q" + END + "\\E", -1)
    blocks = F.slice(blocks, 1, F.size(blocks) - 1)

    def turns(b: Column, i: Column) -> Column:
        head = F.substring_index(b, ROLE_END, 1)
        role = unescape(F.substr(head, F.lit(len(ROLE) + 1)))
        texts = F.split(F.substr(b, F.length(head) + len(ROLE_END) + 1), "\\Q" + NEXT + "\\E", -1)
        return F.transform(texts, lambda t: F.struct(role.alias("role"), unescape(t).alias("text"), i.alias("block")))

    return F.flatten(F.transform(blocks, turns))


def learned_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order and with nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")
