"""Relational chat formatting: Spark expressions only.

The turns of a conversation are collected as structs and sorted, neighbours of the same role are merged, and the
messages are concatenated:

    <|im_start|>role\\ntext<|im_sep|>next text of that role<|im_end|>\\n

Inside texts and roles every "<|" gets a backslash after its "<", and what already has backslashes there one more; that
is taken back exactly by reading. The loss mask are the places of the assistant's texts, without marks and separators.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelmill.llm.expressions import CUT, chunks, let, running_sum

START, SEPARATOR, STOP = "<|im_start|>", "<|im_sep|>", "<|im_end|>\n"
LEARNT_ROLE = "assistant"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def _role_out(role: Column) -> Column:
    return escaped(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def _role_in(role: Column) -> Column:
    return F.replace(F.replace(unescaped(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def _joined(parts: Column, by: str = "") -> Column:
    return F.array_join(parts, by)


def formatted(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row for each conversation: its id, text (formatted) and loss, an array of (start, length) in code points.

    Turns are in the order of turn, then role, then text, nulls first; a null role or text counts as empty, a null id
    is a conversation of its own. Repeated rows are turns of their own. Other columns aren't read. A conversation is one
    row of the result, so its size is that of the conversation; nothing else is gathered.
    """
    turn = F.struct(turns[turn_col].alias("turn"), F.coalesce(turns[role_col], F.lit("")).alias("role"), F.coalesce(turns[text_col], F.lit("")).alias("text"))
    grouped = turns.select(turns[conv_col].alias("conv"), turn.alias("x")).groupBy("conv").agg(F.sort_array(F.collect_list("x")).alias("turns"))
    starts = F.filter(F.sequence(F.lit(1), F.size("turns")), lambda i: (i == 1) | (F.get("turns", i - 1)["role"] != F.get("turns", i - 2)["role"]))
    ends = F.concat(F.slice("starts", 2, F.size("starts")), F.array(F.size("turns") + 1))
    runs = F.zip_with("starts", "ends", lambda a, b: F.slice("turns", a, b - a))
    messages = F.transform(
        "runs",
        lambda run: F.struct(
            F.concat(F.lit(START), _role_out(F.get(run, F.lit(0))["role"]), F.lit("\n")).alias("head"),
            F.transform(run, lambda x: escaped(x["text"])).alias("texts"),
            (F.get(run, F.lit(0))["role"] == LEARNT_ROLE).alias("learnt"),
        ),
    )
    text = _joined(F.transform("messages", lambda m: F.concat(m["head"], _joined(m["texts"], SEPARATOR), F.lit(STOP))))
    # the pieces between which nothing is learnt: before a text, its length, after it
    pieces = F.flatten(
        F.transform(
            "messages",
            lambda m: F.transform(
                m["texts"],
                lambda t, i: F.struct(
                    F.when(i == 0, F.length(m["head"])).otherwise(F.lit(len(SEPARATOR))).alias("before"),
                    F.length(t).alias("length"),
                    F.when(i == F.size(m["texts"]) - 1, F.lit(len(STOP))).otherwise(F.lit(0)).alias("after"),
                    m["learnt"].alias("learnt"),
                ),
            ),
        )
    )
    # where each text ends, from the lengths of all pieces up to it
    upto = running_sum(F.transform("pieces", lambda p: p["before"] + p["length"] + p["after"]))
    placed = F.zip_with("pieces", upto, lambda p, e: F.struct((e - p["after"] - p["length"]).alias("start"), p["length"].alias("length"), p["learnt"].alias("learnt")))
    spans = F.transform(F.filter(placed, lambda s: s["learnt"]), lambda s: F.struct(s["start"].alias("start"), s["length"].alias("length")))
    out = grouped.withColumn("starts", starts).withColumn("ends", ends).withColumn("runs", runs).withColumn("messages", messages)
    out = out.withColumn("text", text).withColumn("pieces", pieces)
    return out.select(F.col("conv").alias(conv_col), "text", spans.alias("loss"))


def turns_of(text: Column) -> Column:
    """The turns (role, text) of a formatted conversation."""
    messages = F.slice(F.split(text, r"<\|im_start\|>", -1), 2, F.length(text) + 1)
    parts = F.transform(messages, lambda m: F.struct(m.alias("m"), F.length(F.substring_index(m, "\n", 1)).alias("n")))
    return F.flatten(
        F.transform(
            parts,
            lambda p: F.transform(
                F.split(p["m"].substr(p["n"] + 2, F.length(p["m"]) - p["n"] - 1 - len(STOP)), r"<\|im_sep\|>", -1),
                lambda t: F.struct(_role_in(p["m"].substr(F.lit(1), p["n"])).alias("role"), unescaped(t).alias("text")),
            ),
        )
    )


def loss_text_of(text: Column, loss: Column) -> Column:
    """All text under the mask, unescaped. The text is cut up by CUT spans at a time, since a place in it is found from its beginning."""

    def part(group: Column) -> Column:
        first = F.get(group, F.lit(0))["start"]
        last = F.get(group, F.size(group) - 1)
        stretch = text.substr(first + 1, last["start"] + last["length"] - first)
        return let(stretch, lambda t: F.array_join(F.transform(group, lambda s: unescaped(t.substr(s["start"] - first + 1, s["length"]))), ""))

    return F.when(F.size(loss) > 0, _joined(F.transform(chunks(loss, CUT), part))).otherwise(F.lit(""))
