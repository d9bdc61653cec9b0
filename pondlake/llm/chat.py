"""Chat formatting in DataFrame functions only.

The turns of a conversation are collected as structs and sorted; adjacent turns
of one role become one block (array slices between the places where the role
changes), and the blocks are concatenated. The template:

    <s> [SYS]system [INST]user [/INST]assistant [ROLE]name[TEXT]any other </s>

(without the blanks shown). A block's further turns are marked ``[+INST]`` and so
on, so the turns can be read back one by one. A control string inside a text gets
a backslash after its first character, and one more if it has some there already,
so escaping is reversible and no text can hold a mark.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<s>", "</s>"
MARKS = {"system": "SYS", "user": "INST", "assistant": "/INST"}
_TAIL = r"(?:/?s>)"
_NAME = r"(?:(?:\+?/?INST|\+?SYS|\+?ROLE|TEXT)\])"
_ESCAPE = rf"(<(?=\\*{_TAIL})|\[(?=\\*{_NAME}))"
_UNESCAPE = rf"(<(?=\\+{_TAIL})|\[(?=\\+{_NAME}))\\"
_TURN = r"\[(?:\+?/?INST|\+?SYS|\+?ROLE)\]"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPE, r"$1\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, _UNESCAPE, "$1")


def _mark(role: Column, more: str) -> Column:
    """The control string that opens a turn of ``role``; ``more`` is + inside a block."""
    known = F.when(role == "system", f"[{more}SYS]").when(role == "user", f"[{more}INST]") \
             .when(role == "assistant", f"[{more}/INST]")
    return F.coalesce(known, F.concat(F.lit(f"[{more}ROLE]"), escaped(role), F.lit("[TEXT]")))


def format_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                 text_col: str = "text") -> DataFrame:
    """One row per conversation: ``conv_id, formatted, segments``.

    ``segments`` are structs ``(text, loss)`` whose texts make up ``formatted`` in
    order; ``loss`` is the mask, true for assistant texts alone. Null text and null
    role count as empty; rows without a turn number come last; rows of one turn
    number go by role, then text; repeated rows are turns of their own; rows with
    a null conversation id form one conversation. Other columns are not read.
    """
    row = F.struct(F.col(turn_col).isNull().alias("last"), F.col(turn_col).alias("turn"),
                   F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
                   F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    chats = turns.groupBy(F.col(conv_col).alias("conv_id")).agg(F.array_sort(F.collect_list(row)).alias("turns"))
    # where a block begins, and after the last block
    begins = F.expr("filter(sequence(1, size(turns)), i -> i = 1 or turns[i - 1].role <> turns[i - 2].role)")
    chats = chats.withColumn("begins", begins)
    blocks = F.expr("transform(begins, (b, j) -> slice(turns, b, case when j + 1 < size(begins)"
                    " then begins[j + 1] else size(turns) + 1 end - b))")

    def segments(block: Column) -> Column:
        def turn(t: Column, i: Column) -> Column:
            mark = F.when(i == 0, _mark(t["role"], "")).otherwise(_mark(t["role"], "+"))
            return F.array(F.struct(mark.alias("text"), F.lit(False).alias("loss")),
                           F.struct(escaped(t["text"]).alias("text"), (t["role"] == "assistant").alias("loss")))
        return F.flatten(F.transform(block, turn))

    edge = lambda s: F.array(F.struct(F.lit(s).alias("text"), F.lit(False).alias("loss")))
    body = F.concat(edge(OPEN), F.flatten(F.transform(blocks, segments)), edge(CLOSE))
    chats = chats.select("conv_id", body.alias("segments"))
    return chats.select("conv_id", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments")


def read_back(chats: DataFrame) -> DataFrame:
    """``conv_id, formatted, turns, loss_text`` of ``format_chats`` output: the turns
    (structs ``role, text``) parsed from ``formatted``, and the unescaped text under
    the loss mask."""
    body = F.expr(f"substring(formatted, {len(OPEN) + 1}, length(formatted) - {len(OPEN) + len(CLOSE)})")
    chats = chats.withColumn("body", body).select(
        "conv_id", "formatted", "segments", F.regexp_extract_all("body", F.lit(f"({_TURN})"), 1).alias("marks"),
        F.split("body", _TURN, -1).alias("parts"))
    pairs = F.arrays_zip(F.col("marks").alias("mark"), F.expr("slice(parts, 2, size(parts))").alias("rest"))

    def turn(p: Column) -> Column:
        mark, rest = F.translate(p["mark"], "+", ""), p["rest"]
        other = mark == "[ROLE]"
        role = F.when(mark == "[SYS]", "system").when(mark == "[INST]", "user").when(mark == "[/INST]", "assistant") \
                .otherwise(unescaped(F.substring_index(rest, "[TEXT]", 1)))
        text = F.when(other, F.substring_index(rest, "[TEXT]", -1)).otherwise(rest)  # the only [TEXT] in it
        return F.struct(role.alias("role"), unescaped(text).alias("text"))

    loss = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescaped(s["text"])), "")
    return chats.select("conv_id", "formatted", F.transform(pairs, turn).alias("turns"), loss.alias("loss_text"))

