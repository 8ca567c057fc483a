"""Chat formatting: conversations as one training text each, with a loss mask, and back.

A run of turns with one role has one header: ``<|turn:role|>`` text ``<|and|>`` text ``<|end|>``. Every control string starts with
``<|`` and a header's role ends at ``|>``. Texts and roles are escaped so that they never hold either: a backslash is doubled, then
``<|`` becomes ``<\\|`` and ``|>`` becomes ``|\\>``. The steps are undone in reverse order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, CLOSE, AND, END = "<|turn:", "|>", "<|and|>", "<|end|>\n"
#: Turns whose spans one fold gathers, and code points of a piece of text that spans are read from: long conversations go by blocks, since
#: a fold copies what it has gathered at every turn and a place in a text is found by counting from its start.
BLOCK, CHUNK = 128, 1024


def escape(c: Column) -> Column:
    doubled = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(doubled, F.lit("<|"), F.lit("<\\|")), F.lit("|>"), F.lit("|\\>"))


def unescape(c: Column) -> Column:
    opened = F.replace(F.replace(c, F.lit("|\\>"), F.lit("|>")), F.lit("<\\|"), F.lit("<|"))
    return F.replace(opened, F.lit("\\\\"), F.lit("\\"))


def _block_spans(block: Column) -> Column:
    """Length of a block of pieces and the spans in it, counted from its start."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))
    return F.aggregate(block, start, lambda a, p: F.struct(
        (a["at"] + F.length(p["before"]) + F.length(p["body"]) + F.length(p["after"])).alias("at"),
        F.when(p["loss"], F.concat(a["spans"], F.array(F.struct(
            (a["at"] + F.length(p["before"])).alias("start"), F.length(p["body"]).alias("length"))))).otherwise(a["spans"]).alias("spans")))


def format_chats(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
                 learned: str = "assistant") -> DataFrame:
    """``conv_id, formatted, loss_spans``: one row per conversation.

    Turns are ordered by number; null numbers come first, equal ones are ordered by role and text, repeated rows stay.
    A null text or role counts as empty, a null conversation is one conversation. ``loss_spans`` holds start (from 0) and length, in code points of
    ``formatted``, of each text whose role is ``learned``, control strings left out. An empty table gives no row.
    """
    rows = turns.select(
        F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text"))
    sorted_turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    item = lambda i: F.get(F.col("t"), i)
    # one struct per turn: what stands before its text, the text, what stands after it
    pieces = F.transform(F.col("t"), lambda x, i: F.struct(
        F.when((i > 0) & (item(i - 1)["role"] == x["role"]), F.lit(AND))
        .otherwise(F.concat(F.lit(TURN), escape(x["role"]), F.lit(CLOSE))).alias("before"),
        escape(x["text"]).alias("body"),
        F.when(item(i + 1)["role"] == x["role"], F.lit("")).otherwise(F.lit(END)).alias("after"),
        (x["role"] == learned).alias("loss")))
    n = F.size("pieces")
    blocks = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / BLOCK).cast("int")), lambda b: F.transform(
        F.sequence(b * BLOCK, F.least((b + 1) * BLOCK, n) - 1), lambda i: F.get(F.col("pieces"), i)))
    done = F.transform(blocks, _block_spans)
    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
    starts = F.aggregate("done", none, lambda a, d: F.struct(
        (a["at"] + d["at"]).alias("at"), F.concat(a["starts"], F.array(a["at"])).alias("starts")), lambda a: a["starts"])
    spans = F.flatten(F.zip_with("done", starts, lambda d, s: F.transform(
        d["spans"], lambda x: F.struct((x["start"] + s).alias("start"), x["length"].alias("length")))))
    texts = F.array_join(F.transform("pieces", lambda p: F.concat(p["before"], p["body"], p["after"])), "")
    return (sorted_turns.select("conv_id", pieces.alias("pieces")).select("conv_id", "pieces", done.alias("done"))
            .select("conv_id", texts.alias("formatted"), spans.alias("loss_spans")))


def read_chats(formatted: DataFrame) -> DataFrame:
    """``conv_id, formatted, turns, loss_text`` read back from ``conv_id, formatted, loss_spans``; turns are structs of role and text."""
    runs = F.split(F.col("formatted"), r"<\|end\|>\n")
    blocks = F.slice(runs, 1, F.size(runs) - 1)  # the last end mark is followed by nothing
    role = lambda b: F.substring_index(F.substring(b, len(TURN) + 1, F.length(b)), CLOSE, 1)
    body = lambda b: F.substring(b, len(TURN) + len(CLOSE) + F.length(role(b)) + 1, F.length(b))
    turns = F.flatten(F.transform(blocks, lambda b: F.transform(
        F.split(body(b), r"<\|and\|>"), lambda t: F.struct(unescape(role(b)).alias("role"), unescape(t).alias("text")))))
    chunks = F.regexp_extract_all("formatted", F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))

    def span(s: Column) -> Column:
        first = F.floor(s["start"] / CHUNK).cast("int")
        # a second mention of the chunks, so that they stay a column of their own and are not cut anew for every span
        last = F.least(F.size("chunks") - 1, F.greatest(first, F.floor((s["start"] + s["length"] - 1) / CHUNK).cast("int")))
        near = F.array_join(F.transform(F.sequence(first, last), lambda c: F.get(F.col("chunks"), c)), "")
        return F.substring(near, s["start"] - first * CHUNK + 1, s["length"])

    loss = F.array_join(F.transform("loss_spans", lambda s: unescape(span(s))), "")
    return (formatted.select("conv_id", "formatted", "loss_spans", chunks.alias("chunks"))
            .select("conv_id", "formatted", turns.alias("turns"), loss.alias("loss_text")))
