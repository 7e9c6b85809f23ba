"""Chat formatting in budgeted, turn-aligned windows with a loss mask, in DataFrame operations only.

A turn is written ``### role: text</turn>`` and a line end. Inside texts and
roles a backslash becomes ``\\b``, ``#`` ``\\h``, ``<`` ``\\l`` (and ``:`` ``\\c`` in
roles), so neither marker can occur there and each text can be restored.

Windows: the prefix sums of a conversation's turn tokens (about one for
``chars_per_token`` characters, plus ``turn_tokens`` for the markers) put the
turn that starts at token c into window c div ``budget``. Each later window
first repeats the system turn and the turns that start at most ``history``
tokens before its first one; what is repeated is masked, so every assistant text
bears loss exactly once. Turns are never cut: a window ends with the turn that
crosses its budget.

Defined cases: null text or role is empty; rows of a conversation go by turn
(null last), equal turns by role and text; repeated rows are turns of their own;
a null conversation id is a conversation; an empty table gives no windows.
A conversation of any length is windowed in blocks of ``BLOCK`` turn numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage, with_uid

OPEN, MIDDLE, CLOSE = "### ", ": ", "</turn>\n"
BLOCK = 256
#: Control characters and what stands for them; the backslash is escaped first and restored last.
_ESCAPES = [("\\", "\\b"), ("#", "\\h"), ("<", "\\l")]


def escape(text: Column, role: bool = False) -> Column:
    for raw, safe in _ESCAPES + [(":", "\\c")] * role:
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def unescape(text: Column) -> Column:
    for raw, safe in [(":", "\\c"), *reversed(_ESCAPES)]:
        text = F.replace(text, F.lit(safe), F.lit(raw))
    return text


def _prefix(rows: DataFrame) -> DataFrame:
    """``pos`` and ``start``: turns and tokens before each turn, from sums of blocks and sums within a block."""
    rows = rows.withColumn("blk", F.floor(F.coalesce("turn", F.lit(2**62)) / BLOCK))
    whole = Window.partitionBy("key").orderBy("blk")
    sums = rows.groupBy("key", "blk").agg(F.count("*").alias("m"), F.sum("tok").alias("t"))
    sums = sums.select("key", "blk", (F.sum("m").over(whole) - F.col("m")).alias("m0"), (F.sum("t").over(whole) - F.col("t")).alias("t0"))
    inner = Window.partitionBy("key", "blk").orderBy(F.col("turn").asc_nulls_last(), "role", "text", "uid")
    return (rows.withColumn("i", F.row_number().over(inner) - 1).withColumn("s", F.sum("tok").over(inner) - F.col("tok"))
            .join(sums, ["key", "blk"]).withColumn("pos", F.col("m0") + F.col("i")).withColumn("start", F.col("t0") + F.col("s")))


def windows(chats: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
            budget: int = 1024, history: int = 256, chars_per_token: int = 4, turn_tokens: int = 4) -> DataFrame:
    """(conv, window, text, repeated, mask): ``repeated`` leading turns were in earlier windows,
    ``mask`` holds (start, length) in characters of the texts that bear loss."""
    if not 0 <= history <= budget:
        raise ValueError("history must not exceed the budget")
    rows = with_uid(chats.select(
        F.coalesce(F.concat(F.lit("="), F.col(conv_col).cast("string")), F.lit("null")).alias("key"), F.col(conv_col).alias("conv"),
        F.col(turn_col).cast("bigint").alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text")))
    rows = rows.withColumn("tok", F.ceil(F.length("text") / chars_per_token) + turn_tokens)
    turns = _prefix(rows).select(
        "key", "conv", "pos", "start", "role", F.floor(F.col("start") / budget).alias("window"),
        F.concat(F.lit(OPEN), escape(F.col("role"), role=True), F.lit(MIDDLE)).alias("head"), escape(F.col("text")).alias("body"))
    turns = stage(turns, "chat-turns")
    spans = turns.groupBy("key", "window").agg(F.min("start").alias("from"))

    target = turns.select("key", "conv", "window", F.lit(2).alias("kind"), "pos", "head", "body", (F.col("role") == "assistant").alias("loss"))
    earlier = turns.withColumn("window", F.col("window") + 1).join(spans, ["key", "window"])
    past = (earlier.filter(F.col("from") - F.col("start") <= history)
            .select("key", "conv", "window", F.lit(1).alias("kind"), "pos", "head", "body", F.lit(False).alias("loss")))
    system = turns.filter("pos = 0 AND role = 'system'").select("key", "conv", "head", "body", "pos", F.col("window").alias("own"))
    kept = (spans.join(system, "key").filter("window > own")
            .filter(~((F.col("window") == F.col("own") + 1) & (F.col("from") <= history)))  # there it is in the history
            .select("key", "conv", "window", F.lit(0).alias("kind"), "pos", "head", "body", F.lit(False).alias("loss")))
    every = target.union(past).union(kept).withColumn("piece", F.concat("head", "body", F.lit(CLOSE)))
    within = Window.partitionBy("key", "window").orderBy("kind", "pos")
    every = every.withColumn("at", F.sum(F.length("piece")).over(within) - F.length("piece") + F.length("head"))
    out = every.groupBy("key", "window").agg(
        F.first("conv").alias("conv"), F.sort_array(F.collect_list(F.struct("kind", "pos", "piece"))).alias("pieces"),
        F.count(F.when(F.col("kind") < 2, 1)).cast("int").alias("repeated"),
        F.sort_array(F.collect_list(F.when(F.col("loss"), F.struct(F.col("at").alias("start"), F.length("body").alias("length"))))).alias("mask"))
    return out.select("conv", "window", F.array_join(F.col("pieces.piece"), "").alias("text"), "repeated", "mask")


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv, n_turns, turns, loss, formatted_chars) restored from the windows alone.

    ``turns`` holds role, line end, text, line end of every turn; ``loss`` all text under the masks.
    """
    pieces = F.filter(F.split("text", CLOSE, -1), lambda p: p != "")
    turn = lambda p: F.concat(
        unescape(F.substr(F.substring_index(p, ":", 1), F.lit(len(OPEN) + 1))), F.lit("\n"),
        unescape(F.substr(p, F.length(F.substring_index(p, ":", 1)) + len(MIDDLE) + 1)), F.lit("\n"))
    per = formatted.withColumn("p", pieces).select(
        "conv", "window", F.length("text").alias("chars"), (F.size("p") - F.col("repeated")).alias("n"),
        F.array_join(F.transform(F.expr("slice(p, repeated + 1, size(p))"), turn), "").alias("t"),
        F.array_join(F.transform("mask", lambda m: unescape(F.substr(F.col("text"), (m["start"] + 1).cast("int"), m["length"]))), "").alias("l"))
    parts = per.groupBy("conv").agg(F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"),
                                    F.sort_array(F.collect_list(F.struct("window", "t", "l"))).alias("w"))
    return parts.select("conv", "n_turns", F.array_join(F.col("w.t"), "").alias("turns"),
                        F.array_join(F.col("w.l"), "").alias("loss"), "formatted_chars")
