"""Chat formatting: prefix-target examples, in DataFrame functions only."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"


def escape(text: Column) -> Column:
    r"""Add one backslash inside every ``<`` ``\``\* ``|``, so no control string is left in ``text``."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    for a, b in (("%", "%25"), ("\n", "%0A"), ("<", "%3C")):
        role = F.replace(role, F.lit(a), F.lit(b))
    return role


def unescape_role(role: Column) -> Column:
    for a, b in (("<", "%3C"), ("\n", "%0A"), ("%", "%25")):
        role = F.replace(role, F.lit(b), F.lit(a))
    return role


def format_conversations(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: ``conv_id, formatted, targets`` (array of start, end of each assistant text).

    Offsets are code points into ``formatted``. Turns follow ``turn``, then role and text where turns tie; a
    repeated row is a turn of its own; null role and text are empty; a null id is a conversation; an empty table
    gives none; other columns are ignored. Later text never changes earlier text, so an example is a prefix.
    """
    rows = df.select(df[conv_col].alias("conv_id"), df[turn_col].alias("turn"), F.coalesce(df[role_col].cast("string"), F.lit("")).alias("role"), F.coalesce(df[text_col].cast("string"), F.lit("")).alias("text"))
    head = F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"))
    rows = rows.select("conv_id", "turn", "role", "text", head.alias("head"), escape(F.col("text")).alias("body"))
    rows = rows.withColumn("segment", F.concat("head", "body", F.lit(END + "\n")))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = rows.select("conv_id", "role", "segment", F.length("head").alias("h"), F.length("body").alias("b"), F.row_number().over(order).alias("ord"), F.sum(F.length("segment").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("stop"))
    start = F.col("stop") - F.length("segment") + F.col("h")
    turn = F.struct("ord", "segment", (F.col("role") == "assistant").alias("target"), start.alias("start"), (start + F.col("b")).alias("end"))
    turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    return turns.select("conv_id", F.array_join(F.transform("turns", lambda t: t["segment"]), "").alias("formatted"), F.transform(F.filter("turns", lambda t: t["target"]), lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"))).alias("targets"))


def prefix_targets(formatted: DataFrame) -> DataFrame:
    """One example per assistant turn: ``conv_id, example, text, loss_start, loss_end``.

    ``text`` has all turns up to the reply; only code points [loss_start, loss_end) are trainable. A conversation
    without assistant turns, and an empty table, have none; an empty reply is an example with nothing to learn; a null
    id stays null; texts of any length are whole; other columns are ignored.
    """
    rows = formatted.select("conv_id", "formatted", F.posexplode("targets").alias("example", "t"))
    return rows.select("conv_id", "example", F.expr("substr(formatted, 1, int(t.end))").alias("text"), F.col("t.start").alias("loss_start"), F.col("t.end").alias("loss_end"))


def loss_text() -> Column:
    """The trainable text of an example, unescaped."""
    return unescape(F.expr("substr(text, int(loss_start) + 1, int(loss_end - loss_start))"))


def parse_turns(formatted: Column) -> Column:
    """Array of (role, text) read back from a formatted conversation."""
    parts = F.filter(F.split(formatted, r"<\|im_end\|>\n"), lambda p: p != "")
    body = lambda p: F.substring(p, len(START) + 1, 2**31 - 1)
    cut = lambda p: F.instr(p, "\n")
    return F.transform(parts, lambda p: F.struct(
        unescape_role(body(p).substr(F.lit(1), cut(body(p)) - 1)).alias("role"),
        unescape(body(p).substr(cut(body(p)) + 1, F.lit(2**31 - 1))).alias("text")))
