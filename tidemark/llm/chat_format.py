"""Chat formatting by Spark expressions only.

The turns of a conversation are collected as structs, sorted, adjacent turns of one role
are merged into a block, and the blocks are concatenated:

    <|im_start|>role NEWLINE text [<|turn|> text ...] <|im_end|> NEWLINE

Inside roles and texts a backslash becomes two and ``<|`` becomes ``<\\|``, so no marker can
be forged and one pass from the left restores the original; a role's newline is ``<|nl|>``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END, TURN, NL = "<|im_start|>", "<|im_end|>\n", "<|turn|>", "<|nl|>"
SEGMENT = "array<struct<text:string,loss:boolean>>"


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def escaped_role(role: Column) -> Column:
    return F.replace(escaped(role), F.lit("\n"), F.lit(NL))


def unescaped_role(role: Column) -> Column:
    return unescaped(F.replace(role, F.lit(NL), F.lit("\n")))


def format_chats(turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", trained_role: str = "assistant") -> DataFrame:
    """One row per conversation: id, ``formatted`` string, ``segments``.

    ``segments`` is the formatted text in pieces, each under the loss mask or not; the
    pieces under it are exactly the escaped texts of ``trained_role``.  Turns are ordered by turn,
    then role, then text, so ties and repeated rows have one order and all stay; a null turn
    comes first, a null role or text is empty, null ids form one conversation.  A conversation is
    one output row, so its turns meet in one task; the group is at most one string long.
    Other columns are not read.  An empty table gives no rows.
    """
    rows = turns.select(
        F.col(conv_col).alias("conv"),
        F.struct(F.col(turn_col).isNotNull().alias("has"), F.coalesce(F.col(turn_col).cast("long"), F.lit(0)).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).alias("t"),
    )
    chats = rows.groupBy("conv").agg(F.array_sort(F.collect_list("t")).alias("ts")).withColumn("n", F.size("ts"))
    at = lambda i: F.get("ts", i)
    firsts = F.filter(F.sequence(F.lit(0), F.col("n") - 1), lambda i: (i == 0) | (at(i)["role"] != F.get("ts", F.greatest(i - 1, F.lit(0)))["role"]))
    chats = chats.withColumn("firsts", firsts)
    until = lambda k: F.coalesce(F.get("firsts", k + 1), F.col("n"))
    blocks = F.transform("firsts", lambda s, k: F.struct(at(s)["role"].alias("role"), F.transform(F.slice("ts", s + 1, until(k) - s), lambda t: t["text"]).alias("texts")))
    plain = lambda text: F.struct(text.alias("text"), F.lit(False).alias("loss"))

    def pieces(block: Column) -> Column:
        texts = F.transform(block["texts"], lambda t, j: F.concat(F.when(j == 0, F.array().cast(SEGMENT)).otherwise(F.array(plain(F.lit(TURN)))), F.array(F.struct(escaped(t).alias("text"), (block["role"] == trained_role).alias("loss")))))
        return F.concat(F.array(plain(F.concat(F.lit(START), escaped_role(block["role"]), F.lit("\n")))), F.flatten(texts), F.array(plain(F.lit(END))))

    chats = chats.select("conv", blocks.alias("blocks")).select("conv", F.flatten(F.transform("blocks", pieces)).alias("segments"))
    return chats.select(F.col("conv").alias(conv_col), F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments")


def read_turns(formatted: Column) -> Column:
    """``array<struct<role, text>>`` read back from a formatted text, merged turns apart again."""
    blocks = F.filter(F.split(formatted, r"<\|im_start\|>"), lambda b: b != "")

    def turns(block: Column) -> Column:
        role = F.substring_index(block, "\n", 1)
        body = F.substring(block, F.length(role) + F.lit(2), F.length(block) - F.length(role) - F.lit(1 + len(END)))
        return F.transform(F.split(body, r"<\|turn\|>", -1), lambda t: F.struct(unescaped_role(role).alias("role"), unescaped(t).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def loss_text(segments: Column) -> Column:
    """The text under the loss mask, unescaped."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescaped(s["text"])), "")
