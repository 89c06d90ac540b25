"""Chat formatting by prefix-target expansion, in DataFrame functions only.

Every assistant turn becomes an example: all preceding turns as context, that reply alone trainable. Turns after the last
reply stay as one example without a target, so nothing of a conversation is lost.

Template of a turn: `<|im_start|>role\\ntext<|im_end|>\\n`. Inside roles and texts `\\` is written `\\s`, `<|` is written `<\\p`,
and in roles a line end is written `\\n`; every backslash of the output is then followed by s, p or n, so reading back is exact.

Defined results: null text or role is an empty string. Turns are ordered by turn, role, text (nulls first), so ties and
repeated rows keep every row and give one order. Rows with a null conv_id form one conversation. An empty table gives no
rows; further columns are ignored. A conversation is one example string, so its turns must fit in a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

START, END = "<|im_start|>", "<|im_end|>\n"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\s")), F.lit("<|"), F.lit("<\\p"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\p"), F.lit("<|")), F.lit("\\s"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("\\n"), F.lit("\n")))


def expand(turns: DataFrame) -> DataFrame:
    """turns (conv_id, turn, role, text) to examples (conv_id, example_no, text, loss_start, loss_chars).

    loss_start and loss_chars are the code points of text under the loss mask (null and 0 for the example without target).
    """
    one = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    grouped = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(one)).alias("turns"))
    shown = F.transform(
        "turns",
        lambda t: F.struct(
            (t["role"] == "assistant").alias("reply"),
            F.concat(F.lit(START), escape_role(t["role"]), F.lit("\n")).alias("head"),
            escape(t["text"]).alias("body"),
        ),
    )
    n = F.size("shown")
    ends = F.filter(F.sequence(F.lit(1), n), lambda i: F.element_at("shown", i)["reply"] | (i == n))
    exploded = grouped.select("conv_id", shown.alias("shown")).select("conv_id", "shown", F.posexplode(ends).alias("example_no", "last"))
    target = F.element_at("shown", F.col("last"))
    context = F.array_join(F.transform(F.slice("shown", F.lit(1), F.col("last") - 1), lambda t: F.concat(t["head"], t["body"], F.lit(END))), "")
    parts = exploded.select("conv_id", "example_no", context.alias("context"), target.alias("t"))
    reply = F.col("t.reply")
    return parts.select(
        "conv_id",
        "example_no",
        F.concat("context", F.col("t.head"), F.col("t.body"), F.lit(END)).alias("text"),
        F.when(reply, F.char_length("context") + F.char_length(F.col("t.head"))).alias("loss_start"),
        F.when(reply, F.char_length(F.col("t.body"))).otherwise(0).alias("loss_chars"),
    )


def parse(text: Column) -> Column:
    """Formatted text back to array<struct<role, text>>, from the text alone."""
    pieces = F.filter(F.split(text, r"<\|im_end\|>\n"), lambda p: p != "")
    return F.transform(
        F.transform(pieces, lambda p: F.substring(p, len(START) + 1, 2**31 - 1)),
        lambda p: F.struct(
            unescape_role(F.substring_index(p, "\n", 1)).alias("role"), unescape(F.substring(p, F.locate("\n", p) + 1, F.lit(2**31 - 1))).alias("text")
        ),
    )


def masked(text: Column, start: Column, length: Column) -> Column:
    """The unescaped text under an example's loss mask."""
    return F.when(start.isNull(), F.lit("")).otherwise(unescape(F.substring(text, start + 1, length)))


def digest(examples: DataFrame) -> DataFrame:
    """Per conversation, read back from its examples: turns of the longest one, and all text under the loss masks in order."""
    loss = masked(F.col("text"), F.col("loss_start"), F.col("loss_chars"))
    folded = (
        examples.groupBy("conv_id")
        .agg(
            F.max_by("text", "example_no").alias("whole"),
            F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("example_no", loss.alias("loss")))), lambda x: x["loss"]), "").alias("loss"),
            F.sum(F.char_length("text").cast("long")).alias("formatted_chars"),
        )
        .withColumn("turns", parse(F.col("whole")))
    )
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return folded.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )
