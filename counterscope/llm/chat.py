"""Chat formatting by prefix-target expansion, in DataFrame functions only.

Every assistant turn becomes an example of its own: all turns before it as context, and only its text is
trainable. Turns after the last assistant turn go out once, as an example without a trainable part, so that
every turn is in the output and can be read back.

The template is ``<|im_start|>role\\ntext<|im_end|>\\n`` for each turn. In roles and texts a backslash becomes
two, ``<|`` becomes ``<\\|`` and, in roles only, a line break becomes backslash n; so no control string can
occur inside them, and reading back is unambiguous.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"


def escaped(text: Column, role: bool = False) -> Column:
    text = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))
    return F.replace(text, F.lit("\n"), F.lit("\\n")) if role else text


def unescaped(text: Column, role: bool = False) -> Column:
    """Undo ``escaped``. Escapes begin with a single backslash, so splitting at pairs of them is unambiguous."""

    def plain(part: Column) -> Column:
        part = F.replace(part, F.lit("\\|"), F.lit("|"))
        return F.replace(part, F.lit("\\n"), F.lit("\n")) if role else part

    return F.array_join(F.transform(F.split(text, r"\\\\"), plain), "\\")


def chat_examples(turns: DataFrame) -> DataFrame:
    """Examples (conv_id, example, formatted, loss_start, loss_length) of conversations (conv_id, turn, role, text).

    ``loss_start`` counts characters from 0 and ``loss_length`` is the trainable reply as escaped; an
    example without a reply has length 0. Null roles and texts count as empty. Turns are ordered by turn, nulls first, ties by role and then
    text; repeated rows are turns of their own. Rows with null conv_id form one conversation. A conversation
    is one row, as an example holds all turns before its reply, so conversations and texts are as long as a row can be. An empty
    table gives no rows; other columns, whatever their names, are not read.
    """
    blank = F.lit("")
    turn = F.struct(
        F.col("turn").alias("turn"), F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text")
    )
    ordered = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    piece = F.transform(
        "turns",
        lambda t: F.struct(
            (t["role"] == "assistant").alias("reply"),
            F.concat(F.lit(START), escaped(t["role"], True), F.lit("\n"), escaped(t["text"]), F.lit(END)).alias("piece"),
            F.length(escaped(t["text"])).alias("size"),
        ),
    )
    numbers = F.sequence(F.lit(0), F.size("pieces") - 1)
    ends = F.filter(numbers, lambda i: F.col("pieces")[i]["reply"] | (i == F.size("pieces") - 1))
    examples = ordered.select("conv_id", piece.alias("pieces")).select("conv_id", "pieces", F.posexplode(ends).alias("example", "at"))
    last = F.col("pieces")[F.col("at")]
    pieces = F.transform(F.slice("pieces", F.lit(1), F.col("at") + 1), lambda p: p["piece"])
    size = F.when(last["reply"], last["size"]).otherwise(0)
    formatted = F.array_join(pieces, "")
    return examples.select("conv_id", "example", formatted.alias("formatted"), size.alias("loss_length")).select(
        "conv_id",
        "example",
        "formatted",
        F.when(F.col("loss_length") > 0, F.length("formatted") - len(END) - F.col("loss_length")).otherwise(0).alias("loss_start"),
        "loss_length",
    )


def turns_of(formatted: Column) -> Column:
    """Read the turns (role, text) back from a formatted example."""
    parts = F.filter(F.split(formatted, r"<\|im_start\|>"), lambda p: p != "")

    def read(part: Column) -> Column:
        body = F.substring(part, F.lit(1), F.length(part) - len(END))
        cut = F.instr(body, "\n") if isinstance(body, str) else F.locate("\n", body)
        return F.struct(
            unescaped(F.substring(body, F.lit(1), cut - 1), True).alias("role"),
            unescaped(F.substring(body, cut + 1, F.length(body))).alias("text"),
        )

    return F.transform(parts, read)


def chat_digest(examples: DataFrame) -> DataFrame:
    """One row per conversation, all of it read back from its examples: counts and digests of turns and loss text."""
    loss = F.expr("substring(formatted, loss_start + 1, loss_length)")
    part = F.struct("example", unescaped(loss).alias("text"))
    read = examples.groupBy("conv_id").agg(
        F.max_by("formatted", "example").alias("longest"),
        F.array_sort(F.collect_list(part)).alias("replies"),
        F.sum(F.length("formatted")).cast("long").alias("formatted_chars"),
    )
    read = read.select(
        "conv_id",
        turns_of(F.col("longest")).alias("turns"),
        F.array_join(F.transform("replies", lambda r: r["text"]), "").alias("loss"),
        "formatted_chars",
    )
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss"), 256).alias("loss_sha256"),
        "formatted_chars",
    )
