"""Chat formatting by prefix-target expansion, in DataFrame expressions only.

Every assistant turn becomes an example of its own: all turns before it are
context, and its text alone is trainable (``loss_start``, ``loss_chars``, in
code points of ``formatted``).  Turns that no assistant turn follows would be
in no example, so a conversation that ends otherwise also gives one example of
all its turns with nothing trainable.

The template writes ``<|im_start|>ROLE\\nTEXT<|im_end|>\\n``.  Within texts a
backslash is put before the bar of each ``<|`` (and one more where ``<\\|``
stands already), so a text can't hold a control string and unescaping is
exact.  Roles percent-encode ``%``, ``<`` and line feeds.

Defined cases: a null text or role is empty; turns with equal numbers go by
role and text; null turn numbers come first; rows with a null conv_id form one
conversation; repeated rows are turns of their own; a very long text is written
as a whole; an empty table gives no rows; other columns play no part.  A
conversation has to fit one row, as the example of its last turn does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"


def escape_text(c: Column) -> Column:
    return F.regexp_replace(c, r"<(\\*)\|", r"<\\$1|")


def unescape_text(c: Column) -> Column:
    return F.regexp_replace(c, r"<\\(\\*)\|", r"<$1|")


def escape_role(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("%"), F.lit("%25")), F.lit("<"), F.lit("%3C")), F.lit("\n"), F.lit("%0A"))


def unescape_role(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("%0A"), F.lit("\n")), F.lit("%3C"), F.lit("<")), F.lit("%25"), F.lit("%"))


def expand(conversations: DataFrame) -> DataFrame:
    """One row per example: conv_id, example, formatted, loss_start, loss_chars, is_last."""
    text, role = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("text", "role"))
    turns = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text")).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    # array_sort puts a null turn first, as a struct's null field is smallest.
    piece = lambda t: F.concat(F.lit(START), escape_role(t["role"]), F.lit("\n"), escape_text(t["text"]), F.lit(END))
    n = F.size("turns")
    written = turns.select("conv_id", "turns", F.transform("turns", piece).alias("pieces"), n.alias("n"))
    examples = written.select("conv_id", "pieces", "n", F.explode(F.filter(
        F.transform("turns", lambda t, i: F.struct((i + 1).alias("upto"), (t["role"] == "assistant").alias("trainable"), F.length(escape_text(t["text"])).alias("chars"))),
        lambda x: x["trainable"] | (x["upto"] == n))).alias("x"))
    formatted = F.array_join(F.slice("pieces", F.lit(1), F.col("x.upto")), "")
    return examples.select(
        "conv_id", F.col("x.upto").alias("example"), formatted.alias("formatted"),
        F.when(F.col("x.trainable"), F.length(formatted) - len(END) - F.col("x.chars")).alias("loss_start"),
        F.when(F.col("x.trainable"), F.col("x.chars")).otherwise(0).alias("loss_chars"),
        (F.col("x.upto") == F.col("n")).alias("is_last"))


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted example, as an array of (role, text)."""
    parts = F.split(formatted, r"<\|im_end\|>\n", -1)
    parts = F.slice(parts, F.lit(1), F.size(parts) - 1)
    body = lambda p: F.substring(p, F.lit(len(START) + 1), F.length(p))
    return F.transform(parts, lambda p: F.struct(
        unescape_role(F.substring_index(body(p), "\n", 1)).alias("role"),
        unescape_text(F.substring(body(p), F.locate("\n", body(p)) + 1, F.length(p))).alias("text")))


def read_loss(formatted: Column, start: Column, chars: Column) -> Column:
    """The unescaped text under an example's loss mask."""
    return unescape_text(F.coalesce(F.substring(formatted, start + 1, chars), F.lit("")))


def digest(examples: DataFrame) -> DataFrame:
    """What the examples say, read back from their text alone."""
    turns = read_turns(F.col("formatted"))
    told = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    read = examples.select(
        "conv_id", "example", F.length("formatted").cast("long").alias("chars"),
        F.when(F.col("is_last"), F.size(turns)).cast("long").alias("n_turns"), F.when(F.col("is_last"), F.sha2(told, 256)).alias("turns_sha256"),
        read_loss(F.col("formatted"), F.col("loss_start"), F.col("loss_chars")).alias("loss"))
    # conv_id still partitions the rows, so this needs no further exchange; what is collected is no more than the conversation.
    loss = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("example", "loss"))), lambda x: x["loss"]), "")
    return (read.groupBy("conv_id").agg(F.max("n_turns").alias("n_turns"), F.max("turns_sha256").alias("turns_sha256"), loss.alias("loss"), F.sum("chars").alias("formatted_chars"))
            .select("conv_id", "n_turns", "turns_sha256", F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars"))
