"""Chat formatting with Spark expressions only.

A conversation's turns are collected as structs, sorted, cut into runs of one
role, and concatenated::

    ### user: first text</turn>
    + a further turn of the same role</turn>
    ### assistant: its answer</turn>

Inside a text a backslash is doubled, ``</`` becomes ``<\\/`` and ``###``
becomes ``\\###``; a role also has its colons escaped. A backslash before any
character stands for that character, so the text can be read back exactly.
``</turn>`` and a newline end every turn and cannot occur inside one.

The loss mask names code-point ranges of the pieces between these ends: each
assistant text, without header and end mark.

Defined cases: a null text or role is empty; a null turn sorts first; equal
turns are ordered by role, then text, and all kept; a null conv_id is a
conversation of its own; an empty table gives no rows; other columns are
ignored. A conversation becomes one string, so it must fit a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

END = "</turn>\n"


def escape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("</"), F.lit("<\\/")), F.lit("###"), F.lit("\\###"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_chat(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """conv_id, n_messages, formatted and loss (array of piece, start, end)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    turn = F.struct(F.col("turn").cast("bigint").alias("turn"), role.alias("role"), text.alias("text"))
    sorted_ = turns.groupBy(F.col("conv_id").cast("bigint").alias("conv_id")).agg(F.array_sort(F.collect_list(turn)).alias("turns"))

    t, n = F.col("turns"), F.size("turns")
    first = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.get(t, i)["role"] != F.get(t, i - 1)["role"]))
    runs = sorted_.withColumn("first", first)
    f = F.col("first")

    def message(at: Column, k: Column) -> Column:
        after = F.coalesce(F.get(f, k + 1), n)
        return F.struct(F.get(t, at)["role"].alias("role"), at.alias("piece"), F.transform(F.slice(t, at + 1, after - at), lambda x: escape(x["text"])).alias("texts"))

    merged = runs.select("conv_id", F.transform(f, message).alias("messages"))

    def header(m: Column) -> Column:
        return F.concat(F.lit("### "), F.replace(escape(m["role"]), F.lit(":"), F.lit("\\:")), F.lit(": "))

    def rendered(m: Column) -> Column:
        return F.concat(header(m), F.array_join(m["texts"], END + "+ "), F.lit(END))

    def span(m: Column) -> Column:
        def one(x: Column, j: Column) -> Column:
            start = F.when(j == 0, F.length(header(m))).otherwise(F.lit(2))
            return F.struct((m["piece"] + j).alias("piece"), start.alias("start"), (start + F.length(x)).alias("end"))

        return F.transform(m["texts"], one)

    return merged.select(
        "conv_id",
        F.size("messages").cast("bigint").alias("n_messages"),
        F.array_join(F.transform("messages", rendered), "").alias("formatted"),
        F.flatten(F.transform(F.filter("messages", lambda m: m["role"] == loss_role), span)).alias("loss"),
    )


def read_chat(formatted: DataFrame) -> DataFrame:
    """conv_id, turns (array of role, text), loss_text and formatted, read back from the output."""
    whole = F.split("formatted", END)
    pieces = formatted.select("conv_id", "formatted", "loss", F.slice(whole, 1, F.size(whole) - 1).alias("pieces"))
    head = r"(?s)^### ((?:[^:\\]|\\.)*+): .*"
    p = F.col("pieces")

    def is_head(x: Column) -> Column:
        return F.startswith(x, F.lit("### "))

    heads = pieces.withColumn("heads", F.filter(F.sequence(F.lit(0), F.size(p) - 1), lambda i: is_head(F.get(p, i))))
    h = F.col("heads")

    def message(at: Column, k: Column) -> Column:
        raw = F.regexp_replace(F.get(p, at), head, "$1")
        own = F.slice(p, at + 1, F.coalesce(F.get(h, k + 1), F.size(p)) - at)
        texts = F.transform(own, lambda x, j: unescape(F.substr(x, F.when(j == 0, F.length(raw) + 7).otherwise(F.lit(3)))))
        return F.transform(texts, lambda x: F.struct(unescape(raw).alias("role"), x.alias("text")))

    loss = F.transform("loss", lambda s: unescape(F.substr(F.get(p, s["piece"]), s["start"] + 1, s["end"] - s["start"])))
    return heads.select("conv_id", F.flatten(F.transform(h, message)).alias("turns"), F.array_join(loss, "").alias("loss_text"), "formatted")


def digest(read: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    turns = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(turns, 256).alias("turns_sha256"),
        F.length("loss_text").cast("bigint").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )
