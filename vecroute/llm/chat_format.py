"""Chat formatting with Spark expressions only.

The turns of a conversation are collected as structs, sorted by turn, and adjacent turns of one role
are merged into a run. A run is written as

    <s>ROLE[INST]TEXT[/INST]TEXT</s>

``[/INST]`` stands between the texts of turns that were merged, so that the single turns can be read
back. Control strings inside roles and texts get one backslash after their first character
(``</s>`` becomes ``<\\/s>``); one that already has backslashes there gets one more. Unescaping takes
one away, so every text comes back unchanged.

Defined cases: a null role or text counts as empty; a null ``conv_id`` is a conversation of its own;
repeated rows are kept as turns of their own, ties in ``turn`` are ordered by role and then text; null
turns come first; an empty table gives an empty result; further columns are ignored. One conversation
is one output row, so a conversation must fit into a task's memory, as its formatted text must.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The template's control strings.
OPEN, HEADER_END, JOIN, CLOSE = "<s>", "[INST]", "[/INST]", "</s>"

#: First character, backslashes so far, rest, of every control string.
_PLAIN = r"([<\[])(\\*)(/?s>|/?INST\])"
_ESCAPED = r"([<\[])\\(\\*)(/?s>|/?INST\])"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _PLAIN, r"$1$2\\$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, "$1$2$3")


def format_conversations(
    turns: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    loss_role: str = "assistant",
) -> DataFrame:
    """One row per conversation: ``conv_id``, ``formatted`` and ``loss_spans``.

    ``loss_spans`` lists the (start, length) of every stretch of ``formatted`` under the loss mask, in
    code points from 0: each text of a ``loss_role`` turn, without control strings.
    """
    rows = turns.select(
        F.col(conv_col).alias("conv_id"),
        F.struct(
            F.col(turn_col).alias("turn"),
            F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
            F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
        ).alias("t"),
    )
    grouped = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    n = F.size("ts")
    # positions at which a run of one role begins
    starts = F.filter(
        F.sequence(F.lit(0), n - 1),
        lambda i: (i == 0) | (F.get(F.col("ts"), i)["role"] != F.get(F.col("ts"), i - 1)["role"]),
    )
    runs = F.transform(
        F.col("starts"),
        lambda s, k: F.struct(
            F.get(F.col("ts"), s)["role"].alias("role"),
            F.transform(
                F.slice(F.col("ts"), s + 1, F.coalesce(F.get(F.col("starts"), k + 1), n) - s),
                lambda t: escape(t["text"]),
            ).alias("texts"),
        ),
    )
    head = lambda r: F.concat(F.lit(OPEN), escape(r["role"]), F.lit(HEADER_END))
    block = lambda r: F.concat(head(r), F.array_join(r["texts"], JOIN), F.lit(CLOSE))
    # every text with what stands before and after it, for the offsets of the loss mask
    pieces = F.flatten(
        F.transform(
            F.col("runs"),
            lambda r: F.transform(
                r["texts"],
                lambda t, j: F.struct(
                    F.when(j == 0, F.length(head(r))).otherwise(F.lit(0)).alias("before"),
                    F.length(t).alias("length"),
                    F.when(j == F.size(r["texts"]) - 1, F.lit(len(CLOSE))).otherwise(F.lit(len(JOIN))).alias("after"),
                    (r["role"] == loss_role).alias("loss"),
                ),
            ),
        )
    )
    no_spans = F.expr("cast(array() as array<struct<start:int,length:int>>)")
    spans = F.aggregate(
        pieces,
        F.struct(F.lit(0).alias("at"), no_spans.alias("spans")),
        lambda acc, p: F.struct(
            (acc["at"] + p["before"] + p["length"] + p["after"]).alias("at"),
            F.when(
                p["loss"],
                F.concat(
                    acc["spans"],
                    F.array(F.struct((acc["at"] + p["before"]).alias("start"), p["length"].alias("length"))),
                ),
            )
            .otherwise(acc["spans"])
            .alias("spans"),
        ),
    )["spans"]
    return (
        grouped.withColumn("starts", starts)
        .withColumn("runs", runs)
        .select(
            "conv_id",
            F.array_join(F.transform("runs", block), "").alias("formatted"),
            spans.alias("loss_spans"),
        )
    )


def read_turns(formatted: Column) -> Column:
    """The single turns of a formatted text: array of (role, text), unescaped, in order."""
    pieces = F.split(formatted, OPEN)
    blocks = F.slice(pieces, F.lit(2), F.size(pieces) - 1)

    def turns_of(block: Column) -> Column:
        parts = F.split(block, r"\[INST\]", 2)
        role = unescape(F.get(parts, F.lit(0)))
        body = F.get(parts, F.lit(1))
        texts = F.split(F.substring(body, F.lit(1), F.length(body) - len(CLOSE)), r"\[/INST\]")
        return F.transform(texts, lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(blocks, turns_of))


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, with nothing between the stretches."""
    return F.array_join(
        F.transform(spans, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["length"]))), ""
    )


def digest(formatted: DataFrame) -> DataFrame:
    """Read ``format_conversations`` output back into counts and hashes, one row per conversation."""
    back = formatted.withColumn("turns", read_turns(F.col("formatted"))).withColumn(
        "loss", loss_text(F.col("formatted"), F.col("loss_spans"))
    )
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
