"""Chats from event logs, rendered for training and read back.

A log has one row for each event of a conversation: conv_id, seq, turn, op, role
and text. ``message`` and ``edit`` set the text of a turn, ``delta`` appends to
it, and ``regenerate`` starts a turn anew and discards the turns after it as
they were. Folding keeps, for each turn, the last event that set it and the
deltas since.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Every control string begins with MARK; ESCAPE replaces it inside texts.
MARK, ESCAPE = "<", "\\"
OPEN, SEP, CLOSE = "<turn:", "<text>", "</turn>\n"
#: The loss is on what this role says.
LEARNED = "assistant"


def escaped(text: Column) -> Column:
    """``text`` without any MARK: the escape as \\0, the mark as \\1."""
    return F.replace(F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE + "0")), F.lit(MARK), F.lit(ESCAPE + "1"))


def unescaped(text: Column) -> Column:
    """What ``escaped`` was given: in its result \\1 only ever stands for the mark."""
    return F.replace(F.replace(text, F.lit(ESCAPE + "1"), F.lit(MARK)), F.lit(ESCAPE + "0"), F.lit(ESCAPE))


def folded(events: DataFrame) -> DataFrame:
    """conv_id, turn, role, text: the messages that a log comes to.

    Events of a conversation go by seq, ties by op, role and text. A turn whose
    first event is a delta starts empty; the role is that of the turn's last
    event that has one. Null texts count as empty, null roles as ``""``.
    """
    per_turn = Window.partitionBy("conv_id", "turn")
    log = events.select("conv_id", "seq", "turn", "op", "role", F.coalesce("text", F.lit("")).alias("text"))
    earlier_turns = Window.partitionBy("conv_id").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    log = log.withColumn("cut", F.max(F.when(F.col("op") == "regenerate", F.col("seq"))).over(earlier_turns))
    log = log.where("cut is null or seq > cut or seq is null")
    log = log.withColumn("set_at", F.max(F.when(F.col("op") != "delta", F.struct("seq", "op", "role", "text"))).over(per_turn))
    kept = log.where(F.col("set_at").isNull() | (F.struct("seq", "op", "role", "text") >= F.col("set_at")))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("seq", "op", "role", "text"))), lambda e: e["text"])
    return kept.groupBy("conv_id", "turn").agg(
        F.coalesce(F.max_by("role", F.when(F.col("role").isNotNull(), F.col("seq"))), F.lit("")).alias("role"),
        F.array_join(parts, "").alias("text"),
    )


def rendered(messages: DataFrame) -> DataFrame:
    """conv_id, formatted, loss of each conversation of ``messages`` (conv_id, turn, role, text).

    formatted: all turns in order of turn, then role and text; every row is a
    turn, repeated rows too. loss: (start, length) in code points, from 0, of
    each text of an assistant in ``formatted``. Null texts and roles count as
    empty; a null conv_id is one conversation, and a null turn comes first.
    """
    turns = messages.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = turns.withColumn("head", F.concat(F.lit(OPEN), escaped(F.col("role")), F.lit(SEP))).withColumn("body", escaped(F.col("text")))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    size = F.length("head") + F.length("body") + len(CLOSE)
    turns = turns.withColumn("n", F.row_number().over(order)).withColumn(
        "at", F.coalesce(F.sum(size.cast("long")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    )
    piece = F.concat("head", "body", F.lit(CLOSE))
    learned = F.when(F.col("role") == LEARNED, F.struct((F.col("at") + F.length("head")).alias("start"), F.length("body").cast("long").alias("length")))
    rows = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("n", piece.alias("piece"), learned.alias("loss")))).alias("rows"))
    return rows.select(
        "conv_id",
        F.array_join(F.transform("rows", lambda r: r["piece"]), "").alias("formatted"),
        F.filter(F.transform("rows", lambda r: r["loss"]), lambda x: x.isNotNull()).alias("loss"),
    )


def read_back(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation."""
    pieces = F.filter(F.split(formatted, CLOSE), lambda p: p != "")
    return F.transform(
        pieces,
        lambda p: F.struct(
            unescaped(F.substring_index(F.substr(p, F.lit(len(OPEN) + 1)), SEP, 1)).alias("role"),
            unescaped(F.substring_index(p, SEP, -1)).alias("text"),
        ),
    )


def loss_text(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(loss, lambda x: unescaped(F.substr(formatted, (x["start"] + 1).cast("int"), x["length"].cast("int")))), "")


def digests(chats: DataFrame) -> DataFrame:
    """What the formatted chats say, read back from them."""
    return (
        chats.withColumn("turns", read_back(F.col("formatted")))
        .withColumn("learned", loss_text(F.col("formatted"), F.col("loss")))
        .select(
            "conv_id",
            F.size("turns").cast("long").alias("n_turns"),
            F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
            F.length("learned").cast("long").alias("loss_chars"),
            F.sha2("learned", 256).alias("loss_sha256"),
            F.length("formatted").cast("long").alias("formatted_chars"),
        )
    )
