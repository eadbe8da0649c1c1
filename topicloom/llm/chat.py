"""Chat formatting: snapshots of one conversation collapse into the longest, which is rendered.

A log holds the same conversation many times, each time a few turns longer. Every turn gets a
hash of its position, role and text; their running exclusive-or identifies each prefix of a
conversation. A conversation whose whole hash is a proper prefix of another one is dropped
by an anti-join; of equal conversations the smallest id stays. Built-in functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PART_TURNS = 256  # turn numbers that share one part of a conversation

# The template of a rendered turn.
OPEN, MIDDLE, CLOSE = "<|im_start|>", "\n", "<|im_end|>\n"


def _code(seed: int) -> Column:
    """64-bit code of a turn at its position; a null is told apart from an empty string."""
    return F.xxhash64(
        F.lit(seed), "pos", F.col("role").isNull(), "role", F.col("text").isNull(), "text", F.lit(-seed)
    )


def numbered_turns(conversations: DataFrame, part_turns: int = PART_TURNS) -> DataFrame:
    """Turns with their position in the conversation, from 0, and the part they belong to.

    Order is turn number, role, text, nulls first. Rows repeated in full count once. A
    conversation is numbered part by part, so one that holds a third of all rows is spread.
    """
    part = F.floor(F.coalesce(F.col("turn"), F.lit(0)) / F.lit(part_turns)).cast("long")
    turns = conversations.where(F.col("conv_id").isNotNull()).select(
        "conv_id", part.alias("block"), "turn", "role", "text"
    )
    turns = turns.repartition("conv_id", "block").distinct()
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("conv_id")
    blocks = (
        turns.groupBy("conv_id", "block")
        .agg(F.count("*").alias("n"))
        .select(
            "conv_id",
            "block",
            F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"),
            (F.row_number().over(Window.partitionBy("conv_id").orderBy("block")) - 1).alias("part"),
            F.sum("n").over(whole).alias("n_turns"),
        )
    )
    inside = Window.partitionBy("conv_id", "block").orderBy(
        F.asc_nulls_first("turn"), F.asc_nulls_first("role"), F.asc_nulls_first("text")
    )
    placed = turns.withColumn("place", F.row_number().over(inside) - 1).join(blocks, ["conv_id", "block"])
    return placed.withColumn("pos", (F.col("before") + F.col("place")).cast("long"))


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """``(conv_id, n_turns, length, h1, h2)``: a 128-bit hash of each prefix of a conversation."""
    coded = turns.select(
        "conv_id", "block", "pos", "n_turns", _code(1).alias("c1"), _code(2).alias("c2")
    )
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    blocks = (
        coded.groupBy("conv_id", "block")
        .agg(F.bit_xor("c1").alias("b1"), F.bit_xor("c2").alias("b2"))
        .select(
            "conv_id",
            "block",
            F.coalesce(F.bit_xor("b1").over(earlier), zero).alias("b1"),
            F.coalesce(F.bit_xor("b2").over(earlier), zero).alias("b2"),
        )
    )
    inside = Window.partitionBy("conv_id", "block").orderBy("pos")
    running = coded.select(
        "conv_id",
        "block",
        "n_turns",
        (F.col("pos") + 1).alias("length"),
        F.bit_xor("c1").over(inside).alias("r1"),
        F.bit_xor("c2").over(inside).alias("r2"),
    )
    return running.join(blocks, ["conv_id", "block"]).select(
        "conv_id",
        "n_turns",
        "length",
        F.col("r1").bitwiseXOR(F.col("b1")).alias("h1"),
        F.col("r2").bitwiseXOR(F.col("b2")).alias("h2"),
    )


def maximal_conversations(turns: DataFrame) -> DataFrame:
    """``(conv_id, n_copies)``: conversations that are no proper prefix of another one.

    Equal conversations are one class, kept under the smallest id. Both sides of the anti-join
    are unique by hash, so a first turn that a third of all conversations share is one row.
    """
    hashes = prefix_hashes(turns)
    whole = (
        hashes.where("length = n_turns")
        .groupBy("length", "h1", "h2")
        .agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies"))
    )
    prefixes = hashes.where("length < n_turns").select("length", "h1", "h2").distinct()
    return whole.join(prefixes, ["length", "h1", "h2"], "left_anti").select("conv_id", "n_copies")


def rendered(role: str = "role", text: str = "text") -> Column:
    """One turn in the template; markers inside a text are broken up so they stay text."""
    safe = F.replace(F.coalesce(F.col(text), F.lit("")), F.lit("<|"), F.lit("< |"))
    who = F.replace(F.coalesce(F.col(role), F.lit("unknown")), F.lit("<|"), F.lit("< |"))
    return F.concat(F.lit(OPEN), who, F.lit(MIDDLE), safe, F.lit(CLOSE))


def format_chats(conversations: DataFrame, part_turns: int = PART_TURNS) -> DataFrame:
    """``(conv_id, part, n_turns, n_copies, text)`` of the maximal conversations, rendered.

    A conversation is rendered in parts of ``part_turns`` turn numbers, joined in order of
    ``part`` they are the whole; most have the one part 0. Null roles render as ``unknown``,
    null texts as empty. Rows without ``conv_id`` belong to no conversation and are left out.
    """
    turns = numbered_turns(conversations, part_turns)
    kept = maximal_conversations(turns)
    return (
        turns.withColumn("line", rendered())
        .groupBy("conv_id", "block")
        .agg(
            F.first("part").cast("int").alias("part"),
            F.first("n_turns").alias("n_turns"),
            F.sort_array(F.collect_list(F.struct("pos", "line"))).alias("lines"),
        )
        .join(kept, "conv_id")
        .select("conv_id", "part", "n_turns", "n_copies", F.array_join("lines.line", "").alias("text"))
    )
