"""Chat formatting: keep the longest logged snapshot of each conversation, then render it. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_SEEDS = (17, 4242)


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """(conv_id, pos, h1, h2, last): 128 rolling bits of every turn prefix of every conversation.

    The roll is the XOR of position-bound turn hashes, so each prefix costs one step. Only hashes are shuffled,
    never texts.
    """
    bare = turns.select("conv_id", "turn", *(F.xxhash64(F.lit(s), "role", "text").alias(f"t{i}") for i, s in enumerate(_SEEDS)))
    order = Window.partitionBy("conv_id").orderBy("turn", "t0", "t1")
    same = F.lag("t0").over(order).eqNullSafe(F.col("t0")) & F.lag("t1").over(order).eqNullSafe(F.col("t1")) & F.lag("turn").over(order).eqNullSafe(F.col("turn"))
    once = bare.withColumn("again", same & F.lag(F.lit(1)).over(order).isNotNull()).filter(~F.col("again"))
    placed = once.withColumn("pos", F.row_number().over(order))
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rolled = [F.bit_xor(F.xxhash64(F.lit(s), "pos", f"t{i}")).over(upto).alias(f"h{i + 1}") for i, s in enumerate(_SEEDS)]
    return placed.select("conv_id", "pos", *rolled, F.lead("pos").over(order).isNull().alias("last"))


def maximal_conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns) of conversations that are no proper prefix of another; of equal ones the smallest id."""
    prefixes = prefix_hashes(turns)
    whole = prefixes.filter("last").groupBy("h1", "h2", F.col("pos").alias("n_turns")).agg(F.min("conv_id").alias("conv_id"))
    shorter = prefixes.filter("not last").select("h1", "h2", F.col("pos").alias("n_turns")).distinct()
    return whole.join(shorter, ["h1", "h2", "n_turns"], "left_anti").select("conv_id", "n_turns")


def render(turns: DataFrame, start: str = "<|", stop: str = "|>", end: str = "<|end|>") -> DataFrame:
    """(conv_id, rendered): the turns of each conversation in order, markers inside texts broken by a space."""
    broken = F.regexp_replace("text", r"<\|", "< |")
    order = [F.col("turn"), *(F.xxhash64(F.lit(s), "role", "text") for s in _SEEDS)]
    piece = F.concat(F.lit(start), F.regexp_replace("role", r"<\|", "< |"), F.lit(stop + "\n"), broken, F.lit(end + "\n"))
    turn = F.struct(*(c.alias(f"k{i}") for i, c in enumerate(order)), piece.alias("piece"))
    ordered = F.array_sort(F.array_distinct(F.collect_list(turn)))
    return turns.groupBy("conv_id").agg(F.array_join(F.transform(ordered, lambda x: x["piece"]), "").alias("rendered"))


def chat_format(conversations: DataFrame) -> DataFrame:
    """One row per maximal conversation: ``conv_id, n_turns, rendered``.

    Columns read: conv_id, turn, role, text; others are ignored. A null role is ``user``, a null text empty. Rows
    that repeat conversation, turn, role and text count once; different rows of one turn number stand in the order
    of their hashes; null turns come first. Rows without conv_id form one conversation with null id. An empty table
    gives no row.
    """
    turns = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("user")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    kept = maximal_conversations(turns).select(F.col("conv_id").alias("kept_id"), "n_turns")
    chosen = turns.join(kept, F.col("conv_id").eqNullSafe(F.col("kept_id")), "left_semi")
    return render(chosen).join(kept, F.col("conv_id").eqNullSafe(F.col("kept_id"))).select("conv_id", F.col("n_turns").cast("long").alias("n_turns"), "rendered")
