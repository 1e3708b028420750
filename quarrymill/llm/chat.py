"""Chat formatting with cumulative-snapshot collapse.

Logs often hold a conversation again and again, each time with more turns. A rolling hash over (position, role, text)
gives every prefix of a conversation an identity of 128 bits; conversations whose whole hash is a proper prefix of another one,
or which equal one with a smaller id, are dropped by anti-joins. The maximal ones are rendered.

Defined results: turns without a conversation id are left out; null roles and texts are values of their own and render
as empty; turns are ordered by turn, role, text (nulls first), for the hashes as for rendering, so equal turn numbers never depend
on the order of rows; repeated rows are repeated turns; a very long conversation is hashed by many tasks, and its rendering is one
row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .turns import ordered, prefixes

BEFORE, BETWEEN, AFTER = "<|im_start|>", "\n", "<|im_end|>\n"


def maximal(turns: DataFrame) -> DataFrame:
    """conv_id and n_turns of the conversations that are no proper prefix of another one, equal ones once.

    Texts are shuffled once, to put the turns in order; from there on their hashes stand for them.
    """
    placed = ordered(turns)
    sizes = placed.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    rolled = cut(prefixes(placed.drop("chars")).join(sizes, "conv_id"))
    whole = rolled.where("position = n").groupBy("h1", "h2", "n").agg(F.min("conv_id").alias("conv_id"))
    inner = rolled.where("position < n").select("h1", "h2", F.col("position").alias("n")).distinct()
    return whole.join(inner, ["h1", "h2", "n"], "left_anti").select("conv_id", F.col("n").alias("n_turns"))


def render(turns: DataFrame) -> DataFrame:
    """conv_id, text: the conversation's turns in order, in the template."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turn = F.struct("turn", F.col("role"), F.col("text"), F.concat(F.lit(BEFORE), role, F.lit(BETWEEN), text, F.lit(AFTER)).alias("out"))
    return turns.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(turn)), lambda t: t["out"]), "").alias("text"))


def format_chats(turns: DataFrame) -> DataFrame:
    """turns(conv_id, turn, role, text) -> conv_id, n_turns, text of the maximal conversations."""
    turns = turns.select("conv_id", "turn", "role", "text")
    kept = maximal(turns)
    return render(turns.join(kept.select("conv_id"), "conv_id", "left_semi")).join(kept, "conv_id").select("conv_id", F.col("n_turns").cast("long").alias("n_turns"), "text")
