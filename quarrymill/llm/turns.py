"""Turns of conversations in order, and the rolling hashes of their prefixes; a conversation of any length is spread over tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Turns whose hashes roll in one group.
STRETCH = 1024


def ordered(turns: DataFrame) -> DataFrame:
    """turns(conv_id, turn, role, text) -> conv_id, position (from 1), c1, c2 (hashes of role and text), chars.

    Turns without a conversation id are left out; the order is turn, role, text, nulls first; a null differs from an empty text.
    Rows are sorted by ranges, so a conversation may lie in several tasks: its parts are counted first.
    """
    rows = turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"), F.monotonically_increasing_id().alias("row"))
    order = [F.col("conv_id").asc(), *[F.col(c).asc_nulls_first() for c in ("turn", "role", "text")], F.col("row").asc()]  # row: equal rows may lie apart
    hashes = [F.xxhash64(F.lit(seed), F.col("role").isNull(), "role", F.col("text").isNull(), "text").alias(name) for seed, name in ((1, "c1"), (2, "c2"))]
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", *hashes, F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("chars"), F.monotonically_increasing_id().alias("at"))
    placed = written(placed, "turns").withColumn("part", F.shiftright("at", 33))
    parts = placed.groupBy("conv_id", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("held"))
    before = F.sum("held").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select("conv_id", "part", (F.col("first") - F.coalesce(before, F.lit(0))).alias("start"))
    return placed.join(parts, ["conv_id", "part"]).select("conv_id", (F.col("at") - F.col("start") + 1).alias("position"), "c1", "c2", "chars")


def prefixes(turns: DataFrame) -> DataFrame:
    """turns(conv_id, position, c1, c2, ...) -> conv_id, position, h1, h2 (128 bits of the turns up to there), and the other columns."""
    own = {name: F.xxhash64("position", c) for name, c in (("x1", "c1"), ("x2", "c2"))}
    others = [c for c in turns.columns if c not in ("conv_id", "position", "c1", "c2")]
    turns = turns.withColumns(own | {"stretch": F.floor(F.col("position") / STRETCH).cast("long")})
    totals = turns.groupBy("conv_id", "stretch").agg(F.bit_xor("x1").alias("t1"), F.bit_xor("x2").alias("t2"))
    past = Window.partitionBy("conv_id").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("conv_id", "stretch", F.bit_xor("t1").over(past).alias("b1"), F.bit_xor("t2").over(past).alias("b2")).where("stretch > 0")
    here = Window.partitionBy("conv_id", "stretch").orderBy("position").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rolled = turns.withColumns({"r1": F.bit_xor("x1").over(here), "r2": F.bit_xor("x2").over(here)}).join(totals, ["conv_id", "stretch"], "left")
    both = [F.col(r).bitwiseXOR(F.coalesce(b, F.lit(0))).alias(h) for r, b, h in (("r1", "b1", "h1"), ("r2", "b2", "h2"))]
    return rolled.select("conv_id", "position", *both, *others)
