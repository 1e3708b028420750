"""Mixing sources to target weights by capped water-filling.

Every source has a weight and a size in words; the targets share a total by weight, but no source is repeated more than
`epochs` times: sources at that cap are clamped and their excess goes to the others in proportion to their weights until
all are feasible. A source then takes every document floor(target / size) times, and once more the documents that come
first in a seeded order, up to the rest of its target.

Defined results: a null source is a source of its own, ordered last; a null text has size 0 and nothing to take; rows are
independent, so repeated rows count each time; a row without a doc_id is drawn by its text; a text of any length is counted whole; an
empty table gives an empty result; other columns are ignored (mix returns them).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, unused, written

WEIGHTS, EPOCHS, SEED, ROUNDS = (5, 2, 1), 3, 17, 3
#: Leading hexadecimal digits of the draw that make a slice: 4096 slices.
SLICE_DIGITS = 3
#: Repeated rows that one row of a plan is exploded to at a time.
LOT = 4096
#: Sources up to which their table of a few numbers a source is broadcast; with more, the rows are joined by source and AQE
#: splits hot ones.
FEW_SOURCES = 20_000


def sized(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, source and size, the number of words of the text, and more columns."""
    words = F.coalesce(F.size(F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(1))).cast("long"), F.lit(0))
    return docs.select("doc_id", "source", F.when(F.col("text").isNull(), 0).otherwise(words).cast("long").alias("size"), *more)


def water_fill(sources: DataFrame, epochs: float = EPOCHS) -> DataFrame:
    """sources(source, source_size, weight) -> with target. One row a source.

    The sources that end at their cap are a prefix of the order by cap / weight: after clamping the first i - 1, the level
    (what is left over by the weight that is left) decides whether source i is clamped as well.
    """
    cap = F.col("source_size") * F.lit(float(epochs))
    everyone = Window.partitionBy(F.lit(1))
    by_ratio = everyone.orderBy("ratio", "place").rowsBetween(Window.unboundedPreceding, -1)
    table = sources.withColumn("cap", cap).withColumn("ratio", F.col("cap") / F.col("weight"))
    table = table.withColumn("free", F.sum("source_size").over(everyone) - F.coalesce(F.sum("cap").over(by_ratio), F.lit(0.0)))
    table = table.withColumn("weight_left", F.sum("weight").over(everyone) - F.coalesce(F.sum("weight").over(by_ratio), F.lit(0)))
    table = table.withColumn("level", F.col("free") / F.col("weight_left"))
    table = table.withColumn("water", F.max(F.when(F.col("ratio") > F.col("level"), F.col("level"))).over(everyone))
    return table.withColumn("target", F.when(F.col("ratio") <= F.col("level"), F.col("cap")).otherwise(F.least("cap", F.col("weight") * F.coalesce("water", "level")))).select("source", "source_size", "target")


def weighted_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """docs(source, size) -> source, source_size, weight, place: weights repeat in code point order, null last."""
    sizes = docs.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") - 1) % len(weights) + 1)
    return sizes.withColumn("place", place).withColumn("weight", weight)


def few(sources: DataFrame) -> DataFrame:
    """One row a source: to be broadcast if their number allows it."""
    return F.broadcast(sources) if sources.count() <= FEW_SOURCES else sources


def _first(rows: DataFrame, left: DataFrame) -> DataFrame:
    """rows(source, slice, draw, doc_id, size, n), left(source, rest) -> rows that fit into their source's rest, with `fit`: how
    many of the row's n repetitions are among the first, in the order of draw, whose sizes add up to no more than the rest.

    Sums of the slices come first, so the running sum only needs one slice's rows in one task: a source with a third
    of all rows is spread evenly, and repeated rows are one row with a number.
    """
    rest = few(left.select(F.col("source").alias("s"), "rest"))
    rows = rows.join(rest, rows["source"].eqNullSafe(F.col("s"))).where((F.col("rest") > 0) & (F.col("size") <= F.col("rest"))).drop("s")
    sums = rows.groupBy("source", "slice").agg(F.sum(F.col("size") * F.col("n")).alias("held"))
    before = F.sum("held").over(Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1))
    starts = sums.select(F.col("source").alias("s"), F.col("slice").alias("k"), F.coalesce(before, F.lit(0)).alias("before"))
    placed = rows.join(starts, rows["source"].eqNullSafe(F.col("s")) & (F.col("slice") == F.col("k"))).drop("s", "k")
    within = Window.partitionBy("source", "slice").orderBy("draw", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    free = F.col("rest") - F.col("before") - F.coalesce(F.sum(F.col("size") * F.col("n")).over(within), F.lit(0))
    fit = F.when(free < 0, 0).when(F.col("size") == 0, F.col("n")).otherwise(F.least("n", F.floor(free / F.col("size"))))
    return placed.withColumn("fit", fit.cast("long")).drop("before", "rest")


def drawn(docs: DataFrame, seed: int = SEED, *more: str) -> DataFrame:
    """sized() with draw, 16 hexadecimal digits: of the seed and the doc_id, or of the text where there is no id."""
    name = F.coalesce(F.col("doc_id").cast("string"), F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")))
    draw = F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), name).cast("binary")), 1, 16)
    spare = unused(docs, "_draw")
    return sized(docs.withColumn(spare, draw), spare, *more).withColumnRenamed(spare, "draw")


def planned(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: float = EPOCHS, seed: int = SEED, rounds: int = ROUNDS) -> DataFrame:
    """docs(doc_id, source, text) -> doc_id, source, size, draw, n, extra, whole, source_size, target: of the n rows that are alike
    in the first four, each is taken `whole` times and `extra` of them once more.

    Each round of extra repetitions takes the first documents that fit into what is left of the source's rest; the
    document that no longer fits ends a round, and the next one goes on with the smaller ones.
    """
    key = ["doc_id", "source", "size", "draw"]
    rows = cut(drawn(docs, seed).groupBy(*key).agg(F.count(F.lit(1)).alias("n")).withColumn("slice", F.substring("draw", 1, SLICE_DIGITS)))
    plan = water_fill(weighted_sources(rows.withColumn("size", F.col("size") * F.col("n")), weights), epochs)
    plan = plan.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    plan = cut(plan.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")))
    left, open_, taken = plan.select("source", "rest"), rows, []
    for _ in range(rounds):
        split = cut(_first(open_, left))
        taken.append(split.where("fit > 0").select(*key, F.col("fit").alias("extra")))
        used = taken[-1].groupBy(F.col("source").alias("s")).agg(F.sum(F.col("size") * F.col("extra")).alias("used"))
        left = cut(left.join(used, left["source"].eqNullSafe(F.col("s")), "left").select("source", (F.col("rest") - F.coalesce("used", F.lit(0))).alias("rest")))
        open_ = split.where("fit < n").withColumn("n", F.col("n") - F.col("fit")).drop("fit")
    counts = rows.select(*key, "n", F.lit(0).cast("long").alias("extra"))
    for more in taken:
        counts = counts.union(more.select(*key, F.lit(0).cast("long").alias("n"), "extra"))
    groups = counts.groupBy(*key).agg(F.sum("n").alias("n"), F.sum("extra").alias("extra"))
    p = few(plan.select(F.col("source").alias("s"), "source_size", "target", "whole"))
    return groups.join(p, groups["source"].eqNullSafe(F.col("s"))).drop("s")


def _times() -> Column:
    """Of the row with the number `copy` within its group."""
    return (F.col("whole") + F.when(F.col("copy") <= F.col("extra"), 1).otherwise(0)).cast("long")


def repeats(docs: DataFrame, **options) -> DataFrame:
    """docs(doc_id, source, text) -> doc_id, size, source_size, target, times (whole repetitions of the document), taken.

    Repeated rows come back one by one, in lots of LOT that are spread over tasks.
    """
    plan = planned(docs, **options)
    lots = plan.withColumn("lot", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / LOT))))
    lots = lots.repartition("doc_id", "draw", "lot").withColumn("first", F.col("lot") * LOT + 1)
    rows = lots.withColumn("copy", F.explode(F.sequence("first", F.least(F.col("n"), F.col("first") + LOT - 1)))).withColumn("times", _times())
    return rows.select("doc_id", "size", "source_size", F.col("target").cast("double").alias("target"), "times", (F.col("size") * F.col("times")).cast("long").alias("taken"))


def _keys(*names: str) -> list[Column]:
    """doc_id and source without nulls, size and draw, for joins."""
    tagged = lambda c: F.coalesce(F.concat(F.lit(":"), F.col(c).cast("string")), F.lit(""))
    return [tagged("doc_id").alias("_id"), tagged("source").alias("_source"), F.col("size").alias("_size"), F.col("draw").alias("_draw"), *names]


def mix(docs: DataFrame, **options) -> DataFrame:
    """docs, every row as many times as the mix takes it, rows without a doc_id as well. Of rows that are alike in doc_id, source
    and size, those first in the order of a hash of their text get the extra repetitions.

    Only where some rows of a group are taken once more, and not all, are they numbered: first counted by hash and task, so that no
    task numbers more of them than it holds.
    """
    key, row = ["_id", "_source", "_size", "_draw"], unused(docs, "_row")
    rows = drawn(docs.withColumn(row, F.struct(*[docs[c] for c in docs.columns])), options.get("seed", SEED), row).withColumnRenamed(row, "_row")
    joined = rows.select(*_keys("_row")).join(planned(docs, **options).select(*_keys("n", "extra", "whole")), key)
    some = (F.col("extra") > 0) & (F.col("extra") < F.col("n"))
    alike = joined.where(~some).withColumn("copy", F.lit(1).cast("long"))
    shared = written(joined.where(some).withColumn("_hash", F.xxhash64("_row.text")), "mixed").withColumn("_at", F.monotonically_increasing_id())
    shared = shared.withColumn("_part", F.shiftright("_at", 33))
    parts = shared.groupBy(*key, "_hash", "_part").agg(F.count(F.lit(1)).alias("held"))
    before = F.sum("held").over(Window.partitionBy(*key).orderBy("_hash", "_part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select(*key, "_hash", "_part", F.coalesce(before, F.lit(0)).alias("before"))
    number = F.row_number().over(Window.partitionBy(*key, "_hash", "_part").orderBy("_at"))
    numbered = shared.withColumn("_n", number).join(parts, [*key, "_hash", "_part"]).withColumn("copy", F.col("before") + F.col("_n"))
    columns = ["_row", "n", "extra", "whole", "copy"]
    counted = alike.select(*columns).union(numbered.select(*columns))
    return counted.withColumn("_times", _times()).where("_times > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times").cast("int")))).select("_row.*")
