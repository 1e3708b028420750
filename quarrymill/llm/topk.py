"""Exact top-k search by distributed histogram selection.

Vectors are packed into blocks, which are dealt into lots, and queries into parts. Each pass scores every part against every lot
and adds up, for each query, a histogram of the scores in the range that still holds its kth best score; the range shrinks to
the one bin that holds it, until the bin is a single value. A last pass returns the scores above that value and as many of the
ties as are needed, smallest ids first.

A lot and a part meet in one group: lots are exchanged once a part, queries once a lot, and neither is broadcast. A lot reports no
bins below its own kth best score: the kth best score of all can't lie there. So a pass returns at most k rows for a query
and lot, however many candidates tie.

Defined results: vectors that are null or hold null or non-finite components take no part; vectors of different lengths
are never scored against each other; rows without an id take no part; rows with the query's own id aren't candidates; of query
rows that share an id the one with the least vector asks, while candidate rows that share an id are candidates each; fewer
than k candidates are all returned; components and scores beyond a long count as its limits (the scores of a block pair
that could pass a long are worked out in Python's integers); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

SCALE, BINS, QUERY_BLOCK, BLOCK = 1024, 2048, 512, 2048
#: Queries of a part, and full blocks of a lot, about.
PART, LOT = 8192, 4
_LOWEST, _HIGHEST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def integer_vectors(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vectors(vec_id, embedding) -> vec_id long, v array<long>: floor(scale * x) of finite vectors."""
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    v = F.transform("embedding", lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))
    return vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & fine).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of up to BLOCK vectors of one length: block (an id to spread them by), dim, ids, numbers, norm."""
    for batch in batches:
        ids, vectors = batch.column("vec_id").to_numpy(), batch.column("v")
        sizes = np.diff(vectors.offsets.to_numpy())
        for dim in np.unique(sizes):
            rows = np.flatnonzero(sizes == dim)
            for first in range(0, len(rows), BLOCK):
                own = rows[first : first + BLOCK]
                flat = vectors.take(pa.array(own)).flatten().to_numpy().reshape(len(own), dim)
                norm = float(np.sqrt((flat.astype(float) ** 2).sum(axis=1)).max())
                narrow = flat.astype(np.int16) if dim and -(2**15) <= flat.min() and flat.max() < 2**15 else flat
                yield pa.RecordBatch.from_arrays([pa.array([int(ids[own[0]])]), pa.array([int(dim)], pa.int32()), pa.array([ids[own].tobytes()], pa.binary()), pa.array([narrow.tobytes()], pa.binary()), pa.array([norm])], ["block", "dim", "ids", "numbers", "norm"])


def _scored(queries: pa.Table, blocks: pa.Table) -> Iterator[tuple[slice, Iterator[tuple[np.ndarray, np.ndarray]]]]:
    """For each QUERY_BLOCK queries of a part, every block of a lot: the candidates' ids, the scores (own rows at the lowest value)."""
    dim = blocks.column("dim")[0].as_py()
    wanted = queries.column("v").combine_chunks().flatten().to_numpy().reshape(len(queries), dim)
    names = queries.column("vec_id").to_numpy()

    def block(row: int, own: slice) -> tuple[np.ndarray, np.ndarray]:
        ids = np.frombuffer(blocks.column("ids")[row].as_py(), np.int64)
        raw = blocks.column("numbers")[row].as_py()
        numbers = np.frombuffer(raw, np.int64 if len(raw) == 8 * dim * len(ids) else np.int16).reshape(len(ids), dim)
        bound = float(np.abs(wanted[own].astype(float)).max(initial=0)) * float(np.abs(numbers.astype(float)).max(initial=0)) * dim
        exact = float if bound < 2**53 else np.int64 if bound < 2**62 else object
        scores = wanted[own].astype(exact) @ numbers.astype(exact).T
        if exact is object:
            scores = np.clip(scores, -_HIGHEST, _HIGHEST)
        scores = scores.astype(np.int64)
        scores[names[own][:, None] == ids[None, :]] = _LOWEST
        return ids, scores

    for first in range(0, len(queries), QUERY_BLOCK):
        own = slice(first, min(first + QUERY_BLOCK, len(queries)))
        yield own, (block(row, own) for row in range(len(blocks)))


def _histograms(queries: pa.Table, blocks: pa.Table, k: int) -> pa.Table:
    """What a lot adds to the histograms of a part's queries."""
    found = [np.zeros((0, 2), np.int64)]
    counts = [np.zeros(0, np.int64)]
    names = queries.column("vec_id").to_numpy()
    if len(queries) and len(blocks):
        bounds = [queries.column(c).to_numpy() for c in ("low", "high", "width")]
        for own, scored in _scored(queries, blocks):
            best = np.zeros((own.stop - own.start, 0), np.int64)
            for _, scores in scored:
                best = np.concatenate([best, scores], axis=1)
                best = best if best.shape[1] <= k else np.partition(best, best.shape[1] - k, axis=1)[:, -k:]
            low, high, width = (c[own][:, None] for c in bounds)
            inside = (best >= low) & (best <= high) & (best > _LOWEST)
            at, _ = np.nonzero(inside)
            bins = ((best[inside].view(np.uint64) - low[at, 0].view(np.uint64)) // width[at, 0].view(np.uint64)).astype(np.int64)  # the distance may pass a long
            pairs, n = np.unique(np.stack([at + own.start, bins], 1), axis=0, return_counts=True)
            found.append(pairs)
            counts.append(n.astype(np.int64))
    pairs = np.concatenate(found)
    return pa.table([pa.array(names[pairs[:, 0]], pa.int64()), pa.array(pairs[:, 1]), pa.array(np.concatenate(counts))], ["query_id", "bin", "n"])


def _select(queries: pa.Table, blocks: pa.Table, k: int) -> pa.Table:
    """A lot's scores above each query's kth best, and of those equal to it the k with the smallest ids."""
    found = [(np.zeros(0, np.int64),) * 3]
    if len(queries) and len(blocks):
        names, lows = queries.column("vec_id").to_numpy(), queries.column("low").to_numpy()
        for own, scored in _scored(queries, blocks):
            for ids, scores in scored:
                order = np.argsort(ids, kind="stable")
                for name, low, row in zip(names[own], lows[own], scores, strict=True):
                    above = np.flatnonzero((row > low) & (row > _LOWEST))
                    ties = order[row[order] == low][:k] if low > _LOWEST else order[:0]
                    at = np.concatenate([above, ties])
                    found.append((np.full(len(at), name, np.int64), ids[at], row[at]))
    return pa.table([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], ["query_id", "vec_id", "score"])


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, scale: int = SCALE) -> DataFrame:
    """vectors, queries (vec_id, embedding) -> query_id, rank, vec_id, score: each query's k best other vectors."""
    blocks = cut(integer_vectors(vectors, scale).mapInArrow(_pack, "block long, dim int, ids binary, numbers binary, norm double"))
    asked = cut(integer_vectors(queries, scale).groupBy("vec_id").agg(F.min("v").alias("v")))
    parts = max(1, -(-asked.count() // PART))
    held = blocks.agg(F.max("norm").alias("norm"), F.sum(F.length("ids")).alias("bytes")).first()
    norm, lots = held["norm"] or 0.0, max(1, -(-(held["bytes"] or 0) // (8 * BLOCK * LOT)))
    own = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x))
    high = F.when(own * norm < 2.0**62, F.ceil(F.least(own * norm, F.lit(2.0**62)) + 1)).otherwise(_HIGHEST).cast("long")
    state = asked.withColumns({"part": F.pmod(F.xxhash64("vec_id"), F.lit(parts)), "dim": F.size("v"), "high": high, "low": -high, "above": F.lit(0).cast("long")})
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    width = F.floor((wide("high") - wide("low")) / BINS).cast("long") + 1
    state = state.withColumn("width", width)
    each = lambda n, name: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias(name)
    placed = blocks.select("dim", "ids", "numbers", F.pmod(F.xxhash64("block"), F.lit(lots)).alias("lot"), each(parts, "part")).groupBy("dim", "lot", "part")

    def met(now: DataFrame, found, columns: str) -> DataFrame:
        """found(queries, blocks, k) for every lot of blocks and part of queries of one length."""
        everywhere = now.select("dim", "vec_id", "v", "low", "high", "width", "part", each(lots, "lot")).groupBy("dim", "lot", "part")
        return everywhere.cogroup(placed).applyInArrow(lambda queries, own: found(queries, own, k), columns)

    while (open_ := state.agg(F.bool_or(F.col("high") > F.col("low"))).first()[0]) is not None and open_:
        counted = met(state, _histograms, "query_id long, bin long, n long").groupBy("query_id", "bin").agg(F.sum("n").alias("n"))
        down = Window.partitionBy("query_id").orderBy(F.desc("bin"))
        reached = counted.withColumn("seen", F.sum("n").over(down.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        found = state.select(F.col("vec_id").alias("query_id"), F.col("above").alias("so_far")).join(reached, "query_id")
        found = found.where("so_far + seen >= %d and so_far + seen - n < %d" % (k, k)).select("query_id", "bin", (F.col("so_far") + F.col("seen") - F.col("n")).alias("over"))
        next_ = state.join(found, state["vec_id"] == found["query_id"], "left")
        # a query with fewer than k candidates keeps everything
        at = lambda bins: wide("low") + bins.cast("decimal(5,0)") * wide("width")
        low = F.when(F.col("bin").isNull(), F.lit(_LOWEST + 1)).otherwise(at(F.col("bin")).cast("long"))
        high = F.when(F.col("bin").isNull(), F.lit(_LOWEST + 1)).otherwise(F.least(F.col("high").cast("decimal(38,0)"), at(F.col("bin") + 1) - 1).cast("long"))
        next_ = next_.select("vec_id", "v", "part", "dim", high.alias("high"), low.alias("low"), F.coalesce("over", "above").alias("above"))
        state = cut(next_.withColumn("width", width))
    chosen = met(state, _select, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return chosen.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
