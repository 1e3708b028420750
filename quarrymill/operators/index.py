"""An index for nearest neighbours: cells around centres, product-quantised residuals in them, exact re-ranking.

The number of cells grows with the square root of the table, and a search reads a fixed share of them. Centres are fitted by k-means
over a sample in proportion to their number, with sums added up by tasks; code books over a sample of a fixed bound. Every
vector is indexed: in the cell of its nearest centre, as one byte a subspace of what is left after subtracting the centre.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import settled
from .vectors import distance, distance_similarity, knn, meeting

#: Cells for each unit of the square root of the rows, their least and greatest number, and sampled vectors a cell.
CELLS_PER_ROOT, FEWEST, MOST, PER_CELL = 4.0, 16, 1 << 16, 64
#: Passes of k-means; dimensions of a subspace, values of a code; rows that code books are fitted to.
ROUNDS, SUBSPACE, CODES, BOOK_ROWS = 6, 4, 256, 20_000
#: Rows of a block of codes, parts that a cell is spread over and blocks that meet queries together, queries of a group and of one
#: step in it, cells that give a query its bound.
BLOCK, SPREAD, TOGETHER, FEW, FIRST = 4096, 16, 2048, 32, 4


@dataclass(frozen=True)
class Index:
    """blocks(kb, cell, ids, codes), centres [cells, dim], books [subspaces, codes, SUBSPACE]; vectors of other lengths are in `rest`."""

    blocks: DataFrame
    centres: np.ndarray
    books: np.ndarray
    rest: DataFrame

    @property
    def dim(self) -> int:
        return self.centres.shape[1]


def _matrices(column: pa.Array, dim: int) -> Iterator[tuple[int, np.ndarray]]:
    flat = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)
    for first in range(0, len(flat), 1024):
        yield first, flat[first : first + 1024]


def _far(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances up to a constant of each row."""
    return (centres**2).sum(axis=1)[None, :] - 2 * x @ centres.T


def _partial(batches: Iterator[pa.RecordBatch], centres: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Sums and numbers of one task's vectors by nearest centre."""
    sums, counts = np.zeros(centres.shape), np.zeros(len(centres), np.int64)
    for batch in batches:
        for _, x in _matrices(batch.column("embedding"), centres.shape[1]):
            own = _far(x, centres).argmin(axis=1)
            np.add.at(sums, own, x)
            counts += np.bincount(own, minlength=len(centres))
    met = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(met.astype(np.int32)), pa.array(list(sums[met]), pa.list_(pa.float64())), pa.array(counts[met])], ["cell", "total", "n"])


def fit_centres(sample: DataFrame, first: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Lloyd's k-means: sample(embedding), centres to start from -> centres. A centre without vectors stays."""
    centres = first.copy()
    for _ in range(rounds):
        made = sample.select("embedding").mapInArrow(lambda it, now=centres: _partial(it, now), "cell int, total array<double>, n long")
        summed = made.select("cell", "n", F.posexplode("total").alias("j", "x")).groupBy("cell", "j").agg(F.sum("x").alias("x"), F.sum("n").alias("n"))
        for r in summed.collect():  # one number for each centre and dimension
            centres[r["cell"], r["j"]] = r["x"] / r["n"]
    return centres


def _books(batches: Iterator[pa.RecordBatch], centres: np.ndarray, rounds: int) -> Iterator[pa.RecordBatch]:
    """Code books of the residuals of a bounded sample, by k-means in each subspace."""
    x = np.concatenate([np.zeros((0, centres.shape[1])), *[m for batch in batches for _, m in _matrices(batch.column("embedding"), centres.shape[1])]])
    residual = x - centres[_far(x, centres).argmin(axis=1)] if len(x) else x
    rng, out = np.random.default_rng(3), []
    for part in np.split(residual, residual.shape[1] // SUBSPACE, axis=1):
        book = part[rng.choice(len(part), CODES, replace=len(part) < CODES)] if len(part) else np.zeros((CODES, SUBSPACE))
        for _ in range(rounds if len(part) else 0):
            own = _far(part, book).argmin(axis=1)
            counts = np.bincount(own, minlength=CODES)
            sums = np.stack([np.bincount(own, part[:, j], CODES) for j in range(SUBSPACE)], axis=1)
            book = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], book)
        out.append(book)
    yield pa.RecordBatch.from_arrays([pa.array([np.stack(out).tobytes()], pa.binary())], ["books"])


def _encode(batches: Iterator[pa.RecordBatch], centres: np.ndarray, books: np.ndarray) -> Iterator[pa.RecordBatch]:
    """kb_id, chunk_id, cell, code of every vector."""
    for batch in batches:
        for first, x in _matrices(batch.column("embedding"), centres.shape[1]):
            cell = _far(x, centres).argmin(axis=1)
            parts = np.split(x - centres[cell], len(books), axis=1)
            codes = np.stack([_far(p, b).argmin(axis=1) for p, b in zip(parts, books, strict=True)], axis=1).astype(np.uint8)
            rows = batch.slice(first, len(x))
            yield pa.RecordBatch.from_arrays([rows.column("kb_id"), rows.column("chunk_id"), pa.array(cell.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary())], ["kb", "chunk_id", "cell", "code"])


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (kb, cell) rows as blocks of up to BLOCK."""
    key, ids, codes = None, [], []

    def block() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([key[0]]), pa.array([key[1]], pa.int32()), pa.array([ids], pa.list_(pa.string())), pa.array([b"".join(codes)], pa.binary())], ["kb", "cell", "ids", "codes"])

    for batch in batches:
        for kb, chunk_id, cell, code in zip(*(batch.column(c).to_pylist() for c in ("kb", "chunk_id", "cell", "code")), strict=True):
            if (kb, cell) != key or len(ids) == BLOCK:
                if ids:
                    yield block()
                key, ids, codes = (kb, cell), [], []
            ids.append(chunk_id)
            codes.append(code)
    if ids:
        yield block()


def build(corpus: DataFrame, cells: int | None = None, rounds: int = ROUNDS) -> Index:
    """corpus(kb_id, chunk_id, embedding) -> the index of all its vectors of the most frequent length; a length that isn't a
    multiple of SUBSPACE, and every other one, stays in `rest`, which a search scans exactly."""
    slim = corpus.select(F.col("kb_id").cast("string").alias("kb_id"), F.col("chunk_id").cast("string").alias("chunk_id"), F.col("embedding").cast("array<double>").alias("embedding")).where("kb_id is not null and embedding is not null")
    sizes = slim.groupBy(F.size("embedding").alias("dim")).agg(F.count(F.lit(1)).alias("n")).where(F.col("dim") % SUBSPACE == 0).where("dim > 0")
    common = sizes.orderBy(F.desc("n"), "dim").first()
    dim, n = (common["dim"], common["n"]) if common else (SUBSPACE, 0)
    own, rest = slim.where(F.size("embedding") == dim), slim.where(F.size("embedding") != dim)
    cells = cells or int(min(MOST, max(FEWEST, CELLS_PER_ROOT * n**0.5)))
    place = F.pmod(F.xxhash64("kb_id", "chunk_id", F.lit(5)), F.lit(1 << 30)) / float(1 << 30)
    sampled = settled(own.select("embedding", place.alias("place")).where(F.col("place") < min(1.0, 1.2 * max(PER_CELL * cells, BOOK_ROWS) / max(1, n))), "sample")
    starts = [r["embedding"] for r in sampled.orderBy("place").limit(cells).collect()]  # as many as there are centres
    centres = fit_centres(sampled.where(F.col("place") < 1.2 * PER_CELL * cells / max(1, n)), np.array(starts).reshape(-1, dim), rounds) if starts else np.zeros((1, dim))
    few = sampled.orderBy("place").limit(BOOK_ROWS).select("embedding").repartition(1)
    books = np.frombuffer(few.mapInArrow(lambda it: _books(it, centres, rounds), "books binary").first()["books"]).reshape(-1, CODES, SUBSPACE)
    coded = own.mapInArrow(lambda it: _encode(it, centres, books), "kb string, chunk_id string, cell int, code binary")
    dealt = coded.repartition("kb", "cell", F.pmod(F.xxhash64("chunk_id"), F.lit(SPREAD))).sortWithinPartitions("kb", "cell")
    return Index(settled(dealt.mapInArrow(_pack, "kb string, cell int, ids array<string>, codes binary"), "index"), centres, books, rest)


def _probes(batches: Iterator[pa.RecordBatch], centres: np.ndarray, probes: int) -> Iterator[pa.RecordBatch]:
    """Queries with the numbers of their nearest centres, the nearest first."""
    for batch in batches:
        for first, x in _matrices(batch.column("vector"), centres.shape[1]):
            far = _far(x, centres)
            cells = np.argpartition(far, probes - 1, axis=1)[:, :probes] if probes < len(centres) else np.tile(np.arange(len(centres)), (len(x), 1))
            cells = np.take_along_axis(cells, np.take_along_axis(far, cells, axis=1).argsort(axis=1, kind="stable"), axis=1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * cells.shape[1]), pa.array(cells.ravel().astype(np.int32)))
            rows = batch.slice(first, len(x))
            yield pa.RecordBatch.from_arrays([rows.column("query_id"), rows.column("kb"), rows.column("vector"), lists], ["query_id", "kb", "vector", "cells"])


def _tables(books: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Squared distances of each row's subspaces to all codes: [rows, subspaces, codes]."""
    parts = left.reshape(len(left), len(books), SUBSPACE)
    return ((parts**2).sum(axis=2)[:, :, None] - 2 * np.einsum("qsj,scj->qsc", parts, books)) + (books**2).sum(axis=2)[None]


def _near(key: tuple, asked: pa.Table, held: pa.Table, centres: np.ndarray, books: np.ndarray, keep: int) -> pa.Table:
    """Of a cell's blocks, for each query that reads the cell, the `keep` nearest by codes; none beyond the query's bound."""
    queries, ids_out, fars = [np.zeros(0, np.int64)], [pa.array([], pa.string())], [np.zeros(0)]
    if len(asked) and len(held):
        vectors = np.array(asked.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(asked), -1)
        numbers, bounds = asked.column("query_id").to_numpy(), asked.column("bound").to_numpy()
        cell = key[1].as_py()
        ids = held.column("ids").combine_chunks().flatten()
        codes = np.frombuffer(b"".join(held.column("codes").to_pylist()), np.uint8).reshape(-1, len(books))
        for first in range(0, len(vectors), FEW):
            table = _tables(books, vectors[first : first + FEW] - centres[cell])
            far = np.zeros((len(table), len(codes)))
            for s in range(len(books)):
                far += table[:, s][:, codes[:, s]]
            least = bounds[first : first + FEW, None]
            if len(codes) > keep:
                least = np.minimum(least, np.partition(far, keep - 1, axis=1)[:, keep - 1 : keep])
            row, at = np.nonzero(far <= least)
            queries.append(numbers[first + row])
            ids_out.append(ids.take(pa.array(at)))
            fars.append(far[row, at])
    flat = np.concatenate(queries)
    return pa.table([pa.array(flat), pa.array([key[0].as_py()] * len(flat), pa.string()), pa.concat_arrays(ids_out), pa.array(np.concatenate(fars))], ["query_id", "kb_id", "chunk_id", "far"])


def probed(index: Index, queries: DataFrame, share: float) -> DataFrame:
    """queries(query_id, kb_id, vector) of the index's length -> query_id, kb, vector, place, cell: a row for each cell that a query
    reads, the nearest at place 0."""
    probes = max(1, int(share * len(index.centres)))
    q = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("kb_id").cast("string").alias("kb"), F.col("vector").cast("array<double>").alias("vector")).where(F.size("vector") == index.dim)
    centres = index.centres
    return q.mapInArrow(lambda it: _probes(it, centres, probes), "query_id long, kb string, vector array<double>, cells array<int>").select("query_id", "kb", "vector", F.posexplode("cells").alias("place", "cell"))


def scored_rows(index: Index, queries: DataFrame, share: float) -> DataFrame:
    """How many vectors each query is compared with: query_id, scored."""
    held = index.blocks.select("kb", "cell", F.size("ids").alias("n"))
    return probed(index, queries, share).join(held, ["kb", "cell"]).groupBy("query_id").agg(F.sum("n").alias("scored"))


def search(index: Index, queries: DataFrame, corpus: DataFrame, k: int, share: float = 0.1, rerank: int = 10, decimals: int = 6) -> DataFrame:
    """queries(query_id, kb_id, vector), corpus(kb_id, chunk_id, embedding) -> query_id, kb_id, chunk_id, similarity, rank, as knn.

    A query reads `share` of the cells; the rerank * k best by codes are ranked by their vectors. A cell's queries (TOGETHER at a
    time) and its blocks meet in one group, or in several for a cell of many blocks; nothing is broadcast. The nearest FIRST cells
    are read first: their (rerank * k)th distance bounds what the others may return, so rows don't grow with the cells read.
    """
    centres, books, keep = index.centres, index.books, rerank * k
    asked = probed(index, queries, share)

    def read(cells: DataFrame) -> DataFrame:
        """cells(query_id, kb, vector, cell, bound) -> the rows within the bound."""
        met = meeting(cells, index.blocks.withColumn("first", F.col("ids")[0]), ["kb", "cell"], ("query_id", TOGETHER), ("first", SPREAD))
        return met.applyInArrow(lambda key, left, right: _near(key, left, right, centres, books, keep), "query_id long, kb_id string, chunk_id string, far double")

    best = F.row_number().over(Window.partitionBy("query_id", "kb_id").orderBy("far", "chunk_id"))
    start = settled(read(asked.where(F.col("place") < FIRST).withColumn("bound", F.lit(float("inf")))).withColumn("_best", best).where(F.col("_best") <= keep), "start")
    bound = start.where(F.col("_best") == keep).select("query_id", F.col("kb_id").alias("kb"), F.col("far").alias("bound"))
    others = asked.where(F.col("place") >= FIRST).join(bound, ["query_id", "kb"], "left").withColumn("bound", F.coalesce("bound", F.lit(float("inf"))))
    near = start.drop("_best").unionByName(read(others))
    few = near.withColumn("_best", best).where(F.col("_best") <= keep).select("query_id", "kb_id", "chunk_id")
    own = corpus.select(F.col("kb_id").cast("string").alias("kb_id"), F.col("chunk_id").cast("string").alias("chunk_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    vectors = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("kb_id").cast("string").alias("kb_id"), F.col("vector").cast("array<double>").alias("vector"))
    exact = few.join(own, ["kb_id", "chunk_id"]).join(vectors, ["query_id", "kb_id"])
    exact = exact.select("query_id", "kb_id", "chunk_id", F.round(distance_similarity(distance(F.col("vector"), F.col("embedding"))), decimals).alias("similarity"))
    other = knn(queries.where(F.size("vector") != index.dim), index.rest, k, decimals).select("query_id", "kb_id", "chunk_id", "similarity")
    rank = F.row_number().over(Window.partitionBy("query_id", "kb_id").orderBy(F.desc("similarity"), "chunk_id"))
    return exact.unionByName(other).withColumn("rank", rank).where(F.col("rank") <= k)
