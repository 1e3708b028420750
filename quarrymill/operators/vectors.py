"""Vector arithmetic, encoding of distinct texts, and nearest-neighbour search."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.group_ops import PandasCogroupedOps

BLOCK = 2048
#: Vectors of a lot and queries of a part that meet in one group of knn; queries of one matrix product in it.
LOT, PART, TOGETHER = 4096, 2048, 256


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def unit(v: Column) -> Column:
    """v at length 1; a zero vector stays as it is."""
    length = norm(v)
    return F.when(length > 0, F.transform(v, lambda x: x.cast("double") / length)).otherwise(F.transform(v, lambda x: x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """0 if either vector is zero."""
    lengths = norm(a) * norm(b)
    return F.when(lengths > 0, dot(a, b) / lengths).otherwise(0.0)


def clamped_dot(a: Column, b: Column) -> Column:
    """Within [-1, 1]; 0 for vectors that are empty or of unequal length."""
    return F.when((F.size(a) > 0) & (F.size(a) == F.size(b)), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b)))).otherwise(0.0)


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x))


def distance_similarity(d: Column) -> Column:
    """1 - d^2 / 2 within [0, 1]: the cosine of unit vectors at the distance d."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - d * d / 2))


def role_text(model: Column, role: str, text: Column) -> Column:
    """Models of the e5 family want the role in front of the text."""
    return F.when(F.lower(model).contains("e5"), F.concat(F.lit("query: " if role == "query" else "passage: "), text)).otherwise(text)


def cache_key(provider: Column, model: Column, text: Column) -> Column:
    return F.concat_ws("::", provider, model, F.sha1(text.cast("binary")))


def hashed_encoder(dimension: int = 64) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A deterministic encoder for (key, text) batches: signed hashed words, at length 1."""
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.zeros((len(batch), dimension))
            for i, text in enumerate(batch.column("text").to_pylist()):
                for word in (text or "").lower().split():
                    code = zlib.crc32(word.encode())
                    rows[i, code % dimension] += 1 if code & 0x10000 else -1
            lengths = np.linalg.norm(rows, axis=1, keepdims=True)
            rows = np.divide(rows, lengths, out=rows, where=lengths > 0).astype(np.float32)
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(list(rows), pa.list_(pa.float32()))], ["key", "embedding"])

    return encode


def letter_encoder() -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """An encoder for (key, text) batches that SQL can follow: how often a text, lower-cased by the caller, has each letter from a to
    z, at length 1. A text without letters is a zero vector."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.zeros((len(batch), 26))
            for i, text in enumerate(batch.column("text").to_pylist()):
                rows[i] = np.bincount(np.frombuffer((text or "").encode(), np.uint8), minlength=256)[97:123]
            lengths = np.sqrt((rows**2).sum(axis=1, keepdims=True))
            rows = np.divide(rows, lengths, out=rows, where=lengths > 0).astype(np.float32)
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(list(rows), pa.list_(pa.float32()))], ["key", "embedding"])

    return encode


def encode_distinct(texts: DataFrame, cache: DataFrame | None, encoder: Callable, provider: str, model: str) -> DataFrame:
    """texts(text, ...) with embedding: every distinct text that cache(key, embedding) lacks is encoded once."""
    keyed = texts.withColumn("key", cache_key(F.lit(provider), F.lit(model), F.col("text")))
    fresh = keyed.select("key", "text").dropDuplicates(["key"])
    if cache is not None:
        fresh = fresh.join(cache.select("key"), "key", "left_anti")
    made = fresh.mapInArrow(encoder, "key string, embedding array<float>")
    return keyed.join(made if cache is None else cache.select("key", "embedding").unionByName(made), "key", "left").drop("key")


def encode_stats(texts: DataFrame, cache: DataFrame) -> DataFrame:
    """total, hit, miss, unique_miss and hit_rate of encoding texts(key) against cache(key)."""
    marked = texts.select("key").join(cache.select("key").distinct().withColumn("found", F.lit(1)), "key", "left")
    per_key = marked.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("found").alias("found"))
    out = per_key.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.coalesce(F.sum(F.when(F.col("found") == 1, F.col("n"))), F.lit(0)).alias("hit"), F.count_if(F.col("found").isNull()).alias("unique_miss"))
    rate = F.when(F.col("total") > 0, F.round(F.col("hit") / F.col("total"), 4)).otherwise(0.0)
    return out.select("total", "hit", (F.col("total") - F.col("hit")).alias("miss"), "unique_miss", rate.alias("hit_rate"))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Vectors of one length as the rows of a matrix."""
    return np.array(column.combine_chunks().flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), -1)


def _nearest(key: tuple, queries: pa.Table, corpus: pa.Table, k: int, decimals: int) -> pa.Table:
    """The k nearest vectors of one lot to each query of one part."""
    found, places, scores = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
    if len(queries) and len(corpus):
        corpus = corpus.take(pc.sort_indices(corpus.column("chunk_id")))  # ties go to the smaller id
        vectors, wanted = _matrix(corpus.column("embedding")), _matrix(queries.column("v"))
        lengths = (vectors**2).sum(1)[None, :]
        for first in range(0, len(wanted), TOGETHER):
            own = wanted[first : first + TOGETHER]
            # the squared distance of the vectors as they are, so that other lengths than 1 count
            square = (own**2).sum(1)[:, None] + lengths - 2 * own @ vectors.T
            near = np.round(np.clip(1 - np.maximum(square, 0) / 2, 0, 1), decimals)
            least = np.partition(near, near.shape[1] - k, axis=1)[:, near.shape[1] - k] if near.shape[1] > k else np.full(len(own), -1.0)
            for row, bound in enumerate(least):
                at = np.flatnonzero(near[row] >= bound)
                at = at[np.argsort(-near[row][at], kind="stable")][:k]
                found.append(np.full(len(at), first + row))
                places.append(at)
                scores.append(near[row][at])
    at = pa.array(np.concatenate(found))
    ids = corpus.column("chunk_id").take(pa.array(np.concatenate(places)))
    return pa.table([queries.column("query_id").take(at), queries.column("kb").take(at), ids, pa.array(np.concatenate(scores))], ["query_id", "kb", "chunk_id", "similarity"])


def meeting(queries: DataFrame, corpus: DataFrame, keys: list[str], parts: tuple[str, int], lots: tuple[str, int]) -> PandasCogroupedOps:
    """Both sides grouped by keys, so that each query row and each corpus row of equal keys are in one group together.

    parts and lots: the column that a side is dealt by and about how many rows of it a group takes. Keys with more rows than that on
    either side have several groups; only these keys and their numbers of parts and lots are broadcast, never rows.
    """
    (asking, part_rows), (held, lot_rows) = parts, lots
    count = lambda rows, name: rows.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))
    sizes = count(corpus, "n").join(count(queries, "m"), keys).where((F.col("n") > lot_rows) | (F.col("m") > part_rows))
    large = F.broadcast(sizes.select(*keys, F.ceil(F.col("n") / lot_rows).alias("lots"), F.ceil(F.col("m") / part_rows).alias("parts")))

    def dealt(rows: DataFrame, own: str, other: str, by: str) -> DataFrame:
        """Each row in one lot (or part) of its own side, once for each of the other side."""
        one = F.lit(1).cast("long")
        every = F.sequence(F.lit(0).cast("long"), F.coalesce(other + "s", one) - 1)
        return rows.join(large, keys, "left").withColumns({own: F.pmod(F.xxhash64(by), F.coalesce(own + "s", one)), other: F.explode(every)}).drop("lots", "parts")

    by = [*keys, "lot", "part"]
    return dealt(queries, "part", "lot", asking).groupBy(*by).cogroup(dealt(corpus, "lot", "part", held).groupBy(*by))


def knn(queries: DataFrame, corpus: DataFrame, k: int, decimals: int = 6, lot_rows: int = LOT, part_rows: int = PART) -> DataFrame:
    """queries(query_id, kb_id, vector), corpus(kb_id, chunk_id, embedding) -> query_id, kb_id, chunk_id, similarity, rank.

    A knowledge base is dealt into lots of about `lot_rows` vectors and its queries into parts of about `part_rows`: every lot meets
    every part in one group, which is a few matrix products and returns at most k rows a query. Small knowledge bases are one
    group, so that nothing is copied for them. Both sides are exchanged and neither is broadcast; only the numbers of lots and
    parts of knowledge bases with more than one are. Similarities are rounded before ranking; ties go to the smaller chunk_id.
    """
    c = corpus.select(F.col("kb_id").cast("string").alias("kb"), F.col("chunk_id").cast("string").alias("chunk_id"), F.col("embedding").cast("array<double>").alias("embedding")).where("embedding is not null and kb_id is not null")
    q = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("kb_id").cast("string").alias("kb"), F.col("vector").cast("array<double>").alias("v")).where("v is not null")
    met = meeting(q.withColumn("dim", F.size("v")), c.withColumn("dim", F.size("embedding")), ["kb", "dim"], ("query_id", part_rows), ("chunk_id", lot_rows))
    found = met.applyInArrow(lambda key, left, right: _nearest(key, left, right, k, decimals), "query_id long, kb string, chunk_id string, similarity double")
    rank = F.row_number().over(Window.partitionBy("query_id", "kb").orderBy(F.desc("similarity"), "chunk_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("kb").alias("kb_id"), "chunk_id", "similarity", "rank")


def multi_kb_knn(query_kbs: DataFrame, corpus: DataFrame, k: int, recall: int) -> DataFrame:
    """query_kbs(query_id, kb_id, vector): each query searches several knowledge bases, each to its share of the recall,
    max(k, min(recall, max(2k, recall div knowledge bases))); then one ranking by query.

    The embedding settings of the knowledge bases must agree (see catalog.embedding_violations).
    """
    counts = query_kbs.groupBy("query_id").agg(F.countDistinct("kb_id").alias("kbs"))
    share = F.greatest(F.lit(k), F.least(F.lit(recall), F.greatest(F.lit(2 * k), F.floor(F.lit(recall) / F.col("kbs")))))
    near = knn(query_kbs, corpus, recall).join(counts, "query_id").where(F.col("rank") <= share)
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "kb_id", "chunk_id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "kb_id", "chunk_id", "similarity", "rank")


def filtered_knn(queries: DataFrame, corpus: DataFrame, k: int, metadata: dict[str, str] | None = None, contains: str | None = None) -> DataFrame:
    """knn over the rows of corpus whose metadata and content match; the filters come first."""
    for name, value in (metadata or {}).items():
        corpus = corpus.where(F.col("metadata")[name] == value)
    if contains is not None:
        corpus = corpus.where(F.col("content").contains(contains))
    return knn(queries, corpus, k)


def _cells(batches: Iterator[pa.RecordBatch], centres: np.ndarray, column: str, probes: int) -> Iterator[pa.RecordBatch]:
    """The rows with `cells`, the numbers of the nearest centres; vectors of another length share the cell 0."""
    for batch in batches:
        vectors, cells = batch.column(column), np.zeros((len(batch), probes), np.int32)
        rows = np.flatnonzero(np.diff(vectors.offsets.to_numpy()) == centres.shape[1])
        for first in range(0, len(rows), BLOCK):
            own = rows[first : first + BLOCK]
            flat = vectors.take(pa.array(own)).flatten().to_numpy(zero_copy_only=False).reshape(len(own), -1)
            far = (centres**2).sum(1)[None, :] - 2 * flat @ centres.T
            cells[own] = np.argpartition(far, probes - 1, axis=1)[:, :probes] if probes < len(centres) else np.arange(probes)
        flat = pa.ListArray.from_arrays(pa.array(np.arange(0, cells.size + 1, probes, dtype=np.int32)), pa.array(cells.reshape(-1)))
        yield pa.RecordBatch.from_arrays([*batch.columns, flat], [*batch.schema.names, "cells"])


def indexed_knn(queries: DataFrame, corpus: DataFrame, k: int, cells: int = 64, probes: int = 48) -> DataFrame:
    """Approximate neighbours: as knn, but a query meets only the vectors of the `probes` cells whose centres are nearest to it.

    The centres are `cells` vectors of the corpus, chosen by a hash of their ids (that sample is all that the driver sees); every
    vector is in the cell of its nearest centre. Knowledge base and cell together are what both sides meet on, in the blocks
    of knn, so a large cell is spread and what comes out is bounded by k a query, cell and block. The defaults suit vectors
    without any structure; where vectors form clusters a few probes do.
    """
    slim = corpus.select(F.col("kb_id").cast("string").alias("kb_id"), F.col("chunk_id").cast("string").alias("chunk_id"), F.col("embedding").cast("array<double>").alias("embedding")).where("embedding is not null and kb_id is not null")
    sample = slim.select("embedding", F.size("embedding").alias("n")).where("n > 0").orderBy(F.xxhash64(slim["chunk_id"]), slim["chunk_id"]).limit(cells).collect()
    length = max((r["n"] for r in sample), default=1, key=[r["n"] for r in sample].count)
    centres = np.array([r["embedding"] for r in sample if r["n"] == length], float).reshape(-1, length)
    if not len(centres):
        centres = np.zeros((1, length))
    probes = min(probes, len(centres))
    placed = slim.mapInArrow(lambda it: _cells(it, centres, "embedding", 1), "kb_id string, chunk_id string, embedding array<double>, cells array<int>")
    q = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("kb_id").cast("string").alias("kb_id"), F.col("vector").cast("array<double>").alias("vector")).where("vector is not null")
    asked = q.mapInArrow(lambda it: _cells(it, centres, "vector", probes), "query_id long, kb_id string, vector array<double>, cells array<int>")
    both = F.concat("kb_id", F.lit("|"), F.col("cell").cast("string")).alias("kb_id")
    inside = placed.select("*", F.col("cells")[0].alias("cell")).select(both, "chunk_id", "embedding")
    near = knn(asked.select("*", F.explode(F.array_distinct("cells")).alias("cell")).select("query_id", both, "vector"), inside, k)
    near = near.withColumn("kb_id", F.regexp_replace("kb_id", r"\|[0-9]+$", ""))
    rank = F.row_number().over(Window.partitionBy("query_id", "kb_id").orderBy(F.desc("similarity"), "chunk_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k)
