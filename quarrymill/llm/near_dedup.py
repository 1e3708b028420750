"""Near-duplicate documents by min-max hashing, confirmed on the full shingle sets.

Documents with equal sets are one node. Min-max signatures are cut into bands; nodes that share a band's key are
candidates. Every candidate link that can change a component is confirmed on the two whole shingle sets, and the
components are the classes. No pair within a group of copies is listed: a bucket's nodes meet its smallest node, and
only nodes that are still apart after that meet each other.

Defined results: a null or blank text has the empty set and is linked with nothing; rows without a doc_id are linked with
nothing and kept; rows that share a doc_id are one document with the links of either; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textcore as tc
from .common import cut, documents, unused
from .components import buckets, linked

#: 40 bands of 6 values of 120 permutations: a pair at similarity 0.8 is missed with probability 5e-6.
BANDS, ROWS = 40, 6


def _features(batches: Iterator[pa.RecordBatch], k: int, bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    scheme = tc.MinMax(bands, rows)
    for batch in batches:
        ids = batch.column("doc_id")
        for first, end, data, offsets in tc.chunks(batch.column("text")):
            n = end - first
            starts, ends, doc = tc.spans(data, offsets)
            hashes, bounds = tc.shingles(tc.word_hashes(data, starts, ends), doc, n, k)
            sizes = np.zeros(n, np.int64)
            prints: list[bytes | None] = [None] * n
            for i in np.flatnonzero(np.diff(bounds)):
                own = tc.distinct(hashes[bounds[i] : bounds[i + 1]])
                sizes[i] = len(own)
                prints[i] = np.array([tc.mix(own).sum(dtype=np.uint64), tc.mix(own ^ np.uint64(0xA5A5A5A55A5A5A5A)).sum(dtype=np.uint64)]).tobytes()
            keys = tc.lists(scheme.keys(hashes, bounds), np.flatnonzero(np.diff(bounds)), n)
            yield pa.RecordBatch.from_arrays([ids.slice(first, n).cast(pa.int64()), pa.array(sizes), pa.array(prints, pa.binary()), keys], ["doc_id", "n_shingles", "print", "bands"])


def _sets(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    for first, end, data, offsets in tc.chunks(texts):
        starts, ends, doc = tc.spans(data, offsets)
        hashes, bounds = tc.shingles(tc.word_hashes(data, starts, ends), doc, end - first, k)
        for i in range(end - first):
            yield tc.distinct(hashes[bounds[i] : bounds[i + 1]])


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """docs(doc_id, text) -> one row per document: doc_id, n_shingles, component_id, kept.

    words: words of a shingle, `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased. Two documents are linked if
    100 * intersection >= percent * union of their sets. component_id: the smallest doc_id reachable; kept: it is its own.
    """
    docs = documents(docs)
    made = docs.mapInArrow(lambda it: _features(it, words, bands, rows), "doc_id long, n_shingles long, print binary, bands array<long>")
    rows_ = cut(made)
    nodes = cut(rows_.where("n_shingles > 0 and doc_id is not null").groupBy("print").agg(F.min("doc_id").alias("node"), F.first("bands").alias("bands")))
    shared = cut(buckets(nodes.select("node", F.explode("bands").alias("key"))))
    texts = docs.where("doc_id is not null").select(F.col("doc_id").alias("node"), "text").join(shared.select("node").distinct(), "node", "left_semi")
    labels = linked(shared, cut(texts), lambda own: _sets(own, words), percent)
    named = nodes.select("print", "node").join(labels, "node", "left").select("print", F.coalesce("label", "node").alias("component"))
    out = rows_.select("doc_id", "n_shingles", "print").join(named, "print", "left")
    out = out.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs that near_duplicates keeps, with all their columns; of rows that share a doc_id one stays, the one whose
    text has the least hash. Rows without a doc_id and rows without words stay; an empty table stays empty."""
    name, order = unused(docs, "_gone"), unused(docs, "_order")
    gone = near_duplicates(docs, **options).where("not kept").select(F.col("doc_id").alias(name)).distinct()
    left = docs.join(gone, F.col("doc_id").cast("long") == F.col(name), "left_anti")
    first = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64("text"), "text"))
    one = left.where("doc_id is not null").withColumn(order, first).where(F.col(order) == 1).drop(order)
    return one.unionByName(left.where("doc_id is null"))
