"""Candidates out of band keys, their confirmation on whole sets, and connected components: DataFrames that never meet in one
task.

A bucket is what shares a band key. Its nodes first meet one of them, the pivot. Buckets that still span several
components after that are compared in full: as pairs of blocks of bounded size, which are spread over all tasks and return
true links only. A pair that shares a bucket and could change the components is never skipped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Nodes and bytes of text of a block, about; and the parts in which the links of one pivot are dealt out.
BLOCK, BLOCK_BYTES, SALTS = 128, 1 << 23, 16
#: Links that one task of union-find holds, about.
LINKS = 250_000
#: Elements that are compared as bits at a time, and bytes of text that are cut into elements at a time.
SLAB, RUN_BYTES = 4096, 1 << 20

#: Cuts an array of texts into the sorted distinct hashes of each text's elements.
Sets = Callable[[pa.Array], Iterator[np.ndarray]]


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key -> (key, node, pivot) of the keys of several nodes; pivot is the node that came first."""
    key, pivot, alone = None, None, True
    for batch in batches:
        keys, nodes = batch.column("key").to_numpy(), batch.column("node").to_numpy()
        if not len(keys):
            continue
        goes_on = key is not None and keys[0] == key
        if goes_on:  # the group that the last batch ended in
            keys, nodes = np.append(key, keys), np.append(pivot, nodes)
        opens = np.ones(len(keys), bool)
        opens[1:] = keys[1:] != keys[:-1]
        first, group = np.flatnonzero(opens), np.cumsum(opens) - 1
        pivots = nodes[first][group]
        other = nodes != pivots
        several = np.zeros(len(first), bool)
        several[group[other]] = True
        # the pivot's row goes out with the first row of another node
        on = other | (opens & several[group])
        if goes_on and not alone:
            on[0] = False
        key, pivot, alone = keys[-1], pivots[-1], not several[-1] and not (goes_on and len(first) == 1 and not alone)
        yield pa.RecordBatch.from_arrays([pa.array(keys[on]), pa.array(nodes[on]), pa.array(pivots[on])], ["key", "node", "pivot"])


def buckets(bands: DataFrame) -> DataFrame:
    """bands(node, key) -> distinct (key, node, pivot) for keys that more than one node has; pivot is any one of them.

    One exchange by key; sorted rows stream through, so a key of any size takes constant memory.
    """
    return bands.select("key", "node").repartition("key").sortWithinPartitions("key").mapInArrow(_shared, "key long, node long, pivot long").distinct()


def stars(in_buckets: DataFrame) -> DataFrame:
    """Distinct candidate links (a, b) from every node of a bucket to the bucket's pivot b."""
    return in_buckets.where("node != pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct()


def _alike(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    if min(len(x), len(y)) * 100 < percent * max(len(x), len(y)):
        return False
    both = np.concatenate([x, y])
    both.sort()
    shared = int((both[1:] == both[:-1]).sum())
    return shared > 0 and 100 * shared >= percent * (len(both) - shared)


def _confirm(batches: Iterator[pa.RecordBatch], sets: Sets, percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        volume = np.cumsum(pc.add(pc.binary_length(batch.column("text_a")), pc.binary_length(batch.column("text_b"))).to_numpy())
        first = 0
        while first < len(batch):
            end = max(first + 1, int(np.searchsorted(volume, RUN_BYTES + (volume[first - 1] if first else 0), "right")))
            rows = batch.slice(first, end - first)
            # each distinct text of the run is cut into elements once
            coded = pa.concat_arrays([rows.column("text_a"), rows.column("text_b")]).dictionary_encode()
            own, index = list(sets(coded.dictionary)), coded.indices.to_numpy()
            good = [_alike(own[p], own[q], percent) for p, q in zip(index[: len(rows)], index[len(rows) :], strict=True)]
            yield pa.RecordBatch.from_arrays([rows.column("a"), rows.column("b")], ["a", "b"]).filter(pa.array(good, pa.bool_()))
            first = end


def confirmed(links: DataFrame, texts: DataFrame, sets: Sets, percent: int) -> DataFrame:
    """The links (a, b) whose texts' whole sets are similar enough: 100 * shared >= percent * union. texts(node, text).

    A node has few links as `a`, but may be the pivot `b` of very many: those are dealt out in SALTS parts, and the pivot's
    text goes to each part that has links.
    """
    salted = links.withColumn("salt", F.pmod(F.xxhash64("a"), F.lit(SALTS)))
    left = salted.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    parts = salted.select("b", "salt").distinct()
    right = parts.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    both = left.join(right, ["b", "salt"]).select("a", "b", "text_a", "text_b")
    return both.mapInArrow(lambda it: _confirm(it, sets, percent), "a long, b long").distinct()


def apart(in_buckets: DataFrame, labels: DataFrame) -> DataFrame:
    """(key, node, label, in_main) of the buckets whose nodes lie in several components: in_main marks the largest of them.

    Buckets of two nodes are left out, as their one pair has been compared, and of buckets that hold the same nodes one stays.
    """
    placed = in_buckets.select("key", "node").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    sizes = placed.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("node").cast("decimal(20,0)")).alias("print"))
    kinds = sizes.groupBy("key").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.count(F.lit(1)).alias("labels"), F.sum("n").alias("members"), F.sum("print").alias("print"))
    kinds = kinds.where("labels > 1 and members > 2").groupBy("members", "print").agg(F.min_by("key", "key").alias("key"), F.min_by("main", "key").alias("main"))
    return placed.join(kinds.select("key", "main"), "key").select("key", "node", "label", (F.col("label") == F.col("main")).alias("in_main"))


def block_pairs(entries: DataFrame, texts: DataFrame, block: int | None = None, most: int = BLOCK_BYTES) -> DataFrame:
    """entries(key, node, label, in_main), texts(node, text) -> one row a pair of blocks of a bucket: `blocks`, one or two lists
    of (node, label, text). Nodes of the main component only meet the others.

    Each block holds about `block` nodes and `most` bytes (a longer text has one to itself, nearly), and goes once to each
    of its partners; the pairs of a large bucket are spread over all tasks.
    """
    block, held = block or BLOCK, entries.join(texts, "node")
    count, volume = F.count(F.lit(1)), F.sum(F.octet_length("text"))
    parts = lambda n, size: F.greatest(F.ceil(n / block), F.ceil(size / most))
    of = lambda c: (F.count_if(c), F.coalesce(F.sum(F.when(c, F.octet_length("text"))), F.lit(0)))
    main = F.col("in_main")
    sizes = held.groupBy("key").agg(parts(count, volume).alias("all"), parts(*of(main)).alias("many"), F.greatest(parts(*of(~main)), F.lit(1)).alias("few"))
    # what fits into one block is compared there
    whole = F.col("all") <= 1
    placed = held.join(sizes.select("key", "few", F.when(whole, 0).otherwise(F.col("many")).alias("many"), whole.alias("whole")), "key").withColumn("in_main", main & ~F.col("whole"))
    # blocks 0 .. few - 1 are of the other components, the rest of the main one
    part = F.pmod(F.xxhash64("node"), F.when(main, F.greatest("many", F.lit(1))).otherwise(F.col("few"))) + F.when(main, F.col("few")).otherwise(0)
    blocks = placed.withColumn("part", part).groupBy("key", "part", "few", "many").agg(F.collect_list(F.struct("node", "label", "text")).alias("held"))
    last = F.when(F.col("part") < F.col("few"), F.col("few") + F.col("many")).otherwise(F.col("few")) - 1
    meets = blocks.select("key", "held", "part", F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"))).alias("other"))
    return meets.groupBy("key", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j")).agg(F.collect_list("held").alias("blocks")).select("blocks")


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[pa.ListArray, list[list[int]]]]:
    """Slices of the column `blocks` with about RUN_BYTES of text (or one row), and for each row the sizes of its blocks."""
    rows = batch.column("blocks")
    inner = rows.flatten()
    block = np.concatenate([[0], np.cumsum(pc.list_value_length(inner).to_numpy())])
    ends = np.concatenate([[0], np.cumsum(pc.list_value_length(rows).to_numpy())])
    volume = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(inner.flatten().field("text")), 0).to_numpy())])[block[ends]]
    first = 0
    while first < len(rows):
        end = max(first + 1, int(np.searchsorted(volume, volume[first] + RUN_BYTES, "right")) - 1)
        yield rows.slice(first, end - first), [np.diff(block[ends[i] : ends[i + 1] + 1]).tolist() for i in range(first, end)]
        first = end


def _intersections(own: list[np.ndarray], n: int, m: int) -> np.ndarray:
    """Sizes of the intersections of the first n sets with the last m. A set is a row of bits, one for each element that several
    sets have."""
    every = np.concatenate(own)
    order = np.argsort(every, kind="stable")
    opens = np.ones(len(every), bool)
    opens[1:] = every[order[1:]] != every[order[:-1]]
    group = np.cumsum(opens) - 1
    often = np.bincount(group) > 1
    on = often[group]
    column, row = (np.cumsum(often) - 1)[group[on]], np.repeat(np.arange(len(own)), [len(x) for x in own])[order[on]]
    shared = np.zeros((n, m), np.int64)
    for first in range(0, int(often.sum()), SLAB):
        here = (column >= first) & (column < first + SLAB)
        ones = np.zeros((len(own), min(SLAB, -(-(int(often.sum()) - first) // 64) * 64)), bool)
        ones[row[here], column[here] - first] = True
        bits = np.packbits(ones, axis=1).view(np.uint64)
        right = bits[len(own) - m :]
        for i in range(n):
            shared[i] += np.bitwise_count(bits[i] & right).sum(axis=1, dtype=np.int64)
    return shared


def _confirm_blocks(batches: Iterator[pa.RecordBatch], sets: Sets, percent: int) -> Iterator[pa.RecordBatch]:
    """True links between nodes of different components, one for each two components of a pair of blocks."""
    for batch in batches:
        for rows, sizes in _runs(batch):
            cells = rows.flatten().flatten()
            own, at = list(sets(cells.field("text"))), 0
            nodes, labels = (cells.field(c).to_numpy(zero_copy_only=False) for c in ("node", "label"))
            for held in sizes:
                here = slice(at, at := at + sum(held))
                label, node, volume = labels[here], nodes[here], np.array([len(x) for x in own[here]])
                n, m = held[0], held[-1]
                shared = _intersections(own[here], n, m)
                near = (shared > 0) & (100 * shared >= percent * (volume[:n, None] + volume[None, -m:] - shared))
                i, j = np.nonzero(near & (label[:n, None] != label[None, -m:]))
                if len(i):
                    j += len(label) - m
                    ends = np.sort(np.stack([label[i], label[j]], axis=1), axis=1)
                    _, one = np.unique(ends, axis=0, return_index=True)
                    x, y = node[i[one]], node[j[one]]
                    yield pa.RecordBatch.from_arrays([pa.array(np.maximum(x, y)), pa.array(np.minimum(x, y))], ["a", "b"])


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over one partition's links: (a, b) from every node to the least node of its component there."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (up := parent.setdefault(top, top)) != top:
            top = up
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    nodes = list(parent)
    ends = np.array([[x, root(x)] for x in nodes], np.int64).reshape(-1, 2)
    ends = ends[ends[:, 0] != ends[:, 1]]
    yield pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], ["a", "b"])


def components(links: DataFrame) -> DataFrame:
    """links(a, b) -> (node, label) for every node of a link: label is the smallest node that it reaches.

    Distributed union-find: every partition of LINKS links, about, becomes a forest of stars; then rounds of taking the neighbours'
    smallest label, then the label's label, until nothing changes. The edges and each round's labels are written to the
    shared checkpoint folder.
    """
    links = links.select("a", "b").where("a != b")
    forest = links.coalesce(-(-links.count() // LINKS) or 1).mapInArrow(_forest, "a long, b long")
    edges = cut(forest.union(forest.select("b", "a")).distinct())
    labels = cut(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("label")))
    while True:
        near = edges.join(labels, edges["b"] == labels["node"]).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("seen"))
        lower = labels.join(near, "node").select("node", F.col("label").alias("before"), F.least("label", "seen").alias("label"))
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("above"))
        after = cut(lower.join(up, "label", "left").select("node", "before", F.least("label", F.coalesce("above", "label")).alias("label")))
        labels = after.select("node", "label")
        if after.where("label != before").isEmpty():
            return labels


def linked(shared: DataFrame, texts: DataFrame, sets: Sets, percent: int) -> DataFrame:
    """shared(key, node, pivot), texts(node, text) of all its nodes -> (node, label): the components of all confirmed links
    within buckets."""
    labels = components(cut(confirmed(stars(shared), texts, sets, percent)))
    mixed = cut(apart(shared, labels))
    if mixed.isEmpty():
        return labels
    pairs = block_pairs(mixed, texts.join(mixed.select("node").distinct(), "node", "left_semi"))
    more = cut(pairs.mapInArrow(lambda it: _confirm_blocks(it, sets, percent), "a long, b long").distinct())
    if more.isEmpty():
        return labels
    # the new links join whole components: those become nodes
    of = lambda c: labels.select(F.col("node").alias(c), F.col("label").alias(f"of_{c}"))
    between = more.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b"))
    merged = components(cut(between)).select(F.col("node").alias("label"), F.col("label").alias("above"))
    alone = merged.select(F.col("label").alias("node"), F.col("above").alias("label")).join(labels, "node", "left_anti")
    return cut(labels.join(merged, "label", "left").select("node", F.coalesce("above", "label").alias("label")).union(alone))
