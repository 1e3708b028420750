"""The prefix trie of conversations, its subtree totals rolled up in bands of depth.

A node is a distinct sequence of first turns; it is named by its smallest member and its depth. Rolling hashes of 128 bits tell
sequences apart, so texts are shuffled once, to put the turns in order. Totals of subtrees come in bands of HEIGHT depths: a node
explodes to its ancestors inside its band only; the band roots, with the sums of their bands as weights, are a trie of a
HEIGHT-th of the depth that is rolled up in the same way; a band root's completed total then goes to its parent, the last node
of the band above, and from there to that node's ancestors in its band. A trie of depth d takes log(d) / log(HEIGHT) rounds, and no
node explodes to more than HEIGHT rows.

Defined results: turns without a conversation id are left out; null roles and texts become empty; turns are ordered by
turn (null first), role, text; repeated rows are repeated turns; a conversation of any length is spread over tasks; an empty
table gives an empty result; other columns are ignored.

A digest over a node's sorted ids is sequential by its definition: ids are joined in runs by all tasks, and one task hashes
a node's runs as they stream by, in constant memory.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written
from .turns import ordered, prefixes

#: Depths of a band.
HEIGHT = 8
#: Shared opening turns: conversation c takes the first crc32(c) % OPENINGS turns of conversation c - c % GROUP.
GROUP, OPENINGS = 100, 6
#: Ids of a run at most.
RUN = 4096
NO_ENDS = hashlib.sha256(b"").hexdigest()


def shared_openings(turns: DataFrame) -> DataFrame:
    """Ordered turns -> those of the rebuilt conversations: conv_id, position, c1, c2, chars, n (turns in all); a conversation
    that is left without turns has one row with position 0."""
    base, h = F.col("conv_id") - F.col("conv_id") % GROUP, F.crc32(F.col("conv_id").cast("string").cast("binary")) % OPENINGS
    sizes = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("own"))
    plans = sizes.select("conv_id", "own", base.alias("base"), h.alias("h"))
    heads = sizes.where(F.col("conv_id") % GROUP == 0).select(F.col("conv_id").alias("base"), F.col("own").alias("head"))
    plans = plans.join(heads, "base", "left").withColumn("taken", F.least("h", F.coalesce("head", F.lit(0))))
    plans = written(plans.withColumn("n", F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0))), "plans")
    opening = turns.where((F.col("conv_id") % GROUP == 0) & (F.col("position") < OPENINGS)).withColumnRenamed("conv_id", "base")
    opening = plans.select("conv_id", "base", "h", "n").join(opening, "base").where("position <= h")
    rest = turns.join(plans.select("conv_id", "h", "taken", "n"), "conv_id").where("position > h").withColumn("position", F.col("taken") + F.col("position") - F.col("h"))
    nothing = plans.where("n = 0").select("conv_id", *[F.lit(0).cast("long").alias(c) for c in ("position", "c1", "c2", "chars", "n")])
    columns = ["conv_id", "position", "c1", "c2", "chars", "n"]
    return opening.select(*columns).union(rest.select(*columns)).union(nothing)


def members(steps: DataFrame) -> DataFrame:
    """Prefixes -> conv_id, depth, n, and of the node there: owner (its smallest member), n_convs, leaf (1 or 0), saved.

    Depth 0, which all conversations share, isn't joined: its owner is one number.
    """
    nodes = steps.where("depth > 0").groupBy("depth", "h1", "h2").agg(F.min("conv_id").alias("owner"), F.count(F.lit(1)).alias("n_convs"), F.sum(F.when(F.col("n") == F.col("depth"), 1).otherwise(0)).alias("ends"), F.max("chars").alias("chars"))
    leaf, saved = (F.col("ends") == F.col("n_convs")).cast("long"), (F.col("n_convs") - 1) * F.col("chars")
    nodes = written(nodes.select("depth", "h1", "h2", "owner", "n_convs", leaf.alias("leaf"), saved.alias("saved")), "nodes")
    found = steps.where("depth > 0").select("conv_id", "depth", "h1", "h2", "n").join(nodes, ["depth", "h1", "h2"]).drop("h1", "h2")
    firsts = steps.where("depth < 2").select("conv_id", "n")  # a row for each conversation
    all_ = firsts.agg(F.min("conv_id").alias("owner"), F.count(F.lit(1)).alias("n_convs"), F.sum(F.when(F.col("n") == 0, 1).otherwise(0)).alias("ends")).first()
    root = [F.lit(v).cast("long").alias(c) for c, v in (("owner", all_["owner"]), ("n_convs", all_["n_convs"]), ("leaf", int(all_["ends"] == all_["n_convs"])), ("saved", 0))]
    return found.unionByName(firsts.select("conv_id", F.lit(0).cast("long").alias("depth"), "n", *root))


def _paths(rows: DataFrame) -> DataFrame:
    """rows(conv_id, depth, owner, ...) of members -> those of nodes (where the owner is the member), with up (the owners of
    its ancestors in its band, itself last), top (the band's first depth) and parent (the parent's owner).

    The last row of a band stands in the next band too, as the parent of its root: a group has at most HEIGHT + 1 rows.
    """
    band = F.floor(F.col("depth") / HEIGHT).cast("long")
    last = F.col("depth") % HEIGHT == HEIGHT - 1
    dealt = rows.withColumn("band", F.explode(F.when(last, F.array(band, band + 1)).otherwise(F.array(band))))
    above = Window.partitionBy("conv_id", "band").orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = dealt.withColumn("seen", F.collect_list("owner").over(above)).where((F.col("owner") == F.col("conv_id")) & (F.col("depth") >= F.col("band") * HEIGHT))
    up = F.when(F.col("band") > 0, F.slice("seen", F.lit(2), F.size("seen"))).otherwise(F.col("seen"))
    return seen.withColumns({"up": up, "top": F.col("band") * HEIGHT, "parent": F.when(F.col("depth") > 0, F.element_at("seen", -2))}).drop("seen", "band")


_WEIGHTS = ("leaf", "saved")


def _to_ancestors(nodes: DataFrame) -> DataFrame:
    """nodes(up, top, leaf, saved) -> conv_id, depth, leaf, saved: summed over the nodes at or below, inside their bands."""
    out = nodes.select("top", *_WEIGHTS, F.posexplode("up").alias("i", "owner"))
    return out.groupBy(F.col("owner").alias("conv_id"), (F.col("top") + F.col("i")).alias("depth")).agg(*[F.sum(c).alias(c) for c in _WEIGHTS])


def rollup(rows: DataFrame, paths: DataFrame | None = None) -> DataFrame:
    """rows(conv_id, depth, owner, leaf, saved) of members, the last two read at nodes only -> conv_id, depth, leaf, saved of each
    node's subtree."""
    paths = _paths(rows) if paths is None else paths
    local = written(_to_ancestors(paths), "bands")
    deepest = local.agg(F.max("depth")).first()[0]
    if deepest is None or deepest < HEIGHT:
        return local
    roots = rows.where(F.col("depth") % HEIGHT == 0).select("conv_id", "depth", "owner").join(local.where(F.col("depth") % HEIGHT == 0), ["conv_id", "depth"], "left")
    whole = rollup(written(roots.withColumn("depth", (F.col("depth") / HEIGHT).cast("long")), "roots"))
    whole = whole.withColumn("depth", F.col("depth") * HEIGHT).where("depth > 0")
    handed = paths.where((F.col("depth") % HEIGHT == 0) & (F.col("depth") > 0)).select("conv_id", "depth", "parent").join(whole, ["conv_id", "depth"])
    handed = handed.groupBy(F.col("parent").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(*[F.sum(c).alias(c) for c in _WEIGHTS])
    deeper = paths.where(F.col("depth") % HEIGHT == HEIGHT - 1).select("conv_id", "depth", "up", "top").join(handed, ["conv_id", "depth"])
    return local.unionByName(_to_ancestors(deeper)).groupBy("conv_id", "depth").agg(*[F.sum(c).alias(c) for c in _WEIGHTS])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (conv_id, depth, end) -> conv_id, depth, first, ids: up to RUN ids of one node, joined by commas."""
    key, ids, rows = None, [], []

    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["conv_id", "depth", "first", "ids"])

    for batch in batches:
        for conv, depth, end in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "depth", "end")), strict=True):
            if (conv, depth) != key or len(ids) == RUN:
                if ids:
                    rows.append((*key, ids[0], ",".join(map(str, ids))))
                key, ids = (conv, depth), []
            ids.append(end)
            if len(rows) == RUN:
                yield out(rows)
                rows = []
    if ids:
        rows.append((*key, ids[0], ",".join(map(str, ids))))
    if rows:
        yield out(rows)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted runs -> conv_id, depth, ends_sha256; a node's runs may span batches."""
    key, digest, rows = None, None, []

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.string()), strict=True)], ["conv_id", "depth", "ends_sha256"])

    for batch in batches:
        for conv, depth, ids in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "depth", "ids")), strict=True):
            if (conv, depth) != key:
                if key:
                    rows.append((*key, digest.hexdigest()))
                key, digest = (conv, depth), hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(ids.encode())
        if rows:
            yield out()
            rows = []
    if key:
        rows.append((*key, digest.hexdigest()))
        yield out()


def ends(rows: DataFrame) -> DataFrame:
    """rows(conv_id, depth, end), a row for each conversation and the node where it ends -> conv_id, depth, ends_sha256."""
    ranged = rows.repartitionByRange("conv_id", "depth", "end").sortWithinPartitions("conv_id", "depth", "end")
    runs = ranged.mapInArrow(_runs, "conv_id long, depth long, first long, ids string")
    return runs.repartition("conv_id", "depth").sortWithinPartitions("conv_id", "depth", "first").mapInArrow(_digests, "conv_id long, depth long, ends_sha256 string")


def prefix_trie(turns: DataFrame) -> DataFrame:
    """turns(conv_id, turn, role, text) with shared openings -> a row for each node: conv_id, depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256."""
    plain = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")]
    steps = shared_openings(ordered(turns.select("conv_id", "turn", *plain)))
    steps = written(prefixes(steps).withColumnRenamed("position", "depth"), "prefixes")
    rows = written(members(steps), "members")
    paths = written(_paths(rows), "paths")
    children = paths.where("depth > 0").groupBy(F.col("parent").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(F.count(F.lit(1)).alias("n_children"))
    totals = rollup(rows, paths).withColumnsRenamed({"leaf": "n_leaves", "saved": "saved_tokens"})
    ended = ends(rows.where("depth = n").select(F.col("owner").alias("conv_id"), "depth", F.col("conv_id").alias("end")))
    facts = paths.select("conv_id", "depth", F.col("parent").alias("parent_conv_id"), "n_convs")
    for more in (children, totals, ended):  # one row a node from each: they meet in one aggregation
        facts = facts.unionByName(more, allowMissingColumns=True)
    names = ("parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    out = facts.groupBy("conv_id", "depth").agg(*[F.max(c).alias(c) for c in names])
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"))
