"""Keyword retrieval: token postings, BM25 whole and pruned, substring candidates, and the keyword score."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import HYBRID
from ..functions.text import let, occurrences, tokens
from ..sources.scratch import among, settled
from .vectors import meeting

#: Robertson & Zaragoza (2009).
K1, B = 1.2, 0.75
WORD_BREAK = r"[^\p{L}\p{N}_]+"
#: Postings of a block, queries that look at a chunk's text together, and what rounding may add to a score.
BLOCK, TOGETHER, SLACK = 256, 256, 1e-6
#: Words of chunks that a task looks at together; chunks of a lot and queries of a part that meet in one group of containing.
WORDS, LOT, PART = 250_000, 2048, 1024
#: Tokens of a query, those with the highest peaks, whose first blocks give its bound.
BOUNDING = 8
#: Words and chunks of a lot of leading, queries of a part, parts that come to every task, slots that more are dealt by, lots of a file.
LOT_WORDS, LOT_CHUNKS, LEADING, PARTS, SLOTS, FILE = 500_000, 4096, 1024, 8, 64, 8


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks with their words -> a row for each different word of a chunk: kb_id, token, chunk_id, tf, length; and one with the token
    "" and tf 0 for the chunk itself, whose length is null where it has no text. A run of WORDS words is counted at a time."""
    for batch in batches:
        volume = np.cumsum(pc.fill_null(pc.list_value_length(batch.column("words")), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        first = 0
        while first < len(batch):
            end = max(first + 1, int(np.searchsorted(volume, WORDS + (volume[first - 1] if first else 0), "right")))
            rows_, first = batch.slice(first, end - first), end
            words = rows_.column("words")
            sizes = pc.list_value_length(words)
            counts = pc.fill_null(sizes, 0).to_numpy(zero_copy_only=False)
            coded = words.flatten().dictionary_encode()
            n = max(1, len(coded.dictionary))
            at = np.repeat(np.arange(len(rows_), dtype=np.int64), counts) * n + coded.indices.to_numpy(zero_copy_only=False)
            pairs, tf = np.unique(at, return_counts=True)
            chunk = pa.array(np.concatenate([pairs // n, np.arange(len(rows_))]))
            token = pa.concat_arrays([coded.dictionary.take(pa.array(pairs % n)).cast(pa.string()), pa.array([""] * len(rows_), pa.string())])
            tf = pa.array(np.concatenate([tf, np.zeros(len(rows_))]).astype(np.int64))
            columns = [rows_.column("kb_id").take(chunk), token, rows_.column("chunk_id").take(chunk), tf, sizes.cast(pa.int32()).take(chunk)]
            yield pa.RecordBatch.from_arrays(columns, ["kb_id", "token", "chunk_id", "tf", "length"])


def _tallied(chunks: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """What _tally gives for chunks(kb_id, chunk_id, content), of the tokens in wanted(kb_id, token) and "" only, if given."""
    split = F.filter(F.split(F.lower("content"), WORD_BREAK), lambda t: t != "")
    words = chunks.select("kb_id", "chunk_id", split.alias("words"))
    kinds = dict(words.dtypes)
    out = words.mapInArrow(_tally, f"kb_id {kinds['kb_id']}, token string, chunk_id {kinds['chunk_id']}, tf long, length int")
    if wanted is None:
        return out
    own = wanted.withColumn("_own", F.lit(True))
    return out.join(own, ["kb_id", "token"], "left").where("_own or token = ''").drop("_own")


def postings(chunks: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """chunks(kb_id, chunk_id, content) -> kb_id, token, chunk_id, tf, length (tokens of the chunk, with repeats); of the tokens in
    wanted(kb_id, token) only, if given. Words are counted inside their chunk, so nothing is exchanged."""
    return _tallied(chunks, wanted).where("token != ''")


def _indexed(chunks: DataFrame, wanted: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """postings, written once, and by knowledge base the number n and the mean length of its chunks: texts are split once for both."""
    rows = settled(_tallied(chunks, wanted), "postings")
    return rows.where("token != ''"), rows.where("token = ''").groupBy("kb_id").agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("mean"))


def _asked(queries: DataFrame) -> DataFrame:
    split = F.array_distinct(F.filter(F.split(F.lower("query_text"), WORD_BREAK), lambda t: t != ""))
    return queries.select("query_id", "kb_id", F.explode(split).alias("token"))


def bm25(queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """queries(query_id, kb_id, query_text) -> query_id, kb_id, chunk_id, ft_score for chunks that share a token.

    The postings meet the queries' tokens in an equi-join; no query is compared with a chunk that has none of its tokens.
    """
    asked = _asked(queries)
    wanted, stats = _indexed(chunks, asked.select("kb_id", "token").distinct())
    df = wanted.groupBy("kb_id", "token").agg(F.count(F.lit(1)).alias("df"))
    scored = wanted.join(df, ["kb_id", "token"]).join(stats, "kb_id")
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    found = scored.withColumn("part", part).join(asked, ["kb_id", "token"])
    return found.groupBy("query_id", "kb_id", "chunk_id").agg(F.round(F.sum("part"), 6).alias("ft_score"))


# --- pruned ---------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Impacts:
    """postings(kb_id, token, chunk_id, impact), and the same as blocks in falling order of impact: blocks(kb_id, token, block, top,
    ids, impacts), where top is the greatest impact."""

    postings: DataFrame
    blocks: DataFrame


def _blocks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Postings sorted by (kb_id, token, impact falling) as blocks of up to `most` of one token; `at`, a row's number, names its block."""
    for batch in batches:
        changed = np.zeros(len(batch), bool)
        changed[:1] = True
        for name in ("kb_id", "token"):
            column = batch.column(name)
            changed[1:] |= pc.not_equal(column.slice(1), column.slice(0, len(batch) - 1)).to_numpy(zero_copy_only=False)
        runs = np.flatnonzero(changed)
        sizes = np.diff(np.append(runs, len(batch)))
        pieces = -(-sizes // most)
        starts = np.repeat(runs, pieces) + most * (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces))
        offsets = pa.array(np.append(starts, len(batch)).astype(np.int32))
        lists = [pa.ListArray.from_arrays(offsets, batch.column(c)) for c in ("chunk_id", "impact")]
        heads = [batch.column(c).take(pa.array(starts)) for c in ("kb_id", "token", "at", "impact")]
        yield pa.RecordBatch.from_arrays([*heads, *lists], ["kb_id", "token", "block", "top", "ids", "impacts"])


def impacts(chunks: DataFrame, queries: DataFrame | None = None) -> Impacts:
    """chunks(kb_id, chunk_id, content) -> what each token adds to a chunk's BM25 score; for the tokens of `queries` only, if given.

    Postings are sorted by ranges of (token, impact), so a frequent token lies in many tasks and blocks.
    """
    wanted = None if queries is None else _asked(queries).select("kb_id", "token").distinct()
    index, stats = _indexed(chunks, wanted)
    df = index.groupBy("kb_id", "token").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    weighed = index.join(df.join(stats, "kb_id"), ["kb_id", "token"]).select(F.col("kb_id").cast("string").alias("kb_id"), "token", F.col("chunk_id").cast("string").alias("chunk_id"), part.alias("impact"))
    weighed = settled(weighed, "impacts")
    order = [F.col("kb_id"), F.col("token"), F.col("impact").desc(), F.col("chunk_id")]
    ranged = weighed.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    made = ranged.mapInArrow(lambda it, most=BLOCK: _blocks(it, most), "kb_id string, token string, block long, top double, ids array<string>, impacts array<double>")
    return Impacts(weighed, settled(made, "blocks"))


def bm25_top(queries: DataFrame, index: Impacts, most: int, looked: bool = False) -> DataFrame:
    """queries(query_id, kb_id, query_text) -> query_id, kb_id, chunk_id, ft_score: of each query the `most` chunks that bm25 puts first,
    with the same scores, ties to the smaller chunk_id. looked: query_id and the numbers of blocks read and skipped instead.

    The first blocks of a query's tokens give sums that `most` chunks reach at least: a bound. Tokens whose peaks together stay below
    it can't bring a chunk in, so candidates come from the other tokens, and of those only from blocks whose top may reach the
    bound with the other tokens' peaks. The rest of a candidate's tokens is looked up by chunk.
    """
    asked = _asked(queries).select("query_id", F.col("kb_id").cast("string").alias("kb_id"), "token")
    of = ["query_id", "kb_id"]
    heads = index.blocks.select("kb_id", "token", "block", "top")
    first = F.row_number().over(Window.partitionBy("kb_id", "token").orderBy(F.desc("top"), "block"))
    peaks = heads.withColumn("_f", first).where("_f = 1").drop("_f").withColumnRenamed("top", "peak")
    held = settled(asked.join(peaks, ["kb_id", "token"]), "asked")
    opened = lambda pairs: pairs.join(index.blocks.select("block", F.arrays_zip("ids", "impacts").alias("z")), "block").select(*of, F.explode("z").alias("z")).select(*of, F.col("z.ids").alias("chunk_id"), F.col("z.impacts").alias("impact"))
    highest = F.row_number().over(Window.partitionBy(*of).orderBy(F.desc("peak"), "token"))
    sums = opened(held.withColumn("_h", highest).where(F.col("_h") <= BOUNDING).select(*of, "block")).groupBy(*of, "chunk_id").agg(F.sum("impact").alias("s"))
    nth = F.row_number().over(Window.partitionBy(*of).orderBy(F.desc("s")))
    bound = sums.withColumn("_n", nth).where(F.col("_n") == most).select(*of, (F.col("s") - SLACK).alias("bound"))
    rising = Window.partitionBy(*of).orderBy("peak", "token")
    tokens_ = held.join(bound, of, "left").withColumn("bound", F.coalesce("bound", F.lit(0.0)))
    tokens_ = tokens_.withColumns({"below": F.sum("peak").over(rising.rowsBetween(Window.unboundedPreceding, Window.currentRow)), "all": F.sum("peak").over(Window.partitionBy(*of))})
    tokens_ = settled(tokens_.withColumn("needed", F.col("below") >= F.col("bound")), "tokens")
    wide = tokens_.where("needed").drop("block").join(heads, ["kb_id", "token"])
    kept = F.col("top") + F.col("all") - F.col("peak") >= F.col("bound")
    if looked:
        every = tokens_.select("query_id", "kb_id", "token").join(heads, ["kb_id", "token"]).groupBy("query_id").agg(F.count(F.lit(1)).alias("blocks"))
        read = wide.where(kept).groupBy("query_id").agg(F.count(F.lit(1)).alias("read"))
        return every.join(read, "query_id", "left").select("query_id", F.coalesce("read", F.lit(0)).alias("read"), (F.col("blocks") - F.coalesce("read", F.lit(0))).alias("skipped"))
    seen = opened(wide.where(kept).select(*of, "block")).groupBy(*of, "chunk_id").agg(F.sum("impact").alias("s"))
    rest = tokens_.groupBy(*of).agg(F.max("bound").alias("bound"), F.coalesce(F.sum(F.when(~F.col("needed"), F.col("peak"))), F.lit(0.0)).alias("rest"))
    able = settled(seen.join(rest, of).where("s + rest >= bound").select(*of, "chunk_id", "s"), "able")
    more = able.join(tokens_.where("not needed").select(*of, "token"), of).join(index.postings, ["kb_id", "token", "chunk_id"]).groupBy(*of, "chunk_id").agg(F.sum("impact").alias("m"))
    scored = able.join(more, [*of, "chunk_id"], "left").select(*of, "chunk_id", F.round(F.col("s") + F.coalesce("m", F.lit(0.0)), 6).alias("ft_score"))
    rank = F.row_number().over(Window.partitionBy(*of).orderBy(F.desc("ft_score"), "chunk_id"))
    return scored.withColumn("_r", rank).where(F.col("_r") <= most).drop("_r")


def _lots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks with their words -> a row for a run of chunks of one knowledge base: their number n, how many are told (have a text) and
    the total of their words; ids and lengths of the chunks; the run's words and in how many chunks (df) each is; the pairs of a chunk
    and a word of it, as steps from one to the next in the grid of both, and their tf."""
    names = ["kb_id", "n", "told", "total", "ids", "words", "df", "lengths", "steps", "tf"]
    one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
    for batch in batches:
        batch = batch.take(pc.sort_indices(batch.column("kb_id")))
        volume = np.cumsum(pc.fill_null(pc.list_value_length(batch.column("words")), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        kb, first = batch.column("kb_id").dictionary_encode().indices.to_numpy(zero_copy_only=False), 0
        while first < len(batch):
            end = min(first + LOT_CHUNKS, int(np.searchsorted(volume, LOT_WORDS + (volume[first - 1] if first else 0), "right")), int(np.searchsorted(kb, kb[first], "right")))
            rows, first = batch.slice(first, max(first + 1, end) - first), max(first + 1, end)
            words = rows.column("words")
            lengths = pc.list_value_length(words)
            counts = pc.fill_null(lengths, 0).to_numpy(zero_copy_only=False)
            coded = words.flatten().dictionary_encode()
            n = max(1, len(coded.dictionary))
            pairs, tf = np.unique(np.repeat(np.arange(len(rows), dtype=np.int64), counts) * n + coded.indices.to_numpy(zero_copy_only=False), return_counts=True)
            figures = [pa.array([x], pa.int64()) for x in (len(rows), len(rows) - lengths.null_count, int(counts.sum()))]
            blobs = [pa.array([_narrow(x)], pa.binary()) for x in (counts, np.diff(pairs, prepend=0), tf)]
            df = pa.array(np.bincount(pairs % n, minlength=len(coded.dictionary)).astype(np.int64))
            yield pa.RecordBatch.from_arrays([rows.column("kb_id").slice(0, 1), *figures, one(rows.column("chunk_id")), one(coded.dictionary.cast(pa.string())), one(df), *blobs], names)


def _narrow(values: np.ndarray) -> bytes:
    """Numbers from 0 up to 32 bits as bytes: how many bytes each takes (1, 2 or 4), and they."""
    size = 1 << int(np.searchsorted([2**8, 2**16], values.max(initial=0), "right"))
    return bytes([size]) + values.astype(f"u{size}").tobytes()


def _widened(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, f"u{raw[0]}", offset=1).astype(np.int64)


def _best(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Pairs of a lot and a part of the queries -> of each query the `most` chunks that bm25 puts first among all lots that the task
    sees; between lots no more than about four times as many rows are kept."""
    held: dict[tuple, dict] = {}
    for batch in batches:
        for row in range(len(batch)):
            get = lambda name: batch.column(name)[row]  # noqa: E731, B023
            kb, key = get("kb_id").as_py(), (get("kb_id").as_py(), get("part").as_py())
            if key not in held:
                token, query, idf = get("asked").values.flatten()
                query, token = query.dictionary_encode(), token.dictionary_encode()
                order = np.argsort(np.array(token.dictionary.to_pylist(), object))  # one order of addition for all lots
                place = np.empty(len(order), np.int64)
                place[order] = np.arange(len(order))
                at, who = place[token.indices.to_numpy(zero_copy_only=False)], query.indices.to_numpy(zero_copy_only=False)
                by = np.argsort(at, kind="stable")
                weights = np.empty(len(order))
                weights[at] = idf.to_numpy(zero_copy_only=False)
                asking = np.split(who[by], np.flatnonzero(np.diff(at[by])) + 1)
                held[key] = {"tokens": token.dictionary.take(pa.array(order)), "asking": asking, "idf": weights, "queries": query.dictionary, "bound": np.zeros(len(query.dictionary)), "rows": [], "n": 0}
            own = held[key]
            ids, words, lengths, tf = get("ids").values, get("words").values, *(_widened(get(c).as_py()) for c in ("lengths", "tf"))
            chunk, code = np.divmod(np.cumsum(_widened(get("steps").as_py())), max(1, len(words)))
            found = pc.fill_null(pc.index_in(own["tokens"], value_set=words), -1).to_numpy(zero_copy_only=False)
            token_of = np.full(len(words) + 1, -1, np.int64)
            token_of[found] = np.arange(len(found))
            token_of[-1] = -1
            tokens_ = token_of[code]
            kept = np.flatnonzero(tokens_ >= 0)
            kept = kept[np.argsort(tokens_[kept], kind="stable")]
            chunk, tf, tokens_ = chunk[kept], tf[kept].astype(float), tokens_[kept]
            part = own["idf"][tokens_] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[chunk] / get("mean").as_py()))
            scores = np.zeros((len(ids), len(own["queries"])))
            starts = np.flatnonzero(np.diff(tokens_, prepend=-1))
            for first, end in zip(starts, np.append(starts, len(tokens_))[1:], strict=True):
                asking = own["asking"][tokens_[first]]
                if len(asking) == 1:
                    scores[chunk[first:end], asking[0]] += part[first:end]
                else:
                    scores[chunk[first:end, None], asking] += part[first:end, None]
            at, query = np.nonzero((scores > 0) & (scores >= own["bound"] - SLACK))
            rounded = np.floor(scores[at, query] * 1e6 + 0.5) / 1e6
            own["rows"].append(pa.table([pa.array(query), pa.array(rounded), ids.take(pa.array(at))], ["query", "score", "id"]))
            own["n"] += len(at)
            if own["n"] > 4 * most * len(own["queries"]):
                _prune(own, most)
    for (kb, _), own in held.items():
        rows = _prune(own, most)
        for batch in rows.combine_chunks().to_batches():
            yield pa.RecordBatch.from_arrays([own["queries"].take(batch.column("query")), pa.array([kb] * len(batch), pa.string()), batch.column("id"), batch.column("score")], ["query_id", "kb_id", "chunk_id", "ft_score"])


def _prune(own: dict, most: int) -> pa.Table:
    """Leaves each query's `most` first rows, and the score that the next rows have to reach."""
    rows = pa.concat_tables(own["rows"])
    rows = rows.take(pc.sort_indices(rows, sort_keys=[("query", "ascending"), ("score", "descending"), ("id", "ascending")]))
    query = rows.column("query").to_numpy()
    place = np.arange(len(query)) - np.searchsorted(query, query)
    last = np.flatnonzero(place == most - 1)
    own["bound"][query[last]] = rows.column("score").to_numpy()[last]
    rows = rows.filter(pa.array(place < most))
    own["rows"], own["n"] = [rows], len(rows)
    return rows


def leading(queries: DataFrame, chunks: DataFrame, most: int) -> DataFrame:
    """What bm25_top gives, without an exchange of postings: every lot of chunks meets every part of the queries in a task, and `most`
    rows a query and task come out.

    Texts are split once; lots are written once, in a few bytes for each different word of a chunk. Some parts come to all tasks;
    more of them, and the lots, are dealt by slots. Of the words in lots only those that queries ask for are exchanged, for
    the number of chunks that have them.
    """
    asked = settled(_asked(queries.where("kb_id is not null").withColumn("kb_id", F.col("kb_id").cast("string"))), "asked")
    split = F.filter(F.split(F.lower("content"), WORD_BREAK), lambda t: t != "")
    words = chunks.select(F.col("kb_id").cast("string").alias("kb_id"), F.col("chunk_id").cast("string").alias("chunk_id"), split.alias("words")).where("kb_id is not null")
    made = among(words, asked, ["kb_id"]).mapInArrow(_lots, "kb_id string, n long, told long, total long, ids array<string>, words array<string>, df array<long>, lengths binary, steps binary, tf binary")
    lots = settled(made, "lots", compression="zstd", maxRecordsPerFile=FILE)  # a file is read at once
    stats = lots.groupBy("kb_id").agg(F.sum("n").alias("n"), (F.sum("total") / F.sum("told")).alias("mean"))
    told = among(lots.select("kb_id", F.explode(F.arrays_zip("words", "df")).alias("w")).select("kb_id", F.col("w.words").alias("token"), "w.df"), asked, ["kb_id", "token"])
    df = told.groupBy("kb_id", "token").agg(F.sum("df").alias("df"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    parts = -(-asked.select("query_id").distinct().count() // LEADING)
    weighed = asked.join(df, ["kb_id", "token"]).join(stats, "kb_id")
    packed = weighed.groupBy("kb_id", F.pmod(F.xxhash64("query_id"), F.lit(max(1, parts))).alias("part")).agg(F.collect_list(F.struct("token", "query_id", idf.alias("idf"))).alias("asked"), F.first("mean").alias("mean"))
    slim = lots.select("kb_id", "ids", "words", "lengths", "steps", "tf")
    if parts <= PARTS:
        met = slim.join(F.broadcast(packed), "kb_id")
    else:
        every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SLOTS - 1).cast("long"))).alias("slot")
        met = slim.withColumn("slot", F.pmod(F.xxhash64("ids"), F.lit(SLOTS))).join(packed.select("*", every).hint("merge"), ["kb_id", "slot"]).drop("slot")
    found = met.mapInArrow(lambda it: _best(it, most), f"query_id {dict(asked.dtypes)['query_id']}, kb_id string, chunk_id string, ft_score double")
    rank = F.row_number().over(Window.partitionBy("query_id", "kb_id").orderBy(F.desc("ft_score"), "chunk_id"))
    return found.withColumn("_r", rank).where(F.col("_r") <= most).drop("_r")


def _holding(queries: pa.Table, chunks: pa.Table) -> pa.Table:
    """The pairs of one part's queries and one lot's chunks where the chunk holds one of the query's tokens."""
    asking: dict[str, list[int]] = {}
    for i, own in enumerate(queries.column("tokens").to_pylist()):
        for token in own or ():
            asking.setdefault(token, []).append(i)
    width, texts = -(-len(queries) // 8), chunks.column("held")
    found = np.zeros((len(chunks), width), np.uint8)  # a bit a query
    volume = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(), dtype=np.int64)
    first = 0
    while first < len(chunks) and asking:
        end = max(first + 1, int(np.searchsorted(volume, 16 * WORDS + (volume[first - 1] if first else 0), "right")))
        place: dict[str, int] = {}
        rows = [[place.setdefault(w, len(place)) for w in (x or "").split(" ")] for x in texts.slice(first, end - first).to_pylist()]
        vocabulary = " ".join(place)
        starts = list(accumulate((len(w) + 1 for w in place), initial=0))
        bits = np.zeros((len(place), width), np.uint8)
        for token, own in asking.items():
            mark, at, hits = np.zeros(width, np.uint8), vocabulary.find(token), []
            while at >= 0:
                word = bisect_right(starts, at) - 1
                hits.append(word)
                at = vocabulary.find(token, starts[word + 1])
            if hits:
                for i in own:
                    mark[i >> 3] |= 1 << (i & 7)
                bits[hits] |= mark
        for i, own in enumerate(rows):
            found[first + i] = np.bitwise_or.reduce(bits[own], axis=0)
        first = end
    at, query = np.nonzero(np.unpackbits(found, axis=1, bitorder="little")[:, : len(queries)])
    # rows of one chunk_id are in one lot: they are one chunk
    coded = chunks.column("chunk_id").combine_chunks().dictionary_encode()
    if len(coded.dictionary) < len(chunks):
        _, one = np.unique(coded.indices.to_numpy(zero_copy_only=False)[at].astype(np.int64) * max(1, len(queries)) + query, return_index=True)
        at, query = at[one], query[one]
    at, query = pa.array(at), pa.array(query)
    return pa.table([queries.column("query_id").take(query), chunks.column("kb_id").take(at), chunks.column("chunk_id").take(at)], ["query_id", "kb_id", "chunk_id"])


def containing(queries: DataFrame, chunks: DataFrame, lot_rows: int = LOT, part_rows: int = PART) -> DataFrame:
    """Pairs (query_id, kb_id, chunk_id) where the chunk contains one of the query's tokens anywhere, whatever its case.

    A token holds no white space, so it stands within one word of a chunk. A lot of chunks and a part of the queries meet in one
    group: tokens are looked up in the lot's distinct words, and a pair comes out once, whatever the number of its tokens. What is
    exchanged are the chunks' distinct words, once a part, and never pairs. Knowledge bases without a query are left out first.
    """
    kinds = dict(chunks.dtypes)
    kb = queries.select("query_id", F.col("kb_id").cast(kinds["kb_id"]).alias("kb_id"), tokens(F.col("query_text")).alias("tokens")).where("kb_id is not null")
    asked = kb.groupBy("query_id", "kb_id").agg(F.array_distinct(F.flatten(F.collect_list("tokens"))).alias("tokens")).where("size(tokens) > 0")
    own = chunks.join(F.broadcast(asked.select("kb_id").distinct()), "kb_id", "left_semi")
    held = own.select("kb_id", "chunk_id", F.array_join(F.array_distinct(F.split(F.lower("content"), r"(?U)\s+")), " ").alias("held")).where("chunk_id is not null")
    met = meeting(asked, held, ["kb_id"], ("query_id", part_rows), ("chunk_id", lot_rows))
    return met.applyInArrow(_holding, f"query_id {dict(asked.dtypes)['query_id']}, kb_id {kinds['kb_id']}, chunk_id {kinds['chunk_id']}")


def _keyword_scores(hits: Column, tf: Column, asked: Column, length: Column, ft: Column, config) -> Column:
    """Coverage and damped counts of the query's tokens, a penalty for long chunks, a share of the full-text score where there is one."""
    raw = (0.7 * hits / asked + 0.3 * (tf / (tf + 2.0))) * F.greatest(F.lit(0.6), F.least(F.lit(1.0), 300.0 / F.greatest(F.lit(300.0), length.cast("double"))))
    mixed = F.when(ft > 0, raw * 0.75 + F.least(F.lit(1.0), ft / (ft + 5.0)) * 0.25).otherwise(raw)
    return F.when(hits > 0, F.pow(F.greatest(F.lit(0.0), F.least(F.lit(1.0), mixed)), F.lit(max(0.5, config.keyword_power))))


def _ranked(rows: DataFrame, top_k: int | None) -> DataFrame:
    """rows(query_id, chunk_id, _raw, ...) with score, best 1.0 within a query, rounded; only hits; the top_k with their rank."""
    best = F.max("_raw").over(Window.partitionBy("query_id"))
    out = rows.where("_raw IS NOT NULL").withColumn("_best", best).where("_best > 0").withColumn("score", F.round(F.col("_raw") / F.col("_best"), 6)).drop("_raw", "_best")
    if top_k is None:
        return out
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= top_k)


def score(candidates: DataFrame, top_k: int | None = None, config=HYBRID) -> DataFrame:
    """candidates(query_id, chunk_id, query_text, content, ft_score) with score, best 1.0 within a query, rounded; only hits."""
    counts = let(F.struct(tokens(F.col("query_text")).alias("t"), F.lower("content").alias("low")), lambda x: F.transform(x["t"], lambda t: occurrences(x["low"], t)))
    counted = candidates.withColumn("_counts", counts)
    hits, tf = F.size(F.filter("_counts", lambda n: n > 0)), F.aggregate("_counts", F.lit(0), lambda s, n: s + F.least(F.lit(3), n))
    raw = _keyword_scores(hits, tf, F.size("_counts"), F.length("content"), F.coalesce(F.col("ft_score"), F.lit(0.0)), config)
    return _ranked(counted.withColumn("_raw", raw).drop("_counts"), top_k)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each chunk and each query that looks at it: tokens found, and their occurrences, three a token at most."""
    for batch in batches:
        rows = []
        for kb, chunk_id, low, length, asking in zip(*(batch.column(c).to_pylist() for c in ("kb_id", "chunk_id", "low", "length", "asking")), strict=True):
            known: dict[str, int] = {}
            for q in asking:
                counts = []
                for t in q["tokens"]:
                    n = known.get(t)
                    if n is None:
                        n = known[t] = min(3, low.count(t))
                    counts.append(n)
                rows.append((q["query_id"], kb, chunk_id, q["ft_score"], len(counts), sum(n > 0 for n in counts), sum(counts), length))
        kinds = (pa.int64(), pa.string(), pa.string(), pa.float64(), pa.int32(), pa.int32(), pa.int32(), pa.int32())
        names = ["query_id", "kb_id", "chunk_id", "ft_score", "asked", "hits", "tf", "length"]
        columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)


def counted(pairs: DataFrame, queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """pairs(query_id, kb_id, chunk_id, ft_score) -> with asked, hits, tf and length, as score works them out.

    A chunk's text comes once for all the queries that look at it (TOGETHER at a time), not once a pair; texts that no query looks at
    aren't exchanged.
    """
    said = queries.select("query_id", F.col("kb_id").cast("string").alias("kb_id"), tokens(F.col("query_text")).alias("tokens"))
    rows = pairs.join(said, ["query_id", "kb_id"])
    lot = F.floor(F.row_number().over(Window.partitionBy("kb_id", "chunk_id", F.pmod(F.xxhash64("query_id"), F.lit(64))).orderBy("query_id")) / TOGETHER)
    asking = rows.withColumn("lot", lot).groupBy("kb_id", "chunk_id", "lot", F.when(F.col("lot") > 0, F.pmod(F.xxhash64("query_id"), F.lit(64))).otherwise(0).alias("part")).agg(F.collect_list(F.struct("query_id", F.col("ft_score").cast("double").alias("ft_score"), "tokens")).alias("asking"))
    texts = chunks.select(F.col("kb_id").cast("string").alias("kb_id"), F.col("chunk_id").cast("string").alias("chunk_id"), F.lower("content").alias("low"), F.length("content").alias("length")).where("low is not null")
    texts = among(texts, pairs, ["kb_id", "chunk_id"])
    met = texts.join(asking, ["kb_id", "chunk_id"]).select("kb_id", "chunk_id", "low", "length", "asking")
    return met.mapInArrow(_count, "query_id long, kb_id string, chunk_id string, ft_score double, asked int, hits int, tf int, length int")


def search(queries: DataFrame, chunks: DataFrame, top_k: int, config=HYBRID, index: Impacts | None = None) -> DataFrame:
    """Full text first; queries without a full-text hit fall back to substrings. -> query_id, kb_id, chunk_id, score, rank.

    Only full-text candidates are limited before scoring, as an index would; those of the fallback have no order yet, so all of
    them are scored. Texts are read once they are candidates, and what comes out are ids and numbers.
    """
    q = queries.select("query_id", F.col("kb_id").cast("string").alias("kb_id"), "query_text")
    most = max(top_k * 8, 60)
    full = settled(bm25_top(q, index, most) if index else leading(q, chunks, most), "full")
    left = settled(q.join(full.select("query_id", "kb_id").distinct(), ["query_id", "kb_id"], "left_anti"), "left")
    typed = chunks.withColumns({"kb_id": F.col("kb_id").cast("string"), "chunk_id": F.col("chunk_id").cast("string")})
    pairs = full if left.isEmpty() else settled(full.unionByName(containing(left, typed).withColumn("ft_score", F.lit(0.0))), "pairs")
    made = counted(pairs, q, typed)
    raw = _keyword_scores(F.col("hits"), F.col("tf"), F.col("asked"), F.col("length"), F.coalesce("ft_score", F.lit(0.0)), config)
    return _ranked(made.withColumn("_raw", raw), top_k).select("query_id", "kb_id", "chunk_id", "score", "rank")
