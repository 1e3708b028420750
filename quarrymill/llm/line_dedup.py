"""Fuzzy line de-duplication across documents.

Lines are what stands between \\n; a line without a character outside [\\x20\\x09-\\x0D] is blank and is never compared or
removed. A line's set: its distinct 8-character shingles (a shorter line is one shingle); lines are compared as they
stand. Min-max signatures are cut into bands, candidate links are confirmed by the exact Jaccard similarity of the whole
sets, and union-find over the confirmed links leaves one line of each component: the first, by doc_id, text hash and position.

Equal lines are one node, named by a 64-bit hash of the content; 128 bits decide what is equal. Only nodes of different
content become candidates, see components.

Defined results: a null text stays null and has no lines; an empty text has no lines that count; rows without a doc_id keep
their text and are compared with nothing; rows that share a doc_id and the text are copies of one document and are edited
alike, with different texts they are documents of their own; an empty table gives an empty result; texts and lines of any
length are read whole; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textcore as tc
from .common import cut, documents, unused, written
from .components import buckets, linked

#: 12 bands of 3 values of 18 permutations: a pair at similarity 0.8 is missed with probability 2e-4, at 0.85 with 2e-5.
BANDS, ROWS, SHINGLE, PERCENT = 12, 3, 8, 80
#: Lines whose hashes a task keeps at most, so that it signs equal lines once; others are signed again, harmlessly.
REMEMBERED = 200_000
LINES = "doc_id long, mark long, position int, node long, other long"
U64 = np.uint64


def _shingle_hashes(chars: np.ndarray, starts: np.ndarray, ends: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds) of the k-character shingles of the lines chars[starts[i]:ends[i]], which must not be empty."""
    n = len(chars)
    up, down = tc.powers(n + 1)
    sums = np.zeros(n + 1, U64)
    codes = (chars.astype(U64) + U64(1)) * U64(0xD1342543DE82EF95)
    codes ^= codes >> U64(29)
    np.cumsum(codes * up[:n], out=sums[1:])
    sizes = ends - starts
    long = sizes >= k
    at = np.zeros(n, U64)
    if n >= k:
        at[: n - k + 1] = (sums[k:] - sums[:-k]) * down[: n - k + 1]
    short = starts[~long]
    at[short] = (sums[ends[~long]] - sums[short]) * down[short] + sizes[~long].astype(U64) * U64(0xD6E8FEB86659FD93)
    edge = np.zeros(n + 1, np.int8)
    edge[starts] += 1
    edge[np.where(long, ends - k + 1, starts + 1)] -= 1
    return tc.mix(at[np.cumsum(edge[:n], dtype=np.int8) > 0]), np.concatenate([[0], np.cumsum(np.where(long, sizes - k + 1, 1))])


def _lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Code points of a chunk, and of each of its lines that isn't blank: start, end, document, position."""
    chars = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    at = lead[offsets]
    breaks = np.flatnonzero(chars == 10)
    n = len(offsets) - 1
    held = np.searchsorted(breaks, at[1:]) - np.searchsorted(breaks, at[:-1])
    first = np.concatenate([[0], np.cumsum(held + 1)])
    opening = np.zeros(first[-1], bool)
    opening[first[:-1]] = True
    closing = np.zeros(first[-1], bool)
    closing[first[1:] - 1] = True
    starts, ends = np.empty(first[-1], np.int64), np.empty(first[-1], np.int64)
    starts[opening], starts[~opening] = at[:-1], breaks + 1
    ends[closing], ends[~closing] = at[1:], breaks
    doc = np.repeat(np.arange(n), held + 1)
    place = np.arange(first[-1]) - np.repeat(first[:-1], held + 1)
    inked = np.concatenate([[0], np.cumsum((chars != 32) & ((chars < 9) | (chars > 13)))])
    on = inked[ends] > inked[starts]
    return chars, starts[on], ends[on], doc[on], place[on]


def _prints(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[bytes]:
    """128-bit hashes of the lines that stand between these characters."""
    at = np.concatenate([np.flatnonzero((data & 0xC0) != 0x80), [len(data)]])  # the byte of every character
    raw = memoryview(data.tobytes())
    return [xxhash.xxh3_128_digest(raw[a:b]) for a, b in zip(at[starts].tolist(), at[ends].tolist())]


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """LINES of every line that isn't blank: its document (id and Spark's xxhash64 of the text), its number there, 128 bits of
    its content."""
    for batch in batches:
        ids = batch.column("doc_id").to_numpy()
        for first, _, data, offsets in tc.chunks(batch.column("text"), 1 << 18):
            _, starts, ends, doc, place = _lines(data, offsets)
            raw = memoryview(data.tobytes())
            marks = np.array([xxhash.xxh64_intdigest(raw[a:b], 42) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())], U64).view(np.int64)
            prints = np.frombuffer(b"".join(_prints(data, starts, ends)), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(ids[first + doc]), pa.array(marks[doc]), pa.array(place.astype(np.int32)), pa.array(prints[:, 0]), pa.array(prints[:, 1])], ["doc_id", "mark", "position", "node", "other"])


def _bands(batches: Iterator[pa.RecordBatch], bands: int, rows: int, k: int) -> Iterator[pa.RecordBatch]:
    """(node, key) of every line that isn't blank, where this task meets it for the first time."""
    scheme, seen = tc.MinMax(bands, rows), set()
    for batch in batches:
        for _, _, data, offsets in tc.chunks(batch.column("text"), 1 << 18):
            chars, starts, ends, _, _ = _lines(data, offsets)
            own, fresh = _prints(data, starts, ends), []
            for i, print_ in enumerate(own):
                if print_ not in seen:
                    seen.add(print_)
                    fresh.append(i)
            if len(seen) > REMEMBERED:
                seen.clear()
            if fresh:
                nodes = np.frombuffer(b"".join(own[i] for i in fresh), np.int64)[::2]
                keys = scheme.keys(*_shingle_hashes(chars, starts[fresh], ends[fresh], k))
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(nodes, bands)), pa.array(keys.reshape(-1))], ["node", "key"])


def _pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The wanted lines of each document: (node, text)."""
    for batch in batches:
        nodes, lines = [], []
        for text, wanted in zip(batch.column("text").to_pylist(), batch.column("wanted").to_pylist(), strict=True):
            own = text.split("\n")
            for place in wanted:
                nodes.append(place["node"])
                lines.append(own[place["position"]])
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(lines, pa.string())], ["node", "text"])


def _line_shingles(lines: pa.Array, k: int, most: int = 1 << 18) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, hashes, bounds) of runs of lines, none of them empty."""
    for first, end, data, offsets in tc.chunks(lines, most):
        text = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        at = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
        yield first, end, *_shingle_hashes(text, at[:-1], at[1:], k)


def _sets(lines: pa.Array, k: int) -> Iterator[np.ndarray]:
    for first, end, hashes, bounds in _line_shingles(lines, k):
        for i in range(end - first):
            yield tc.distinct(hashes[bounds[i] : bounds[i + 1]])


def _texts(firsts: DataFrame, docs: DataFrame) -> DataFrame:
    """firsts(node, first place) -> (node, text). Only the documents' texts are shuffled."""
    wanted = firsts.select("node", "first.*").groupBy("doc_id", "mark").agg(F.collect_list(F.struct("node", "position")).alias("wanted"))
    one = docs.withColumn("mark", F.xxhash64("text")).join(wanted, ["doc_id", "mark"]).select("text", "wanted")
    return one.mapInArrow(_pick, "node long, text string").dropDuplicates(["node"])


def repeated_lines(docs: DataFrame, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS, shingle: int = SHINGLE) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, mark, position, first_doc_id, first_position) of the lines that repeat an earlier one; mark
    is the xxhash64 of the document's text."""
    docs = documents(docs).where("doc_id is not null and text is not null")
    lines = written(docs.mapInArrow(_read, LINES), "lines")
    shared = cut(buckets(docs.mapInArrow(lambda it: _bands(it, bands, rows, shingle), "node long, key long")))
    candidates = shared.select("node").distinct()
    # lines that stand once and share no band key stay; only the places of the others are needed from here on
    often = lines.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("node")
    places = cut(lines.join(often.union(candidates).distinct().hint("shuffle_hash"), "node", "left_semi"))
    place = F.struct("doc_id", "mark", "position")
    kinds = cut(places.groupBy("node", "other").agg(F.min(place).alias("first")))
    texts = cut(_texts(kinds.join(candidates, "node", "left_semi"), docs))
    labels = linked(shared, texts, lambda own: _sets(own, shingle), percent)
    named = kinds.join(labels, "node", "left")
    heads = named.where("label IS NOT NULL").groupBy("label").agg(F.min("first").alias("head"))
    head = named.join(heads, "label", "left").select("node", "other", F.coalesce("head", "first").alias("head"))
    gone = places.join(head, ["node", "other"]).where(place != F.col("head"))
    return gone.select("doc_id", "mark", "position", F.col("head.doc_id").alias("first_doc_id"), F.col("head.position").alias("first_position"))


def _with_dropped(docs: DataFrame, id_: str, text: str, name: str, **options) -> DataFrame:
    """docs with the numbers of the lines to drop in the column `name`, null if there are none."""
    key, mark = unused(docs, "_id"), unused(docs, "_mark")
    gone = repeated_lines(docs, **options).groupBy(F.col("doc_id").alias(key), F.col("mark").alias(mark)).agg(F.collect_set("position").alias(name))
    same = (F.col(id_).cast("long") == F.col(key)) & (F.xxhash64(F.col(text).cast("string")) == F.col(mark))
    return docs.join(gone, same, "left").drop(key, mark)


def _rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Puts the kept lines together; a row without dropped lines passes as it is."""
    for batch in batches:
        texts, n_lines, n_dropped = [], [], []
        for text, dropped in zip(batch.column("text").to_pylist(), batch.column("dropped").to_pylist(), strict=True):
            lines = [] if text is None else text.split("\n")
            gone = set(dropped or ())
            texts.append("\n".join(x for i, x in enumerate(lines) if i not in gone) if gone else text)
            n_lines.append(len(lines))
            n_dropped.append(len(gone))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], ["doc_id", "text", "n_lines", "n_dropped"])


def dedup_lines(docs: DataFrame, **options) -> DataFrame:
    """docs(doc_id, text) -> one row per row: doc_id, text without repeated lines, n_lines, n_dropped."""
    joined = _with_dropped(documents(docs), "doc_id", "text", "dropped", **options)
    return joined.mapInArrow(_rebuild, "doc_id long, text string, n_lines long, n_dropped long")


def _edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Like _rebuild, for rows of any columns, the numbers of dropped lines last: text and n_chars change, rows left without a
    word go."""
    for batch in batches:
        names = batch.schema.names[:-1]
        texts, dropped = batch.column("text").to_pylist(), batch.column(len(names)).to_pylist()
        stays = np.ones(len(batch), bool)
        changed = [i for i, gone in enumerate(dropped) if gone]
        for i in changed:
            gone = set(dropped[i])
            texts[i] = "\n".join(x for p, x in enumerate(texts[i].split("\n")) if p not in gone)
            stays[i] = bool(texts[i].strip(" \t\n\v\f\r"))
        columns = {name: batch.column(name) for name in names}
        columns["text"] = pa.array(texts, batch.schema.field("text").type)
        if "n_chars" in columns:
            counts = columns["n_chars"].to_pylist()
            for i in changed:
                counts[i] = len(texts[i])
            columns["n_chars"] = pa.array(counts, batch.schema.field("n_chars").type)
        yield pa.RecordBatch.from_arrays(list(columns.values()), names).filter(pa.array(stays))


def edit_documents(docs: DataFrame, **options) -> DataFrame:
    """docs with the repeated lines taken out of text, and all other columns as they are (n_chars follows the text).

    A document all of whose words stood in repeated lines is dropped: earlier documents hold them. Documents that had no
    words before stay, as do rows without a doc_id or a text; repeated rows are edited alike.
    """
    return _with_dropped(docs, "doc_id", "text", unused(docs, "_dropped"), **options).mapInArrow(_edit, docs.schema)
