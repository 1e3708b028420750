"""A quality classifier: histogram gradient-boosted trees over statistics of a document.

Statistics of a whole text are taken once, in numpy over Arrow batches, and written; training and scoring read only them.
Training bins each statistic at quantiles, adds up gradients by bin to choose the splits of a level, and boosts the logistic
loss; it runs in one task, on at most about PER_LABEL different texts a label. The trees are complete binary ones of DEPTH levels,
flattened into arrays, and all rows descend all trees at once.

Defined results: a null text counts as empty; an empty text has statistics of 0 and a score like others; a row without
a doc_id is scored but never learned from; equal texts teach once, with their larger label; with no labels every score is 0.5, with
labels of one kind their smoothed share; repeated rows are scored alike; a text of any length is read whole; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textcore as tc
from .common import held_out, written

PER_LABEL = 20_000
THRESHOLD = 0.7
TREES, DEPTH, RATE, BINS = 60, 4, 0.15, 64
#: Added to each leaf's sum of second derivatives, and their least sum in a leaf.
SHRINK, LEAST = 1.0, 0.5
U64 = np.uint64

#: Classes of bytes whose shares are statistics.
_CLASSES = {
    "upper": [*range(65, 91)],
    "digit": [*range(48, 58)],
    "space": [32, 9, 11, 12, 13],
    "newline": [10],
    "stop": [*b".!?"],
    "comma": [*b",;:"],
    "symbol": [*b"#*$%&|<>"],
    "bracket": [*b"()[]{}/\\=+_~^@`"],
    "quote": [*b"\"'-"],
    "beyond_ascii": [*range(128, 256)],
}
STATISTICS = (
    "log_bytes", "log_words", "log_lines", "log_longest_word", "mean_word", "word_spread", "entropy", *_CLASSES,
    "distinct_words", "top_word", "same_as_before", "repeated_triples", "repeated_lines", "words_a_line", "ends_in_stop", "ends_in_symbol", "starts_upper",
)


def _lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of every line with at least one byte."""
    cuts = np.union1d(offsets, np.concatenate([at := np.flatnonzero(data == 10), at + 1])).astype(np.int64)
    starts, ends = cuts[:-1], cuts[1:]
    own = data[starts] != 10 if len(starts) else np.zeros(0, bool)
    starts, ends = starts[own], ends[own]
    return starts, ends, np.searchsorted(offsets[1:], starts, "right")


def _own(hashes: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Hashes that differ between documents."""
    return tc.mix(hashes ^ tc.mix(doc.astype(U64) + U64(1)))


def _repeats(hashes: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Number of different items of each document, and how often its most frequent one occurs."""
    kept, first, counts = np.unique(_own(hashes, doc), return_index=True, return_counts=True)
    owner, most = doc[first], np.zeros(n, np.int64)
    np.maximum.at(most, owner, counts)
    return np.bincount(owner, minlength=n), most


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """float64[documents, STATISTICS] of documents laid end to end."""
    n = len(offsets) - 1
    sizes = np.diff(offsets)
    per_byte = np.bincount(np.repeat(np.arange(n), sizes) * 256 + data, minlength=n * 256).reshape(n, 256)
    share = per_byte / np.maximum(sizes, 1)[:, None]
    entropy = -(share * np.log2(np.where(share > 0, share, 1))).sum(axis=1)
    starts, ends, doc = tc.spans(data, offsets)
    words = np.bincount(doc, minlength=n)
    some = np.maximum(words, 1)
    length = (ends - starts).astype(float)
    mean = np.bincount(doc, length, n) / some
    spread = np.sqrt(np.maximum(np.bincount(doc, length * length, n) / some - mean * mean, 0))
    longest = np.zeros(n)
    np.maximum.at(longest, doc, length)
    hashes = tc.word_hashes(data, starts, ends)
    different, most = _repeats(hashes, doc, n)
    again = np.zeros(len(doc), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])
    triples, bounds = tc.shingles(hashes, doc, n, 3)
    made = np.diff(bounds)
    distinct_triples, _ = _repeats(triples, np.repeat(np.arange(n), made), n)
    line_start, line_end, line_doc = _lines(data, offsets)
    lines = np.bincount(line_doc, minlength=n)
    distinct_lines, _ = _repeats(tc.word_hashes(data, line_start, line_end), line_doc, n)
    flags = {name: np.isin(np.arange(256), codes) for name, codes in _CLASSES.items()}
    part = lambda mask: np.bincount(doc[mask], minlength=n) / some
    last, first = (data[ends - 1], data[starts]) if len(doc) else (np.zeros(0, np.uint8),) * 2
    columns = [np.log1p(sizes), np.log1p(words), np.log1p(lines), np.log1p(longest), mean, spread, entropy]
    columns += [share[:, mask].sum(axis=1) for mask in flags.values()]
    columns += [different / some, most / some, part(again), 1 - distinct_triples / np.maximum(made, 1), 1 - distinct_lines / np.maximum(lines, 1), words / np.maximum(lines, 1)]
    columns[-3], columns[-2] = np.where(made > 0, columns[-3], 0), np.where(lines > 0, columns[-2], 0)
    columns += [part(flags["stop"][last]), part(flags["symbol"][last]), part(flags["upper"][first])]
    return np.stack(columns, axis=1).astype(float)


@dataclass
class Trees:
    """Complete trees flattened: inner node i of a tree goes to 2i + 1, or to 2i + 2 if the statistic is above the bound."""

    start: float = 0.0
    feature: np.ndarray = field(default_factory=lambda: np.zeros((0, 2**DEPTH - 1), np.int32))
    bound: np.ndarray = field(default_factory=lambda: np.zeros((0, 2**DEPTH - 1)))
    leaf: np.ndarray = field(default_factory=lambda: np.zeros((0, 2**DEPTH)))

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of rows x[rows, statistics]; all trees step down together."""
        rows, trees = np.arange(len(x))[:, None], np.arange(len(self.leaf))[None, :]
        at = np.zeros((len(x), len(self.leaf)), np.int64)
        inner = self.feature.shape[1]
        while inner and at.size and at.min() < inner:
            at = 2 * at + 1 + (x[rows, self.feature[trees, at]] > self.bound[trees, at])
        total = self.start + self.leaf[trees, at - inner].sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def cuts(x: np.ndarray, bins: int = BINS) -> list[np.ndarray]:
    """For each statistic the bounds between its bins: at most bins - 1 values halfway between neighbouring ones, at quantiles."""
    out = []
    for column in x.T:
        values = np.unique(column)
        halfway = (values[1:] + values[:-1]) / 2
        if len(halfway) > bins - 1:
            ranked = np.sort(column)
            picked = np.searchsorted(values, ranked[np.linspace(0, len(ranked) - 1, bins + 1)[1:-1].astype(int)])
            halfway = halfway[np.unique(np.minimum(picked, len(halfway) - 1))]
        out.append(halfway)
    return out


def boost(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> Trees:
    """Trees fitted to labels y (0 or 1): at each level every node takes the split of the largest gain, by histograms of the
    first and second derivatives of the logistic loss; a node without gain sends all its rows left."""
    n, ones = len(y), float(y.sum())
    out = Trees(start=float(np.log((ones + 1) / (n - ones + 1))))
    if n == 0 or ones in (0, n):
        return out
    edges = cuts(x)
    width = max(map(len, edges)) + 1
    binned = np.stack([np.searchsorted(e, column, "left") for e, column in zip(edges, x.T, strict=True)], axis=1)
    places = binned + np.arange(x.shape[1]) * width
    features, bounds, leaves = [], [], []
    total = np.full(n, out.start)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        slope, bend = p - y, p * (1 - p)
        at, feature, bound = np.zeros(n, np.int64), np.zeros(2**depth - 1, np.int32), np.full(2**depth - 1, np.inf)
        for level in range(depth):
            nodes, first = 2**level, 2**level - 1
            slots = ((at - first)[:, None] * (x.shape[1] * width) + places).ravel()
            g, h = (np.bincount(slots, np.repeat(v, x.shape[1]), nodes * x.shape[1] * width).reshape(nodes, x.shape[1], width) for v in (slope, bend))
            left_g, left_h = g.cumsum(axis=2), h.cumsum(axis=2)
            all_g, all_h = left_g[:, :, -1:], left_h[:, :, -1:]
            gain = left_g**2 / (left_h + SHRINK) + (all_g - left_g) ** 2 / (all_h - left_h + SHRINK) - all_g**2 / (all_h + SHRINK)
            gain[(left_h < LEAST) | (all_h - left_h < LEAST)] = 0
            best = gain.reshape(nodes, -1).argmax(axis=1)
            own, cut = np.divmod(best, width)
            worth = gain.reshape(nodes, -1)[np.arange(nodes), best] > 1e-9
            feature[first : first + nodes] = np.where(worth, own, 0)
            bound[first : first + nodes] = [edges[f][c] if w else np.inf for f, c, w in zip(own, cut, worth, strict=True)]
            at = 2 * at + 1 + (x[np.arange(n), feature[at]] > bound[at])
        leaf = at - (2**depth - 1)
        value = -RATE * np.bincount(leaf, slope, 2**depth) / (np.bincount(leaf, bend, 2**depth) + SHRINK)
        total = total + value[leaf]
        for kept, made in ((features, feature), (bounds, bound), (leaves, value)):
            kept.append(made)
    return Trees(out.start, np.stack(features), np.stack(bounds), np.stack(leaves))


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, end, data, offsets in tc.chunks(batch.column("text")):
            rows = batch.slice(first, end - first)
            flat = statistics(data, offsets).ravel()
            lists = pa.ListArray.from_arrays(pa.array(np.arange(end - first + 1, dtype=np.int32) * len(STATISTICS)), pa.array(flat))
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("copy"), lists], ["doc_id", "copy", "x"])


def measured(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> doc_id, copy (a hash of the text), x (its statistics)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("copy"), text.alias("text"))
    return rows.mapInArrow(_measure, "doc_id long, copy long, x array<double>")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), len(STATISTICS))


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    x, y = [np.zeros((0, len(STATISTICS)))], [np.zeros(0)]
    for batch in batches:
        x.append(_matrix(batch.column("x")))
        y.append(batch.column("label").to_numpy().astype(float))
    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(boost(np.concatenate(x), np.concatenate(y)))], pa.binary())], ["trees"])


def learn(measured: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> Trees:
    """measured(doc_id, copy, x), labels(doc_id, quality) -> trees, from documents that aren't held out.

    Copies of a text are one row before the sample is drawn, by the hash of the text; one task reads it, about per_label rows of
    a few hundred bytes for each label.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").cast("int").alias("label"))
    texts = measured.join(known, "doc_id").groupBy("copy").agg(F.max("label").alias("label"), F.max("x").alias("x"))
    texts = written(texts, "labelled")
    counts = {r["label"]: r["n"] for r in texts.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    spread = 1 << 20
    share = [int(spread * min(1.0, per_label / counts.get(label, 1))) for label in (0, 1)]
    drawn = F.pmod(F.xxhash64("copy", F.lit(7)), F.lit(spread)) < F.when(F.col("label") == 1, share[1]).otherwise(share[0])
    made = texts.where(drawn).repartition(1).sortWithinPartitions("copy").mapInArrow(_fit, "trees binary").first()
    return pickle.loads(made["trees"]) if made else Trees()


def _score(batches: Iterator[pa.RecordBatch], trees: Trees, threshold: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first in range(0, len(batch), 4096):
            rows = batch.slice(first, 4096)
            scores = trees.scores(_matrix(rows.column("x")))
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("held_out"), pa.array(scores), pa.array((scores >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])


def score(measured: DataFrame, trees: Trees, threshold: float = THRESHOLD) -> DataFrame:
    """measured(doc_id, x) -> doc_id, held_out, score, predicted."""
    rows = measured.select("doc_id", held_out().alias("held_out"), "x")
    return rows.mapInArrow(lambda it: _score(it, trees, threshold), "doc_id long, held_out boolean, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs(doc_id, text), labels(doc_id, quality) -> doc_id, held_out, score, predicted for every row of docs."""
    rows = written(measured(docs), "statistics")
    return score(rows, learn(rows, labels))
