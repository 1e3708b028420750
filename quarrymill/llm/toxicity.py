"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained in numpy.

Inputs of a word (`[^\\x20\\x09-\\x0D]+`, A-Z lower-cased): a hashed word embedding plus the mean of the hashed embeddings of
its character 4-grams. A text is read in windows of WINDOW words that overlap by OVERLAP; the last window ends with the
text, so every word is read. A window's states are pooled by attention into one logit; a text's logit is its highest
window's, calibrated by a logistic fit on labelled texts that training didn't see.

Training is multiple-instance learning on a bounded sample of labelled documents (PER_LABEL, LABEL_BYTES and TEXT_BYTES are its
bounds), in one task; the driver only receives the network. A toxic teaches by the window that looks most toxic (at first by its words' log odds), a clean one by any window.

Defined results: null and blank texts score 0; a row without a doc_id is scored but never learned from; equal texts teach once, as
toxic if any of them is, and repeated rows score alike; texts of any length are scored whole, and those over TEXT_BYTES teach
nothing; with labels of one kind only, or none, every text scores 0; an empty table gives an empty result; other columns are
ignored.
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

WINDOW, OVERLAP = 48, 8
EMBED, HIDDEN, ATTEND = 12, 8, 8
WORD_SLOTS, GRAM_SLOTS, GRAM = 1 << 15, 1 << 14, 4
#: The sample that training reads: labelled documents for each label at most, about; bytes of their texts for each label at most;
#: longer texts aren't sampled.
PER_LABEL, LABEL_BYTES, TEXT_BYTES = 2500, 24_000_000, 400_000
THRESHOLD = 0.3
#: Passes over the training windows, at least, and steps of gradient descent, at least.
EPOCHS, STEPS = 10, 400
BATCH, RATE, SEED = 128, 0.01, 5
#: Bytes of text that are read at a time, about.
RUN = 1 << 19
EMBED_RATE, DECAY = 1.0, 1e-5
#: Documents added to each side of the odds that embeddings start from, and the scale of their logarithm.
SHRINK, ODDS_SCALE = 2.0, 0.5
U64 = np.uint64


@dataclass
class Words:
    """The distinct words of a chunk: word slots, and the slots of their character grams laid end to end."""

    slots: np.ndarray
    grams: np.ndarray
    bounds: np.ndarray


def read_words(data: np.ndarray, offsets: np.ndarray) -> tuple[Words, np.ndarray, np.ndarray]:
    """(distinct words, index of every word's distinct word, first word of every document and their number)."""
    starts, ends, doc = tc.spans(data, offsets)
    hashes = tc.word_hashes(data, starts, ends)
    distinct, first, index = np.unique(hashes, return_index=True, return_inverse=True)
    s, e = starts[first], ends[first]
    sizes = e - s
    # grams of a word between two marks, so that its ends show; bytes stand for characters
    made = np.maximum(sizes + 2 - GRAM, 0) + 1
    bounds = np.concatenate([[0], np.cumsum(made)])
    at = np.arange(bounds[-1]) - np.repeat(bounds[:-1], made)
    word_start, word_size = np.repeat(s, made), np.repeat(sizes, made)
    low = tc._LOWER[data] if len(data) else data
    code = np.zeros(bounds[-1], np.uint32)
    for j in range(GRAM):
        place = at + j - 1
        char = np.where((place >= 0) & (place < word_size), low[np.clip(word_start + place, 0, max(len(low) - 1, 0))], 1) if len(low) else code
        code = code * np.uint32(257) + char.astype(np.uint32)
    code = (code ^ (code >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    words = Words(((distinct >> U64(49)) % U64(WORD_SLOTS)).astype(np.int32), ((code >> np.uint32(16)) % GRAM_SLOTS).astype(np.int32), bounds)
    return words, index.reshape(-1), np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(offsets) - 1))])


def windows(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, size, document) of the windows over documents that hold the words first[i]:first[i + 1]."""
    sizes = np.diff(first)
    step = WINDOW - OVERLAP
    counts = np.where(sizes > WINDOW, -(-(sizes - WINDOW) // step) + 1, np.minimum(sizes, 1))
    doc = np.repeat(np.arange(len(sizes)), counts)
    at = (np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)) * step
    at = np.minimum(at, np.maximum(sizes[doc] - WINDOW, 0))
    return first[doc] + at, np.minimum(sizes[doc], WINDOW), doc


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


@dataclass
class Network:
    """Parameters p by name; f and b are the two directions."""

    p: dict[str, np.ndarray] = field(default_factory=dict)
    slope: float = 1.0
    shift: float = 0.0
    trained: bool = False

    @classmethod
    def fresh(cls, seed: int = SEED) -> "Network":
        rng = np.random.default_rng(seed)
        draw = lambda scale, *shape: (rng.standard_normal(shape) * scale).astype(np.float32)
        p = {"word": np.zeros((WORD_SLOTS, EMBED), np.float32), "gram": np.zeros((GRAM_SLOTS, EMBED), np.float32)}  # unseen words say nothing
        for d in "fb":
            p[f"x{d}"], p[f"u{d}"], p[f"c{d}"] = draw(EMBED**-0.5, EMBED, 3 * HIDDEN), draw(HIDDEN**-0.5, HIDDEN, 3 * HIDDEN), np.zeros(3 * HIDDEN, np.float32)
        p |= {"aw": draw((2 * HIDDEN) ** -0.5, 2 * HIDDEN, ATTEND), "ac": np.zeros(ATTEND, np.float32), "av": draw(ATTEND**-0.5, ATTEND), "ow": draw((2 * HIDDEN) ** -0.5, 2 * HIDDEN), "oc": np.zeros(1, np.float32)}
        return cls(p)

    def embed(self, words: Words) -> np.ndarray:
        if not len(words.slots):
            return np.zeros((0, EMBED), np.float32)
        grams = np.add.reduceat(self.p["gram"][words.grams], words.bounds[:-1], axis=0) / np.diff(words.bounds)[:, None].astype(np.float32)
        return self.p["word"][words.slots] + grams

    def logits(self, inputs: dict[str, np.ndarray], index: np.ndarray, mask: np.ndarray | None, keep: list | None = None) -> np.ndarray:
        """Logits of windows. inputs: gate inputs by direction of the distinct words; index [windows, words];
        mask [windows, words] or None if all are full; keep: gets what the backward pass needs."""
        p, (n, steps) = self.p, index.shape
        states = np.empty((steps, n, 2 * HIDDEN), np.float32)
        trace: dict[str, list] = {"f": [], "b": []}
        for d, order in (("f", range(steps)), ("b", range(steps - 1, -1, -1))):
            h, u = np.zeros((n, HIDDEN), np.float32), p[f"u{d}"]
            for t in order:
                x, g = inputs[d][index[:, t]], h @ u
                zr = _sigmoid(x[:, : 2 * HIDDEN] + g[:, : 2 * HIDDEN])
                z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
                c = np.tanh(x[:, 2 * HIDDEN :] + r * g[:, 2 * HIDDEN :])
                new = c + z * (h - c)
                if mask is not None:
                    new = np.where(mask[:, t, None], new, h)
                if keep is not None:
                    trace[d].append((t, h, zr, c, g[:, 2 * HIDDEN :]))
                h = new
                states[t, :, (0 if d == "f" else HIDDEN) : (HIDDEN if d == "f" else 2 * HIDDEN)] = h
        a = np.tanh(states @ p["aw"] + p["ac"])
        e = a @ p["av"]
        if mask is not None:
            e = np.where(mask.T, e, np.float32(-30))
        w = np.exp(e - e.max(axis=0))
        w /= w.sum(axis=0)
        pooled = np.einsum("tn,tnh->nh", w, states)
        out = pooled @ p["ow"] + p["oc"]
        if keep is not None:
            keep += [trace, states, a, w, pooled]
        return out

    def inputs(self, embedded: np.ndarray) -> dict[str, np.ndarray]:
        return {d: embedded @ self.p[f"x{d}"] + self.p[f"c{d}"] for d in "fb"}

    def gradients(self, words: Words, index: np.ndarray, mask: np.ndarray, target: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross-entropy over windows, by backpropagation through time."""
        p, n = self.p, len(index)
        embedded = self.embed(words)
        kept: list = []
        out = self.logits(self.inputs(embedded), index, mask, kept)
        trace, states, a, w, pooled = kept
        g = {k: np.zeros_like(v) for k, v in p.items()}
        d_out = ((_sigmoid(out) - target) / n).astype(np.float32)
        g["ow"], g["oc"] = pooled.T @ d_out, d_out.sum(keepdims=True)
        d_pooled = d_out[:, None] * p["ow"]
        d_states = w[:, :, None] * d_pooled
        d_w = np.einsum("tnh,nh->tn", states, d_pooled)
        d_e = w * (d_w - (w * d_w).sum(axis=0))
        g["av"] = np.einsum("tn,tna->a", d_e, a)
        d_a = d_e[:, :, None] * p["av"] * (1 - a * a)
        g["aw"], g["ac"] = np.einsum("tnh,tna->ha", states, d_a), d_a.sum(axis=(0, 1))
        d_states = d_states + d_a @ p["aw"].T
        d_embedded = np.zeros_like(embedded)
        for d, side in (("f", slice(0, HIDDEN)), ("b", slice(HIDDEN, 2 * HIDDEN))):
            u, d_h = p[f"u{d}"], np.zeros((n, HIDDEN), np.float32)
            d_x = np.zeros((len(embedded), 3 * HIDDEN), np.float32)
            for t, h, zr, c, gc in reversed(trace[d]):
                d_new = d_h + d_states[t][:, side]
                on = mask[:, t, None]
                z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
                live = np.where(on, d_new, 0)
                d_c = live * (1 - z) * (1 - c * c)
                d_gates = np.concatenate([live * (h - c) * z * (1 - z), d_c * gc * r * (1 - r)], axis=1)
                through = np.concatenate([d_gates, d_c * r], axis=1)
                g[f"u{d}"] += h.T @ through
                np.add.at(d_x, index[:, t], np.concatenate([d_gates, d_c], axis=1))
                d_h = np.where(on, live * z, d_new) + through @ u.T
            g[f"x{d}"], g[f"c{d}"] = embedded.T @ d_x, d_x.sum(axis=0)
            d_embedded += d_x @ p[f"x{d}"].T
        np.add.at(g["word"], words.slots, d_embedded)
        sizes = np.diff(words.bounds)
        np.add.at(g["gram"], words.grams, np.repeat(d_embedded / sizes[:, None].astype(np.float32), sizes, axis=0))
        return g


def _index(index: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word indices and mask [windows, WINDOW]; short windows are padded behind."""
    at = np.arange(WINDOW)
    mask = at[None, :] < size[:, None]
    return index[np.minimum(start[:, None] + at, len(index) - 1)] * mask, mask


def window_logits(net: Network, words: Words, index: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    out = np.empty(len(start), np.float32)
    inputs = net.inputs(net.embed(words))
    for full in (True, False):
        own = np.flatnonzero((size == WINDOW) == full)
        for first in range(0, len(own), 1024):
            rows = own[first : first + 1024]
            at, mask = _index(index, start[rows], size[rows])
            out[rows] = net.logits(inputs, at, None if full else mask)
    return out


@dataclass
class Shelf:
    """Labelled texts as runs of a bounded size: distinct words of every run, the runs' first word, and windows of all."""

    words: Words
    first_word: list[int]
    index: np.ndarray
    start: np.ndarray
    size: np.ndarray
    doc: np.ndarray
    run: np.ndarray

    @classmethod
    def fill(cls, texts: list[str]) -> "Shelf":
        slots, grams, bounds, index, start, size, doc, run, first_word = [], [], [np.zeros(1, np.int64)], [], [], [], [], [], [0]
        n_words = n_index = n_grams = 0
        for first, end, data, offsets in tc.chunks(pa.array(texts, pa.string()), RUN):
            words, own, begins = read_words(data, offsets)
            s, z, d = windows(begins)
            slots.append(words.slots)
            grams.append(words.grams)
            bounds.append(words.bounds[1:] + n_grams)
            index.append((own + n_words).astype(np.int32))
            start.append(s + n_index)
            size.append(z)
            doc.append(d + first)
            run.append(np.full(len(s), len(first_word) - 1))
            n_words, n_index, n_grams = n_words + len(words.slots), n_index + len(own), n_grams + len(words.grams)
            first_word.append(n_words)
        join = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
        return cls(Words(join(slots), join(grams), join(bounds)), first_word, join(index), join(start), join(size), join(doc), join(run))

    def part(self, run: int) -> Words:
        a, b = self.first_word[run], self.first_word[run + 1]
        bounds = self.words.bounds[a : b + 1]
        return Words(self.words.slots[a:b], self.words.grams[bounds[0] : bounds[-1]], bounds - bounds[0])

    def logits(self, net: Network) -> np.ndarray:
        out = np.zeros(len(self.start), np.float32)
        for run in range(len(self.first_word) - 1):
            own = np.flatnonzero(self.run == run)
            out[own] = window_logits(net, self.part(run), self.index - self.first_word[run], self.start[own], self.size[own])
        return out


def _best(logits: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """The window with the highest logit of each document, -1 for documents without windows."""
    out = np.full(n, -1)
    order = np.lexsort((logits, doc))
    out[doc[order]] = order  # the last of a document's entries stays
    return out


def _pick(words: Words, used: np.ndarray) -> tuple[Words, np.ndarray]:
    """The distinct words in used only, and the new index of the entries of used."""
    kept, index = np.unique(used, return_inverse=True)
    sizes = np.diff(words.bounds)[kept]
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    at = np.arange(bounds[-1]) - np.repeat(bounds[:-1] - words.bounds[kept], sizes)
    return Words(words.slots[kept], words.grams[at], bounds), index.reshape(used.shape)


def train(texts: list[str], labels: list[int], epochs: int = EPOCHS, steps: int = STEPS, seed: int = SEED) -> Network:
    """The network from labelled texts; every fifth text is kept for the calibration."""
    net, rng = Network.fresh(seed), np.random.default_rng(seed)
    y = np.array(labels, np.float32)
    if len(set(labels)) < 2:
        return net
    shelf = Shelf.fill(texts)
    words, index, start, size, doc = shelf.words, shelf.index, shelf.start, shelf.size, shelf.doc
    n = len(texts)
    learns = np.arange(n) % 5 != 0
    totals = [max(1, int((learns & (y == label)).sum())) for label in (0, 1)]
    at, mask = _index(index, start, size) if len(start) else (np.zeros((0, WINDOW), int), np.zeros((0, WINDOW), bool))
    # shrunken log odds of a word's or gram's presence: the first component of its embedding, and a first guess of windows
    seen = {"word": np.zeros((2, WORD_SLOTS)), "gram": np.zeros((2, GRAM_SLOTS))}
    for run in range(len(shelf.first_word) - 1):
        own = np.flatnonzero((shelf.run == run) & learns[doc])
        pairs = np.unique((at[own].astype(np.int64) * n + doc[own][:, None])[mask[own]])  # distinct words of each document
        word, owner = pairs // n, pairs % n
        sizes = np.diff(words.bounds)[word]
        which = np.arange(sizes.sum()) + np.repeat(words.bounds[word] - np.cumsum(sizes) + sizes, sizes)
        for name, slots, docs in (("word", words.slots[word], owner), ("gram", words.grams[which], np.repeat(owner, sizes))):
            pairs = np.unique(slots.astype(np.int64) * n + docs)
            for label in (0, 1):
                seen[name][label] += np.bincount(pairs[y[pairs % n] == label] // n, minlength=seen[name].shape[1])
    for name, (clean_, toxic_) in seen.items():
        net.p[name][:, 0] = ODDS_SCALE * np.log((toxic_ + SHRINK) / (clean_ * (totals[1] / totals[0]) + SHRINK))
    sign = np.concatenate([net.embed(shelf.part(run))[:, 0] for run in range(len(shelf.first_word) - 1)] or [np.zeros(0, np.float32)])
    guess = np.where(mask, sign[at], -9).max(axis=1, initial=-9) if len(start) else np.zeros(0)
    clean, toxic = np.flatnonzero(learns[doc] & (y[doc] == 0)), np.flatnonzero(learns & (y == 1))
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items() if k not in ("word", "gram")}
    epochs = max(epochs, -(-steps // max(1, -(-4 * len(toxic) // BATCH))))
    step = 0
    for epoch in range(epochs):
        if epoch >= 0.3 * epochs and epoch % max(1, epochs // 10) == 0:
            guess = shelf.logits(net)
        best = _best(guess, doc, n)[toxic]
        positive = best[best >= 0]
        hard = clean[np.argsort(-guess[clean], kind="stable")[: len(positive)]]
        other = rng.permutation(clean)[: 2 * len(positive)]
        rows = rng.permutation(np.concatenate([positive, hard, other]))
        target = (y[doc[rows]] == 1).astype(np.float32)
        for i in range(0, len(rows), BATCH):
            own, part = rows[i : i + BATCH], target[i : i + BATCH]
            few, local = _pick(words, at[own])
            grads = net.gradients(few, local, mask[own], part)
            step += 1
            rate = RATE * (0.5 if epoch > epochs // 2 else 1.0)
            for k, g in grads.items():
                if k in ("word", "gram"):  # plain descent: a word that is seen more often moves farther
                    net.p[k] -= EMBED_RATE * (g + DECAY * net.p[k])
                    continue
                m, v = moment[k]
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                net.p[k] -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    # calibration on the documents that training didn't use
    logits = shelf.logits(net)
    best = _best(logits, doc, n)
    for chosen in (~learns & (best >= 0), best >= 0):
        x, t = logits[best[chosen]].astype(float), y[chosen].astype(float)
        if len(set(t)) == 2:
            break
    slope, shift = 1.0, 0.0
    for _ in range(200):
        q = _sigmoid(slope * x + shift) - t
        slope, shift = max(0.05, slope - 0.5 * (q * x).mean() / max(1.0, (x * x).mean()) * 4), shift - 0.5 * q.mean() * 2
    net.slope, net.shift, net.trained = float(slope), float(shift), True
    return net


def _score(batches: Iterator[pa.RecordBatch], shared, threshold: float) -> Iterator[pa.RecordBatch]:
    net: Network = shared.value
    for batch in batches:
        for first, end, data, offsets in tc.chunks(batch.column("text"), RUN):
            n, scores = end - first, np.zeros(end - first)
            words, index, bounds = read_words(data, offsets)
            start, size, doc = windows(bounds)
            if net.trained and len(start):
                top = np.full(n, -np.inf)
                np.maximum.at(top, doc, window_logits(net, words, index, start, size).astype(float))
                scores = np.where(np.isfinite(top), _sigmoid(net.slope * np.where(np.isfinite(top), top, 0) + net.shift), 0.0)
            rows = batch.slice(first, n)
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("held_out"), pa.array(scores), pa.array((scores >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pickled network of a sorted sample of (text, toxic); a label's texts end with its bytes."""
    texts: list[str] = []
    labels: list[int] = []
    left = {0: LABEL_BYTES, 1: LABEL_BYTES}
    for batch in batches:
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
            left[toxic] -= len(text.encode())
            if left[toxic] >= 0:
                texts.append(text)
                labels.append(toxic)
    order = np.random.default_rng(SEED).permutation(len(texts))
    net = train([texts[i] for i in order], [labels[i] for i in order])
    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(net)], pa.binary())], ["net"])


def learn(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> Network:
    """Trains on labelled documents that aren't held out: about per_label different texts a label, chosen by a hash of the text.

    Copies become one text before anything is counted or chosen, by hashes that meet the labels without the texts. Only the chosen
    ids, bounded by per_label, are broadcast to fetch texts; the sample is bounded in rows and bytes, and one task reads it.
    Without labels of both kinds the network is untrained.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(F.octet_length("text") <= TEXT_BYTES)
    texts = texts.withColumn("copy", F.xxhash64("text"))
    different = texts.select("doc_id", "copy").join(known, "doc_id").groupBy("copy").agg(F.max("toxic").alias("toxic"), F.min("doc_id").alias("doc_id"))
    different = written(different, "labelled")
    counts = {r["toxic"]: r["n"] for r in different.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    spread = 1 << 20
    draw = F.pmod(F.xxhash64("copy", F.lit(3)), F.lit(spread))
    share = {label: int(spread * min(1.0, per_label / n)) for label, n in counts.items()}
    chosen = different.where(F.when(F.col("toxic") == 1, draw < share.get(1, 0)).otherwise(draw < share.get(0, 0))).limit(3 * per_label)
    sample = texts.join(F.broadcast(chosen), ["doc_id", "copy"]).groupBy("copy", "toxic").agg(F.max("text").alias("text"))  # rows may share an id
    made = sample.withColumn("draw", draw).repartition(1).sortWithinPartitions("toxic", "draw", "copy").mapInArrow(_train, "net binary").first()
    return pickle.loads(made["net"]) if made else Network.fresh()


def score(docs: DataFrame, net: Network, threshold: float = THRESHOLD) -> DataFrame:
    """docs(doc_id, text) -> doc_id, held_out, score, predicted: each row's whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(net)  # of fixed size
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text")
    return rows.mapInArrow(lambda it: _score(it, shared, threshold), "doc_id long, held_out boolean, score double, predicted int")


def _keep(batches: Iterator[pa.RecordBatch], shared, threshold: float) -> Iterator[pa.RecordBatch]:
    """The rows, as they are, whose text is not predicted to be toxic."""
    for batch in batches:
        slim = pa.RecordBatch.from_arrays([pa.nulls(len(batch), pa.int64()), pa.nulls(len(batch), pa.bool_()), batch.column("text")], ["doc_id", "held_out", "text"])
        flags = [out.column("predicted").to_numpy() for out in _score(iter([slim]), shared, threshold)]
        yield batch.filter(pa.array(np.concatenate([np.zeros(0, np.int32), *flags]) == 0))


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score under the threshold, with all columns: nulls and blanks stay, repeated rows share their
    fate, an empty table stays empty."""
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs, labels))
    return docs.mapInArrow(lambda it: _keep(it, shared, threshold), docs.schema)
