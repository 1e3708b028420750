"""Language identification by interpolated Kneser-Ney character language models, one for each language.

A text is read as symbols of 16 bits: a letter or mark is its lower-cased code point (those beyond 16 bits are hashed to the
private use area), a run of other characters is one boundary. Four symbols make a gram of 64 bits. Spark counts the grams of
all training texts and adds them up by language, by context and by suffix; the driver turns the sums into levels, one for
each order: a sorted array of grams with a column of log-probabilities for each language, and the back-off weights of their
contexts. All tasks get the levels. The language with the lowest cross-entropy per symbol wins.

4-grams seen fewer than LEAST times give their mass to the lower orders (a count cut-off, as is usual for the highest order);
they still count in all sums. So the model grows with the different grams of the corpus, at 8 bytes and 4 a language each.

A share of the training texts, RESERVED, calibrates the confidence and the rejection: all of these texts, whole, against a model
of the others. Then every training text is counted in the model that predicts. A language of few texts calibrates nothing.

Defined results: a null text or one without a letter is `und` with score 0 (also when nothing was learned); a row without
a doc_id is predicted but never learned from; repeated rows teach and are predicted each; an empty table gives an empty
result; texts of any length are read whole; ties go to the language first in code point order; other columns are ignored.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textcore as tc
from .common import cut, held_out

ORDER, SYMBOL_BITS = 4, 16
SYMBOLS = 1 << SYMBOL_BITS
#: Times that a 4-gram must have been seen to have a probability of its own.
LEAST = 2
UNKNOWN = "und"
#: One in RESERVED training texts of languages with at least RESERVED_FROM calibrates.
RESERVED, RESERVED_FROM = 8, 32
#: What the confidence's sharpness is chosen from, and the units that entropies and losses are rounded to, so that sums are exact.
SHARPNESS, ENTROPY_UNIT, LOSS_UNIT = 2.0 ** np.arange(-4, 6), 1e-4, 1e-6
#: Different grams that a task holds before it hands them on, about.
HELD = 2_000_000
U64, BITS, SPREAD = np.uint64, np.uint64(SYMBOL_BITS), np.uint64(0x9E3779B97F4A7C15)
_tables: list[np.ndarray] = []


def _symbol(char: str) -> int:
    if unicodedata.category(char)[0] not in "LM":
        return 0
    low = ord(char.lower()[0])
    return low if low < SYMBOLS else 0xE000 + low % 0x1900


def symbols(chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The symbol of every code point, 0 for a boundary, and whether it is a letter."""
    if not _tables:
        plain = [chr(c) if not 0xD800 <= c < 0xE000 else " " for c in range(SYMBOLS)]
        _tables.extend([np.array([_symbol(c) for c in plain], np.uint16), np.array([c.isalpha() for c in plain])])
    low = np.minimum(chars, SYMBOLS - 1)
    own, letter = _tables[0][low], _tables[1][low]
    if (beyond := chars >= SYMBOLS).any():
        for c in np.unique(chars[beyond]):
            own[chars == c], letter[chars == c] = _symbol(chr(c)), chr(c).isalpha()
    return own, letter


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(gram of every symbol with the three before it, its document, letters of each document) of a chunk.

    Runs of boundaries count once; a document starts and ends at boundaries.
    """
    n = len(offsets) - 1
    chars = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    at = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
    own, letter = symbols(chars)
    doc = np.repeat(np.arange(n, dtype=np.int32), np.diff(at))
    letters = np.bincount(doc[letter], minlength=n)
    keep = own > 0
    keep[1:] |= keep[:-1] & (doc[1:] == doc[:-1])
    own, doc = own[keep], doc[keep]
    padded = np.zeros(len(own) + (ORDER - 1) * n + ORDER, np.uint16)
    place = np.arange(len(own), dtype=np.int64) + (ORDER - 1) * (doc.astype(np.int64) + 1)
    padded[place] = own
    codes = own.astype(U64)
    for j in range(1, ORDER):
        codes |= padded[place - j].astype(U64) << U64(SYMBOL_BITS * j)
    return codes, doc, letters


def _added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    codes, n = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(codes, kind="stable")
    return _sums(codes[order], n[order])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, gram, n) of one partition; a gram comes once a language, or more often if there are very many."""
    held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

    def out() -> Iterator[pa.RecordBatch]:
        for lang in list(held):
            codes, n = _added(held.pop(lang))
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes.view(np.int64)), pa.array(n)], ["lang", "gram", "n"])

    pending = 0
    for batch in batches:
        coded = batch.column("lang").dictionary_encode()
        langs, names = coded.indices.to_numpy(), coded.dictionary.to_pylist()
        for first, end, data, offsets in tc.chunks(batch.column("text")):
            codes, doc, _ = grams(data, offsets)
            own = langs[first:end]
            for i in np.unique(own):
                if len(mine := codes[(own == i)[doc]]):
                    held.setdefault(names[i], []).append(np.unique(mine, return_counts=True))
                    pending += len(held[names[i]][-1][0])
            if pending > HELD:
                held = {lang: [_added(parts)] for lang, parts in held.items()}
                pending = sum(len(parts[0][0]) for parts in held.values())
                if pending > HELD // 2:
                    yield from out()
                    pending = 0
    yield from out()


def count_grams(docs: DataFrame) -> DataFrame:
    """docs(text, lang) -> lang, gram, n over all of them."""
    return docs.select("text", "lang").mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


@dataclass
class Level:
    """Grams of one order: logs[i, l] is the log-probability of grams[i] in language l. weights[j, l] is what language l multiplies
    the lower order with after contexts[j] (as a logarithm, 0 if it doesn't know the context)."""

    grams: np.ndarray
    logs: np.ndarray
    contexts: np.ndarray
    weights: np.ndarray
    slots: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        """Where most grams are, by their top bits after a multiplication: saves most of the binary searches."""
        self.shift = U64(64 - max(1, (4 * len(self.grams)).bit_length()))
        self.slots = np.zeros(1 << int(64 - self.shift), np.int32)
        self.slots[(self.grams * SPREAD) >> self.shift] = np.arange(len(self.grams))

    def find(self, codes: np.ndarray) -> np.ndarray:
        """The places of the codes among the sorted grams; those that aren't there get the place of another."""
        at = self.slots[(codes * SPREAD) >> self.shift]
        miss = np.flatnonzero(self.grams[at] != codes)
        at[miss] = np.minimum(np.searchsorted(self.grams, codes[miss]), len(self.grams) - 1)
        return at

    def weight(self, codes: np.ndarray) -> np.ndarray:
        context = codes >> BITS
        at = np.minimum(np.searchsorted(self.contexts, context), len(self.contexts) - 1)
        return np.where((self.contexts[at] == context)[:, None], self.weights[at], np.float32(0))


@dataclass
class Model:
    """Levels of the orders 1 to ORDER; the first holds every symbol."""

    langs: list[str]
    levels: list[Level] = field(default_factory=list)
    sharpness: float = 1.0
    limits: np.ndarray | None = None

    def logs(self, codes: np.ndarray, order: int = ORDER) -> np.ndarray:
        """[codes, languages]: log-probabilities of the last symbol of each gram after the others."""
        level = self.levels[order - 1]
        if order == 1:
            return level.logs[codes]
        at = level.find(codes)
        found, out = level.grams[at] == codes, level.logs[at]
        if len(rest := codes[~found]):
            out[~found] = level.weight(rest) + self.logs(rest & U64((1 << (SYMBOL_BITS * (order - 1))) - 1), order - 1)
        return out

    def entropies(self, codes: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
        """[n, languages]: cross-entropy of each document per symbol; documents without symbols get 0."""
        out = np.zeros((n, len(self.langs)))
        if len(codes) and self.langs:
            starts = np.flatnonzero(np.diff(doc, prepend=-1))
            sums = np.add.reduceat(self.logs(codes), starts, axis=0, dtype=np.float64)
            out[doc[starts]] = -sums / np.diff(np.append(starts, len(doc)))[:, None]
        return out


def _discount(one: float, two: float) -> float:
    """Ney's estimate from the numbers of singletons and pairs."""
    return min(max(one / (one + 2 * two), 0.1), 0.95) if one + two else 0.5


def _sums(codes: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(different codes, sums of their values) of sorted codes."""
    starts = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])) if len(codes) else np.zeros(0, int)
    return codes[starts], np.add.reduceat(values, starts) if len(starts) else values[:0]


def _level(model: Model, order: int, counts: list[tuple[np.ndarray, np.ndarray]], totals: list[tuple[np.ndarray, np.ndarray]], discounts: list[float]) -> Level:
    """One level from, by language, sorted grams with counts (above the cut-off) and sorted contexts with the totals of all counts."""
    every = np.unique(np.concatenate([c for c, _ in counts]))
    contexts = np.unique(np.concatenate([c for c, _ in totals]))
    own, weights = np.zeros((len(every), len(counts))), np.zeros((len(contexts), len(counts)), np.float32)
    for i, ((codes, n), (context, total), d) in enumerate(zip(counts, totals, discounts, strict=True)):
        mass = total[np.searchsorted(context, codes >> BITS)]
        share = np.maximum(n - d, 0) / mass
        own[np.searchsorted(every, codes), i] = share
        left = np.ones(len(context))
        with_grams, held = _sums(codes >> BITS, share)
        left[np.searchsorted(context, with_grams)] -= held
        weights[np.searchsorted(contexts, context), i] = np.log(np.maximum(left, 1e-12))
    level = Level(every, np.zeros((0, len(counts)), np.float32), contexts, weights)
    below = model.logs(every & U64((1 << (SYMBOL_BITS * (order - 1))) - 1), order - 1)
    level.logs = np.log(own + np.exp(level.weight(every).astype(float) + below)).astype(np.float32)
    return level


def build(langs: list[str], kept: list[tuple[np.ndarray, np.ndarray]], totals: list[tuple[np.ndarray, np.ndarray]], ends: list[tuple[np.ndarray, np.ndarray]], discounts: list[float]) -> Model:
    """The model from, by language: sorted 4-grams with counts of at least LEAST, sorted contexts with the totals of all 4-grams, sorted
    3-grams with the number of different 4-grams that they end, and the discount of the highest order."""
    model = Model(langs)
    if not langs:
        return model
    lower = [ends]
    for order in (2, 1):  # in how many different grams of the next order a gram ends
        suffixes = [codes & U64((1 << (SYMBOL_BITS * order)) - 1) for codes, _ in lower[-1]]
        lower.append([(codes, n.astype(float)) for codes, n in (np.unique(x, return_counts=True) for x in suffixes)])
    ney = lambda counts: [_discount(int((n == 1).sum()), int((n == 2).sum())) for _, n in counts]
    first = np.zeros((SYMBOLS, len(langs)))
    for i, ((codes, n), d) in enumerate(zip(lower[2], ney(lower[2]), strict=True)):
        first[codes.astype(int), i] = np.maximum(n - d, 0) / n.sum()
        first[:, i] += (1 - first[:, i].sum()) / SYMBOLS
    model.levels.append(Level(np.arange(SYMBOLS, dtype=U64), np.log(first).astype(np.float32), np.zeros(1, U64), np.zeros((1, len(langs)), np.float32)))
    for order, counts in ((2, lower[1]), (3, lower[0])):
        model.levels.append(_level(model, order, counts, [_sums(codes >> BITS, n) for codes, n in counts], ney(counts)))
    model.levels.append(_level(model, 4, kept, totals, discounts))
    return model


def _by_language(rows: DataFrame, langs: list[str], *columns: str) -> list[tuple[np.ndarray, ...]]:
    """rows(lang, gram, ...) as arrays for each language, sorted by gram."""
    table = rows.select("lang", *columns).toArrow()
    coded = table.column("lang").combine_chunks().dictionary_encode() if len(table) else pa.array([], pa.string()).dictionary_encode()
    place = {name: i for i, name in enumerate(coded.dictionary.to_pylist())}
    own, out = coded.indices.to_numpy(), []
    arrays = [table.column(c).to_numpy() for c in columns]
    for lang in langs:
        at = np.flatnonzero(own == place.get(lang, -1))
        codes = arrays[0][at].view(U64)
        order = np.argsort(codes)
        out.append((codes[order], *(a[at][order].astype(float) for a in arrays[1:])))
    return out


def fit(docs: DataFrame) -> Model:
    """The model of docs(text, lang), uncalibrated."""
    counts = cut(count_grams(docs))
    singles = {r["lang"]: r for r in counts.groupBy("lang").agg(F.count_if(F.col("n") == 1).alias("one"), F.count_if(F.col("n") == 2).alias("two")).collect()}
    langs = sorted(singles)
    kept = _by_language(counts.where(F.col("n") >= LEAST), langs, "gram", "n")
    before = counts.groupBy("lang", F.shiftrightunsigned("gram", SYMBOL_BITS).alias("gram")).agg(F.sum("n").alias("n"))
    after = counts.groupBy("lang", F.col("gram").bitwiseAND((1 << (SYMBOL_BITS * (ORDER - 1))) - 1).alias("gram")).agg(F.count(F.lit(1)).alias("n"))
    return build(langs, kept, _by_language(before, langs, "gram", "n"), _by_language(after, langs, "gram", "n"), [_discount(singles[x]["one"], singles[x]["two"]) for x in langs])


def _posteriors(entropies: np.ndarray, letters: np.ndarray, sharpness: float) -> np.ndarray:
    logits = -sharpness * entropies * np.sqrt(np.maximum(letters, 1))[:, None]
    e = np.exp(logits - logits.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def calibrate(model: Model, sums: dict[int, tuple[int, int, int]], losses: np.ndarray) -> Model:
    """Fits the confidence's sharpness by likelihood, and for each language the entropy above which a text is rejected: six
    deviations above its mean. sums: by language the texts, their entropies and the squares of these, in ENTROPY_UNIT; losses: one
    sum for each SHARPNESS."""
    model.limits = np.full(len(model.langs), np.inf)
    if sums:
        model.sharpness = float(SHARPNESS[int(np.argmin(losses))])
        mean = {i: total / n for i, (n, total, _) in sums.items()}
        # whole numbers, so that the difference is exact
        variance = {i: (n * square - total * total) / n**2 for i, (n, total, square) in sums.items()}
        spread = np.sqrt(np.mean(list(variance.values())))
        for i in sums:
            model.limits[i] = (mean[i] + 6 * max(np.sqrt(variance[i]), spread)) * ENTROPY_UNIT + 0.1
    return model


def _measure(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    """One row for each language of a run of texts: lang, n, total, square, losses (see calibrate) of its texts with letters."""
    model: Model = shared.value
    place = {lang: i for i, lang in enumerate(model.langs)}
    for batch in batches:
        for first, end, data, offsets in tc.chunks(batch.column("text"), 1 << 18):
            codes, doc, letters = grams(data, offsets)
            e = model.entropies(codes, doc, end - first)
            true = np.array([place.get(x, -1) for x in batch.column("lang").slice(first, end - first).to_pylist()])
            on = np.flatnonzero((letters > 0) & (true >= 0))
            own = np.rint(e[on, true[on]] / ENTROPY_UNIT).astype(np.int64)
            loss = np.stack([np.rint(-np.log(np.maximum(_posteriors(e[on], letters[on], s)[np.arange(len(on)), true[on]], 1e-9)) / LOSS_UNIT) for s in SHARPNESS], axis=1).astype(np.int64)
            rows = [(int(i), int(at.sum()), int(own[at].sum()), int((own[at] ** 2).sum()), loss[at].sum(axis=0).tolist()) for i in np.unique(true[on]) for at in [true[on] == i]]
            yield pa.RecordBatch.from_pylist([dict(zip(("lang", "n", "total", "square", "losses"), r)) for r in rows], pa.schema([("lang", pa.int32()), ("n", pa.int64()), ("total", pa.int64()), ("square", pa.int64()), ("losses", pa.list_(pa.int64()))]))


def learn(docs: DataFrame) -> Model:
    """docs(doc_id, text, lang), all of them to learn from."""
    sizes = {r["lang"]: r["n"] for r in docs.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    large = sorted(lang for lang, n in sizes.items() if n >= RESERVED_FROM)
    if not large:
        return calibrate(fit(docs), {}, np.zeros(len(SHARPNESS)))
    apart = F.col("lang").isin(large) & (F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(RESERVED)) == 0)
    model = fit(docs.where(~apart))
    langs = model.langs
    shared = docs.sparkSession.sparkContext.broadcast(model)
    del model
    measured = docs.where(apart).select("lang", "text").mapInArrow(lambda it: _measure(it, shared), "lang int, n long, total long, square long, losses array<long>")
    exact = lambda c: F.sum(c.cast("decimal(20,0)"))
    rows = measured.groupBy("lang").agg(F.sum("n").alias("n"), exact(F.col("total")).alias("total"), exact(F.col("square")).alias("square"), F.array(*[exact(F.col("losses")[i]) for i in range(len(SHARPNESS))]).alias("losses")).collect()
    shared.destroy()
    model = fit(docs)
    place = {lang: i for i, lang in enumerate(model.langs)}
    sums = {place[langs[r["lang"]]]: (r["n"], int(r["total"]), int(r["square"])) for r in rows}
    return calibrate(model, sums, np.array([[int(x) for x in r["losses"]] for r in rows], float).reshape(-1, len(SHARPNESS)).sum(axis=0))


def _predict(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    model: Model = shared.value
    names = np.array([*model.langs, UNKNOWN], object)
    for batch in batches:
        for first, end, data, offsets in tc.chunks(batch.column("text"), 1 << 18):
            codes, doc, letters = grams(data, offsets)
            n = end - first
            e = model.entropies(codes, doc, n)
            known = (letters > 0) & bool(model.langs)
            best = np.where(known, e.argmin(axis=1), len(names) - 1) if model.langs else np.full(n, len(names) - 1)
            score, rejected = np.zeros(n), ~known
            if model.langs:
                score = np.where(known, _posteriors(e, letters, model.sharpness).max(axis=1), 0.0)
                rejected = rejected | (e.min(axis=1) > model.limits[np.minimum(best, len(model.langs) - 1)])
            rows = batch.slice(first, n)
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("held_out"), pa.array(names[best], pa.string()), pa.array(score), pa.array(rejected)], ["doc_id", "held_out", "lang_pred", "score", "rejected"])


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """docs(doc_id, text) -> doc_id, held_out, lang_pred, score, rejected (the text is unlike all that was learned)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text")
    return rows.mapInArrow(lambda it: _predict(it, shared), "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")


def identify(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, lang): learns from the rows with a language that aren't held out, then predicts all texts."""
    return predict(docs, learn(docs.where(~held_out() & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull())))
