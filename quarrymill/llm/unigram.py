"""Token counts of a unigram tokenizer, without building the tokens.

A text is cut at white space; each word gets the mark U+2581 in front. An Aho-Corasick automaton enumerates the vocabulary's
matches in a word, and a Viterbi pass carries the best score and the piece count of every end position. Ties and unknown
characters follow the `tokenizers` library: a later candidate must be strictly better, candidates come by start position;
an unknown character costs 10 below the lowest score, and a run of unknown characters is one piece. Words are counted once
a task; the memory for them is bounded.

Defined results: null and blank texts have no tokens; rows are independent; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from .common import documents

MARK = "\u2581"
UNKNOWN_PENALTY = 10.0
#: Words whose counts a worker remembers at most.
REMEMBERED = 400_000
#: Unicode White_Space: what separates words. Fixed values.
_SPACE = re.compile("[\t-\r \x85\xa0  -     　]+")
_made: dict[int, "PieceCounter"] = {}


def vocabulary(model_path: str) -> list[tuple[str, float]]:
    """The pieces of a public sentencepiece vocabulary, in its order, with Zipf's law for scores: -log(rank + 1).

    Control pieces and byte pieces are left out; the first entry is the unknown piece.
    """
    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    return [("<unk>", 0.0)] + [(piece, -math.log(rank + 1)) for rank, piece in enumerate(dict.fromkeys(pieces), 1)]


class PieceCounter:
    """Counts the pieces of words; vocab: (piece, score), the first entry is the unknown piece."""

    def __init__(self, vocab: list[tuple[str, float]]):
        self.automaton = ahocorasick.Automaton()
        for piece, score in vocab[1:]:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        if len(self.automaton):
            self.automaton.make_automaton()
        self.single = {piece for piece, _ in vocab[1:] if len(piece) == 1}
        self.unknown = min((score for _, score in vocab), default=0.0) - UNKNOWN_PENALTY
        self.known: dict[str, int] = {}

    def pieces(self, word: str) -> int:
        """Viterbi over the end positions: score, pieces, and whether the last piece is unknown.

        The automaton reports the matches of one end from the longest to the shortest, so by start position.
        """
        n = len(word)
        best: list[float | None] = [0.0] + [None] * n
        count, unknown = [0] * (n + 1), [False] * (n + 1)

        def close(end: int) -> None:
            if word[end - 1] in self.single:
                return
            score = self.unknown + best[end - 1]
            if best[end] is None or score > best[end]:
                best[end], count[end], unknown[end] = score, count[end - 1] + (not unknown[end - 1]), True

        done = 0
        for last, (length, gain) in self.automaton.iter(word) if len(self.automaton) else ():
            while done < last:
                done += 1
                close(done)
            start = last + 1 - length
            score = gain + best[start]
            if best[last + 1] is None or score > best[last + 1]:
                best[last + 1], count[last + 1], unknown[last + 1] = score, count[start] + 1, False
        while done < n:
            done += 1
            close(done)
        return count[n]

    def text(self, text: str | None) -> int:
        if not text:
            return 0
        known, total = self.known, 0
        for word, times in Counter(_SPACE.split(text)).items():
            if word:
                n = known.get(word)
                if n is None:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    n = known[word] = self.pieces(MARK + word)
                total += n * times
        return total


def _count(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    if shared.id not in _made:
        _made[shared.id] = PieceCounter(shared.value)
    counter = _made[shared.id]
    for batch in batches:
        counts = np.array([counter.text(text.as_py()) for text in batch.column("text")], np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts)], ["doc_id", "n_tokens"])


class _Shared:
    """A broadcast value and a name for what workers derive from it."""

    def __init__(self, spark, value):
        self.held = spark.sparkContext.broadcast(value)
        self.id = hash(repr(value))

    @property
    def value(self):
        return self.held.value


def token_counts(docs: DataFrame, vocab: list[tuple[str, float]]) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_tokens."""
    shared = _Shared(docs.sparkSession, vocab)
    return documents(docs).mapInArrow(lambda it: _count(it, shared), "doc_id long, n_tokens long")
