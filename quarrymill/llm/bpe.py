"""BPE encoding and decoding by prefix-sharing trie traversal.

The text is normalised and cut into words the way the tokenizer file says. The distinct words of a chunk form a trie; a
depth-first walk over it (the words in sorted order, with a stack of states for the current path) keeps for every prefix the
last token of its encoding, so that a prefix that words share is encoded once. The last token of a prefix is the one
vocabulary token that ends there and stays next to the last token of what is before it: two tokens stay apart if
encoding their concatenation gives the two. A word's tokens are read off backwards.

Covers tokenizer files with a BPE model with an end-of-word suffix, NFC, white space and lower-case normalisers, a splitting pattern
and byte-level symbols; their special tokens are recognised in the raw text. Decoding without a decoder joins tokens by spaces.

Defined results: a null text is the empty text, which has no tokens; rows are independent; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import documents

#: Unicode White_Space, which the files' \\s means. Fixed values.
_SPACE = r"\t-\r \x85\xa0  -     　"
#: Words, and token pairs, that a worker remembers at most.
REMEMBERED = 400_000


def _byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself where it is printable Latin-1, else from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


@dataclass
class TokenizerFile:
    """What is needed of a tokenizer file."""

    vocab: dict[str, int]
    merges: dict[tuple[str, str], int]
    suffix: str
    pattern: str
    special: dict[str, int]

    @classmethod
    def read(cls, path: str) -> "TokenizerFile":
        with open(path, encoding="utf-8") as f:
            raw = json.load(f)
        model, split = raw["model"], raw["pre_tokenizer"]["pretokenizers"][0]
        if model["type"] != "BPE" or raw["decoder"] is not None or [n["type"] for n in raw["normalizer"]["normalizers"]] != ["NFC", "Replace", "Lowercase"]:
            raise ValueError(f"{path} is of a kind that isn't covered")
        merges = {tuple(m.split(" ") if isinstance(m, str) else m): i for i, m in enumerate(model["merges"])}
        return cls(model["vocab"], merges, model["end_of_word_suffix"] or "", split["pattern"]["Regex"], {t["content"]: t["id"] for t in raw["added_tokens"]})


class Encoder:
    def __init__(self, file: TokenizerFile):
        self.file = file
        self.bytes_ = _byte_symbols()
        self.split = regex.compile(file.pattern.replace(r"\s", _SPACE))
        self.special = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(file.special, key=len, reverse=True)) + ")") if file.special else None
        self.longest = max(map(len, file.vocab))
        self.leads = {s[0] for s in file.special if s}
        self.names = {i: t for t, i in file.vocab.items()} | {i: t for t, i in file.special.items()}
        self.joined: dict[str, bool] = {}
        self.whole: dict[str, bool] = {}
        #: word -> (ids as little-endian 32-bit integers, tokens joined by spaces in UTF-8)
        self.words: dict[str, tuple[bytes, bytes]] = {}
        self.fixed = {text: (np.array([i], "<u4").tobytes(), text.encode()) for text, i in file.special.items()}

    def merge(self, parts: list[str]) -> list[str]:
        """BPE by its definition: the pair of the lowest rank, the leftmost first, again and again."""
        ranks = self.file.merges
        while len(parts) > 1:
            rank, i = min((ranks.get(pair, len(ranks)), i) for i, pair in enumerate(zip(parts, parts[1:])))
            if rank == len(ranks):
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def symbols(self, token: str) -> list[str]:
        """A token's symbols; the end-of-word suffix belongs to the last."""
        end = self.file.suffix
        return [*token[: -len(end) - 1], token[-len(end) - 1 :]] if end and len(token) > len(end) and token.endswith(end) else list(token)

    def stands(self, token: str) -> bool:
        """Whether encoding the token gives the token itself."""
        if (known := self.whole.get(token)) is None:
            known = self.whole[token] = token in self.file.vocab and self.merge(self.symbols(token)) == [token]
        return known

    def apart(self, left: str, right: str) -> bool:
        """Whether encoding left + right gives these two tokens."""
        pair = f"{left}\0{right}"
        if (known := self.joined.get(pair)) is None:
            if len(self.joined) >= REMEMBERED:
                self.joined.clear()
            known = self.joined[pair] = self.merge(self.symbols(left) + self.symbols(right)) == [left, right]
        return known

    def last(self, path: list[str], symbols: str, depth: int, suffix: str) -> str:
        """The last token of the encoding of symbols[:depth] + suffix; path[i] is that of symbols[:i]."""
        vocab = self.file.vocab
        for start in range(max(0, depth - self.longest), depth):
            token = symbols[start:depth] + suffix
            if token in vocab and self.stands(token) and (start == 0 or self.apart(path[start], token)):
                return token
        raise ValueError(f"no token ends at {depth} of {symbols!r}")

    def learn(self, words: set[str]) -> None:
        """Encodes distinct words by a depth-first walk over their trie."""
        if len(self.words) + len(words) > REMEMBERED:
            self.words.clear()
        suffix, vocab = self.file.suffix, self.file.vocab
        spelled = sorted(("".join(self.bytes_[b] for b in word.encode("utf-8")), word) for word in words)
        path, before = [""], ""
        for symbols, word in spelled:
            common = 0
            for a, b in zip(symbols, before):
                if a != b:
                    break
                common += 1
            del path[min(common, len(path) - 1) + 1 :]  # back up to the deepest shared node
            while len(path) < len(symbols):
                path.append(self.last(path, symbols, len(path), ""))
            before = symbols
            tokens, at = [], len(symbols)
            token = self.last(path, symbols, at, suffix)
            at -= len(token) - len(suffix)
            tokens.append(token)
            while at:
                tokens.append(path[at])
                at -= len(path[at])
            tokens.reverse()
            self.words[word] = np.array([vocab[t] for t in tokens], "<u4").tobytes(), " ".join(tokens).encode()

    def cut(self, text: str) -> list[tuple[bool, str]]:
        """(is a special token, piece) of a text in order; words are normalised."""
        out: list[tuple[bool, str]] = []
        for i, part in enumerate(self.special.split(text) if any(c in text for c in self.leads) else [text]):
            if i % 2:
                out.append((True, part))
            elif part:
                if not part.isascii():
                    part = unicodedata.normalize("NFC", part).replace("Σ", "σ")  # no rule for final sigmas
                out += [(False, word) for word in self.split.findall(part.lower())]
        return out

    def encode(self, texts: list[str | None]) -> list[tuple[bytes, bytes]]:
        """(ids as bytes, decoded text as bytes) of each text."""
        pieces = [self.cut(text or "") for text in texts]
        fresh = {word for own in pieces for special, word in own if not special} - self.words.keys()
        if fresh:
            if len(self.words) + len(fresh) > REMEMBERED:
                fresh = {word for own in pieces for special, word in own if not special}
            self.learn(fresh)
        known, out = self.words, []
        for own in pieces:
            found = [self.fixed[word] if special else known[word] for special, word in own]
            out.append((b"".join([ids for ids, _ in found]), b" ".join([tokens for _, tokens in found])))
        return out

    def decode(self, ids: list[int]) -> str:
        """The tokens joined by spaces, special ones included; ids that the file doesn't have are left out."""
        return " ".join(self.names[i] for i in ids if i in self.names)


_encoders: dict[int, Encoder] = {}


def _digests(batches: Iterator[pa.RecordBatch], shared, key: int) -> Iterator[pa.RecordBatch]:
    if key not in _encoders:
        _encoders[key] = Encoder(shared.value)
    encoder = _encoders[key]
    for batch in batches:
        texts, first = batch.column("text"), 0
        while first < len(batch):
            own, size = [], 0
            while first + len(own) < len(batch) and (not own or size < 1 << 21):
                own.append(texts[first + len(own)].as_py())
                size += len(own[-1] or "")
            coded = encoder.encode(own)
            ids = batch.column("doc_id").slice(first, len(own))
            counts = pa.array([len(i) // 4 for i, _ in coded], pa.int64())
            digests = [pa.array([hashlib.sha256(x[side]).hexdigest() for x in coded], pa.string()) for side in (0, 1)]
            yield pa.RecordBatch.from_arrays([ids, counts, *digests], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
            first += len(own)


def _ids(batches: Iterator[pa.RecordBatch], shared, key: int) -> Iterator[pa.RecordBatch]:
    if key not in _encoders:
        _encoders[key] = Encoder(shared.value)
    encoder = _encoders[key]
    for batch in batches:
        for row in range(len(batch)):
            ((ids, decoded),) = encoder.encode([batch.column("text")[row].as_py()])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(row, 1), pa.array([np.frombuffer(ids, "<u4").astype(np.int32)], pa.list_(pa.int32())), pa.array([decoded.decode()])], ["doc_id", "ids", "decoded"])


def _shared(docs: DataFrame, path: str):
    file = TokenizerFile.read(path)
    return docs.sparkSession.sparkContext.broadcast(file), hash((path, len(file.vocab), len(file.merges)))


def encode(docs: DataFrame, path: str) -> DataFrame:
    """docs(doc_id, text) -> doc_id, ids array<int>, decoded. The file at path is read on the driver and broadcast."""
    shared, key = _shared(docs, path)
    return documents(docs).mapInArrow(lambda it: _ids(it, shared, key), "doc_id long, ids array<int>, decoded string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_tokens, ids_sha256, decoded_sha256 (of little-endian 32-bit ids, and of UTF-8)."""
    shared, key = _shared(docs, path)
    return documents(docs).mapInArrow(lambda it: _digests(it, shared, key), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
