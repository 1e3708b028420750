"""Cutting documents into chunks: recursive and semantic splitters, fixed windows, quality figures.

The splitters are state machines over one text, so they run as Arrow-batched functions; a text's chunks then become rows.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import PROFILES, Profile
from ..functions.text import HEADING, fixed_windows, tokens

#: The separators of each document type, from coarse to fine.
SEPARATORS = {
    "text": ["\n# ", "\n## ", "\n### ", "\n#### ", "\n- ", "\n* ", "\n1. ", "\n|", "\n---", "\n\n", "\n", "。", "！", "？", "；", "，", ". ", "! ", "? ", "; ", ", ", " ", ""],
    "markdown": ["\n# ", "\n## ", "\n### ", "\n#### ", "\n- ", "\n* ", "\n1. ", "\n|", "\n\n", "\n", "。", ". ", " ", ""],
    "code": ["\n\nclass ", "\n\ndef ", "\n\nasync def ", "\n\nfunc ", "\n\nSELECT ", "\n\nINSERT ", "\n\nUPDATE ", "\n\nDELETE ", "\n\n", "\n", " ", ""],
    "html": ["\n\n", "\n", "。", ". ", " ", ""],
    "json": ["\n\n", "\n", "},", "],", ',"', ",", " ", ""],
}
#: Extensions by document type, the punctuation after which long lines are cut, and their length.
EXTENSIONS = {"code": ["py", "js", "ts", "java", "cpp", "c", "go", "rs", "sql", "sh", "bat"], "html": ["html", "htm", "xml"], "markdown": ["md", "markdown"], "json": ["json", "jsonl"]}
PUNCTUATION = "。！？!?；;,.，"
LONG_LINE = 280
#: Bytes of text that a task splits at a time.
RUN_BYTES = 1 << 20
EXTENSION_TYPES = {ext: kind for kind, known in EXTENSIONS.items() for ext in known}


def document_type(filename: Column) -> Column:
    ext = F.lower(F.regexp_extract(filename, r"\.([^.]+)$", 1))
    kind = F.create_map(*[F.lit(x) for pair in EXTENSION_TYPES.items() for x in pair])[ext]
    return F.coalesce(kind, F.lit("text"))


def with_profile(docs: DataFrame) -> DataFrame:
    """docs(doc_type) with chunk_size and overlap; an overlap that isn't smaller than the size becomes a fifth of it."""
    out = docs
    for name in ("chunk_size", "overlap"):
        values = F.create_map(*[F.lit(x) for kind, p in PROFILES.items() for x in (kind, getattr(p, name))])
        out = out.withColumn(name, F.coalesce(values[F.col("doc_type")], F.lit(getattr(PROFILES["text"], name))))
    return out.withColumn("overlap", F.when(F.col("overlap") >= F.col("chunk_size"), F.floor(F.col("chunk_size") / 5)).otherwise(F.col("overlap")).cast("int"))


def cut_places(ends: list[int], most: int) -> Iterator[int]:
    """Where a line with punctuation ending at `ends` is cut. A piece reaches for the first end that makes it `most` characters or more,
    and gives that end up if an earlier one is inside the piece. An end that was reached for isn't reached for again."""
    start, at = 0, bisect_left(ends, most)
    while at < len(ends):
        inside = at > 0 and ends[at - 1] > start
        start = ends[at - inside]
        yield start
        at = bisect_left(ends, start + most, at + 1)


def split_line(line: str, most: int) -> list[str]:
    """A line over `most` characters in pieces: cut at punctuation (see cut_places). The rest stays whole up to 1.3 times the limit, else it is
    cut every `most` characters, as is a line without punctuation."""
    ends = [m.end() for m in re.finditer(f"[{re.escape(PUNCTUATION)}]", line)]
    cuts = [0, *cut_places(ends, most)]
    rest = line[cuts[-1] :].strip()
    whole = bool(ends) and len(rest) <= 1.3 * most
    tail = [rest] if whole else [rest[i : i + most] for i in range(0, len(rest), most)]
    return [p for p in (x.strip() for x in [*(line[i:j] for i, j in pairwise(cuts)), *tail]) if p]


def hard_split(text: str, most: int = LONG_LINE) -> str:
    """Lines, stripped; those over `most` characters in pieces, each a line of its own. Blank pieces go, blank lines stay."""
    lines = (x.strip() for x in text.split("\n"))
    return "\n".join(piece for line in lines for piece in (split_line(line, most) if len(line) > most else [line]))


def recursive_split(text: str, size: int, overlap: int, separators: list[str]) -> list[str]:
    """By the first separator that occurs; pieces that are too long by the finer ones; packed up to `size`, with up to `overlap`
    characters of whole pieces carried over; stripped, without blanks. A piece as long as `size` is split as well."""
    at = next((i for i, s in enumerate(separators) if s == "" or s in text), len(separators) - 1)
    separator, finer = separators[at], separators[at + 1 :]
    parts = list(text) if separator == "" else [p if i == 0 else separator + p for i, p in enumerate(text.split(separator))]
    chunks: list[str] = []
    held: list[str] = []
    length = 0

    def close(carry: bool) -> None:
        nonlocal held, length
        if held:
            chunks.append("".join(held))
        while held and (not carry or length > overlap):
            length -= len(held.pop(0))

    for part in parts:
        if len(part) >= size and finer:
            close(False)
            chunks += recursive_split(part, size, overlap, finer)
            continue
        if length + len(part) > size and held:
            close(True)
            while held and length + len(part) > size:
                length -= len(held.pop(0))
        held.append(part)
        length += len(part)
    close(False)
    return [c for c in (c.strip() for c in chunks) if c]


def normalise(text: str) -> str:
    """functions.text.normalise for one text."""
    text = re.sub(r"[\t\f\v]+", " ", re.sub(r"\r\n?", "\n", text).replace("\u00a0", " "))
    return re.sub(r" {2,}", " ", re.sub(r"\n{3,}", "\n\n", text)).strip()


def _split_one(text: str | None, doc_type: str | None, profile: Profile | None = None) -> list[str]:
    kind = doc_type if doc_type in SEPARATORS else "text"
    size, overlap = (profile.chunk_size, profile.overlap) if profile else (PROFILES[kind].chunk_size, PROFILES[kind].overlap)
    overlap = overlap if overlap < size else size // 5
    clean = normalise(text or "")
    if not clean:
        return []
    clean = hard_split(clean)
    return [clean] if len(clean) <= size else recursive_split(clean, size, overlap, SEPARATORS[kind])


def recursive_chunks(docs: DataFrame, profile: Profile | None = None) -> DataFrame:
    """docs(doc_id, text, doc_type) -> doc_id, chunk_index, content, chunk_size, chunk_id."""

    return _split_rows(docs.select("doc_id", "text", "doc_type"), lambda text, kind: _split_one(text, kind, profile))


def _split_runs(batches: Iterator[pa.RecordBatch], split: Callable[..., list[str]]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, text, what else split takes) -> doc_id, chunk_index, content. Texts of RUN_BYTES, or one longer text, are split and
    handed on at a time, so that a task holds no more of them as Python objects, whatever the size of a batch."""
    for batch in batches:
        volume = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        first = 0
        while first < len(batch):
            end = max(first + 1, int(np.searchsorted(volume, RUN_BYTES + (volume[first - 1] if first else 0), "right")))
            run, first = batch.slice(first, end - first), end
            made = [split(*own) for own in zip(*(c.to_pylist() for c in run.columns[1:]), strict=True)]
            sizes = np.array([len(m) for m in made], np.int64)
            place = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            doc = run.column("doc_id").take(pa.array(np.repeat(np.arange(len(made)), sizes)))
            yield pa.RecordBatch.from_arrays([doc, pa.array(place.astype(np.int32)), pa.array([c for m in made for c in m], pa.string())], ["doc_id", "chunk_index", "content"])


def _split_rows(docs: DataFrame, split: Callable[..., list[str]]) -> DataFrame:
    """docs(doc_id, text, ...), split(text, ...) -> as as_rows."""
    kind = dict(docs.dtypes)["doc_id"]
    return _named(docs.mapInArrow(lambda it: _split_runs(it, split), f"doc_id {kind}, chunk_index int, content string"))


def as_rows(docs: DataFrame) -> DataFrame:
    """docs(doc_id, chunks array<string>) -> one row a chunk, with its id file_{doc}_chunk_{i}."""
    return _named(docs.select("doc_id", F.posexplode("chunks").alias("chunk_index", "content")))


def _named(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", "chunk_index", "content", F.length("content").alias("chunk_size"), F.concat(F.lit("file_"), F.col("doc_id").cast("string"), F.lit("_chunk_"), F.col("chunk_index").cast("string")).alias("chunk_id"))


def fixed_chunks(docs: DataFrame, size: int, overlap: int) -> DataFrame:
    """docs(doc_id, text) -> doc_id, chunk_index, start, content of windows that aren't blank."""
    rows = docs.select("doc_id", F.posexplode(fixed_windows(F.col("text"), size, max(1, size - overlap))).alias("chunk_index", "w"))
    return rows.select("doc_id", "chunk_index", F.col("w.start").alias("start"), F.col("w.content").alias("content"))


def layered_windows(docs: DataFrame, size: int = 3200, overlap: int = 300) -> DataFrame:
    """Texts over `size` characters as overlapping windows, shorter ones whole: doc_id, layer, content (trimmed, not blank)."""
    short = F.array(F.struct(F.lit(0).alias("start"), F.col("text").alias("content")))
    windows = F.when(F.length("text") <= size, short).otherwise(fixed_windows(F.col("text"), size, max(50, size - overlap)))
    kept = F.filter(F.transform(windows, lambda w: F.trim(w["content"])), lambda c: c != "")
    return docs.select("doc_id", F.posexplode(kept).alias("layer", "content"))


def pack_paragraphs(pieces: Column, most: int) -> Column:
    """array<string>: neighbouring pieces joined by blank lines while they fit into `most` characters."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def step(acc: Column, p: Column) -> Column:
        fits = F.length(acc["open"]) + F.length(p) + 2 <= most
        return F.when(acc["open"] == "", F.struct(acc["done"].alias("done"), p.alias("open"))).when(fits, F.struct(acc["done"].alias("done"), F.concat(acc["open"], F.lit("\n\n"), p).alias("open"))).otherwise(F.struct(F.concat(acc["done"], F.array(acc["open"])).alias("done"), p.alias("open")))

    return F.aggregate(pieces, start, step, lambda acc: F.when(acc["open"] == "", acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"]))))


def token_overlap_judge(tail: str, head: str) -> bool:
    """Whether two passages seem to be about the same: they share a tenth of their words."""
    a, b = set(re.findall(r"\w+", tail.lower())), set(re.findall(r"\w+", head.lower()))
    return bool(a and b) and len(a & b) / min(len(a), len(b)) >= 0.1


def packed(pieces: Iterable[str], most: int, joint: str = "", together: Callable[[str, str], bool] = lambda held, piece: True) -> list[str]:
    """Neighbours joined as long as they fit into `most` characters and belong together; a longer piece stays whole."""
    out = [""]
    for p in pieces:
        joins = out[-1] and len(out[-1]) + len(joint) + len(p) <= most and together(out[-1], p)
        out[-1:] = [f"{out[-1]}{joint}{p}"] if joins else [out[-1], p]
    return [p for p in out if p]


def force_split(text: str, most: int) -> list[str]:
    """By sentences, packed up to `most`; a longer sentence stays whole."""
    sentences = re.findall(r"[^。！？.!?]*[。！？.!?]+|[^。！？.!?]+\Z", text)
    return [c for c in (x.strip() for x in packed(sentences, most)) if c]


def semantic_split(text: str | None, least: int, most: int, judge: Callable[[str, str], bool] | None = token_overlap_judge) -> list[str]:
    """Paragraphs, merged with the next one while both fit into `most`, unless they have twice the least size and the judge says that a
    new topic starts; too long ones cut by sentences; a short one joins the next, once. The blank line between two doesn't
    count. Without a judge paragraphs are packed, blank lines included, and nothing follows."""
    pieces = [p.strip() for p in re.split(rf"\n\n+|\n{HEADING}", text or "") if p.strip()]
    if judge is None:
        return packed(pieces, most, "\n\n")
    merged = packed(pieces, most + 2, "\n\n", lambda held, p: len(held) < 2 * least or judge(held[-200:], p[:200]))
    sized = [x for m in merged for x in (force_split(m, most) if len(m) > most else [m])]
    out: list[tuple[str, bool]] = []
    for p in sized:
        # a short piece waits for its neighbour
        if out and out[-1][1] and len(out[-1][0]) + len(p) <= most:
            out[-1] = (f"{out[-1][0]}\n\n{p}", False)
        else:
            out.append((p, len(p) < least))
    return [p for p, _ in out]


def semantic_chunks(docs: DataFrame, least: int = 200, most: int = 800, judge: Callable[[str, str], bool] | None = token_overlap_judge) -> DataFrame:
    """docs(doc_id, text) -> as recursive_chunks. judge(tail, head) may be a user's function."""
    return _split_rows(docs.select("doc_id", "text"), lambda text: semantic_split(text, least, most, judge))


def chunk_quality(chunks: DataFrame, by: str = "doc_id") -> DataFrame:
    """chunks(doc_id, content) -> count, mean length (2 places), least, greatest, empty ones, the 95th percentile by position."""
    n = F.length(F.coalesce("content", F.lit("")))
    out = chunks.groupBy(by).agg(F.count(F.lit(1)).alias("chunks"), F.round(F.avg(n), 2).alias("avg_length"), F.min(n).alias("min_length"), F.max(n).alias("max_length"), F.count_if(F.trim(F.coalesce("content", F.lit(""))) == "").alias("empty"), F.sort_array(F.collect_list(n)).alias("_all"))
    at = F.greatest(F.lit(0), F.least(F.size("_all") - 1, F.floor(F.size("_all") * F.lit(0.95)) - 1)).cast("int")
    return out.withColumn("p95_length", F.get("_all", at)).drop("_all")


def same_topic(tail: Column, head: Column) -> Column:
    """The judge's rule as a column, for plans that stay in the JVM."""
    a, b = tokens(tail), tokens(head)
    return (F.size(a) > 0) & (F.size(b) > 0) & (F.size(F.array_intersect(a, b)) / F.least(F.size(a), F.size(b)) >= 0.1)
