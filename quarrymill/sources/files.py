"""Documents from files: text, markdown, HTML, JSON and JSON lines, told apart by extension."""

from __future__ import annotations

import json
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Encodings tried in this order; the last never fails.
ENCODINGS = ("utf-8", "gbk", "gb2312", "latin-1")
#: Elements whose content isn't text; elements that are walked through; elements that are one block.
SKIPPED = {"script", "style", "nav", "footer", "noscript", "svg", "iframe"}
WALKED = {"html", "body", "div", "article", "section", "main", "aside", "details", "[document]"}
BLOCKS = {"p", "blockquote", "pre"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
OTHER_LEAST = 20


def decode(raw: bytes | None) -> str | None:
    for encoding in ENCODINGS:
        try:
            return None if raw is None else bytes(raw).decode(encoding)
        except UnicodeDecodeError:
            continue
    return None


class _Tree(HTMLParser):
    """A light element tree: (tag, children); text is a str child."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root: tuple[str, list] = ("[document]", [])
        self.stack = [self.root]

    def handle_starttag(self, tag, attrs):
        node = (tag, [])
        self.stack[-1][1].append(node)
        if tag not in VOID:
            self.stack.append(node)

    def handle_endtag(self, tag):
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i][0] == tag:
                del self.stack[i:]
                break

    def handle_data(self, data):
        self.stack[-1][1].append(data)


def _text(node, separator: str = " ") -> str:
    if isinstance(node, str):
        return node
    if node[0] in SKIPPED:
        return ""
    return separator.join(" ".join(x.split()) for x in (_text(c, separator) for c in node[1]) if x.strip())


def _find(node, tags: set[str]) -> Iterator:
    for child in node[1]:
        if not isinstance(child, str):
            if child[0] in tags:
                yield child
            else:
                yield from _find(child, tags)


def _blocks(node) -> Iterator[str]:
    for child in node[1]:
        if isinstance(child, str) or child[0] in SKIPPED | {"head", "title"}:
            continue
        tag = child[0]
        if len(tag) == 2 and tag[0] == "h" and tag[1] in "123456":
            if text := _text(child).strip():
                yield "#" * int(tag[1]) + " " + text
        elif tag in ("ul", "ol"):
            lines = [f"- {t}" for t in (_text(x).strip() for x in _find(child, {"li"})) if t]
            if lines:
                yield "\n".join(lines)
        elif tag == "table":
            rows = [[_text(c).strip() for c in _find(row, {"td", "th"})] for row in _find(child, {"tr"})]
            if lines := [" | ".join(r) for r in rows if any(r)]:
                yield "\n".join(lines)
        elif tag in BLOCKS:
            if text := _text(child).strip():
                yield text
        elif tag in WALKED:
            yield from _blocks(child)
        else:
            text = _text(child).strip()
            if len(text) > OTHER_LEAST:
                yield text


def html_text(html: str | None) -> str | None:
    """Headings, lists, tables and paragraphs in document order, equal blocks once, blank lines between them."""
    if html is None:
        return None
    tree = _Tree()
    tree.feed(html)
    tree.close()
    return "\n\n".join(dict.fromkeys(_blocks(tree.root)))


def json_lines(value, depth: int = 0) -> list[str]:
    """`key: value` lines, nested values two spaces deeper; a list of scalars as `- x`, other lists with a blank line between
    their items."""
    pad = "  " * depth
    if isinstance(value, dict):
        return [line for k, v in value.items() for line in ([f"{pad}{k}:", *(json_lines(v, depth + 1) or [""])] if isinstance(v, dict | list) else [f"{pad}{k}: {v}"])]
    if not isinstance(value, list):
        return [f"{pad}{value}"]
    if all(isinstance(v, str | int | float | bool) for v in value):
        return [f"{pad}- {v}" for v in value]
    out: list[str] = []
    for i, v in enumerate(value):
        out += ([""] if i else []) + (json_lines(v, depth) or [""])
    return out


def json_text(raw: str | None, lines: bool = False) -> str | None:
    """A JSON document; or JSON lines as `[Record i]` blocks, where i counts all lines and a line that can't be parsed stays as it is.
    Documents of several lines that don't start with a bracket, or that can't be parsed, are read as lines."""
    if raw is None or not (raw := raw.strip()):
        return raw
    if not lines and ("\n" not in raw or raw[0] in "[{"):
        try:
            return "\n".join(json_lines(json.loads(raw)))
        except ValueError:
            pass
    blocks = []
    for i, line in enumerate((x.strip() for x in raw.split("\n")), 1):
        if line:
            try:
                line = "\n".join(json_lines(json.loads(line)))
            except ValueError:
                pass
            blocks.append(f"[Record {i}]\n{line}")
    return "\n\n".join(blocks)


@F.pandas_udf(StringType())
def html_to_text(pages: pd.Series) -> pd.Series:
    return pages.map(html_text)


@F.pandas_udf(StringType())
def decode_bytes(content: pd.Series) -> pd.Series:
    return content.map(decode)


@F.pandas_udf(StringType())
def render(content: pd.Series, ext: pd.Series) -> pd.Series:
    """File contents as text by their extension."""
    kinds = {"html": html_text, "htm": html_text, "json": json_text, "jsonl": lambda t: json_text(t, True)}
    return pd.Series([kinds.get(e, lambda t: t)(decode(c)) for c, e in zip(content, ext)], dtype=object)


def read_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """path, ext, size, text of the files of a folder that have a known type."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    named = files.withColumn("ext", F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))).where(F.col("ext").isin("txt", "md", "markdown", "html", "htm", "json", "jsonl"))
    return named.select("path", "ext", F.col("length").alias("size"), render("content", "ext").alias("text"))


LABELLED = "kb_id INT, query STRING, relevant_chunk_ids ARRAY<STRING>, relevant_keywords ARRAY<STRING>"


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line (from 1 in its file, blank ones counted), value. Files may be split: a line's number is its place in its block and the
    lines of the blocks before, so only one row a block is exchanged."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"))
    blocks = lines.groupBy("file", "_block").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    earlier = F.sum("_n").over(Window.partitionBy("file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    placed = blocks.select("file", "_block", (F.coalesce(earlier, F.lit(0)) - F.col("_first") + 1).alias("_shift"))
    return lines.join(placed, ["file", "_block"]).select("file", (F.col("_at") + F.col("_shift")).alias("line"), "value")


def read_labelled_queries(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Labelled retrieval queries from JSON lines: kb_id, query, and lists that are empty where they are missing. Blank lines are passed
    over; a line that isn't a JSON object, or lacks kb_id or query, fails the read with its number. The first `limit` lines by file
    and number, if given."""
    lines = numbered_lines(spark, path).where(F.trim("value") != "")
    keys = F.json_object_keys("value")
    fail = lambda why: F.raise_error(F.concat(F.lit("line "), F.col("line").cast("string"), F.lit(" of "), F.col("file"), F.lit(f": {why}"))).cast("string")
    sound = F.when(keys.isNull(), fail("not a JSON object")).when(~F.array_contains(keys, "kb_id") | ~F.array_contains(keys, "query"), fail("kb_id or query is missing")).otherwise(F.col("value"))
    rows = lines.select("file", "line", F.from_json(sound, LABELLED).alias("row"))
    rows = rows if limit is None else rows.orderBy("file", "line").limit(limit)
    lists = [F.coalesce(f"row.{c}", F.array().cast("array<string>")).alias(c) for c in ("relevant_chunk_ids", "relevant_keywords")]
    return rows.select("row.kb_id", "row.query", *lists)
