"""Column expressions over text: normalisation, tokens, keys, windows. All of them stay in the JVM unless they say otherwise."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..config import COMPLEX_MARKERS, HYBRID, INTENT_SUFFIX, SPLIT_TOKENS, STOP_WORDS, VECTOR

#: Fixed value: the characters between tokens.
TOKEN_BREAK = r"(?U)[\s,，。！？!?:：;；()（）\[\]{}<>《》、/\\\-|_]+"
#: Fixed value: the characters that lookup keys leave out.
KEY_DROP = r"(?U)[\s\-_/\\|·•,，。！？!?:：;；'\"“”‘’()（）\[\]{}<>《》、]+"
#: Forms of codes, and of text in CJK characters alone.
#: A letter or digit of any script next to a code makes it part of a longer word; \b is ASCII's alone in newer JVMs.
CODE_PREFIXED = r"(?<![\p{L}\p{N}_])[a-zA-Z]{1,4}\s*[-_/]?\s*\d{2,10}[a-zA-Z]{0,2}(?![\p{L}\p{N}_])"
CODE_SUFFIXED = r"(?<![\p{L}\p{N}_])\d{2,10}[a-zA-Z]{1,4}(?![\p{L}\p{N}_])"
CJK = r"^[一-鿿]+$"
#: A new paragraph starts at such a line.
HEADING = r"(?=[一二三四五六七八九十]、|\d+\.|[A-Z]\.)"


@F.pandas_udf(StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    """Unicode NFKC; Spark has no function for it."""
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def let(value: Column, body) -> Column:
    """body(value) with value worked out once, even where body uses it inside a lambda or more than once."""
    return F.transform(F.array(value), body)[0]


def compatible(text: Column, ascii_only: bool = False) -> Column:
    return text if ascii_only else nfkc(text)


def trim_all(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^[\s\x1C-\x1F]+|[\s\x1C-\x1F]+$", "")


def normalise(text: Column) -> Column:
    """Line ends to \\n, no-break spaces to spaces, runs of tabs, form feeds and vertical tabs to one space, three or more line
    breaks to two, runs of spaces to one; stripped."""
    out = F.translate(F.regexp_replace(text, "\r\n?", "\n"), "\u00a0", " ")
    out = F.regexp_replace(out, r"[\t\f\x0B]+", " ")
    out = F.regexp_replace(out, "\n{3,}", "\n\n")
    return trim_all(F.regexp_replace(out, " {2,}", " "))


#: What makes a text look like markdown.
MARKDOWN_SIGNS = (r"^#{1,6}\s", r"^[-*]\s", r"^\d+\.\s", r"^\|.*\|", r"^```", r"\n##\s")
#: Lines that become headings.
HEADING_LINES = (r"^第[一二三四五六七八九十百0-9]+章", r"^[一二三四五六七八九十]+、", r"^\(?[一二三四五六七八九十]+\)", r"^\d+(?:\.\d+){0,2}\s+")


def looks_like_markdown(text: Column) -> Column:
    found = F.lit(False)
    for sign in MARKDOWN_SIGNS:
        found = found | text.rlike(f"(?mdU){sign}")  # \\n alone ends a line
    return F.coalesce(found, F.lit(False))


def infer_headings(text: Column) -> Column:
    """Lines are stripped, those that look like chapter or section titles become second-level headings, and the whole is
    normalised."""

    def line(x: Column) -> Column:
        title = F.lit(False)
        for sign in HEADING_LINES:
            title = title | x.rlike(f"(?U){sign}")
        return F.when(title, F.concat(F.lit("## "), x)).otherwise(x)

    stripped = F.transform(F.split(text, "\n", -1), trim_all)
    return normalise(F.array_join(F.transform(stripped, line), "\n"))


def tokens(text: Column, stop_words: tuple[str, ...] = STOP_WORDS) -> Column:
    """Distinct lower-case tokens in order of appearance; stop words and single characters other than CJK are left out."""
    pieces = F.transform(F.split(F.coalesce(text, F.lit("")), TOKEN_BREAK), lambda x: F.lower(x))
    keep = lambda x: (x != "") & ~x.isin(*stop_words) & ((F.length(x) > 1) | x.rlike(CJK))
    return F.array_distinct(F.filter(pieces, keep))


def variants(text: Column, most: int = HYBRID.max_variants, intent: bool = False, ascii_only: bool = False) -> Column:
    """The query, its normal form, its tokens, and with intent the tokens with a suffix: distinct, at most `most`."""
    raw = trim_all(F.coalesce(text, F.lit("")))
    normal = trim_all(F.regexp_replace(compatible(raw, ascii_only), r"(?U)\s+", " "))
    own = tokens(raw)
    joined = F.array_join(own, " ")
    forms = [raw, normal, joined]
    if intent:
        forms.append(F.when(F.size(own) >= 2, F.concat(joined, F.lit(INTENT_SUFFIX))))
    return F.slice(F.array_distinct(F.filter(F.array(*forms), lambda x: x.isNotNull() & (x != ""))), 1, most)


def is_complex(text: Column) -> Column:
    marks = sum(F.coalesce(text, F.lit("")).contains(m).cast("int") for m in COMPLEX_MARKERS)
    return (F.size(tokens(text)) >= 6) | (marks >= 2)


def hybrid_recall(text: Column, top_k: Column, config=HYBRID) -> Column:
    """Candidates per channel: more for long and complex questions; cut to an integer."""
    n = F.size(tokens(text))
    factor = 1.0 + F.when(n >= 10, 0.5).when(n >= 6, 0.25).otherwise(0.0) + F.when(is_complex(text), 0.2).otherwise(0.0)
    factor = F.greatest(F.lit(config.min_factor), F.least(F.lit(config.max_factor), factor))
    return F.greatest(F.lit(1), F.floor(F.greatest(top_k * 4, F.lit(config.window)) * factor)).cast("int")


def vector_recall(top_k: Column, chunk_size: Column, config=VECTOR) -> Column:
    """Candidates of a vector search: more for small chunks; rounded half to even."""
    ratio = F.greatest(F.lit(0.85), F.least(F.lit(1.6), F.lit(800.0) / F.greatest(F.lit(200), chunk_size)))
    recall = F.bround(F.greatest(F.lit(1), top_k) * config.recall_factor * ratio)
    return F.least(F.lit(config.max_recall), F.greatest(F.lit(config.min_recall), recall)).cast("int")


def lookup_key(name: Column, ascii_only: bool = False) -> Column:
    """The form in which entity names are compared."""
    return F.regexp_replace(F.lower(trim_all(compatible(F.coalesce(name, F.lit("")), ascii_only))), KEY_DROP, "")


def code_entities(text: Column) -> Column:
    """Codes such as N-47, P_1127 or 1127A, distinct, in order."""
    found = [F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({p})"), F.lit(1)) for p in (CODE_PREFIXED, CODE_SUFFIXED)]
    return F.array_distinct(F.transform(F.concat(*found), lambda x: F.trim(x)))


def code_keys(keys: Column) -> Column:
    """Of lookup keys, those that are codes."""
    return F.filter(keys, lambda k: k.rlike(r"^([a-z]{1,4}\d{2,10}[a-z]{0,2}|\d{2,10}[a-z]{1,4})$"))


def fallbacks(name: Column, min_length: int = 2, most: int = HYBRID.max_fallbacks) -> Column:
    """Parts of a compound name; for CJK names of four or more characters also the ends."""
    parts = name
    for token in SPLIT_TOKENS:
        parts = F.replace(parts, F.lit(token), F.lit(" "))
    keep = lambda x: (x != "") & ~x.isin(*STOP_WORDS)
    split = F.filter(F.split(parts, r"(?U)[\s,，;；/|]+"), lambda x: keep(x) & (F.length(x) >= min_length))
    compact = F.regexp_replace(name, r"(?U)\s+", "")
    ends = F.array(F.substring(compact, 1, 2), F.substring(compact, -2, 2), F.substring(compact, 1, 3), F.substring(compact, -3, 3))
    ends = F.when(compact.rlike(CJK) & (F.length(compact) >= 4), F.filter(ends, keep)).otherwise(F.array().cast("array<string>"))
    return F.slice(F.array_distinct(F.concat(split, ends)), 1, most)


def min_extraction_length(text: Column) -> Column:
    t = trim_all(F.coalesce(text, F.lit("")))
    return F.when(t == "", 5).when(t.rlike(CODE_PREFIXED), 2).when(F.length(t) <= 8, 3).otherwise(5)


def fixed_windows(text: Column, size: int, step: int) -> Column:
    """array<struct<start, content>> of the windows that start every `step` characters (from 0) and aren't blank."""
    starts = F.when(F.length(text) > 0, F.sequence(F.lit(0), F.length(text) - 1, F.lit(step))).otherwise(F.array().cast("array<int>"))
    made = F.transform(starts, lambda s: F.struct(s.alias("start"), F.substring(text, s + 1, F.lit(size)).alias("content")))
    return F.filter(made, lambda w: F.trim(w["content"]) != "")


def paragraphs(text: Column) -> Column:
    """Pieces between blank lines and before numbered lines, trimmed, without blanks."""
    return F.filter(F.transform(F.split(text, rf"\n\n+|\n{HEADING}"), trim_all), lambda x: x != "")


def fingerprint(text: Column) -> Column:
    return F.sha1(F.trim(text).cast("binary"))


def preview(text: Column, size: int = 220) -> Column:
    return F.substring(F.replace(F.trim(text), F.lit("\n"), F.lit(" ")), 1, size)


def result_key(chunk_id: Column, entity: Column, source: Column, start: Column, target: Column, relations: Column, hop: Column, evidence: Column, content: Column) -> Column:
    """What makes two retrieval results the same: the chunk, else the entity, else the path, else the content."""
    mark = F.substring(F.md5(F.array_join(F.sort_array(F.slice(evidence, 1, 5)), "|").cast("binary")), 1, 8)
    path = F.concat(F.lit("path::"), start, F.lit("::"), target, F.lit("::"), F.array_join(relations, ","), F.lit("::hop"), F.coalesce(hop, F.lit(1)).cast("string"), F.lit("::ev"), mark)
    return (
        F.when(F.coalesce(chunk_id, F.lit("")) != "", F.concat(F.lit("chunk::"), chunk_id))
        .when(F.coalesce(entity, F.lit("")) != "", F.concat(F.lit("entity::"), entity, F.lit("::"), F.coalesce(source, F.lit("unknown"))))
        .when((F.coalesce(target, F.lit("")) != "") & (F.coalesce(start, F.lit("")) != ""), path)
        .otherwise(F.concat(F.lit("content::"), F.substring(F.md5(F.coalesce(content, F.lit("")).cast("binary")), 1, 12)))
    )


def occurrences(text: Column, part: Column) -> Column:
    """How often part stands in text, without overlaps; 0 for an empty part."""
    return F.when(F.length(part) > 0, (F.length(text) - F.length(F.replace(text, part, F.lit("")))) / F.length(part)).otherwise(0).cast("int")
