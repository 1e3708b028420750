"""Extraction: raw model replies to entities and relations, and a rule extractor for texts without a model."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import code_entities

ENTITY = "STRUCT<name STRING, canonical_name STRING, type STRING, labels ARRAY<STRING>, confidence DOUBLE, attributes MAP<STRING, STRING>>"
TRIPLE = "STRUCT<head STRING, source STRING, relation STRING, type STRING, tail STRING, target STRING, confidence DOUBLE>"
SCHEMA = f"entities ARRAY<{ENTITY}>, nodes ARRAY<{ENTITY}>, triples ARRAY<{TRIPLE}>, relations ARRAY<{TRIPLE}>, edges ARRAY<{TRIPLE}>"


def repaired(reply: Column) -> Column:
    """The part between the outer braces, without fences; trailing commas dropped, single quotes doubled, NaN and Infinity null."""
    body = F.regexp_extract(F.regexp_replace(reply, "```(json)?", ""), r"(?s)(\{.*\})", 1)
    body = F.regexp_replace(body, r",\s*([}\]])", "$1")
    body = F.regexp_replace(body, r":\s*(NaN|-?Infinity)", ": null")
    return F.when(F.contains(body, F.lit('"')), body).otherwise(F.translate(body, "'", '"'))


def parse_replies(replies: DataFrame) -> DataFrame:
    """replies(chunk_id, reply) -> chunk_id, entities, triples, parse_failed. Strict JSON first, else the repaired text, else empty.
    nodes, relations and edges are other names; source and target other names of head and tail."""
    strict = F.from_json("reply", SCHEMA, {"mode": "PERMISSIVE", "allowSingleQuotes": "false", "allowNonNumericNumbers": "false"})
    loose = F.from_json(repaired(F.col("reply")), SCHEMA)
    has = lambda c: F.coalesce(c["entities"], c["nodes"]).isNotNull() | F.coalesce(c["triples"], c["relations"], c["edges"]).isNotNull()
    out = replies.withColumns({"_s": strict, "_l": loose}).withColumn("_p", F.when(has(F.col("_s")), F.col("_s")).when(has(F.col("_l")), F.col("_l")))
    triples = F.transform(F.coalesce("_p.triples", "_p.relations", "_p.edges"), lambda t: F.struct(F.coalesce(t["head"], t["source"]).alias("head"), F.coalesce(t["relation"], t["type"]).alias("relation"), F.coalesce(t["tail"], t["target"]).alias("tail"), t["confidence"].alias("confidence")))
    empty_e, empty_t = F.array().cast(f"ARRAY<{ENTITY}>"), F.array().cast("ARRAY<STRUCT<head STRING, relation STRING, tail STRING, confidence DOUBLE>>")
    return out.select("chunk_id", F.coalesce("_p.entities", "_p.nodes", empty_e).alias("entities"), F.coalesce(triples, empty_t).alias("triples"), F.col("_p").isNull().alias("parse_failed"))


def extract(chunks: DataFrame, extractor: Callable, schema: str = "chunk_id string, reply string") -> DataFrame:
    """Any user's function of batches, for example a call of a model, by mapInPandas."""
    return chunks.mapInPandas(extractor, schema)


def rule_entities(chunks: DataFrame) -> DataFrame:
    """chunks(chunk_id, content) -> chunk_id, seq, name, type, confidence: the codes in the text."""
    rows = chunks.select("chunk_id", F.posexplode(code_entities(F.col("content"))).alias("seq", "name"))
    return rows.select("chunk_id", "seq", "name", F.lit("code").alias("type"), F.lit(0.7).alias("confidence"))


def cooccurrences(entities: DataFrame, most_apart: int = 3) -> DataFrame:
    """entities(chunk_id, seq, name) -> neighbours in a chunk's list, at most `most_apart` places apart, as relations."""
    a, b = entities.alias("a"), entities.alias("b")
    near = a.join(b, (F.col("a.chunk_id") == F.col("b.chunk_id")) & (F.col("b.seq") > F.col("a.seq")) & (F.col("b.seq") - F.col("a.seq") <= most_apart) & (F.col("a.name") != F.col("b.name")))
    return near.select(F.col("a.chunk_id").alias("chunk_id"), F.col("a.seq").alias("seq"), F.col("a.name").alias("head"), F.lit("co_occurs").alias("relation"), F.col("b.name").alias("tail"), F.lit(0.6).alias("confidence"))
