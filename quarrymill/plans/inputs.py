"""The given tables in the shapes that the operators take, and the same shapes as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as chunks: three knowledge bases, ten chunks a file."""
    e = table(spark, sf_dir, "embeddings")
    return e.select((F.col("label") % 3).cast("int").alias("kb_id"), F.col("vec_id").cast("string").alias("chunk_id"), F.floor(F.col("vec_id") / 10).cast("long").alias("file_id"), (F.col("vec_id") % 10).cast("int").alias("chunk_index"), F.col("vec_id"), "embedding")


def vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated query set: every vector whose id is divisible by 20, asking its own knowledge base."""
    c = corpus(spark, sf_dir).where("vec_id % 20 = 0")
    return c.select(F.col("vec_id").alias("query_id"), "kb_id", F.col("embedding").alias("vector"))


def text_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of all languages as chunks of one knowledge base."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.lit("docs").alias("kb_id"), F.col("doc_id").cast("string").alias("chunk_id"), F.col("text").alias("content"), "doc_id", "source")


def text_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages as queries to all documents."""
    b = table(spark, sf_dir, "benchmark")
    return b.select(F.col("item_id").alias("query_id"), F.lit("docs").alias("kb_id"), F.col("text").alias("query_text"))


CORPUS_SQL = """corpus AS (
  SELECT (label % 3)::INTEGER AS kb_id, vec_id::VARCHAR AS chunk_id, vec_id // 10 AS file_id, (vec_id % 10)::INTEGER AS chunk_index, vec_id, embedding::DOUBLE[] AS e FROM embeddings
)"""
SIMILARITY_SQL = f"""{CORPUS_SQL}, sims AS (
  SELECT q.vec_id AS query_id, c.kb_id, c.chunk_id, c.vec_id, c.file_id, c.chunk_index, q.e AS qe, c.e AS e,
    round(greatest(0, least(1, 1 - greatest(0, list_dot_product(q.e, q.e) + list_dot_product(c.e, c.e) - 2 * list_dot_product(q.e, c.e)) / 2)), 6) AS similarity
  FROM corpus q JOIN corpus c ON q.vec_id % 20 = 0 AND q.kb_id = c.kb_id
), near AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, chunk_id)::INTEGER AS rank FROM sims)"""


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with the names that they are extracted from, in order chunks of three knowledge bases."""
    li, p, s, n = (table(spark, sf_dir, t) for t in ("lineitem", "part", "supplier", "nation"))
    rows = li.join(p, F.col("l_partkey") == F.col("p_partkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey")).join(n, F.col("s_nationkey") == F.col("n_nationkey"))
    return rows.select((F.col("l_orderkey") % 3).cast("int").alias("kb_id"), (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("seq"), F.col("l_orderkey").cast("string").alias("chunk"), F.round(1 - F.col("l_discount"), 4).alias("confidence"), "p_brand", "s_name", "n_name", "l_returnflag")


def mentions(spark: SparkSession, sf_dir: str, rows: DataFrame | None = None) -> DataFrame:
    """Line items (rows: what items gives, if it is there already) as extracted entities: brand, supplier and nation.

    Suppliers of returned items have an unknown type.
    """
    rows = items(spark, sf_dir) if rows is None else rows
    entity = lambda name, kind: F.struct(name.alias("name"), kind.alias("type"))
    kinds = F.array(entity(F.col("p_brand"), F.lit("brand")), entity(F.col("s_name"), F.when(F.col("l_returnflag") == "R", "unknown").otherwise("supplier")), entity(F.col("n_name"), F.lit("nation")))
    out = rows.select("kb_id", "seq", "chunk", "confidence", F.explode(kinds).alias("k"))
    return out.select("kb_id", "seq", F.col("k.name").alias("canonical_name"), F.col("k.name").alias("name"), F.col("k.type").alias("type"), F.array("k.type").alias("labels"), F.array(F.upper("k.name")).alias("aliases"), "confidence", F.lit(1).alias("mention_count"), F.array("chunk").alias("chunk_ids"), F.create_map(F.lit("first_seen"), F.col("chunk")).alias("attributes"))


def ties(spark: SparkSession, sf_dir: str, rows: DataFrame | None = None) -> DataFrame:
    """Line items (rows as in mentions) as extracted relations: a brand is supplied by a supplier, a supplier located in a nation."""
    rows = items(spark, sf_dir) if rows is None else rows
    tie = lambda a, t, b: F.struct(F.col(a).alias("a"), F.lit(t).alias("t"), F.col(b).alias("b"))
    out = rows.select("kb_id", "seq", "chunk", "confidence", F.explode(F.array(tie("p_brand", "supplied_by", "s_name"), tie("s_name", "located_in", "n_name"))).alias("k"))
    return out.select("kb_id", "seq", F.col("k.a").alias("source"), F.col("k.b").alias("target"), F.col("k.t").alias("type"), "confidence", F.lit(1).alias("evidence_count"), F.array("chunk").alias("chunk_ids"))


GRAPH_SQL = """items AS (
  SELECT (l_orderkey % 3)::INTEGER AS kb_id, l_orderkey * 100 + l_linenumber AS seq, l_orderkey::VARCHAR AS chunk, l_orderkey, round(1 - l_discount, 4) AS confidence, p_brand, s_name, n_name, l_returnflag
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
), mentions AS (
  SELECT kb_id, seq, chunk, l_orderkey, confidence, p_brand AS name, 'brand' AS type FROM items UNION ALL
  SELECT kb_id, seq, chunk, l_orderkey, confidence, s_name, CASE WHEN l_returnflag = 'R' THEN 'unknown' ELSE 'supplier' END FROM items UNION ALL
  SELECT kb_id, seq, chunk, l_orderkey, confidence, n_name, 'nation' FROM items
), ties AS (
  SELECT kb_id, seq, chunk, l_orderkey, confidence, p_brand AS source, s_name AS target, 'supplied_by' AS type FROM items UNION ALL
  SELECT kb_id, seq, chunk, l_orderkey, confidence, s_name, n_name, 'located_in' FROM items
), entities AS (
  SELECT kb_id, name, coalesce(arg_min(type, seq) FILTER (type <> 'unknown'), 'unknown') AS type, round(max(confidence), 4) AS confidence, count(*) AS mention_count, count(DISTINCT chunk) AS n_chunks,
         array_to_string(list_sort(list(DISTINCT type)), ',') AS labels, min(chunk) FILTER (TRUE) AS least_chunk
  FROM mentions GROUP BY kb_id, name
), relations AS (
  SELECT kb_id, source, target, type, round(max(confidence), 4) AS confidence, count(*) AS evidence_count, count(DISTINCT chunk) AS n_chunks, list_sort(list(DISTINCT chunk)) AS chunk_ids
  FROM ties WHERE source <> target GROUP BY kb_id, source, target, type
)"""
