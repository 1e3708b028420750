"""Queries over vectors, rankings and evaluation, with their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import Hybrid
from ..operators import evaluate, index, ranking, vectors
from ..sources.scratch import settled
from . import retrieval
from .inputs import CORPUS_SQL, SIMILARITY_SQL, corpus, table, text_chunks, vector_queries
from .registry import query

K = 10


def near(spark: SparkSession, sf_dir: str, k: int = 30) -> DataFrame:
    """The k nearest chunks of every query, with the columns that rankings need."""
    c = corpus(spark, sf_dir).select(F.col("kb_id").cast("string").alias("kb_id"), "chunk_id", "file_id", "chunk_index", "embedding")
    return vectors.knn(vector_queries(spark, sf_dir), corpus(spark, sf_dir), k).join(c, ["kb_id", "chunk_id"]).withColumn("key", F.col("chunk_id"))


@query(f"WITH {SIMILARITY_SQL} SELECT query_id, kb_id::VARCHAR AS kb_id, chunk_id, similarity, rank FROM near WHERE rank <= 10")
def knn_topk(spark, sf_dir):
    return vectors.knn(vector_queries(spark, sf_dir), corpus(spark, sf_dir), K)


THRESHOLD_SQL = """t AS (SELECT *, greatest(0.2, max(similarity) OVER (PARTITION BY query_id) - 0.08) AS effective_threshold FROM near WHERE rank <= 30),
u AS (SELECT *, count(*) FILTER (similarity >= effective_threshold) OVER (PARTITION BY query_id) AS kept FROM t),
passed AS (SELECT * FROM u WHERE CASE WHEN kept < 3 THEN rank <= 3 ELSE similarity >= effective_threshold END)"""


@query(f"WITH {SIMILARITY_SQL}, {THRESHOLD_SQL} SELECT query_id, chunk_id, similarity, round(effective_threshold, 6) AS effective_threshold FROM passed")
def knn_threshold(spark, sf_dir):
    kept = ranking.dynamic_threshold(near(spark, sf_dir), K)
    return kept.select("query_id", "chunk_id", "similarity", F.round("effective_threshold", 6).alias("effective_threshold"))


@query(f"""WITH {SIMILARITY_SQL}, f AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, chunk_id)::INTEGER AS r FROM sims WHERE chunk_index = 3 AND chunk_id LIKE '%1%')
SELECT query_id, kb_id::VARCHAR AS kb_id, chunk_id, similarity, r AS rank FROM f WHERE r <= 10""")
def filtered_knn(spark, sf_dir):
    c = corpus(spark, sf_dir).withColumns({"metadata": F.create_map(F.lit("chunk_index"), F.col("chunk_index").cast("string")), "content": F.col("chunk_id")})
    return vectors.filtered_knn(vector_queries(spark, sf_dir), c, K, {"chunk_index": "3"}, "1")


@query(f"""WITH {CORPUS_SQL}, sims AS (
  SELECT q.vec_id AS query_id, c.kb_id, c.chunk_id, round(greatest(0, least(1, 1 - greatest(0, list_dot_product(q.e, q.e) + list_dot_product(c.e, c.e) - 2 * list_dot_product(q.e, c.e)) / 2)), 6) AS similarity
  FROM corpus q, corpus c WHERE q.vec_id % 20 = 0
), near AS (SELECT *, row_number() OVER (PARTITION BY query_id, kb_id ORDER BY similarity DESC, chunk_id) AS r FROM sims),
few AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, kb_id, chunk_id)::INTEGER AS rank FROM near WHERE r <= 20)
SELECT query_id, kb_id::VARCHAR AS kb_id, chunk_id, similarity, rank FROM few WHERE rank <= 10""")
def multi_kb_knn(spark, sf_dir):
    every = vector_queries(spark, sf_dir).drop("kb_id").withColumn("kb_id", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    return vectors.multi_kb_knn(every, corpus(spark, sf_dir), K, 43)


def lsh_knn(spark, sf_dir):
    return vectors.indexed_knn(vector_queries(spark, sf_dir), corpus(spark, sf_dir), K)


query()(lsh_knn)


def clustered(spark, sf_dir):
    """The given vectors drawn to forty of them, so that they form clusters as encoded texts do; in one knowledge base."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", vectors.unit(F.col("embedding")).alias("e"))
    heads = e.where("vec_id < 40").select((F.col("vec_id")).alias("head"), F.col("e").alias("h"))
    drawn = e.withColumn("head", F.pmod(F.xxhash64("vec_id"), F.lit(40))).join(heads, "head")
    near = vectors.unit(F.zip_with("h", "e", lambda h, x: h + 0.6 * x))
    return drawn.select(F.lit("all").alias("kb_id"), F.col("vec_id").cast("string").alias("chunk_id"), "vec_id", near.alias("embedding"))


@query("SELECT count(*) AS queries, TRUE AS recalled, TRUE AS few_scored FROM embeddings WHERE vec_id % 20 = 0")
def indexed_knn(spark, sf_dir):
    """The index over clustered vectors: recall of the ten nearest is 0.9 or more, and a query is compared with a fifth of the vectors at
    most, though it reads a tenth of the cells."""
    c = settled(clustered(spark, sf_dir), "clustered")
    q = c.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "kb_id", F.col("embedding").alias("vector"))
    made = index.build(c)
    exact, near = vectors.knn(q, c, K), index.search(made, q, c, K)
    figures = exact.join(near, ["query_id", "chunk_id"], "left_semi").agg(F.count(F.lit(1)).alias("hits"))
    for more in (
        exact.agg(F.count(F.lit(1)).alias("pairs")),
        index.scored_rows(made, q, 0.1).agg(F.count(F.lit(1)).alias("queries"), F.sum("scored").alias("scored")),
        c.agg(F.count(F.lit(1)).alias("n")),
    ):
        figures = figures.unionByName(more, allowMissingColumns=True)
    one = figures.agg(*[F.max(x).alias(x) for x in ("hits", "pairs", "queries", "scored", "n")])
    return one.select("queries", (F.col("hits") >= 0.9 * F.col("pairs")).alias("recalled"), (F.col("scored") <= 0.2 * F.col("queries") * F.col("n")).alias("few_scored"))



VARIANT_SQL = """v AS (SELECT query_id, 0 AS variant, chunk_id AS key, similarity AS score FROM near WHERE rank <= 30 UNION ALL
  SELECT query_id, 1, chunk_id, round(similarity * (1 - chunk_index / 20), 6) FROM near WHERE rank <= 30),
p AS (SELECT *, row_number() OVER (PARTITION BY query_id, variant ORDER BY score DESC, key) AS r FROM v)"""


def variant_lists(spark, sf_dir):
    n = near(spark, sf_dir)
    second = n.withColumn("score", F.round(F.col("similarity") * (1 - F.col("chunk_index") / 20), 6))
    return n.select("query_id", F.lit(0).alias("variant"), "key", F.col("similarity").alias("score")).unionByName(second.select("query_id", F.lit(1).alias("variant"), "key", "score"))


@query(f"WITH {SIMILARITY_SQL}, {VARIANT_SQL} SELECT query_id, key, round(sum(1.0::DOUBLE / (60 + r)), 8) AS score, max(score) AS best FROM p GROUP BY query_id, key")
def variant_rrf(spark, sf_dir):
    return ranking.fuse_variants(variant_lists(spark, sf_dir))


@query(f"WITH {SIMILARITY_SQL}, {VARIANT_SQL} SELECT query_id, key, round(max(score), 8) AS score, max(score) AS best FROM p GROUP BY query_id, key")
def variant_max(spark, sf_dir):
    return ranking.fuse_variants(variant_lists(spark, sf_dir), "max")


CHANNEL_SQL = """ch AS (SELECT query_id, 'vector' AS channel, chunk_id AS key, similarity AS score FROM near WHERE rank <= 30 UNION ALL
  SELECT query_id, 'keyword', chunk_id, round(similarity * (chunk_index + 1) / 10, 6) FROM near WHERE rank <= 30 AND chunk_index % 2 = 0 UNION ALL
  SELECT query_id, 'graph', chunk_id, round(similarity * 0.9, 6) FROM near WHERE rank <= 30 AND chunk_index % 3 = 0),
cr AS (SELECT *, row_number() OVER (PARTITION BY query_id, channel ORDER BY score DESC, key) AS r FROM ch),
fused AS (SELECT query_id, key, round(sum(CASE channel WHEN 'vector' THEN 0.6 WHEN 'keyword' THEN 0.5 ELSE 0.4 END::DOUBLE / (60 + r)), 8) AS final_score,
  array_to_string(list_sort(list(DISTINCT channel)), ',') AS channels, max(score) AS score FROM cr WHERE r <= 50 GROUP BY query_id, key)"""
WEIGHTS = {"vector": 0.6, "keyword": 0.5, "graph": 0.4}


def channel_lists(spark, sf_dir):
    n = near(spark, sf_dir)
    row = lambda df, channel, score: df.select("query_id", F.lit(channel).alias("channel"), "key", F.round(score, 6).alias("score"))
    return row(n, "vector", F.col("similarity")).unionByName(row(n.where("chunk_index % 2 = 0"), "keyword", F.col("similarity") * (F.col("chunk_index") + 1) / 10)).unionByName(row(n.where("chunk_index % 3 = 0"), "graph", F.col("similarity") * 0.9))


@query(f"WITH {SIMILARITY_SQL}, {CHANNEL_SQL} SELECT * FROM fused")
def channel_rrf(spark, sf_dir):
    return ranking.fuse_channels(channel_lists(spark, sf_dir), WEIGHTS).withColumn("channels", F.array_join("channels", ","))


@query(f"WITH {SIMILARITY_SQL}, {CHANNEL_SQL} SELECT query_id, channel, key, round(score * CASE channel WHEN 'vector' THEN 0.6 WHEN 'keyword' THEN 0.5 ELSE 0.4 END, 8) AS final_score FROM ch")
def weighted_fusion(spark, sf_dir):
    return ranking.weigh_channels(channel_lists(spark, sf_dir), WEIGHTS).select("query_id", "channel", "key", F.round("final_score", 8).alias("final_score"))


@query(f"""WITH {SIMILARITY_SQL}, {CHANNEL_SQL}, b AS (SELECT *, min(final_score) OVER (PARTITION BY query_id) AS lo, max(final_score) OVER (PARTITION BY query_id) AS hi FROM fused)
SELECT query_id, key, round(CASE WHEN hi <= lo THEN 1 ELSE (final_score - lo) / (hi - lo) END, 6) AS normalized FROM b""")
def minmax_scores(spark, sf_dir):
    return ranking.min_max(ranking.fuse_channels(channel_lists(spark, sf_dir), WEIGHTS)).select("query_id", "key", F.round("normalized", 6).alias("normalized"))



@query(f"""WITH {SIMILARITY_SQL}, {CHANNEL_SQL}, b AS (
  SELECT f.*, min(final_score) OVER (PARTITION BY query_id) AS lo, max(final_score) OVER (PARTITION BY query_id) AS hi, channels LIKE '%graph%' AS g,
    ((key::INTEGER % 3 = 0)::INTEGER + (key::INTEGER % 5 = 0)::INTEGER) / 2 AS ov FROM fused f
), s AS (SELECT *, 0.7 * CASE WHEN hi <= lo THEN 1 ELSE (final_score - lo) / (hi - lo) END + 0.3 * ov + CASE WHEN g THEN 0.08 ELSE 0 END + CASE WHEN key::INTEGER % 7 = 0 THEN 0.08 ELSE 0 END AS x FROM b)
SELECT query_id, key, round(greatest(0, least(1, CASE WHEN NOT g AND ov < 0.05 THEN x * 0.68 ELSE x END)), 6) AS rerank_score FROM s""")
def rerank_hybrid(spark, sf_dir):
    f = ranking.fuse_channels(channel_lists(spark, sf_dir), WEIGHTS)
    n = F.col("key").cast("int")
    words = F.concat_ws(" ", F.when(n % 3 == 0, "alpha").otherwise("other"), F.when(n % 5 == 0, "delta").otherwise("words"))
    rows = f.withColumns({"query_text": F.lit("alpha delta"), "content": words, "source": F.lit("vector"), "match_stage": F.when(n % 7 == 0, "exact").otherwise("")})
    return ranking.rerank_hybrid(rows).select("query_id", "key", F.round("rerank_score", 6).alias("rerank_score"))


@query(f"""WITH {SIMILARITY_SQL} SELECT query_id, chunk_id, round(0.75 * similarity + 0.25 * least(1, ((vec_id % 3 = 0)::INTEGER + (vec_id % 5 = 0)::INTEGER) / 2 + CASE WHEN file_id % 2 = 0 THEN 0.1 ELSE 0 END), 8) AS rerank_score FROM near WHERE rank <= 30""")
def rerank_vector(spark, sf_dir):
    n = F.col("chunk_id").cast("int")
    words = F.concat_ws(" ", F.when(n % 3 == 0, "alpha").otherwise("other"), F.when(n % 5 == 0, "delta").otherwise("words"))
    rows = near(spark, sf_dir).withColumns({"query_text": F.lit("alpha delta"), "content": words, "filename": F.when(F.col("file_id") % 2 == 0, "alpha.txt").otherwise("b.txt")})
    return ranking.rerank_vector(rows).select("query_id", "chunk_id", F.round("rerank_score", 8).alias("rerank_score"))


CLUSTER_SQL = """g AS (SELECT *, CASE WHEN chunk_index - lag(chunk_index) OVER (PARTITION BY query_id, file_id ORDER BY chunk_index, chunk_id) > 1 THEN 1 ELSE 0 END AS gap FROM {source}),
runs AS (SELECT *, sum(gap) OVER (PARTITION BY query_id, file_id ORDER BY chunk_index, chunk_id) AS run FROM g),
parts AS (SELECT *, (row_number() OVER (PARTITION BY query_id, file_id, run ORDER BY chunk_index, chunk_id) - 1) // 3 AS part FROM runs),
merged AS (SELECT query_id, file_id, run, part, max(similarity) AS similarity, arg_max(chunk_id, (similarity, -chunk_index)) AS key, string_agg(chunk_id, ',' ORDER BY chunk_index, chunk_id) AS evidence, count(*) AS cluster_size FROM parts GROUP BY ALL),
best AS (SELECT *, row_number() OVER (PARTITION BY query_id, file_id ORDER BY similarity DESC, key) AS b FROM merged),
clusters AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, key)::INTEGER AS place FROM best WHERE b <= 2)"""


@query(f"WITH {SIMILARITY_SQL}, few AS (SELECT * FROM near WHERE rank <= 60), {CLUSTER_SQL.format(source='few')} SELECT query_id, file_id, key, similarity, evidence, cluster_size, place AS rank FROM clusters")
def cluster_chunks(spark, sf_dir):
    rows = near(spark, sf_dir, 60).withColumn("content", F.col("chunk_id"))
    return ranking.cluster_chunks(rows).select("query_id", "file_id", "key", "similarity", F.array_join("evidence_chunks", ",").alias("evidence"), "cluster_size", "rank")


@query(f"""WITH {SIMILARITY_SQL}, s AS (SELECT query_id, chunk_id AS key, rank, CASE WHEN rank <= 20 THEN round(0.7 * (1 / (1 + exp(-(chunk_index - 4.5)))) + 0.3 * similarity, 8) END AS second_score FROM near WHERE rank <= 30)
SELECT query_id, key, round(second_score, 6) AS second_score, row_number() OVER (PARTITION BY query_id ORDER BY rank > 20, second_score DESC, CASE WHEN rank <= 20 THEN 0 ELSE rank END, key)::INTEGER AS rank FROM s""")
def sigmoid_blend(spark, sf_dir):
    rows = near(spark, sf_dir).withColumns({"base_score": F.col("similarity"), "logit": F.col("chunk_index") - 4.5})
    return ranking.blend_second_stage(rows).select("query_id", "key", F.round("second_score", 6).alias("second_score"), "rank")


@query(f"""WITH {SIMILARITY_SQL}, f AS (SELECT query_id, chunk_id AS key, similarity AS final_score, rank AS place, chunk_index = 9 AS g FROM near WHERE rank <= 30),
n AS (SELECT *, least(2, count(*) FILTER (g) OVER (PARTITION BY query_id), 10) - count(*) FILTER (g AND place <= 10) OVER (PARTITION BY query_id) AS need FROM f),
s AS (SELECT *, CASE WHEN place > 10 AND g AND final_score >= 0.12 THEN row_number() OVER (PARTITION BY query_id, place > 10 AND g AND final_score >= 0.12 ORDER BY place) END AS spare,
  CASE WHEN place <= 10 AND NOT g THEN row_number() OVER (PARTITION BY query_id, place <= 10 AND NOT g ORDER BY place DESC) END AS leave FROM n),
w AS (SELECT *, least(greatest(need, 0), coalesce(max(spare) OVER (PARTITION BY query_id), 0), coalesce(max(leave) OVER (PARTITION BY query_id), 0)) AS swap FROM s)
SELECT query_id, key, final_score, row_number() OVER (PARTITION BY query_id ORDER BY final_score DESC, key)::INTEGER AS rank FROM w WHERE (place <= 10 AND NOT coalesce(leave <= swap, FALSE)) OR coalesce(spare <= swap, FALSE)""")
def graph_floor(spark, sf_dir):
    rows = near(spark, sf_dir).select("query_id", "key", F.col("similarity").alias("final_score"), (F.col("chunk_index") == 9).alias("is_graph"))
    return ranking.graph_floor(rows, 10, config=Hybrid(graph_min_results=2)).select("query_id", "key", "final_score", "rank")


@query(f"""WITH {SIMILARITY_SQL}, f AS (SELECT query_id, chunk_id AS key, similarity AS score, rank, CASE chunk_index % 3 WHEN 0 THEN 'graph_direct' WHEN 1 THEN 'graph_related' ELSE 'vector' END AS source, chunk_index / 10 AS confidence FROM near WHERE rank <= 30),
t AS (SELECT *, score >= CASE WHEN source LIKE 'graph%' THEN 0.10 ELSE 0.12 END AND NOT (source = 'graph_direct' AND confidence > 0 AND confidence < 0.35) AS fits FROM f),
u AS (SELECT *, count(*) FILTER (fits) OVER (PARTITION BY query_id) AS any_fit FROM t),
p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN any_fit > 0 THEN NOT fits ELSE FALSE END, score DESC, key) AS place FROM u)
SELECT query_id, key, score, source FROM p WHERE CASE WHEN any_fit > 0 THEN fits AND place <= 10 ELSE place <= 10 END""")
def context_filter(spark, sf_dir):
    kind = F.col("chunk_index") % 3
    rows = near(spark, sf_dir).select("query_id", "key", F.col("similarity").alias("score"), F.when(kind == 0, "graph_direct").when(kind == 1, "graph_related").otherwise("vector").alias("source"), (F.col("chunk_index") / 10).alias("confidence"))
    return ranking.context_filter(rows).select("query_id", "key", "score", "source")


@query(f"""WITH {SIMILARITY_SQL}, b AS (SELECT query_id, chunk_id AS key, similarity, min(similarity) OVER (PARTITION BY query_id) AS lo, max(similarity) OVER (PARTITION BY query_id) AS hi, count(*) OVER (PARTITION BY query_id) AS n FROM near WHERE rank <= 10),
x AS (SELECT *, CASE WHEN hi > lo THEN (similarity - lo) / (hi - lo) END AS x FROM b)
SELECT query_id, key, round(coalesce(x / sum(x) OVER (PARTITION BY query_id), 1 / n), 6) AS weight FROM x""")
def display_weights(spark, sf_dir):
    rows = near(spark, sf_dir, 10).select("query_id", "key", F.col("similarity").alias("score"))
    return ranking.display_weights(rows).select("query_id", "key", F.round("weight", 6).alias("weight"))


@query(f"""WITH {SIMILARITY_SQL}, {THRESHOLD_SQL} SELECT query_id, count(*) AS candidate_count, count(*) FILTER (similarity >= effective_threshold) AS after_threshold, round(max(effective_threshold), 6) AS effective_threshold, 'vector' AS channels FROM t GROUP BY query_id""")
def search_diagnostics(spark, sf_dir):
    rows = near(spark, sf_dir).withColumns({"effective_threshold": F.greatest(F.lit(0.2), F.max("similarity").over(Window.partitionBy("query_id")) - 0.08), "channel": F.lit("vector")})
    return ranking.diagnostics(rows).withColumn("effective_threshold", F.round("effective_threshold", 6))


@query(f"""WITH {SIMILARITY_SQL} SELECT query_id, string_agg('[文档' || rank || '] (相似度: ' || printf('%.2f', similarity * 100) || '%) (通道: keyword, vector)' || chr(10) || chunk_id || chr(10) || '证据块: file ' || file_id || chr(10), chr(10) ORDER BY rank) AS context FROM near WHERE rank <= 5 GROUP BY query_id""")
def context_text(spark, sf_dir):
    rows = near(spark, sf_dir, 5).select("query_id", "rank", F.col("chunk_id").alias("content"), F.col("similarity").alias("score"), F.array(F.lit("keyword"), F.lit("vector")).alias("channels"), F.array(F.concat(F.lit("file "), F.col("file_id").cast("string"))).alias("evidence"))
    return ranking.context_text(rows)


@query(f"""WITH {SIMILARITY_SQL}, k AS (SELECT near.*, text, min(similarity) OVER w AS lo, max(similarity) OVER w AS hi, count(*) OVER w AS n FROM near LEFT JOIN documents ON doc_id = vec_id WHERE rank <= 5 WINDOW w AS (PARTITION BY query_id)),
x AS (SELECT *, CASE WHEN hi > lo THEN (similarity - lo) / (hi - lo) END AS x FROM k)
SELECT query_id, rank, md5(substr(coalesce(text, ''), 1, 200) || CASE WHEN length(text) > 200 THEN '...' ELSE '' END) AS preview, length(coalesce(text, '')) AS size, similarity, round(coalesce(x / sum(x) OVER (PARTITION BY query_id), 1.0 / n), 6) AS display_weight, 0.0::DOUBLE AS raw_score, similarity AS final_score, file_id, 'unknown' AS source FROM x""")
def source_items(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("chunk_id"), F.col("text").alias("content"))
    none = F.lit(None).cast("double")
    rows = near(spark, sf_dir, 5).select("query_id", "rank", "chunk_id", "similarity", "file_id").join(d, "chunk_id", "left").withColumns({"score": none, "final_score": none, "source": F.lit(None).cast("string")})
    out = ranking.source_items(rows, 5)
    return out.select("query_id", "rank", F.md5(F.col("content").cast("binary")).alias("preview"), F.length("full_content").cast("long").alias("size"), "similarity", F.round("display_weight", 6).alias("display_weight"), "raw_score", "final_score", "file_id", "source")


@query(f"""WITH {SIMILARITY_SQL} SELECT query_id, '{{"chunk_id":"' || chunk_id || '","rank":' || rank || ',"file_id":' || file_id || '}}' AS sources FROM near WHERE rank <= 5""")
def source_json(spark, sf_dir):
    return ranking.source_json(near(spark, sf_dir, 5).select("query_id", "chunk_id", "rank", "file_id"))


@query()
def mmr(spark, sf_dir):
    return ranking.mmr(near(spark, sf_dir).select("query_id", "key", "similarity", "embedding"), K, 43)


# the rule depends on the rows kept before, so SQL walks a query's rows one by one as well
@query(f"""WITH RECURSIVE {CORPUS_SQL}, sims AS (
  SELECT q.vec_id AS query_id, c.kb_id, c.chunk_id, round(greatest(0, least(1, 1 - greatest(0, list_dot_product(q.e, q.e) + list_dot_product(c.e, c.e) - 2 * list_dot_product(q.e, c.e)) / 2)), 6) AS similarity
  FROM corpus q, corpus c WHERE q.vec_id % 20 = 0
), near AS (SELECT *, row_number() OVER (PARTITION BY query_id, kb_id ORDER BY similarity DESC, chunk_id) AS r FROM sims),
few AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, kb_id, chunk_id) AS o FROM near WHERE r <= 40),
listed AS (SELECT query_id, chunk_id AS key, kb_id::VARCHAR AS kb_id, 'file' || chunk_id::BIGINT % 4 AS source, similarity AS score, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, chunk_id) AS i, count(DISTINCT kb_id) OVER (PARTITION BY query_id) AS kbs FROM few WHERE o <= 20),
walk AS (SELECT query_id, 0::BIGINT AS i, []::VARCHAR[] AS sources, []::VARCHAR[] AS held, FALSE AS kept FROM listed GROUP BY query_id UNION ALL
  SELECT query_id, i, CASE WHEN fits THEN list_append(sources, source) ELSE sources END, CASE WHEN fits THEN list_append(held, kb_id) ELSE held END, fits FROM (
    SELECT w.query_id, l.i, w.sources, w.held, l.source, l.kb_id, kbs = 1 OR (len(list_filter(w.held, lambda x: x = l.kb_id)) < 4 AND (len(w.held) = 0 OR len(list_filter(w.sources, lambda x: x = l.source)) + 1 <= 0.8 * (len(w.held) + 1))) AS fits FROM walk w JOIN listed l ON l.query_id = w.query_id AND l.i = w.i + 1))
SELECT query_id, key, kb_id, source, score FROM walk JOIN listed USING (query_id, i) WHERE kept""")
def source_diversity(spark, sf_dir):
    every = vector_queries(spark, sf_dir).drop("kb_id").withColumn("kb_id", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    found = vectors.multi_kb_knn(every, corpus(spark, sf_dir), 20, 60)
    return ranking.diversify_sources(found.select("query_id", F.col("chunk_id").alias("key"), "kb_id", F.concat(F.lit("file"), (F.col("chunk_id").cast("int") % 4).cast("string")).alias("source"), F.col("similarity").alias("score")))


# requests of four kinds: one knowledge base that the list lacks (nothing), one, a list with repeats and noise, none named (the first two)
@query(f"""WITH {CORPUS_SQL}, sims AS (
  SELECT q.vec_id AS query_id, c.kb_id, c.chunk_id, c.chunk_index, round(greatest(0, least(1, 1 - greatest(0, list_dot_product(q.e, q.e) + list_dot_product(c.e, c.e) - 2 * list_dot_product(q.e, c.e)) / 2)), 6) AS similarity
  FROM corpus q, corpus c WHERE q.vec_id % 20 = 0
), near AS (SELECT *, row_number() OVER (PARTITION BY query_id, kb_id ORDER BY similarity DESC, chunk_id) AS r FROM sims),
asked AS (SELECT DISTINCT query_id, unnest(CASE query_id // 20 % 4 WHEN 0 THEN []::INTEGER[] WHEN 1 THEN [1] WHEN 2 THEN [2, 0] ELSE [0, 1] END) AS kb_id FROM near),
own AS (SELECT n.*, query_id % 100 <> 0 AND chunk_index % 2 = 0 AS h FROM near n JOIN asked USING (query_id, kb_id) WHERE r <= 20),
hyb AS (SELECT query_id, kb_id, chunk_id, round(similarity - 0.01, 6) AS score, 'hybrid' AS branch FROM own WHERE h),
hr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, kb_id, chunk_id)::INTEGER AS rank FROM hyb),
vec AS (SELECT query_id, kb_id, chunk_id, similarity AS score, 'vector' AS branch FROM own WHERE similarity >= 0.2 AND query_id NOT IN (SELECT query_id FROM hyb)),
vr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, kb_id, chunk_id)::INTEGER AS rank FROM vec)
SELECT query_id, kb_id::VARCHAR AS kb_id, chunk_id AS key, score, branch, rank FROM (SELECT * FROM hr WHERE rank <= 10 UNION ALL SELECT * FROM vr WHERE rank <= 5)""")
def agent_evidence(spark, sf_dir):
    every = vector_queries(spark, sf_dir).drop("kb_id").withColumn("kb_id", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    found = settled(vectors.knn(every, corpus(spark, sf_dir), 20), "found").select("query_id", "kb_id", F.col("chunk_id").alias("key"), F.col("similarity").alias("score"))
    kind = F.floor(F.col("query_id") / 20) % 4
    one, several = F.when(kind.isin(0, 1), 1), F.when(kind == 0, F.array(F.lit("2"))).when(kind == 2, F.array(*map(F.lit, ("2", "2", "x", "0"))))
    asked = vector_queries(spark, sf_dir).select("query_id", ranking.resolve_kbs(one, several, F.array(F.lit(0), F.lit(1), F.lit(2)), 2).alias("kbs"))
    even = (F.col("query_id") % 100 != 0) & (F.col("key").cast("int") % 10 % 2 == 0)
    return ranking.agent_evidence(asked, found.where(even).withColumn("score", F.round(F.col("score") - 0.01, 6)), found, 5)


@query(f"""WITH {CORPUS_SQL.replace('embedding::DOUBLE[]', 'embedding::DOUBLE[]')}, sims AS (
  SELECT q.vec_id AS query_id, c.chunk_id, c.file_id, c.chunk_index, round(greatest(0, least(1, 1 - greatest(0, list_dot_product(q.e, q.e) + list_dot_product(c.e, c.e) - 2 * list_dot_product(q.e, c.e)) / 2)), 4) AS similarity
  FROM corpus q JOIN corpus c ON q.vec_id % 20 = 0 AND q.kb_id = c.kb_id
), near AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, chunk_id) AS rank FROM sims), {THRESHOLD_SQL.replace('rank <= 30', 'rank <= 43')}, {CLUSTER_SQL.format(source='passed')}
SELECT query_id, file_id, 'chunk::' || key AS key, similarity, cluster_size, place AS rank FROM clusters WHERE place <= 5""")
def vector_search(spark, sf_dir):
    c = corpus(spark, sf_dir).withColumns({"content": F.concat(F.lit("chunk "), F.col("chunk_id")), "filename": F.concat(F.lit("file"), F.col("file_id").cast("string"))})
    q = vector_queries(spark, sf_dir).withColumn("query_text", F.lit("alpha delta"))
    return retrieval.vector_search(q, c, 5, 43).drop("content")


RELEVANT_SQL = """, rel AS (SELECT c.vec_id AS query_id, list(o.chunk_id) AS keys, count(*) AS total FROM corpus c JOIN corpus o ON c.vec_id % 20 = 0 AND o.file_id = c.file_id GROUP BY c.vec_id)"""


def _relevant(spark, sf_dir):
    c = corpus(spark, sf_dir)
    q = c.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "file_id")
    return q.join(c.select("file_id", "chunk_id"), "file_id").groupBy("query_id").agg(F.collect_list("chunk_id").alias("keys"), F.count(F.lit(1)).alias("total")).withColumn("keywords", F.array().cast("array<string>"))


IR_SQL = f"""WITH {SIMILARITY_SQL} {RELEVANT_SQL}, h AS (SELECT near.query_id, rank, list_contains(keys, chunk_id) AS hit FROM near JOIN rel USING (query_id) WHERE rank <= 10),
g AS (SELECT query_id, min(rank) FILTER (hit) AS first, sum(CASE WHEN hit THEN 1 / log2(rank + 1) ELSE 0 END) AS dcg FROM h GROUP BY query_id),
m AS (SELECT query_id, CASE WHEN first IS NULL THEN 0.0 ELSE 1.0 END::DOUBLE AS recall, round(coalesce(1.0::DOUBLE / first, 0), 6) AS mrr, round(coalesce(dcg, 0) / (SELECT sum(1 / log2(i + 1)) FROM range(1, least(total, 10)::INTEGER + 1) r(i)), 6) AS ndcg FROM rel LEFT JOIN g USING (query_id))"""


@query(f"{IR_SQL} SELECT * FROM m")
def ir_metrics(spark, sf_dir):
    rel = _relevant(spark, sf_dir)
    hits = evaluate.label_hits(near(spark, sf_dir, 10).withColumn("content", F.lit("")), rel.drop("total"), 10)
    return evaluate.ir_metrics(hits.select("query_id", "rank", "hit"), rel.select("query_id", "total"), 10)


@query(f"{IR_SQL} SELECT count(*) AS queries, round(avg(recall), 6) AS recall, round(avg(mrr), 6) AS mrr, round(avg(ndcg), 6) AS ndcg FROM m")
def ir_macro(spark, sf_dir):
    return evaluate.macro(ir_metrics(spark, sf_dir))


RUNS_SQL = """runs AS (SELECT CASE WHEN user_id % 2 = 0 THEN 'A' ELSE 'B' END AS mode, event_type AS category, value > 5 AS success, value AS elapsed_ms, event_id % 3 AS iterations, user_id % 4 AS steps, 1 + user_id % 5 AS quality FROM events),
summary AS (SELECT mode, category, count(*) AS samples, round(avg(success::INTEGER), 4) AS success_rate, round(avg(elapsed_ms), 2) AS avg_ms, round(quantile_cont(elapsed_ms, 0.95), 2) AS p95_ms, round(avg(iterations), 2) AS avg_iterations, round(avg(steps), 2) AS avg_steps, round(avg(quality), 2) AS avg_quality FROM runs GROUP BY mode, category)"""


def _runs(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select(F.when(F.col("user_id") % 2 == 0, "A").otherwise("B").alias("mode"), F.col("event_type").alias("category"), (F.col("value") > 5).alias("success"), F.col("value").alias("elapsed_ms"), (F.col("event_id") % 3).alias("iterations"), (F.col("user_id") % 4).alias("steps"), (1 + F.col("user_id") % 5).alias("quality"))


@query(f"WITH {RUNS_SQL} SELECT * FROM summary")
def ab_summary(spark, sf_dir):
    return evaluate.ab_summary(_runs(spark, sf_dir))


@query(f"WITH {RUNS_SQL} SELECT mode, sum(samples)::BIGINT AS total, {', '.join(f'round(sum({c} * samples) / sum(samples), 4) AS {c}' for c in ('success_rate', 'avg_ms', 'p95_ms', 'avg_iterations', 'avg_steps', 'avg_quality'))} FROM summary GROUP BY mode")
def ab_overall(spark, sf_dir):
    return evaluate.ab_overall(evaluate.ab_summary(_runs(spark, sf_dir)))


@query(f"WITH {RUNS_SQL} SELECT mode, category, count(*) AS samples, round(avg(elapsed_ms), 4) AS avg_ms, round(quantile_cont(elapsed_ms, 0.95), 4) AS p95_ms FROM runs GROUP BY ROLLUP (mode, category)")
def ab_rollup(spark, sf_dir):
    return evaluate.ab_rollup(_runs(spark, sf_dir))


@query("""SELECT conv_id, turn, CASE WHEN trim(text) = '' THEN 1 WHEN contains(text, '抱歉') OR contains(text, '错误') THEN 2 WHEN length(trim(text)) < 30 THEN 3 WHEN length(trim(text)) < 120 THEN 4 ELSE 5 END AS quality FROM conversations WHERE role = 'assistant'""")
def answer_quality(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    return c.select("conv_id", "turn", evaluate.answer_quality(F.col("text")).alias("quality"))


@query("""SELECT (user_id % 5)::INTEGER AS kb_id, count(*) AS searches, round(avg((event_id % 7 = 0)::INTEGER), 6) AS empty_rate, round(sum(event_id % 7) / sum(10 + event_id % 13), 6) AS return_ratio, round(quantile_cont(value, 0.95), 4) AS p95_ms, round(max(value) / 100 - min(value) / 100, 6) AS threshold_spread FROM events GROUP BY user_id % 5""")
def monitoring(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return evaluate.monitoring(e.select((F.col("user_id") % 5).cast("int").alias("kb_id"), (10 + F.col("event_id") % 13).alias("candidate_count"), (F.col("event_id") % 7).alias("returned_count"), F.col("value").alias("elapsed_ms"), (F.col("value") / 100).alias("threshold")))


@query("SELECT doc_id, md5(CASE WHEN doc_id % 2 = 0 THEN 'query: ' ELSE '' END || text) AS asked, md5(CASE WHEN doc_id % 2 = 0 THEN 'passage: ' ELSE '' END || text) AS stored FROM documents")
def role_texts(spark, sf_dir):
    """What an encoder of either family gets for queries and for passages."""
    d = table(spark, sf_dir, "documents").withColumn("model", F.when(F.col("doc_id") % 2 == 0, "multilingual-E5-base").otherwise("bge-m3"))
    made = lambda role: F.md5(vectors.role_text(F.col("model"), role, F.col("text")).cast("binary"))
    return d.select("doc_id", made("query").alias("asked"), made("passage").alias("stored"))


@query(f"WITH {SIMILARITY_SQL} SELECT query_id, chunk_id, similarity, rank FROM near WHERE rank <= 3")
def public_columns(spark, sf_dir):
    """What a user gets of results that carry vectors and working columns."""
    rows = near(spark, sf_dir, 3).select("query_id", "chunk_id", "similarity", "rank", "embedding").withColumn("_debug", F.lit(1))
    return ranking.public_columns(rows)


DISTINCT_SQL = "SELECT count(*) AS total, count(*) FILTER (found) AS hit, count(*) - count(*) FILTER (found) AS miss, count(DISTINCT text) FILTER (NOT found) AS unique_miss, round(count(*) FILTER (found) / count(*), 4) AS hit_rate FROM (SELECT text, text IN (SELECT text FROM documents WHERE source = 'src0') AS found FROM documents)"


@query(DISTINCT_SQL)
def encode_dedup_stats(spark, sf_dir):
    d = text_chunks(spark, sf_dir)
    key = vectors.cache_key(F.lit("local"), F.lit("hashed"), F.col("content")).alias("key")
    return vectors.encode_stats(d.select(key), d.where("source = 'src0'").select(key))


@query()
def encode_distinct(spark, sf_dir):
    """Vectors of the default encoder for all documents, each distinct text encoded once."""
    d = text_chunks(spark, sf_dir).select("doc_id", F.col("content").alias("text"))
    out = vectors.encode_distinct(d, None, vectors.hashed_encoder(), "local", "hashed")
    return out.select("doc_id", F.size("embedding").alias("dimension"), F.round(vectors.norm(F.col("embedding")), 4).alias("length"))


@query(f"""WITH {CORPUS_SQL}, p AS (SELECT a.vec_id, a.e AS a, b.e AS b FROM corpus a JOIN corpus b ON b.vec_id = a.vec_id + 1)
SELECT vec_id, round(list_dot_product(a, b) / (sqrt(list_dot_product(a, a)) * sqrt(list_dot_product(b, b))), 6) AS cosine, round(greatest(-1, least(1, list_dot_product(a, b))), 6) AS clamped, round(list_distance(a, b), 6) AS distance, round(greatest(0, least(1, 1 - list_distance(a, b) ** 2 / 2)), 6) AS similarity, round(list_dot_product(a, a) / list_dot_product(a, a), 6) AS unit_length FROM p""")
def vector_math(spark, sf_dir):
    c = corpus(spark, sf_dir).select("vec_id", "embedding")
    p = c.select("vec_id", F.col("embedding").alias("a")).join(c.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b")), "vec_id")
    a, b = F.col("a"), F.col("b")
    return p.select("vec_id", F.round(vectors.cosine(a, b), 6).alias("cosine"), F.round(vectors.clamped_dot(a, b), 6).alias("clamped"), F.round(vectors.distance(a, b), 6).alias("distance"), F.round(vectors.distance_similarity(vectors.distance(a, b)), 6).alias("similarity"), F.round(vectors.norm(vectors.unit(a)), 6).alias("unit_length"))
