"""The retrieval pipelines as one lazy plan each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import HYBRID, VECTOR
from ..functions.text import variants
from ..operators import graph, keyword, ranking, vectors
from ..sources.scratch import among, settled


def vector_search(queries: DataFrame, corpus: DataFrame, top_k: int, recall: int, explicit: float | None = None, diversify: bool = False, config=VECTOR) -> DataFrame:
    """queries(query_id, kb_id, vector, query_text), corpus(kb_id, chunk_id, file_id, chunk_index, content, filename, embedding) ->
    query_id, file_id, key, similarity, cluster_size, rank.

    Recall, threshold, re-ranking, optional diversification, clusters of neighbours, cut. The similarities are rounded to four places
    before the threshold; clusters are ranked by their best similarity, so re-ranking only shows in rerank_score.
    """
    near = vectors.knn(queries, corpus, recall, decimals=4)
    clusters = postprocess(near.drop("rank"), queries, corpus, top_k, recall, explicit, diversify, config=config)
    return clusters.select("query_id", "file_id", "key", "content", "similarity", "cluster_size", "rank")


def postprocess(found: DataFrame, queries: DataFrame, corpus: DataFrame, top_k: int, recall: int, explicit: float | None = None, diversify: bool = False, scorer: Callable | None = None, stages: ranking.Stages | None = None, config=VECTOR) -> DataFrame:
    """found(query_id, kb_id, chunk_id, similarity), one row a chunk of a query -> clusters: threshold, token overlap, the second stage of
    the first second_top rows with a scorer, diversification, clusters of neighbours, cut at top_k.

    The threshold comes before texts and vectors are fetched. rerank_score and second_score are those of a cluster's best chunk.
    """
    seen = lambda name, df: df if stages is None else stages.at(name, df)
    rows = found.withColumns({"kb_id": F.col("kb_id").cast("string"), "chunk_id": F.col("chunk_id").cast("string")}).withColumn("key", F.concat(F.lit("chunk::"), "chunk_id"))
    passed = seen("threshold", ranking.dynamic_threshold(seen("candidates", rows), top_k, explicit, config))
    slim = corpus.select(F.col("kb_id").cast("string").alias("kb_id"), F.col("chunk_id").cast("string").alias("chunk_id"), "file_id", "chunk_index", "content", "filename", *(["embedding"] if diversify else []))
    kept = ranking.rerank_vector(passed.join(slim, ["kb_id", "chunk_id"]).join(queries.select("query_id", "query_text"), "query_id"), config).withColumn("rerank_score", F.round("rerank_score", 8))
    kept = kept.withColumn("second_score", F.lit(None).cast("double"))
    if scorer is not None:
        place = F.row_number().over(ranking.by_query(F.desc("rerank_score"), "key"))
        scored = ranking.score_with(kept.withColumn("_place", place), scorer, F.col("_place") <= config.second_top)
        kept = ranking.blend_second_stage(scored.withColumn("base_score", F.col("rerank_score")), config).drop("_place", "base_score", "logit", "rank")
    if diversify:
        order = ranking.mmr(kept.select("query_id", "key", "similarity", "embedding"), top_k, recall, config)
        kept = kept.join(order.select("query_id", "key", F.col("rank").alias("mmr_rank")), ["query_id", "key"])
    return seen("clusters", ranking.cluster_chunks(kept, config, ("kb_id", "chunk_id", "filename", "rerank_score", "second_score"))).where(F.col("rank") <= top_k)


def text_search(queries: DataFrame, corpus: DataFrame, top_k: int, recall: int, encode: Callable[[DataFrame], DataFrame], explicit: float | None = None, diversify: bool = False, scorer: Callable | None = None, method: str = "rrf", ascii_only: bool = False, stages: ranking.Stages | None = None, config=VECTOR) -> DataFrame:
    """queries(query_id long, kb_id, query_text), corpus as in vector_search -> query_id, file_id, kb_id, key, chunk_id, content, filename,
    similarity, rerank_score, second_score, cluster_size, evidence_chunks, rank.

    Each query is asked in up to three forms; encode adds embedding to a table with a text column. The forms' lists are fused: a chunk
    counts once, with its best similarity. Queries without text ask nothing.
    """
    most = HYBRID.max_variants
    forms = queries.select("query_id", "kb_id", F.posexplode(variants(F.col("query_text"), most, True, ascii_only)).alias("variant", "text"))
    asked = encode(forms).select((F.col("query_id") * most + F.col("variant")).alias("query_id"), "kb_id", F.col("embedding").alias("vector"))
    near = vectors.knn(asked, corpus, recall, decimals=4)
    lists = near.select(F.expr(f"(query_id - pmod(query_id, {most})) div {most}").alias("query_id"), F.expr(f"pmod(query_id, {most})").alias("variant"), F.struct("kb_id", "chunk_id").alias("key"), F.col("similarity").alias("score"))
    fused = ranking.fuse_variants(lists, method, HYBRID.rrf_k).select("query_id", "key.kb_id", "key.chunk_id", F.col("best").alias("similarity"), F.col("score").alias("fusion_score"))
    return postprocess(fused, queries, corpus, top_k, recall, explicit, diversify, scorer, stages, config)


def hybrid_search(queries: DataFrame, chunks: DataFrame, top_k: int, vector: DataFrame | None = None, names: DataFrame | None = None, entities: DataFrame | None = None, relations: DataFrame | None = None, channels: tuple[str, ...] = ("vector", "keyword", "graph"), config=HYBRID, mentioned: DataFrame | None = None, evidence: DataFrame | None = None) -> DataFrame:
    """queries(query_id, kb_id, query_text), chunks(kb_id, chunk_id, content) -> query_id, key, chunk_id, content, final_score, channels,
    source, match_stage, rank. chunk_id and content are null for graph rows.

    The channels are independent branches: vector takes its results (query_id, chunk_id, similarity), keyword is computed here, graph
    takes names(query_id, kb_id, query_entity) and the graph's tables, with mentioned and evidence as graph_channel has them. Fused by weighted reciprocal ranks, re-ranked, cut, with a floor
    for graph evidence. Which channels run is the caller's choice.
    """
    parts = []
    row = lambda df, channel, source: df.withColumns({"channel": F.lit(channel), "source": F.lit(source) if source else F.col("source")})
    content = chunks.select(F.concat(F.lit("chunk::"), "chunk_id").alias("key"), F.col("chunk_id").cast("string").alias("chunk_id"), "content")
    columns = ["query_id", "channel", "key", "score", "source", "match_stage"]
    if "vector" in channels and vector is not None:
        parts.append(row(vector.select("query_id", F.concat(F.lit("chunk::"), "chunk_id").alias("key"), F.col("similarity").alias("score"), F.lit("").alias("match_stage")), "vector", "vector").select(columns))
    if "keyword" in channels:
        found = keyword.search(queries, chunks, max(top_k * 4, config.window), config)
        parts.append(row(found.select("query_id", F.concat(F.lit("chunk::"), "chunk_id").alias("key"), "score", F.lit("").alias("match_stage")), "keyword", "keyword").select(columns))
    if "graph" in channels and names is not None:
        parts.append(row(graph.graph_channel(names, entities, relations, config.window, config=config, hit=settled(graph.lookup(names, entities), "hits"), mentioned=mentioned, evidence=evidence), "graph", None).select(columns))
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    union = settled(union, "channels")  # the channels are worked out once
    fused = ranking.fuse_channels(union, {"vector": config.vector_weight, "keyword": config.keyword_weight, "graph": config.graph_weight}, config.rrf_k, config.window)
    content = among(content, union, ["key"])
    texts = fused.join(content, "key", "left").join(queries.select("query_id", "query_text"), "query_id")
    ranked = ranking.rerank_hybrid(texts, config).withColumn("final_score", F.round("rerank_score", 6)).withColumn("is_graph", F.array_contains("channels", "graph"))
    kept = ranking.graph_floor(ranked, top_k, config=config)
    return kept.select("query_id", "key", "chunk_id", "content", "final_score", F.array_join("channels", ",").alias("channels"), "source", "match_stage", "rank")
