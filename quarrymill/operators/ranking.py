"""The ranking algebra: fusion, normalisation, re-ranking, thresholds, clusters, floors, context, all by query_id.

Every order is total: score first, then the result key, so results do not depend on partitioning.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..config import HYBRID, VECTOR
from ..functions.text import let, tokens


def by_query(*order: Column | str) -> Window:
    w = Window.partitionBy("query_id")
    return w.orderBy(*order) if order else w


def top(df: DataFrame, k: int, score: str = "score", tie: str = "key", rank: str = "rank") -> DataFrame:
    return df.withColumn(rank, F.row_number().over(by_query(F.desc(score), tie))).where(F.col(rank) <= k)


def fuse_variants(results: DataFrame, method: str = "rrf", rrf_k: int = HYBRID.rrf_k) -> DataFrame:
    """results(query_id, variant, key, score) -> query_id, key, score, best: reciprocal ranks added up, or the best score.

    best is the highest single score, whose payload a caller may fetch.
    """
    rank = F.row_number().over(Window.partitionBy("query_id", "variant").orderBy(F.desc("score"), "key"))
    gain = F.max("score") if method == "max" else F.sum(1.0 / (rrf_k + F.col("_rank")))
    return results.withColumn("_rank", rank).groupBy("query_id", "key").agg(gain.alias("fused"), F.max("score").alias("best")).select("query_id", "key", F.round("fused", 8).alias("score"), "best")


def fuse_channels(results: DataFrame, weights: dict[str, float], rrf_k: int = HYBRID.rrf_k, window: int = HYBRID.window) -> DataFrame:
    """results(query_id, channel, key, score, ...) -> one row a key: the payload of its best score, final_score, channels.

    Weighted reciprocal ranks of the best `window` of each channel. A channel without a weight has 1; an explicit 0 is 0.
    Channels are merged in alphabetical order, so a payload is replaced by a strictly better one only.
    """
    rank = F.row_number().over(Window.partitionBy("query_id", "channel").orderBy(F.desc("score"), "key"))
    weight = F.coalesce(F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])[F.col("channel")], F.lit(1.0)) if weights else F.lit(1.0)
    ranked = results.withColumn("_rank", rank).where(F.col("_rank") <= window).withColumn("_gain", weight / (rrf_k + F.col("_rank")))
    payload = [c for c in results.columns if c not in ("query_id", "key", "channel")]
    first = F.row_number().over(Window.partitionBy("query_id", "key").orderBy(F.desc("score"), "channel"))
    best = ranked.withColumn("_first", first).where("_first = 1").select("query_id", "key", *payload)
    total = ranked.groupBy("query_id", "key").agg(F.round(F.sum("_gain"), 8).alias("final_score"), F.array_sort(F.collect_set("channel")).alias("channels"))
    return best.join(total, ["query_id", "key"])


def weigh_channels(results: DataFrame, weights: dict[str, float]) -> DataFrame:
    """final_score = score * weight of the channel; keys aren't merged."""
    weight = F.coalesce(F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])[F.col("channel")], F.lit(1.0))
    return results.withColumn("final_score", F.col("score") * weight)


def min_max(df: DataFrame, column: str = "final_score", out: str = "normalized") -> DataFrame:
    """Scaled to [0, 1] by query; equal values give 1."""
    low, high = F.min(column).over(by_query()), F.max(column).over(by_query())
    return df.withColumns({"_low": low, "_high": high}).withColumn(out, F.when(F.col("_high") <= F.col("_low"), 1.0).otherwise((F.col(column) - F.col("_low")) / (F.col("_high") - F.col("_low")))).drop("_low", "_high")


def overlap(query: Column, content: Column) -> Column:
    """Share of the query's tokens that the content has."""
    return let(tokens(query), lambda own: F.when(F.size(own) > 0, F.size(F.array_intersect(own, tokens(content))) / F.size(own)).otherwise(0.0))


def rerank_hybrid(df: DataFrame, config=HYBRID) -> DataFrame:
    """df(query_id, query_text, key, content, final_score, channels, source, match_stage) with rerank_score.

    Normalised fusion score and token overlap, bonuses for graph evidence, a penalty for rows without either. A query without
    tokens keeps its scores.
    """
    marked = df.withColumns({"_overlap": overlap(F.col("query_text"), F.col("content")), "_graph": F.array_contains("channels", "graph") | F.coalesce(F.col("source").startswith("graph_"), F.lit(False))})
    scored = min_max(marked)  # its window keeps the overlap from being worked out more than once
    bonus = F.when(F.col("_graph"), 0.08).otherwise(0.0) + F.when(F.col("source") == "graph_direct", 0.12).otherwise(0.0) + F.when(F.lower("match_stage") == "exact", 0.08).otherwise(0.0)
    raw = config.rerank_alpha * F.col("normalized") + (1 - config.rerank_alpha) * F.col("_overlap") + bonus
    raw = F.when(~F.col("_graph") & (F.col("_overlap") < 0.05), raw * 0.68).otherwise(raw)
    final = F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw))
    return scored.withColumn("rerank_score", F.when(F.size(tokens(F.col("query_text"))) > 0, final).otherwise(F.col("final_score"))).drop("_overlap", "_graph", "normalized")


def rerank_vector(df: DataFrame, config=VECTOR, head: int = 1200) -> DataFrame:
    """df(query_id, query_text, content, filename, similarity) with rerank_score: similarity and overlap of the content's first
    characters, more if the file's name has a token."""
    own = tokens(F.col("query_text"))
    named = F.exists(own, lambda t: F.contains(F.lower(F.coalesce("filename", F.lit(""))), t))
    lexical = F.greatest(F.lit(0.0), F.least(F.lit(1.0), overlap(F.col("query_text"), F.substring("content", 1, head)) + F.when(named, 0.1).otherwise(0.0)))
    mixed = config.rerank_alpha * F.col("similarity") + (1 - config.rerank_alpha) * lexical
    return df.withColumn("rerank_score", F.when(F.size(own) > 0, mixed).otherwise(F.col("similarity")))


def dynamic_threshold(df: DataFrame, top_k: int, explicit: float | None = None, config=VECTOR) -> DataFrame:
    """Rows at or above max(base, best - margin); with fewer than min_keep of them the first min(min_keep, 3 top_k).

    One pass: counts and ranks are windows over the query.
    """
    base = explicit if explicit is not None and explicit > 0 else config.base_threshold
    limit = F.greatest(F.lit(base), F.max("similarity").over(by_query()) - config.margin)
    marked = df.withColumn("effective_threshold", limit)
    marked = marked.withColumns({"_kept": F.count_if(F.col("similarity") >= F.col("effective_threshold")).over(by_query()), "_rank": F.row_number().over(by_query(F.desc("similarity"), "key"))})
    few = F.col("_kept") < config.min_keep
    return marked.where(F.when(few, F.col("_rank") <= min(config.min_keep, 3 * max(1, top_k))).otherwise(F.col("similarity") >= F.col("effective_threshold"))).drop("_kept", "_rank")


def blend_second_stage(df: DataFrame, config=VECTOR) -> DataFrame:
    """df(query_id, key, base_score, logit): the best second_top rows get alpha * sigmoid(logit) + (1 - alpha) * base and are
    ranked by it; the others follow in their order. Adds second_score and rank."""
    placed = df.withColumn("_place", F.row_number().over(by_query(F.desc("base_score"), "key")))
    top_ = F.col("_place") <= config.second_top
    sigmoid = 1 / (1 + F.exp(-F.col("logit")))
    scored = placed.withColumn("second_score", F.when(top_, F.round(config.second_alpha * sigmoid + (1 - config.second_alpha) * F.col("base_score"), 8)))
    return scored.withColumn("rank", F.row_number().over(by_query(F.when(top_, 0).otherwise(1), F.desc("second_score"), F.when(top_, 0).otherwise(F.col("_place")), "key"))).drop("_place")


def cluster_chunks(df: DataFrame, config=VECTOR, carry: tuple[str, ...] = ()) -> DataFrame:
    """df(query_id, file_id, chunk_index, key, content, similarity) -> merged clusters of neighbouring chunks of a file.

    A cluster ends at a gap or after max_chunks chunks; the max_clusters best of a file stay. Texts are joined in order;
    key, similarity and the columns to carry are those of the best chunk.
    """
    file = Window.partitionBy("query_id", "file_id").orderBy("chunk_index", "key")
    gap = F.col("chunk_index") - F.lag("chunk_index").over(file) > config.adjacent
    runs = df.withColumn("_run", F.sum(F.when(F.coalesce(gap, F.lit(False)), 1).otherwise(0)).over(file))
    place = F.row_number().over(Window.partitionBy("query_id", "file_id", "_run").orderBy("chunk_index", "key"))
    parts = runs.withColumn("_part", F.floor((place - 1) / config.max_chunks))
    ordered = F.array_sort(F.collect_list(F.struct("chunk_index", "key", "content")))
    merged = parts.groupBy("query_id", "file_id", "_run", "_part").agg(
        F.max("similarity").alias("similarity"),
        F.max_by(F.struct("key", *carry), F.struct("similarity", -F.col("chunk_index"))).alias("_payload"),
        F.array_join(F.transform(F.filter(ordered, lambda x: F.coalesce(x["content"], F.lit("")) != ""), lambda x: x["content"]), "\n").alias("content"),
        F.transform(ordered, lambda x: x["key"]).alias("evidence_chunks"),
        F.count(F.lit(1)).alias("cluster_size"),
    ).select("*", *(f"_payload.{c}" for c in ("key", *carry))).drop("_payload")
    best = F.row_number().over(Window.partitionBy("query_id", "file_id").orderBy(F.desc("similarity"), "key"))
    kept = merged.withColumn("_best", best).where(F.col("_best") <= config.max_clusters).drop("_best", "_run", "_part")
    return kept.withColumn("rank", F.row_number().over(by_query(F.desc("similarity"), "key")))


def graph_floor(df: DataFrame, top_k: int, graph_total: Column | None = None, config=HYBRID) -> DataFrame:
    """df(query_id, key, final_score, is_graph) -> the top_k rows, where the last rows without graph evidence make room for good
    graph rows until graph_min_results (or all graph rows, if fewer) are in. Adds rank.

    graph_total: graph rows that were retrieved; those in df if None.
    """
    total = graph_total if graph_total is not None else F.count_if(F.col("is_graph")).over(by_query())
    placed = df.withColumns({"_place": F.row_number().over(by_query(F.desc("final_score"), "key")), "_total": total})
    placed = placed.withColumn("_in", F.col("_place") <= top_k)
    placed = placed.withColumn("_need", F.least(F.lit(config.graph_min_results), F.col("_total"), F.lit(top_k)) - F.count_if(F.col("_in") & F.col("is_graph")).over(by_query()))
    spare = ~F.col("_in") & F.col("is_graph") & (F.col("final_score") >= config.graph_min_quality)
    leaves = F.col("_in") & ~F.col("is_graph")
    placed = placed.withColumns({"_spare": F.when(spare, F.row_number().over(Window.partitionBy("query_id", spare).orderBy("_place"))), "_leave": F.when(leaves, F.row_number().over(Window.partitionBy("query_id", leaves).orderBy(F.desc("_place"))))})
    placed = placed.withColumn("_swap", F.least(F.greatest(F.col("_need"), F.lit(0)), F.coalesce(F.max("_spare").over(by_query()), F.lit(0)), F.coalesce(F.max("_leave").over(by_query()), F.lit(0))))
    kept = placed.where((F.col("_in") & ~F.coalesce(F.col("_leave") <= F.col("_swap"), F.lit(False))) | F.coalesce(F.col("_spare") <= F.col("_swap"), F.lit(False)))
    return kept.withColumn("rank", F.row_number().over(by_query(F.desc("final_score"), "key"))).drop("_place", "_total", "_in", "_need", "_spare", "_leave", "_swap")


def context_filter(df: DataFrame, fallback: int = HYBRID.context_max, config=HYBRID) -> DataFrame:
    """df(query_id, key, score, source, confidence): rows relevant enough for a prompt, context_max at most; if none is,
    the first `fallback` rows (10 for chats, 1 for agents)."""
    graph = F.coalesce(F.col("source").startswith("graph"), F.lit(False))
    weak = (F.col("source") == "graph_direct") & (F.col("confidence") > 0) & (F.col("confidence") < config.graph_min_confidence)
    fits = (F.col("score") >= F.when(graph, config.graph_min_similarity).otherwise(config.min_similarity)) & ~F.coalesce(weak, F.lit(False))
    marked = df.withColumn("_fits", fits).withColumn("_any", F.count_if(F.col("_fits")).over(by_query()))
    marked = marked.withColumn("_place", F.row_number().over(by_query(F.when(F.col("_any") > 0, ~F.col("_fits")).otherwise(F.lit(False)), F.desc("score"), "key")))
    return marked.where(F.when(F.col("_any") > 0, F.col("_fits") & (F.col("_place") <= config.context_max)).otherwise(F.col("_place") <= fallback)).drop("_fits", "_any", "_place")


def display_weights(df: DataFrame, column: str = "score") -> DataFrame:
    """Min-max by query, then parts of 1; equal scores share alike."""
    scaled = df.withColumns({"_low": F.min(column).over(by_query()), "_high": F.max(column).over(by_query()), "_n": F.count(F.lit(1)).over(by_query())})
    scaled = scaled.withColumn("_x", F.when(F.col("_high") > F.col("_low"), (F.col(column) - F.col("_low")) / (F.col("_high") - F.col("_low"))))
    return scaled.withColumn("weight", F.coalesce(F.col("_x") / F.sum("_x").over(by_query()), 1.0 / F.col("_n"))).drop("_low", "_high", "_n", "_x")


def mmr(df: DataFrame, top_k: int, recall: int, config=VECTOR) -> DataFrame:
    """df(query_id, key, similarity, embedding) with rank: greedy choice of lambda * similarity - (1 - lambda) * the highest dot
    product with what was chosen, until max(top_k, min(rows, recall)); then the rest, then rows without a vector.

    Sequential by nature: one query's candidates (recall at most) make a group.
    """
    def diversify(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["similarity", "key"], ascending=[False, True]).reset_index(drop=True)
        has = [i for i, v in enumerate(rows["embedding"]) if v is not None and len(v)]
        chosen: list[int] = []
        if len(has) > 1:
            left, worst = list(has), {i: None for i in has}
            vectors = {i: np.asarray(rows["embedding"][i], float) for i in has}
            while left and len(chosen) < max(top_k, min(len(has), recall)):
                value = lambda i: config.mmr_lambda * rows["similarity"][i] - (1 - config.mmr_lambda) * (0.0 if worst[i] is None else worst[i])
                best = max(left, key=lambda i: (round(value(i), 12), -i))
                left.remove(best)
                chosen.append(best)
                for i in left:
                    same = len(vectors[i]) == len(vectors[best])
                    d = float(np.clip(vectors[i] @ vectors[best], -1, 1)) if same else 0.0
                    worst[i] = d if worst[i] is None else max(worst[i], d)
        order = chosen + [i for i in has if i not in set(chosen)] + [i for i in range(len(rows)) if i not in set(has)]
        if not chosen:
            order = list(range(len(rows)))
        return pd.DataFrame({"query_id": rows["query_id"][order].to_numpy(), "key": rows["key"][order].to_numpy(), "similarity": rows["similarity"][order].to_numpy(), "rank": range(1, len(order) + 1)})

    return df.select("query_id", "key", "similarity", "embedding").groupBy("query_id").applyInPandas(diversify, "query_id long, key string, similarity double, rank int")


def diversify_sources(df: DataFrame, config=HYBRID) -> DataFrame:
    """df(query_id, key, kb_id, source, score) for queries over several knowledge bases: in order of score a row is left out if
    its key was seen, if its source would exceed max_same_source of the rows so far, or if its knowledge base has max_per_kb.

    The ratio depends on what was kept before, so a query's rows are walked in order. Queries with one knowledge base pass.

    Without a key column the key is diversity_key of chunk_id, source, entity and content. Repeated keys go in the JVM: the first of
    equal keys that a limit turns away may be followed by another, so only rows that agree in all that counts are dropped there. Rows
    without a knowledge base have no limit of their own.
    """
    keyed = df if "key" in df.columns else df.withColumn("key", diversity_key(*map(F.col, ("chunk_id", "source", "entity", "content"))))
    slim = keyed.select("query_id", "key", "kb_id", F.coalesce("source", F.lit("unknown")).alias("source"), "score")

    def kept(rows: pd.DataFrame) -> pd.DataFrame:
        if rows["kb_id"].nunique() <= 1:
            return rows
        chosen: list = []
        for row in rows.sort_values(["score", "key", "kb_id", "source"], ascending=[False, True, True, True]).itertuples():
            same = 1 + sum(c.source == row.source for c in chosen)
            crowded = bool(chosen) and same > config.max_same_source * (len(chosen) + 1)
            full = sum(c.kb_id == row.kb_id for c in chosen) >= config.max_per_kb
            if not (crowded or full or any(c.key == row.key for c in chosen)):
                chosen.append(row)
        return rows.loc[[c.Index for c in chosen]]

    several = slim.groupBy("query_id").agg(F.count_distinct("kb_id").alias("_kbs"))
    marked = slim.join(several, "query_id").select(*slim.columns, (F.col("_kbs") > 1).alias("_several"))
    once = marked.where("_several").drop("_several").dropDuplicates()
    return marked.where("NOT _several").drop("_several").unionByName(once.groupBy("query_id").applyInPandas(kept, slim.schema))


def diversity_key(chunk_id: Column, source: Column, entity: Column, content: Column) -> Column:
    """What makes results of several knowledge bases the same: the chunk, else source, entity and the content's first 120 characters."""
    head = F.substring(F.sha1(F.substring(F.coalesce(content, F.lit("")), 1, 120).cast("binary")), 1, 16)
    return F.when(F.coalesce(chunk_id, F.lit("")) != "", chunk_id).otherwise(F.concat_ws("|", F.coalesce(source, F.lit("unknown")), F.coalesce(entity, F.lit("")), head))


def diagnostics(df: DataFrame) -> DataFrame:
    """df(query_id, channel, similarity, effective_threshold) -> counts per stage by query."""
    return df.groupBy("query_id").agg(F.count(F.lit(1)).alias("candidate_count"), F.count_if(F.col("similarity") >= F.col("effective_threshold")).alias("after_threshold"), F.max("effective_threshold").alias("effective_threshold"), F.array_join(F.array_sort(F.collect_set("channel")), ",").alias("channels"))


def search_report(channels: DataFrame, fused: DataFrame, entities: DataFrame | None = None, names: tuple[str, ...] = ("vector", "keyword", "graph")) -> DataFrame:
    """channels(query_id, channel), fused(query_id) -> by query the rows of each channel and those that were fused, with
    entities(query_id, ...) of graph.entity_report beside them. Queries that only one side has are rows too."""
    found = channels.groupBy("query_id").agg(*[F.count_if(F.col("channel") == n).alias(f"{n}_result_count") for n in names])
    out = found.join(fused.groupBy("query_id").agg(F.count(F.lit(1)).alias("fused_result_count")), "query_id", "full_outer")
    out = out if entities is None else out.join(entities, "query_id", "full_outer")
    return out.fillna(0, [*(f"{n}_result_count" for n in names), "fused_result_count"])


class Stages:
    """Row counts of a plan's stages, taken by observation while the plan runs: no second pass."""

    def __init__(self) -> None:
        self._seen: dict[str, Observation] = {}

    def at(self, name: str, df: DataFrame) -> DataFrame:
        self._seen[name] = Observation(f"{name}-{uuid.uuid4().hex}")
        return df.observe(self._seen[name], F.count(F.lit(1)).alias("rows"))

    def counts(self) -> dict[str, int]:
        """Waits for the first action on the plan."""
        return {name: seen.get["rows"] for name, seen in self._seen.items()}


def public_columns(df: DataFrame) -> DataFrame:
    """Without the columns that start with an underscore, and without embeddings."""
    return df.select(*[c for c in df.columns if not c.startswith("_") and c != "embedding"])


def context_text(df: DataFrame, most_evidence: int = 5) -> DataFrame:
    """df(query_id, rank, content, score, channels, evidence) -> query_id, context: numbered blocks in order of rank, each with its
    channels and evidence if it has any; a blank line between them."""
    channels = F.when(F.size("channels") > 0, F.concat(F.lit(" (通道: "), F.array_join("channels", ", "), F.lit(")"))).otherwise("")
    evidence = F.when(F.size("evidence") > 0, F.concat(F.lit("\n证据块: "), F.array_join(F.slice("evidence", 1, most_evidence), ", "))).otherwise("")
    # format_number rounds the double itself, ties to even; format_string rounds its shortest decimal form, halves up
    percent = F.coalesce(F.call_function("format_number", F.col("score") * 100, F.lit("0.00")), F.lit("null"))
    block = F.concat(F.format_string("[文档%d] (相似度: %s%%)", "rank", percent), channels, F.lit("\n"), F.coalesce("content", F.lit("")), evidence, F.lit("\n"))
    return df.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", block.alias("block")))), lambda x: x["block"]), "\n").alias("context"))


def source_items(df: DataFrame, limit: int) -> DataFrame:
    """df(query_id, rank, content, similarity, score, final_score, file_id, source) -> the first `limit` of each query as a user sees
    them: a preview of 200 characters, the whole content, the score that counts and the share of the display it gives."""
    counts = F.coalesce("final_score", "similarity", "score", F.lit(0.0))
    kept = display_weights(df.where(F.col("rank") <= limit).withColumn("_counts", counts), "_counts")
    content = F.coalesce("content", F.lit(""))
    preview_ = F.concat(F.substring(content, 1, 200), F.when(F.length(content) > 200, "...").otherwise(""))
    return kept.select("query_id", "rank", preview_.alias("content"), content.alias("full_content"), F.col("_counts").alias("similarity"), F.col("weight").alias("display_weight"), F.coalesce("score", F.lit(0.0)).alias("raw_score"), F.coalesce("final_score", "_counts").alias("final_score"), "file_id", F.coalesce("source", F.lit("unknown")).alias("source"))


def projected(df: DataFrame, fields: tuple[str, ...] = (), also: tuple[str, ...] = ()) -> DataFrame:
    """df(query_id, rank, content, ...) -> query_id, rank, content, similarity, metadata, source, chunk_id: the rows of any pipeline as
    users see them. similarity is the score that counts; metadata (map of texts) has those of the fields, and the channels, that have
    a value. Columns in `also` follow as they are."""
    has = lambda *names: [F.col(n) for n in names if n in df.columns]
    fields = (*fields, "channels") if "channels" in df.columns and "channels" not in fields else fields
    text = lambda f: F.array_join(f, ",") if df.schema[f].dataType.typeName() == "array" else F.col(f).cast("string")
    pairs = [F.struct(F.lit(f).alias("key"), text(f).alias("value")) for f in fields]
    metadata = F.map_from_entries(F.filter(F.array(*pairs), lambda p: p["value"].isNotNull())) if pairs else F.create_map().cast("map<string,string>")
    score = F.coalesce(*has("final_score", "similarity", "score"), F.lit(0.0)).cast("double")
    return df.select("query_id", "rank", F.coalesce("content", F.lit("")).alias("content"), score.alias("similarity"), metadata.alias("metadata"), F.coalesce(*has("source"), F.lit("unknown")).alias("source"), F.coalesce(*has("chunk_id"), F.lit(None).cast("string")).alias("chunk_id"), *also)


def source_json(df: DataFrame) -> DataFrame:
    """df(query_id, ...) -> query_id, sources: the other columns as one JSON text, timestamps in ISO form."""
    return df.select("query_id", F.to_json(F.struct(*[c for c in df.columns if c != "query_id"]), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss"}).alias("sources"))


def score_with(df: DataFrame, scorer: Callable, chosen: Column | None = None, head: int = 1500) -> DataFrame:
    """df(query_id, query_text, content, ...) with logit from a user's function of two pandas Series, query_text and the content's first
    characters. Rows that aren't chosen don't reach the function; their logit is null."""

    def score(queries: pd.Series, contents: pd.Series, wanted: pd.Series) -> pd.Series:
        on = wanted.to_numpy(bool)
        out = pd.Series([None] * len(queries), dtype="Float64")
        if on.any():
            out[on] = np.asarray(scorer(queries[on], contents[on]), float)
        return out

    wanted = F.lit(True) if chosen is None else F.coalesce(chosen, F.lit(False))
    return df.withColumn("logit", F.pandas_udf(score, "double")("query_text", F.substring(F.coalesce("content", F.lit("")), 1, head), wanted))


# --- an agent's evidence --------------------------------------------------------------------------------------------


def resolve_kbs(kb_id: Column, kb_ids: Column, every: Column, limit: int = 5) -> Column:
    """The knowledge bases (array<int>) that a request means: the one it names, unless its list lacks it; else the first `limit` different
    numbers of its list (array<string>; other entries are skipped); else the first `limit` of `every`."""
    listed = F.array_distinct(F.filter(F.transform(F.coalesce(kb_ids, F.array().cast("array<string>")), lambda x: x.try_cast("int")), lambda x: x.isNotNull()))
    named = F.coalesce(kb_id, F.lit(0)) != 0
    none = F.array().cast("array<int>")
    one = F.when((F.size(listed) > 0) & ~F.array_contains(listed, kb_id.cast("int")), none).otherwise(F.array(kb_id.cast("int")))
    return F.when(named, one).when(F.size(listed) > 0, F.slice(listed, 1, limit)).otherwise(F.slice(every, 1, limit))


def agent_evidence(asked: DataFrame, hybrid: DataFrame, vector: DataFrame, top_k: int, threshold: float = 0.2) -> DataFrame:
    """asked(query_id, kbs), hybrid and vector (query_id, kb_id, key, score) -> query_id, kb_id, key, score, branch, rank.

    A query's hybrid rows of all its knowledge bases are merged and the first 2 * top_k stay; a query without any takes the vector
    branch: rows at the threshold or above, top_k of them. Both are branches of one plan; queries meet their rows by equi-joins.
    """
    pairs = asked.select("query_id", F.explode(F.array_distinct(F.col("kbs").cast("array<string>"))).alias("kb_id"))
    own = lambda df, branch: df.withColumn("kb_id", F.col("kb_id").cast("string")).join(pairs, ["query_id", "kb_id"]).select("query_id", "kb_id", "key", "score", F.lit(branch).alias("branch"))
    order = by_query(F.desc("score"), "kb_id", "key")
    first = own(hybrid, "hybrid").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= 2 * top_k)
    left = pairs.select("query_id").distinct().join(first.select("query_id"), "query_id", "left_anti")
    rest = own(vector.where(F.col("score") >= threshold), "vector").join(left, "query_id", "left_semi")
    return first.unionByName(rest.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k))
