"""Retrieval and answer quality: hit labels, Recall@k, MRR, nDCG, A/B summaries, monitoring figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import trim_all


def label_hits(results: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """results(query_id, rank, key, content), relevant(query_id, keys, keywords) -> results up to k with hit: the key is relevant, or
    the content has a relevant keyword."""
    keyword = F.exists(F.coalesce("keywords", F.array().cast("array<string>")), lambda w: F.contains(F.lower("content"), F.lower(w)))
    hit = F.coalesce(F.array_contains("keys", F.col("key")), F.lit(False)) | F.coalesce(keyword, F.lit(False))
    return results.where(F.col("rank") <= k).join(relevant, "query_id", "left").withColumn("hit", hit)


def ir_metrics(labelled: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """labelled(query_id, rank, hit), relevant(query_id, total) -> query_id, recall, mrr, ndcg for every query of relevant.

    recall is 1 with any hit. nDCG divides by the ideal of min(total, k) hits, total at least 1; it isn't capped at 1.
    """
    gained = labelled.groupBy("query_id").agg(F.min(F.when(F.col("hit"), F.col("rank"))).alias("first"), F.sum(F.when(F.col("hit"), 1 / F.log2(F.col("rank") + 1.0)).otherwise(0.0)).alias("dcg"))
    n = F.least(F.greatest(F.col("total"), F.lit(1)), F.lit(k)).cast("int")
    ideal = F.aggregate(F.sequence(F.lit(1), n), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + F.lit(1.0)))
    out = relevant.select("query_id", "total").join(gained, "query_id", "left")
    return out.select("query_id", F.when(F.col("first").isNotNull(), 1.0).otherwise(0.0).alias("recall"), F.round(F.coalesce(1.0 / F.col("first"), F.lit(0.0)), 6).alias("mrr"), F.round(F.coalesce("dcg", F.lit(0.0)) / ideal, 6).alias("ndcg"))


def macro(metrics: DataFrame) -> DataFrame:
    return metrics.agg(F.count(F.lit(1)).alias("queries"), *[F.round(F.avg(c), 6).alias(c) for c in ("recall", "mrr", "ndcg")])


def ab_summary(runs: DataFrame) -> DataFrame:
    """runs(mode, category, success, elapsed_ms, iterations, steps, quality) by mode and category; the percentile interpolates
    linearly. The success rate has four decimals, the other figures two."""
    mean = lambda c, name: F.round(F.avg(c), 2).alias(name)
    return runs.groupBy("mode", "category").agg(F.count(F.lit(1)).alias("samples"), F.round(F.avg(F.col("success").cast("int")), 4).alias("success_rate"), mean("elapsed_ms", "avg_ms"), F.round(F.percentile("elapsed_ms", 0.95), 2).alias("p95_ms"), mean("iterations", "avg_iterations"), mean("steps", "avg_steps"), mean("quality", "avg_quality"))


def ab_overall(summary: DataFrame) -> DataFrame:
    """Sample-weighted means of the groups' figures by mode (of the percentiles as well; see ab_rollup for exact ones)."""
    weigh = lambda c: F.round(F.sum(F.col(c) * F.col("samples")) / F.sum("samples"), 4).alias(c)
    return summary.groupBy("mode").agg(F.sum("samples").alias("total"), *[weigh(c) for c in ("success_rate", "avg_ms", "p95_ms", "avg_iterations", "avg_steps", "avg_quality")])


def ab_rollup(runs: DataFrame) -> DataFrame:
    """The figures at every level from the rows themselves: mode and category, mode, all."""
    return runs.rollup("mode", "category").agg(F.count(F.lit(1)).alias("samples"), F.round(F.avg("elapsed_ms"), 4).alias("avg_ms"), F.round(F.percentile("elapsed_ms", 0.95), 4).alias("p95_ms"))


#: Words of answers that failed.
APOLOGIES = ("抱歉", "错误")


def answer_quality(answer: Column) -> Column:
    """1 for no answer, 2 for an apology, else 3 to 5 by length: under 30, under 120, more characters."""
    text = trim_all(F.coalesce(answer, F.lit("")))
    failed = F.lit(False)
    for word in APOLOGIES:
        failed = failed | text.contains(word)
    return F.when(text == "", 1).when(failed, 2).when(F.length(text) < 30, 3).when(F.length(text) < 120, 4).otherwise(5)


def monitoring(metrics: DataFrame) -> DataFrame:
    """metrics(kb_id, candidate_count, returned_count, elapsed_ms, threshold) -> rates, ratio, percentile and spread by knowledge base."""
    return metrics.groupBy("kb_id").agg(
        F.count(F.lit(1)).alias("searches"),
        F.round(F.avg((F.col("returned_count") == 0).cast("int")), 6).alias("empty_rate"),
        F.round(F.sum("returned_count") / F.sum("candidate_count"), 6).alias("return_ratio"),
        F.round(F.percentile("elapsed_ms", 0.95), 4).alias("p95_ms"),
        F.round(F.max("threshold") - F.min("threshold"), 6).alias("threshold_spread"),
    )
