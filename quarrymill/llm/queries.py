"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat, gbt, langid, line_dedup, mixing, near_dedup, oracles, quality, topk, toxicity, trie, unigram, whitening
from .common import read


def tokenizer(name: str) -> str:
    """The place of a public tokenizer's file."""
    return public_tokenizers.path(name)


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(read(spark, sf_dir, "documents"), words=4, percent=80)


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a maximal conversation: conv_id, n_turns, text."""
    return chat.format_chats(read(spark, sf_dir, "conversations"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(read(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a document: doc_id, n_tokens."""
    return unigram.token_counts(read(spark, sf_dir, "documents"), unigram.vocabulary(tokenizer("piece_bpe_32k.model")))


def op5_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.where("vec_id % 100 = 0"), k=10)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a document: its text without repeated lines, how many lines it had and lost."""
    return line_dedup.dedup_lines(read(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.learn(docs, read(spark, sf_dir, "labels")))


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.repeats(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(read(spark, sf_dir, "documents"))


def op10_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(read(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read(spark, sf_dir, "embeddings"))


def op12_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gbt.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(read(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_minhash_near_dedup,
        op2_chat_format,
        op3_language_id,
        op4_token_counts,
        op5_exact_top_k,
        op6_line_dedup,
        op7_toxicity,
        op8_mix_sources,
        op9_quality_rules,
        op10_bpe_encode_decode,
        op11_embedding_whitening,
        op12_quality_classifier,
        op13_prefix_trie,
    )
}

ORACLE_SQL: dict[str, str] = oracles.ORACLE_SQL
