"""Settings of the operators. An explicit 0 counts as 0."""

from __future__ import annotations

from dataclasses import dataclass

#: Words that are no query tokens.
STOP_WORDS = ("的", "了", "和", "与", "及", "由", "是", "是什么", "怎么", "如何", "哪些", "哪几", "吗", "呢", "啊", "呀")
#: Where compound entity names are split.
SPLIT_TOKENS = ("的", "与", "和", "及", "由", "、", "/", "-", "_")
#: Words that mark a complex question.
COMPLEX_MARKERS = ("以及", "并且", "区别", "对比", "流程", "步骤", "如何", "为什么")
#: Fixed value: words added to a query of two or more tokens.
INTENT_SUFFIX = " 定义 作用 场景"


@dataclass(frozen=True)
class Hybrid:
    """Hybrid retrieval: channels, fusion, re-ranking, graph scores, context."""

    vector_weight: float = 0.6
    graph_weight: float = 0.4
    keyword_weight: float = 0.5
    rrf_k: int = 60
    window: int = 50
    rerank_alpha: float = 0.7
    graph_min_results: int = 1
    graph_min_quality: float = 0.12
    max_fallbacks: int = 8
    keyword_power: float = 1.0
    max_variants: int = 3
    min_factor: float = 1.0
    max_factor: float = 1.8
    direct_base: float = 0.82
    hop_base: float = 0.62
    confidence_weight: float = 0.22
    evidence_weight: float = 0.16
    mention_weight: float = 0.08
    hop_decay: float = 0.25
    context_max: int = 10
    min_similarity: float = 0.12
    graph_min_similarity: float = 0.10
    graph_min_confidence: float = 0.35
    max_per_kb: int = 4
    max_same_source: float = 0.8


@dataclass(frozen=True)
class VectorSearch:
    """Vector retrieval: recall, threshold, re-ranking, diversification, clusters."""

    recall_factor: int = 8
    min_recall: int = 30
    max_recall: int = 120
    base_threshold: float = 0.2
    margin: float = 0.08
    min_keep: int = 3
    rerank_alpha: float = 0.75
    mmr_lambda: float = 0.7
    adjacent: int = 1
    max_chunks: int = 3
    max_clusters: int = 2
    second_top: int = 20
    second_alpha: float = 0.7


@dataclass(frozen=True)
class Profile:
    chunk_size: int
    overlap: int


#: Chunk size and overlap by document type.
PROFILES = {"text": Profile(750, 120), "code": Profile(600, 100), "html": Profile(700, 120), "json": Profile(650, 100), "markdown": Profile(700, 120)}
HYBRID, VECTOR = Hybrid(), VectorSearch()
