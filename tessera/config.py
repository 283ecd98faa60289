"""Tunable constants of retrieval, chunking and evaluation."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class RetrievalConfig:
    top_k_dense: int = 200
    top_k_sparse: int = 200
    final_k: int = 10
    max_same_article: int = 2
    alpha_default: float = 0.60
    alpha_short: float = 0.50
    alpha_exact: float = 0.30
    alpha_semantic: float = 0.70
    short_words: int = 4
    long_words: int = 15
    boost_article: float = 10.0
    boost_law: float = 1.2
    other_law_penalty: float = 0.70
    shortcut_max: int = 3
    shortcut_lift: float = 1.2
    min_score: float = 0.001
    dense_fallback_below: int = 10


@dataclass(frozen=True)
class Bm25Config:
    k1: float = 1.6
    b: float = 0.68
    delta: float = 1.0


@dataclass(frozen=True)
class ChunkConfig:
    min_tokens: int = 180
    max_tokens: int = 250
    overlap_ratio: float = 0.15
    min_chunk_tokens: int = 40
    #: A last window of fewer tokens joins the one before it, or is dropped if there is none.
    min_last_tokens: int = 50


#: Characters that may stand between a law's number, or its name, and the number of an article in a question, and between a law's number and the
#: word for article in a decision.
NUMBER_REACH, NAME_REACH, CITATION_REACH = 60, 40, 50
