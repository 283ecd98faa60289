"""Models behind small interfaces, with deterministic stand-ins.

An encoder, a cross-encoder and a generator are functions of batches; they run in iterator pandas UDFs, so that a worker
loads its model once. The stand-ins need no model: a hashing encoder, the share of common words, the best sentences.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType, StringType

from ..functions.text import query_text, search_tokens, sentences

Encoder = Callable[[Sequence[str]], np.ndarray]
Scorer = Callable[[Sequence[str], Sequence[str]], Sequence[float]]
Generator = Callable[[Sequence[str]], Sequence[str]]


def hashing_encoder(dim: int = 64) -> Encoder:
    """Signed hashed word counts."""

    def encode(texts: Sequence[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim), np.float32)
        for i, t in enumerate(texts):
            for w in (t or "").lower().split():
                h = zlib.crc32(w.encode())
                out[i, (h >> 1) % dim] += 1.0 if h & 1 else -1.0
        return out

    return encode


def encode(text: Column, load: Callable[[], Encoder], *, prefix: bool = True, normalise: bool = True, batch: int = 32) -> Column:
    """Vectors of a text column. load runs once a worker and task."""

    @F.pandas_udf(ArrayType(FloatType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for texts in batches:
            parts = [model(texts.iloc[a : a + batch].fillna("").tolist()) for a in range(0, len(texts), batch)]
            v = np.concatenate(parts) if parts else np.zeros((0, 1), np.float32)
            if normalise:
                v = v / np.maximum(np.sqrt((v * v).sum(axis=1, keepdims=True)), 1e-12)
            yield pd.Series(list(v.astype(np.float32)))

    return run(query_text(text) if prefix else text)


def cross_score(query: Column, text: Column, load: Callable[[], Scorer]) -> Column:
    @F.pandas_udf(DoubleType())
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = load()
        for q, t in batches:
            yield pd.Series(np.asarray(model(q.fillna("").tolist(), t.fillna("").tolist()), np.float64))

    return run(query, text)


def generate(prompt: Column, load: Callable[[], Generator]) -> Column:
    """Answers of a generator; a failing batch gets a fixed answer by kind of error."""

    @F.pandas_udf(StringType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for prompts in batches:
            try:
                yield pd.Series(list(model(prompts.fillna("").tolist())), dtype=object)
            except TimeoutError:
                yield pd.Series(["[timeout]"] * len(prompts))
            except Exception as e:  # the model's own errors become answers, as the service does it
                yield pd.Series(["[rate limit]" if "429" in str(e) else "[error]"] * len(prompts))

    return run(prompt)


def overlap_score(query: Column, text: Column) -> Column:
    """Stand-in for a cross-encoder: share of the query's words that the text has, on a logit-like scale."""
    return overlap_of(word_set(query), word_set(text))


def word_set(text: Column) -> Column:
    return F.array_distinct(search_tokens(text))


def overlap_of(query_words: Column, text_words: Column) -> Column:
    """overlap_score of word sets, so that a text that meets many queries is cut into words once."""
    share = F.size(F.array_intersect(query_words, text_words)) / F.size(query_words)
    return F.when(F.size(query_words) > 0, share * 8 - 4).otherwise(F.lit(-4.0))


def token_counts(text: Column, vocabulary: str) -> Column:
    """Exact tokens of a text by the tokenizer file at ``vocabulary`` (without special tokens); a null text has none."""

    @F.pandas_udf("long")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(vocabulary)
        for texts in batches:
            found = tokenizer.encode_batch_fast(texts.fillna("").tolist(), add_special_tokens=False)
            yield pd.Series([len(x.ids) for x in found], dtype="int64")

    return run(text)


def extractive_answer(query: Column, context: Column, most: int = 3) -> Column:
    """Stand-in for a generator: the context's sentences that share most words with the query."""
    q = F.array_distinct(search_tokens(query))
    scored = F.transform(sentences(context), lambda s, i: F.struct((-F.size(F.array_intersect(q, search_tokens(s)))).alias("n"), i.alias("i"), s.alias("s")))
    return F.array_join(F.transform(F.slice(F.array_sort(scored), 1, most), lambda x: x["s"]), " ")
