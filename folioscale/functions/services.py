"""Outside services behind plain functions, with deterministic stand-ins for work without a network (SURVEY tier X).

A service is any callable of the given form. It is called once for an Arrow batch with the batch's texts, so an adapter can
send them in one request; a failing call is tried again and then fails the task, which Spark tries again elsewhere.
"""

from __future__ import annotations

import hashlib
import re
import time
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscale.operators.lexical import rank_capped, split_tokens

Embedder = Callable[[list[str]], np.ndarray]
Scorer = Callable[[list[str], list[str]], list[float]]
Generator = Callable[[list[str]], list[str]]


class HashedWords:
    """Texts as unit vectors of their tokens' counts in ``dimension`` places, each place and sign by a hash of the token."""

    def __init__(self, dimension: int = 64) -> None:
        self.dimension = dimension

    def __call__(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dimension))
        for row, text in zip(out, texts):
            for t in split_tokens(text):
                h = int.from_bytes(hashlib.blake2b(t.encode(), digest_size=8).digest(), "big")
                row[h % self.dimension] += 1 if h >> 63 else -1
        length = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(length > 0, length, 1)


def shared_words(queries: list[str], texts: list[str]) -> list[float]:
    """Share of each query's distinct tokens that the text holds."""
    out = []
    for q, t in zip(queries, texts):
        asked, found = set(split_tokens(q)), set(split_tokens(t))
        out.append(len(asked & found) / len(asked) if asked else 0.0)
    return out


def first_sentences(prompts: list[str]) -> list[str]:
    """The first sentence of each prompt: what stands in for generated text."""
    return [re.split(r"(?<=[.!?])\s", p or "", maxsplit=1)[0] for p in prompts]


def estimated_tokens(text: Column) -> Column:
    """A fourth of the characters, rounded up; 0 for null."""
    return F.coalesce(F.ceil(F.length(text) / 4), F.lit(0)).cast("bigint")


def patiently(call: Callable, *args, tries: int = 3, wait: float = 1.0, most: float = 30.0):  # noqa: ANN002, ANN201
    """The call's result; a failing call is tried again after a wait that doubles up to ``most`` seconds."""
    for k in range(tries):
        try:
            return call(*args)
        except Exception:
            if k + 1 == tries:
                raise
            time.sleep(min(wait * 2**k, most))


def embedded(text: Column, embedder: Embedder) -> Column:
    """Vectors of the texts; null for null."""

    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        got = patiently(embedder, [t or "" for t in texts])
        if len(got) != len(texts):
            raise ValueError(f"{len(got)} vectors for {len(texts)} texts")
        return pd.Series([None if t is None else v.astype("float32").tolist() for t, v in zip(texts, got)])

    return run(text)


def embedded_by_group(chunks: DataFrame, group: str, order: str, text: str, embedder: Callable[[list[str]], np.ndarray]) -> DataFrame:
    """group, order, embedding: the texts of one group are embedded in one call, in order; a service of one document at a time."""
    kinds = dict(chunks.dtypes)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order)
        got = patiently(embedder, rows[text].fillna("").tolist())
        if len(got) != len(rows):
            raise ValueError(f"{len(got)} vectors for {len(rows)} chunks")
        return pd.DataFrame({group: rows[group], order: rows[order], "embedding": [v.astype("float32").tolist() for v in got]})

    return chunks.select(group, order, text).groupBy(group).applyInPandas(run, f"{group} {kinds[group]}, {order} {kinds[order]}, embedding array<float>")


def scored(query: Column, text: Column, scorer: Scorer = shared_words) -> Column:
    @F.pandas_udf("double")
    def run(queries: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series(patiently(scorer, queries.fillna("").tolist(), texts.fillna("").tolist()), dtype="float64")

    return run(query, text)


def reranked(answers: DataFrame, scorer: Scorer = shared_words, top: int = 15, per_paper: int = 3, key: str = "chunk_id") -> DataFrame:
    """answers (query_id, query, ``key``, paper_id, text, rank) in the scorer's order, ``per_paper`` of a paper, with rerank_score and the old rank as ``was``."""
    rows = answers.withColumnRenamed("rank", "was").withColumn("rerank_score", F.round(scored(F.col("query"), F.col("text"), scorer), 6))
    return rank_capped(rows, "query_id", "paper_id", [F.desc("rerank_score"), F.asc("was"), F.asc(key)], per_paper, top)


def generated(prompt: Column, generator: Generator = first_sentences) -> Column:
    @F.pandas_udf("string")
    def run(prompts: pd.Series) -> pd.Series:
        return pd.Series(patiently(generator, prompts.fillna("").tolist()))

    return run(prompt)


def cached(rows: DataFrame, key: str, cache: DataFrame, value: str, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """rows with ``value``: from the cache (key, value) where it is there, made only for the keys that are not."""
    missing = rows.join(cache.select(key), key, "left_anti").dropDuplicates([key])
    both = cache.select(key, value).unionByName(make(missing).select(key, value))
    return rows.join(both, key, "left")


def hypothetical(question: Column, generator: Generator = first_sentences) -> Column:
    """The question with a made-up answer, to be embedded in its place."""
    return F.concat(F.lit("Query: "), question, F.lit("\nRelevant excerpt: "), generated(question, generator))
