"""Plug points for models: an embedder and a completer are plain functions.

``Embedder``: list of texts to list of vectors. ``Completer``: list of prompts to
list of answers. Both run inside Arrow batches on the executors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loreweave.operators.vector import is_zero_vector

Embedder = Callable[[list[str]], list[list[float]]]
Completer = Callable[[list[str]], list[str]]


def hashing_embedder(dim: int = 64) -> Embedder:
    """Deterministic embedder for tests: hashed words, unit length."""

    def embed(texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), dim))
        for row, body in enumerate(texts):
            for word in (body or "").lower().split():
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "big")
                out[row, h % dim] += 1.0
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(norm == 0, 1, norm)).astype("float32").tolist()

    return embed


def _batched(df: DataFrame, fn, source: str, target: str, kind: str, batch: int, retries: int) -> DataFrame:
    """Only the ``source`` column travels to Python; the rest of the row stays put."""

    def call(part: list[str]) -> list:
        for attempt in range(retries):
            try:
                got = fn(part)
                break
            except Exception:
                if attempt + 1 == retries:
                    raise
        if len(got) != len(part):
            raise ValueError(f"model returned {len(got)} results for {len(part)} inputs")
        return got

    def run(columns: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for column in columns:
            values = column.fillna("").tolist()
            yield pd.Series([r for at in range(0, len(values), batch) for r in call(values[at : at + batch])], dtype=object)

    return df.withColumn(target, F.pandas_udf(run, kind)(F.col(source)))


def embed(
    df: DataFrame, embedder: Embedder, source: str = "text", target: str = "embedding", batch: int = 20, retries: int = 3
) -> DataFrame:
    """Add a vector column; the result count of each call is checked."""
    return _batched(df, embedder, source, target, "array<float>", batch, retries)


def complete(
    df: DataFrame, completer: Completer, source: str = "prompt", target: str = "answer", batch: int = 20, retries: int = 3
) -> DataFrame:
    """Add an answer column to a table of prompts."""
    return _batched(df, completer, source, target, "string", batch, retries)


def reembed_zero_vectors(facts: DataFrame, embedder: Embedder, batch: int = 20) -> DataFrame:
    """Give facts whose vector is all zeros a fresh one; others pass unchanged."""
    zero = is_zero_vector(F.col("embedding")) & (F.coalesce("fact_value", F.lit("")) != "")
    fresh = embed(facts.filter(zero), embedder, "fact_value", "embedding", batch)
    return facts.filter(~zero).unionByName(fresh)
