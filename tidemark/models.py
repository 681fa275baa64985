"""Scorers: models are a plug, with a deterministic stand-in that needs no weights."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Scorer(Protocol):
    """What a model gives for a batch of inputs: one vector of `dim` for each."""

    dim: int

    def score(self, inputs: list) -> np.ndarray: ...


class Stub:
    """Pseudo-random but fixed unit vectors: equal inputs, equal vectors."""

    def __init__(self, dim: int = 64, unit: bool = True):
        self.dim, self.unit = dim, unit

    def score(self, inputs: list) -> np.ndarray:
        import zlib

        out = np.empty((len(inputs), self.dim))
        for k, x in enumerate(inputs):
            raw = x.encode() if isinstance(x, str) else np.asarray(x, dtype="<f4").tobytes()
            out[k] = np.random.default_rng(zlib.crc32(raw)).normal(size=self.dim)
        return out / np.linalg.norm(out, axis=1, keepdims=True) if self.unit else out


def scoring(make: Callable[[], Scorer]) -> Callable[[Column], Column]:
    """A column function: make() runs once in each Python worker's task, not once for each batch."""

    @F.pandas_udf("array<float>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = make()
        for batch in batches:
            yield pd.Series(list(scorer.score(batch.tolist()).astype(np.float32)))

    return of


def embedded_windows(df: DataFrame, by: list[str], samples: str, window: int, hop: int, make: Callable[[], Scorer]) -> DataFrame:
    """(by, start, len, coverage, embedding) for each window of an array of samples, short ones padded with zeros."""
    from tidemark.functions import signal
    from tidemark.operators import windows

    cut = windows.spans(df.withColumn("__n", F.size(samples).cast("long")), "__n", windows.Plan(window, hop))
    piece = signal.padded_or_cut(F.expr(f"slice(`{samples}`, cast(start as int) + 1, {window})"), window)
    return cut.select(*by, "start", "len", "coverage", scoring(make)(piece).alias("embedding"))


def embedded_texts(df: DataFrame, key: str, text: str, make: Callable[[], Scorer], budget: int = 512) -> DataFrame:
    """(key, embedding): long texts by chunks, averaged by how much of the budget each fills, over the norm."""
    from tidemark.operators import aggregates, chunking

    parts = chunking.chunked(df, key, text, budget)
    vectors = parts.select(key, (F.col("n_tokens") / budget).alias("w"), scoring(make)(F.col("text")).alias("v"))
    return aggregates.pooled(vectors, [key], "v", weight=F.col("w"))
