"""Images: patch budgets, antialiased resizing and patches, in NumPy for Arrow functions."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

PATCH, BUDGET = 16, 256


def target_size(height: int, width: int, budget: int = BUDGET, patch: int = PATCH) -> tuple[int, int]:
    """The largest size, in whole patches, near the aspect of the image, of at most `budget` patches."""

    def grid(scale: float) -> tuple[int, int]:
        return max(1, math.ceil(height * scale / patch)), max(1, math.ceil(width * scale / patch))

    low, high = 1e-6, 100.0
    while high - low >= 1e-5:
        middle = (low + high) / 2
        rows, columns = grid(middle)
        low, high = (middle, high) if rows * columns <= budget else (low, middle)
    rows, columns = grid(low)
    return rows * patch, columns * patch


def taps(source: int, target: int) -> np.ndarray:
    """target x source weights of a triangle filter that widens when it shrinks."""
    scale = source / target
    support = max(1.0, scale)
    centre = (np.arange(target)[:, None] + 0.5) * scale
    w = np.maximum(0, 1 - np.abs((np.arange(source) + 0.5 - centre) / support))
    return w / w.sum(1, keepdims=True)


def resized(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Rows x columns x channels, separably."""
    x = np.einsum("hs,swc->hwc", taps(image.shape[0], height), image.astype(np.float64))
    return np.einsum("ws,hsc->hwc", taps(image.shape[1], width), x)


def patches(image: np.ndarray, budget: int = BUDGET, patch: int = PATCH) -> tuple[np.ndarray, np.ndarray]:
    """(budget x patch elements, mask): patches row by row, then zeros."""
    h, w, c = image.shape
    rows = image.reshape(h // patch, patch, w // patch, patch, c).swapaxes(1, 2).reshape(-1, patch * patch * c)
    out, mask = np.zeros((budget, rows.shape[1])), np.zeros(budget, dtype=int)
    out[: len(rows)], mask[: len(rows)] = rows, 1
    return out, mask


def lifted(grid: np.ndarray, rows: int, columns: int, budget: int = BUDGET) -> np.ndarray:
    """A grid of position vectors at another size, then zeros."""
    x = resized(grid, rows, columns).reshape(rows * columns, -1)
    return np.concatenate([x, np.zeros((budget - len(x), x.shape[1]))])


def preprocessed(data: bytes, height: int, width: int, budget: int = BUDGET, patch: int = PATCH) -> tuple[np.ndarray, np.ndarray, tuple[int, int]]:
    """(patches, mask, (rows, columns)) of RGB bytes."""
    if len(data) != height * width * 3 or not height or not width:
        raise ValueError("bytes do not fit the size")
    image = np.frombuffer(data, dtype=np.uint8).reshape(height, width, 3)
    h, w = target_size(height, width, budget, patch)
    x = np.clip(np.rint(resized(image, h, w)), 0, 255)
    out, mask = patches((x / 255 - 0.5) / 0.5, budget, patch)
    return out, mask, (h // patch, w // patch)


def preprocess(df: DataFrame, key: str, pixels: str, height: str, width: str, budget: int = BUDGET) -> DataFrame:
    """(key, patches, mask, rows, columns, error) of raw RGB images."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for k, d, h, w in zip(batch[key], batch[pixels], batch[height], batch[width], strict=True):
                try:
                    x, mask, (r, c) = preprocessed(bytes(d), int(h), int(w), budget)
                    rows.append((k, x.ravel().astype(np.float32), mask, r, c, None))
                except (TypeError, ValueError) as e:
                    rows.append((k, None, None, None, None, str(e)))
            yield pd.DataFrame(rows, columns=["key", "patches", "mask", "rows", "columns", "error"])

    return df.select(key, pixels, height, width).mapInPandas(of, "key long, patches array<float>, mask array<int>, rows int, columns int, error string")
