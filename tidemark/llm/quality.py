"""Quality by Bradley-Terry pairwise ranking.

Each document has a strength, linear in features of its text. From labelled documents, pairs of a good and a bad
one are preference pairs; the weights minimise the mean logistic loss of the feature differences of all pairs. The
threshold is a quantile of the strengths of all training documents: the one asked for, or else the one where
accepting costs least.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle, written
from .labelled import held_out, told

#: A document is accepted from this score on.
ACCEPT = 0.3
MARKS = "*&%$#!|@~^_<>{}[]=+\\/"
STOPS = ".,;:?"


def features(text: str | None) -> np.ndarray:
    """Shares of words, characters and lines that tell prose from noise; of the whole text."""
    text = text or ""
    words = text.split()
    lines = [x for x in text.split("\n") if x.strip()]
    n, chars = max(1, len(words)), max(1, len(text))
    fives = len(words) - 4
    digits = sum(map(text.count, "0123456789"))
    marks = sum(map(text.count, MARKS))
    shares = [
        sum(map(str.isupper, words)) / n,
        sum(map(str.istitle, words)) / n,
        marks / n,
        marks / chars,
        sum(map(text.count, STOPS)) / n,
        digits / chars,
        sum(map(eq, words, words[1:])) / n,
        1 - len(set(words)) / n,
        1 - len(set(zip(words, words[1:], words[2:], words[3:], words[4:], strict=False))) / fives if fives > 0 else 0.0,
        1 - len(set(lines)) / max(1, len(lines)),
        text.count("|") / n,
        len(text) / n / 20,
    ]
    x = np.clip(np.array(shares), 0, 4)
    return np.concatenate([x, np.sqrt(x), [np.log1p(len(words)) / 10, np.log1p(len(lines)) / 10, float(not words)]])


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float
    slope: float
    #: The share of the training documents below the cut.
    quantile: float = 0.0

    def strength(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) / self.scale @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        """0 to 1; ACCEPT at the cut."""
        z = self.slope * (self.strength(x) - self.cut) + np.log(ACCEPT / (1 - ACCEPT))
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


#: What a pass over the training documents gives: sums (keys, rows of values), several at a time.
Sums = list[tuple[np.ndarray, np.ndarray]]
#: A pass: calls a function of (features, labels) on all training documents, in parts, and adds up its sums by key.
Pass = Callable[[Callable[[np.ndarray, np.ndarray], Sums]], Sums]

#: Features are multiples of 1 / GRAIN, standardised ones of 1 / FINE: their sums, and those of their products, are
#: then exact in a double, for up to 2^25 documents, so that neither order nor partition of the rows matters.
GRAIN, FINE = 2.0**20, 2.0**14
#: Bins of strength, per unit, where opponents meet; NARROW of them make one for the second derivatives.
BINS, NARROW = 32, 5
#: Strengths beyond these share a bin where opponents meet, or count as this for the cut.
FAR, FARTHEST = 64, 1024
#: Bins per unit in which the cut is looked for, and their parts, in which it is then found.
STEPS, PARTS = 512, 2048
#: Tasks of a pass over the training documents, at most; each sends its sums to the driver.
TASKS = 32


def by_key(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sums of the values of each key."""
    order = np.argsort(keys, kind="stable")
    own = keys[order]
    starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]]) if len(own) else np.zeros(0, dtype=np.int64)
    return own[starts], np.add.reduceat(values[order], starts, axis=0) if len(own) else values.astype(float)


def added(parts: list[Sums]) -> Sums:
    return [by_key(np.concatenate([k for k, _ in same]), np.concatenate([v for _, v in same])) for same in zip(*parts, strict=True)]


def moments(x: np.ndarray, y: np.ndarray) -> Sums:
    """Per label: the count, the sum of the features, that of their squares in two parts."""
    q = np.rint(x * GRAIN).astype(np.int64)
    return [by_key(y, np.concatenate([np.ones((len(q), 1)), q, q * q >> 22, q * q & (1 << 22) - 1], 1))]


@dataclass
class Scale:
    mean: np.ndarray
    scale: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.rint((x - self.mean) / self.scale * FINE) / FINE


def meet(x: np.ndarray, y: np.ndarray, to: Scale, w: np.ndarray) -> Sums:
    """Of each label's bins of strength: the count and the sum of the features; of wider bins, that of their products."""
    z = to(x)
    b = np.clip(np.floor((z * w).sum(1) * BINS), -FAR * BINS, FAR * BINS - 1).astype(np.int64)
    key = b * 2 + y
    order = np.lexsort([b, y])
    z, wide = z[order], ((b >> NARROW) * 2 + y)[order]
    starts = np.flatnonzero(np.r_[True, wide[1:] != wide[:-1]]) if len(wide) else np.zeros(0, dtype=np.int64)
    products = [(z[i:j].T @ z[i:j]).ravel() for i, j in zip(starts, [*starts[1:], len(wide)], strict=True)]
    squares = np.stack(products) if products else np.zeros((0, z.shape[1] ** 2))
    return [by_key(key[order], np.concatenate([np.ones((len(z), 1)), z], 1)), (wide[starts], squares)]


def newton(sums: Sums, w: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """(loss, step) over all pairs of a good and a bad document, each at the middle strength of its bin."""
    (keys, first), (wide, second) = sums
    sides, k = [], len(w)
    for label in (1, 0):
        n, z = first[keys % 2 == label][:, 0], first[keys % 2 == label][:, 1:]
        own = wide[wide % 2 == label] >> 1
        at = np.searchsorted(own, keys[keys % 2 == label] >> 1 + NARROW)
        nn, zz = np.bincount(at, n, len(own)), np.zeros((len(own), k))
        np.add.at(zz, at, z)
        sides.append((n, z, z @ w / n, nn, zz, zz @ w / nn, second[wide % 2 == label].reshape(-1, k, k)))
    (ng, zg, sg, ngw, zgw, sgw, xg), (nb, zb, sb, nbw, zbw, sbw, xb) = sides
    pairs = ng.sum() * nb.sum()
    loss, up, down = 0.0, np.zeros(len(ng)), np.zeros(len(nb))
    for a in range(0, len(ng), 256):
        part = slice(a, a + 256)
        apart = np.clip(sg[part, None] - sb, -500, 500)
        loss += ng[part] @ np.log1p(np.exp(-apart)) @ nb
        p = 1 / (1 + np.exp(apart))
        up[part] = p @ nb
        down += p.T @ ng[part]
    slope = (zg.T @ up - zb.T @ down) / pairs - ridge * w
    p = 1 / (1 + np.exp(np.clip(sgw[:, None] - sbw, -500, 500)))
    q = p * (1 - p)
    cross = zgw.T @ q @ zbw
    bend = (np.einsum("i,ijk->jk", q @ nbw, xg) + np.einsum("i,ijk->jk", q.T @ ngw, xb) - cross - cross.T) / pairs
    return float(loss / pairs + ridge * (w @ w) / 2), np.linalg.solve(bend + ridge * np.eye(k), slope)


def strengths(x: np.ndarray, y: np.ndarray, to: Scale, w: np.ndarray, within: np.ndarray | None = None) -> Sums:
    """(bad, good) of each bin of strength; of those within, by their parts."""
    s = np.floor(np.clip(((x - to.mean) / to.scale * w).sum(1), -FARTHEST, FARTHEST) * (STEPS * PARTS)).astype(np.int64)
    counts = np.stack([y == 0, y == 1], 1).astype(float)
    if within is None:
        return [by_key(s // PARTS, counts)]
    inside = np.isin(s // PARTS, within)
    return [by_key(s[inside], counts[inside])]


def cheapest(bad: np.ndarray, good: np.ndarray) -> float:
    """The quantile below which rejecting costs least, if a rejected good document costs 1 - ACCEPT, and an accepted
    bad one ACCEPT over the share of bad ones. bad, good: counts by rising strength."""
    bad, good = np.concatenate([[0], np.cumsum(bad)]), np.concatenate([[0], np.cumsum(good)])
    cost = ACCEPT * (bad[-1] - bad) / max(1, bad[-1]) * good[-1] + (1 - ACCEPT) * good
    best = np.flatnonzero(cost <= cost.min() * (1 + 1e-12))
    return float((bad + good)[best[len(best) // 2]] / (bad[-1] + good[-1]))


def cut_at(run: Pass, to: Scale, w: np.ndarray, bins: np.ndarray, counts: np.ndarray, quantile: float) -> float:
    """Half way between the strengths below which that share of the documents lies, and above."""
    n, until = int(counts.sum()), np.cumsum(counts)
    at = min(n, max(0, round(quantile * n)))
    # The bins of the last document below, and of the first one above.
    own = np.searchsorted(until, [max(0, at - 1), min(n - 1, at)], side="right")
    [(parts, pair)] = run(partial(strengths, to=to, w=w, within=bins[own]))
    inside = np.cumsum(pair.sum(1)) + until[own[0]] - counts[own[0]]
    low, high = (parts[np.searchsorted(inside, k, side="right")] / (STEPS * PARTS) for k in (max(0, at - 1), min(n - 1, at)))
    if at in (0, n):
        return float(low - 0.5 if at == 0 else high + 0.5)
    return float(low if low == high else (low + high + 1 / (STEPS * PARTS)) / 2)


def fitted(run: Pass, k: int, ridge: float = 1e-3, quantile: float | None = None) -> Model:
    """By passes over all training documents; all pairs of a good and a bad one count, and none is made.

    The loss of a document against all opponents depends on its strength and theirs alone, so opponents are taken
    together by bins of strength. quantile: of the training documents' strengths, the cut; None: the one of least cost.
    Without a good and a bad document there is no pair: all scores are then 0.5.
    """
    [(found, sums)] = run(moments)
    if set(found.tolist()) != {0, 1}:
        return Model(np.zeros(k), np.ones(k), np.zeros(k), -np.log((1 - ACCEPT) / ACCEPT), 1.0)
    total = sums.sum(0)
    n, mean, square = total[0], total[1 : k + 1] / GRAIN / total[0], (total[k + 1 : 2 * k + 1] * 2.0**22 + total[2 * k + 1 :]) / GRAIN**2 / total[0]
    to = Scale(mean, np.sqrt(np.maximum(0, square - mean**2)) + 1e-6)
    w, step, least = np.zeros(k), np.zeros(k), np.inf
    for _ in range(25):
        loss, ahead = newton(run(partial(meet, to=to, w=w)), w, ridge)
        if loss > least + 1e-6:  # too far: half the way
            step = step / 2
            w = w - step
            continue
        least, step = loss, ahead
        w = w + step
        if np.abs(step).max() < 1e-4:
            break
    [(bins, counts)] = run(partial(strengths, to=to, w=w))
    if quantile is None:
        quantile = cheapest(counts[:, 0], counts[:, 1])
    cut = cut_at(run, to, w, bins, counts.sum(1), quantile)
    # One slope, by Newton steps, with the cut held at ACCEPT.
    slope, base, t = 1.0, np.log(ACCEPT / (1 - ACCEPT)), (bins + 0.5) / STEPS - cut
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(slope * t + base, -50, 50)))
        change = (counts[:, 1] * (1 - p) - counts[:, 0] * p) @ t / n - 1e-3 * slope
        change /= counts.sum(1) @ (p * (1 - p) * t * t) / n + 1e-3
        slope = min(20.0, max(1e-3, slope + change))
        if abs(change) < 1e-6:
            break
    return Model(to.mean, to.scale, w, cut, slope, quantile)


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, quantile: float | None = None) -> Model:
    """fitted() on arrays."""
    return fitted(lambda f: added([f(x, y.astype(np.int64))]), x.shape[1], ridge, quantile)


def over(table: DataFrame, k: int) -> Pass:
    """Passes over a table (label, x); the executors add up, TASKS sums come to the driver."""

    def run(f: Callable[[np.ndarray, np.ndarray], Sums]) -> Sums:
        def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            settle()
            total = None
            for batch in batches:
                x = batch.column(1).flatten().to_numpy().reshape(-1, k).astype(float)
                own = f(x, batch.column(0).to_numpy().astype(np.int64))
                total = added([total, own] if total else [own])
            if total:
                yield pa.RecordBatch.from_pydict({"sums": [pickle.dumps(total)]}, pa.schema([("sums", pa.binary())]))

        parts = [pickle.loads(r.sums) for r in table.coalesce(TASKS).mapInArrow(of, "sums binary").collect()]
        return added(parts or [f(np.zeros((0, k)), np.zeros(0, dtype=np.int64))])

    return run


def learn(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", quantile: float | None = None) -> Model:
    """From all labelled documents that are not held out. Their features, 108 bytes each, are written once."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        settle()
        for batch in batches:
            yield pd.DataFrame({"label": batch["label"], "x": [(np.rint(features(t) * GRAIN) / GRAIN).astype(np.float32) for t in batch["text"]]})

    table = written(told(docs, labels, "quality", text, key).mapInPandas(of, "label int, x array<float>"), "quality-features")
    return fitted(over(table, len(features(""))), len(features("")), quantile=quantile)


def scored(docs: DataFrame, model: Model, text: str = "text", column: str = "score") -> DataFrame:
    """docs with a column of scores, 0 to 1, higher: better. Null text scores as empty text."""

    @F.pandas_udf("double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        settle()
        for batch in batches:
            yield pd.Series(model.score(np.stack([features(t) for t in batch])) if len(batch) else [], dtype="float64")

    return docs.withColumn(column, of(F.coalesce(F.col(text), F.lit(""))))


def quality(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs.

    Repeated rows score alike; rows with a null key are scored, and are held out. Without labels of both kinds, all
    score 0.5. An empty table gives no rows. No column but the text is an input of the score.
    """
    rows = scored(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")), learn(docs, labels, text=text, key=key))
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", quantile: float | None = None) -> DataFrame:
    """The rows of docs, all columns, that score at least ACCEPT, which the cut at the quantile has; see fit()."""
    model = learn(docs, labels, text=text, key=key, quantile=quantile)
    return scored(docs, model, text, "__tm_score").filter(F.col("__tm_score") >= ACCEPT).drop("__tm_score")
