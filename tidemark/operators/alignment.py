"""Alignment: dynamic time warping, word times from it, and forced alignment by connectionist Viterbi."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.signal import let


def warp(weights: np.ndarray) -> tuple[list[int], list[int]]:
    """The cheapest monotone path over -weights, as row and column indices.

    A diagonal step is taken only if strictly cheapest, then a step down, else one to the right. Costs fill one
    anti-diagonal at a time, so the work is vectorised.
    """
    cost = -np.asarray(weights, dtype=np.float64)
    n, m = cost.shape
    total = np.full((n + 1, m + 1), np.inf)
    total[0, 0] = 0.0
    came = np.zeros((n + 1, m + 1), dtype=np.int8)
    for d in range(2, n + m + 1):
        i = np.arange(max(1, d - m), min(n, d - 1) + 1)
        j = d - i
        # The cell's cost is added before comparing, as rounding then makes ties.
        own = cost[i - 1, j - 1]
        diagonal, up, left = total[i - 1, j - 1] + own, total[i - 1, j] + own, total[i, j - 1] + own
        step = np.where((diagonal < up) & (diagonal < left), 0, np.where((up < diagonal) & (up < left), 1, 2))
        total[i, j] = np.choose(step, [diagonal, up, left])
        came[i, j] = step
    came[0, :], came[:, 0] = 2, 1
    i, j, rows, columns = n, m, [], []
    while i > 0 or j > 0:
        rows.append(i - 1)
        columns.append(j - 1)
        step = came[i, j]
        i, j = i - (step != 2), j - (step != 1)
    return rows[::-1], columns[::-1]


def paths(df: DataFrame, key: str, weights: str) -> DataFrame:
    """(key, text_idx, time_idx) arrays for each row's matrix, an array of rows."""

    def of(batches):
        for batch in batches:
            got = [warp(np.stack([np.asarray(r, dtype=float) for r in w])) if w is not None and len(w) else ([], []) for w in batch[weights]]
            yield pd.DataFrame({"key": batch[key], "text_idx": [g[0] for g in got], "time_idx": [g[1] for g in got]})

    return df.select(key, weights).mapInPandas(of, "key long, text_idx array<int>, time_idx array<int>")


def word_times(rows: list[int], columns: list[int], words: list[list[int]], logprobs: list[float], step: float = 0.02) -> list[tuple[int, float, float, float]]:
    """(word, start, end, probability) from a path and the token numbers of each word."""
    first = {}
    for r, c in zip(rows, columns, strict=True):
        first.setdefault(r, c)
    edge = [first[k] * step for k in sorted(first)] + [(columns[-1] + 1) * step if columns else 0.0]
    out, at = [], 0
    for k, word in enumerate(words):
        a, z = at, at + len(word)
        if word and z < len(edge):
            out.append((k, edge[a], edge[z], float(np.exp(np.mean(logprobs[a:z])))))
        at = z
    return out


def log_prob_faults(frame: Column, floor: float = -100.0, tolerance: float = 2e-2) -> Column:
    """Null for a row of log probabilities, else what is wrong with it."""

    def fault(x: Column, top: Column) -> Column:
        off = F.abs(top + F.ln(F.aggregate(x, F.lit(0.0), lambda s, v: s + F.exp(v - top))))
        return F.when(F.exists(x, lambda v: F.coalesce(F.isnan(v), F.lit(True))), "not a number").when(F.array_min(x) < floor, "below the floor").when(off > tolerance, "not normalised")

    return let(frame.cast("array<double>"), lambda x: let(F.array_max(x), lambda top: fault(x, top)))


def unknown_characters(text: Column) -> Column:
    """The characters of a transcript, in upper case, that the alignment classes lack."""
    return F.array_distinct(F.filter(F.split(F.replace(F.upper(text), F.lit(" "), F.lit("|")), ""), lambda c: (c != "") & ~c.rlike(r"[A-Z'|]")))


def forced(log_probs: np.ndarray, labels: list[int], blank: int = 0) -> list[tuple[int, int, float]] | None:
    """(first frame, end frame, mean log probability) of each label by Viterbi over the blank-extended labels.

    None where the frames are too few for the labels.
    """
    frames = len(log_probs)
    if not labels:
        return []
    states = np.array([blank, *[x for c in labels for x in (c, blank)]])
    n = len(states)
    skip = np.zeros(n, dtype=bool)
    skip[3::2] = states[3::2] != states[1:-2:2]
    score = np.full(n, -np.inf)
    score[0], score[1] = log_probs[0, blank], log_probs[0, states[1]]
    back = np.zeros((frames, n), dtype=np.int8)
    for t in range(1, frames):
        stay, step, jump = score, np.concatenate([[-np.inf], score[:-1]]), np.concatenate([[-np.inf] * 2, score[:-2]])
        jump = np.where(skip, jump, -np.inf)
        choice = np.argmax(np.stack([stay, step, jump]), axis=0)
        score = np.choose(choice, [stay, step, jump]) + log_probs[t, states]
        back[t] = choice
    s = n - 1 if score[n - 1] >= score[n - 2] else n - 2
    if not np.isfinite(score[s]):
        return None
    path = np.zeros(frames, dtype=np.int64)
    for t in range(frames - 1, -1, -1):
        path[t] = s
        s -= back[t, s]
    out = []
    for k in range(len(labels)):
        at = np.flatnonzero(path == 2 * k + 1)
        if not len(at):
            return None
        out.append((int(at[0]), int(at[-1]) + 1, float(log_probs[at, labels[k]].mean())))
    return out
