"""Token decoding: prompts, logit filters, sampling, acceptance rules and the retry ladder."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.islands import argmax

NEVER = float("-inf")
#: How much of a prompt and of a prefix is kept.
PROMPT, PREFIX = 111, 112

LogitsFilter = Callable[[Column, Column], Column]


def prefill(sot: int, previous: int, specials_from: int, prompt: Column, prefix: Column, language: Column, task: Column, no_times: int | None = None) -> Column:
    """[previous, tail of the prompt] start, language, task, [mark], tail of the prefix; special ids in either go."""
    plain = lambda a, n: F.filter(F.slice(a, F.greatest(F.size(a) - n, F.lit(0)) + 1, F.lit(n)), lambda x: x < specials_from)
    none = F.array().cast("array<int>")
    head = F.when(F.size(prompt) > 0, F.concat(F.array(F.lit(previous)), plain(prompt, PROMPT))).otherwise(none)
    parts = [head, F.array(F.lit(sot), language.cast("int"), task.cast("int"))]
    if no_times is not None:
        parts.append(F.array(F.lit(no_times)))
    return F.concat(*parts, F.coalesce(plain(prefix, PREFIX), none))


def suppressed(logits: Column, ids: list[int]) -> Column:
    """logits with minus infinity at the ids."""
    return F.transform(logits.cast("array<double>"), lambda x, i: F.when(i.isin(*ids), NEVER).otherwise(x)) if ids else logits.cast("array<double>")


def suppress_tokens(ids: list[int]) -> LogitsFilter:
    return lambda logits, tokens: suppressed(logits, ids)


def suppress_blank(blank: list[int], end: int, begin: int) -> LogitsFilter:
    """At the first sampled place, neither blank nor end."""
    return lambda logits, tokens: F.when(F.size(tokens) == begin, suppressed(logits, [*blank, end])).otherwise(logits.cast("array<double>"))


def only_ids(ids: list[int]) -> LogitsFilter:
    """Nothing but the ids, as for a language."""
    return lambda logits, tokens: F.transform(logits.cast("array<double>"), lambda x, i: F.when(i.isin(*ids), x).otherwise(NEVER))


@dataclass(frozen=True)
class TimeRules:
    """Where time marks may stand: ids from `first` on are marks, ids below `text_end` text, `end` ends.

    Marks come in pairs and never run back; and where the marks together are likelier than any text, a mark is taken.
    That last comparison is made in 16-bit floats. The first place need not be a mark.
    """

    first: int
    end: int
    no_times: int
    begin: int

    def apply(self, logits: np.ndarray, tokens: list[int]) -> np.ndarray:
        x = np.array(logits, dtype=np.float64)
        x[self.no_times] = NEVER
        sampled = tokens[self.begin :]
        if sampled and sampled[-1] >= self.first:
            if len(sampled) < 2 or sampled[-2] >= self.first:
                x[self.first :] = NEVER
            else:
                x[: self.end] = NEVER
        marks = [t for t in sampled if t >= self.first]
        if marks:
            paired = sampled[-1] >= self.first and not (len(sampled) < 2 or sampled[-2] >= self.first)
            x[self.first : marks[-1] + (0 if paired else 1)] = NEVER
        if mass_exceeds(x, self.first):
            x[: self.first] = NEVER
        return x


def mass_exceeds(logits: np.ndarray, first: int) -> bool:
    """Whether the marks' summed probability passes the likeliest text id's, in 16-bit floats. The sum is of plain
    probabilities: marks too unlikely for a 32-bit float have none."""
    x = np.asarray(logits, dtype=np.float32)
    top = x.max(initial=np.float32(NEVER))
    if not np.isfinite(top):
        return False
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        log_p = (x - top - np.log(np.exp(x - top).sum(dtype=np.float32))).astype(np.float16)
        mass = np.log(np.exp(log_p[first:].astype(np.float32)).sum(dtype=np.float32)).astype(np.float16)
    return bool(mass > log_p[:first].max(initial=np.float16(NEVER)))


def greedy(logits: Column) -> Column:
    """(token, logprob) of the likeliest id; NaN is skipped."""
    x = F.transform(logits.cast("array<double>"), lambda v: F.when(v.isNull() | F.isnan(v), NEVER).otherwise(v))
    top = F.array_max(x)
    total = F.aggregate(x, F.lit(0.0), lambda s, v: s + F.when(v == NEVER, 0.0).otherwise(F.exp(v - top)))
    return F.struct(argmax(logits).alias("token"), F.when(top == NEVER, F.lit(NEVER)).otherwise(-F.ln(total)).alias("logprob"))


_MASK = (1 << 64) - 1


def splitmix64(x: int) -> int:
    x = (x + 0x9E3779B97F4A7C15) & _MASK
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & _MASK
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & _MASK
    return x ^ (x >> 31)


def attempt_seed(seed: int, *parts: int) -> int:
    """A seed of its own for each chain of parts."""
    for part in parts:
        seed = splitmix64(seed ^ part)
    return seed


def sample(logits: np.ndarray, temperature: float, top_k: int, seed: int) -> tuple[int, float]:
    """(token, logprob): a draw among the top_k of softmax(logits / temperature); the likeliest at temperature 0."""
    x = np.where(np.isnan(logits), NEVER, np.asarray(logits, dtype=np.float64))
    top = x.max()
    if not np.isfinite(top):
        return int(np.argmax(x)), NEVER
    log_p = x - top - math.log(np.exp(x - top).sum())
    if temperature <= 0:
        k = int(np.argmax(x))
        return k, float(log_p[k])
    best = np.lexsort((np.arange(len(x)), -x))[:top_k]
    p = np.exp((x[best] - top) / temperature)
    at = int(np.searchsorted(np.cumsum(p), splitmix64(seed) / 2**64 * p.sum(), side="right"))
    k = int(best[min(at, len(best) - 1)])
    return k, float(log_p[k])


def finished(tokens: Column, logprobs: Column, end: int) -> tuple[Column, Column]:
    """tokens and logprobs with the end, of logprob 0, if it is missing."""
    missing = F.coalesce(F.element_at(tokens, -1) != end, F.lit(True))
    return F.when(missing, F.concat(tokens, F.array(F.lit(end)))).otherwise(tokens), F.when(missing, F.concat(logprobs, F.array(F.lit(0.0)))).otherwise(logprobs)


def between(tokens: Column, start: int, end: int) -> Column:
    """The tokens from the start id up to the end id."""
    a = F.greatest(F.array_position(tokens, start), F.lit(1)).cast("int")
    z = F.array_position(tokens, end).cast("int")
    return F.slice(tokens, a, F.greatest(F.when(z > 0, z).otherwise(F.size(tokens) + 1) - a, F.lit(0)))


def average(logprobs: Column) -> Column:
    return F.when(F.size(logprobs) > 0, F.aggregate(logprobs.cast("array<double>"), F.lit(0.0), lambda s, x: s + x) / F.size(logprobs))


@dataclass(frozen=True)
class Acceptance:
    """A null threshold switches its rule off."""

    first_token: float | None = -1.5
    no_speech: float | None = 0.6
    compression: float | None = 2.4
    average: float | None = -1.0

    def reason(self, first: Column, no_speech: Column, compression: Column, average: Column) -> Column:
        """Why an attempt is tried again; null where it is accepted. The rules apply in this order."""
        rules = F.when(F.lit(False), F.lit(""))
        if self.first_token is not None:
            rules = rules.when(first < self.first_token, "first_token")
        if self.no_speech is not None:
            rules = rules.when(no_speech > self.no_speech, F.lit(None).cast("string"))
        if self.compression is not None:
            rules = rules.when(compression > self.compression, "compression")
        if self.average is not None:
            rules = rules.when(average < self.average, "average")
        return rules


def temperatures(start: float = 0.0, step: float = 0.2, count: int = 5) -> list[float]:
    return [round(start + step * k, 10) for k in range(count + 1)]


def first_accepted(attempts: DataFrame, by: list[str], attempt: str, reason: str, keep: list[str]) -> DataFrame:
    """(by, keep): of each group the first attempt without a reason to go on, else the last."""
    order = F.when(F.col(reason).isNull(), F.col(attempt)).otherwise(F.lit(1 << 30) - F.col(attempt))
    best = F.min_by(F.struct(*keep), order)
    return attempts.groupBy(*by).agg(best.alias("__b")).select(*by, "__b.*")


def stops_early(ratio: Column, average: Column, compression: float | None, least: float | None) -> Column:
    """Whether decoding should end: a missing compression threshold counts as 0 here, a missing average as none."""
    stop = ratio > (compression or 0.0)
    return stop if least is None else stop | (average < least)


def sampled_from(tokens: Column, task_ids: list[int], multilingual: bool = True) -> Column:
    """The place after the task id, if it is among the first three; else after the first."""
    head = F.slice(tokens, 1, 3)
    at = F.greatest(*[F.array_position(head, t) for t in task_ids], F.lit(0)) if len(task_ids) else F.lit(0)
    return F.when(at > 0, at).otherwise(1).cast("int") if multilingual else F.lit(1)


@dataclass
class Decoder:
    """A token loop over a step function (tokens -> logits), one window at a time; for grouped Arrow functions."""

    step: Callable[[list[int]], np.ndarray]
    end: int
    most: int = 223
    rules: TimeRules | None = None
    suppress: list[int] = field(default_factory=list)
    top_k: int = 5

    def run(self, prompt: list[int], temperature: float = 0.0, seed: int = 0) -> tuple[list[int], list[float]]:
        tokens, logprobs = list(prompt), []
        for turn in range(self.most):
            logits = np.array(self.step(tokens), dtype=np.float64)
            logits[self.suppress] = NEVER
            if self.rules:
                logits = self.rules.apply(logits, tokens)
            token, logprob = sample(logits, temperature, self.top_k, attempt_seed(seed, turn))
            tokens.append(token)
            logprobs.append(logprob)
            if token == self.end:
                break
        return tokens[len(prompt) :], logprobs


def decoded(windows: DataFrame, key: str, prompt: str, make: Callable[[], Decoder], ladder: list[float], accept: Callable[[list[int], list[float]], bool], seed: int = 0) -> DataFrame:
    """(key, tokens, avg_logprob, temperature): each window down the ladder until an attempt is accepted."""

    def of(batches):
        decoder = make()
        for batch in batches:
            rows = []
            for k, p in zip(batch[key], batch[prompt], strict=True):
                for n, t in enumerate(ladder):
                    tokens, logprobs = decoder.run(list(p), t, attempt_seed(seed, int(k), n))
                    if accept(tokens, logprobs):
                        break
                rows.append((k, tokens, float(np.mean(logprobs)) if logprobs else 0.0, t))
            yield pd.DataFrame(rows, columns=["key", "tokens", "avg_logprob", "temperature"])

    return windows.select(F.col(key), F.col(prompt)).mapInPandas(of, "key long, tokens array<int>, avg_logprob double, temperature double")
