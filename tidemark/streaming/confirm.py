"""Confirmation of growing transcripts: all segments but the last, or words that successive hypotheses agree on.

Each has a batch form in window functions and a streaming form with keyed state. The state of a key is what is
not confirmed yet; a time to live ends keys that fall silent.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState
from pyspark.sql.window import Window

from tidemark.streaming.state import ends, keep

#: Segments that stay open, hypotheses that must agree.
OPEN, AGREE = 2, 2


def confirmed(df: DataFrame, by: list[str], order: list[str], keep_open: int = OPEN) -> DataFrame:
    """df with `confirmed`: false for the last `keep_open` rows of a group."""
    left = F.row_number().over(Window.partitionBy(*by).orderBy(*[F.desc(c) for c in order]))
    return df.withColumn("confirmed", left > keep_open)


def confirm_stream(df: DataFrame, key: str, at: str, text: str, keep_open: int = OPEN, ttl_ms: int | None = 3_600_000) -> DataFrame:
    """(key, at, text): segments once `keep_open` later ones of their key have come; the rest when the key expires.

    A segment that comes again at the same place replaces the open one; one before the confirmed mark is late and
    dropped.
    """

    def of(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        mark, ats, texts = state.get if state.exists else (float("-inf"), [], [])
        rows = dict(zip(ats, texts, strict=True))
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([(k[0], a, rows[a]) for a in sorted(rows)], columns=["key", "at", "text"])
            return
        for batch in batches:
            for a, t in zip(batch[at], batch[text], strict=True):
                if a > mark:
                    rows[float(a)] = t
        order = sorted(rows)
        done, left = (order[:-keep_open], order[-keep_open:]) if keep_open else (order, [])
        state.update((done[-1] if done else mark, left, [rows[a] for a in left]))
        keep(state, ttl_ms)
        yield pd.DataFrame([(k[0], a, rows[a]) for a in done], columns=["key", "at", "text"])

    kind = df.schema[key].dataType.simpleString()
    rows = df.select(key, F.col(at).cast("double").alias(at), text)
    return rows.groupBy(key).applyInPandasWithState(of, f"key {kind}, at double, text string", "mark double, ats array<double>, texts array<string>", "append", ends(ttl_ms))


def same_word(a: str, b: str) -> bool:
    clean = lambda w: " ".join(re.sub(r"[^\w\s]", "", w.lower().replace("-", " ")).split())
    return clean(a) == clean(b)


def shared_prefix(hypotheses: list[list[str]]) -> int:
    n = 0
    for words in zip(*hypotheses, strict=False):
        if not all(same_word(words[0], w) for w in words[1:]):
            break
        n += 1
    return n


class Agreement:
    """Words are confirmed once `agree` successive hypotheses share them, all but the last `agree` of those words.

    A hypothesis is a list of (word, start); only words from the mark on count. The mark is where the words that
    agree, but are not confirmed, begin.
    """

    def __init__(self, agree: int = AGREE):
        self.agree, self.mark, self.history, self.done, self.tail = agree, 0.0, [], [], []

    def push(self, words: list[tuple[str, float]]) -> list[tuple[str, float]]:
        fresh = [w for w in words if w[1] >= self.mark]
        # Words at the mark that were confirmed already come again.
        while self.done and fresh and fresh[0][1] <= self.done[-1][1] and any(same_word(fresh[0][0], d[0]) and d[1] >= fresh[0][1] for d in self.done):
            fresh.pop(0)
        self.history = [*self.history, fresh][-self.agree :]
        if len(self.history) < self.agree:
            return []
        n = shared_prefix([[w for w, _ in h] for h in self.history])
        new = fresh[: max(0, n - self.agree)]
        self.tail = fresh[len(new) : n]
        if new:
            self.done += new
            self.mark = self.tail[0][1] if self.tail else self.mark
            self.history = [[w for w in h[len(new) :]] for h in self.history]
        return new

    def finish(self) -> list[tuple[str, float]]:
        """What is left at the end: all of the last hypothesis that isn't confirmed."""
        return list(self.history[-1]) if self.history else []


def agreed(df: DataFrame, key: str, order: str, words: str, agree: int = AGREE) -> DataFrame:
    """(key, n, word, start, confirmed) of hypotheses in order; words: array of (word, start)."""

    def of(k: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        a = Agreement(agree)
        for h in rows.sort_values(order)[words]:
            a.push([(w["word"], float(w["start"])) for w in h])
        out = [(w, s, True) for w, s in a.done] + [(w, s, False) for w, s in a.finish()]
        return pd.DataFrame([(k[0], n, *x) for n, x in enumerate(out)], columns=["key", "n", "word", "start", "confirmed"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, order, words).groupBy(key).applyInPandas(of, f"key {kind}, n int, word string, start double, confirmed boolean")


def agree_stream(df: DataFrame, key: str, order: str, words: str, agree: int = AGREE, ttl_ms: int | None = 3_600_000) -> DataFrame:
    """(key, word, start): words as they are confirmed; what is left when the key expires."""
    import json

    def of(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        a: Any = Agreement(agree)
        if state.exists:
            a.mark, a.history, a.done = json.loads(state.get[0])
        out: list = []
        if state.hasTimedOut:
            state.remove()
            out = a.finish()
        else:
            rows = pd.concat(list(batches)).sort_values(order)
            for h in rows[words]:
                out += a.push([(w["word"], float(w["start"])) for w in h])
            # Of the confirmed words, those at the mark are all that later ones are held against.
            state.update((json.dumps([a.mark, a.history, [d for d in a.done if d[1] >= a.mark] or a.done[-1:]]),))
            keep(state, ttl_ms)
        yield pd.DataFrame([(k[0], w, s) for w, s in out], columns=["key", "word", "start"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, order, words).groupBy(key).applyInPandasWithState(of, f"key {kind}, word string, start double", "state string", "append", ends(ttl_ms))


def contains_run(have: list, run: list) -> bool:
    """Whether the run is in the list, without gaps."""
    return any(have[k : k + len(run)] == run for k in range(len(have) - len(run) + 1))
