"""Text chunks of a token budget that partition the text, at paragraphs, sentences or words."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUDGET = 512
#: From coarse to fine: where a text may be cut.
LEVELS = [re.compile(r"(?:\r?\n){2,}"), re.compile(r"\n"), re.compile(r"(?<=[.!?])\s+"), re.compile(r"\s+")]


def by_words(text: str) -> int:
    """A stand-in for a tokenizer: words and marks."""
    return len(re.findall(r"\w+|[^\w\s]", text))


def pieces(text: str, budget: int, measure: Callable[[str], int], level: int = 0) -> Iterator[str]:
    """Parts of at most `budget` tokens, in order; together they are the text."""
    if not text:
        return
    if measure(text) <= budget:
        yield text
        return
    if level == len(LEVELS):
        middle = len(text) // 2
        if not middle:
            yield text
            return
        yield from pieces(text[:middle], budget, measure, level)
        yield from pieces(text[middle:], budget, measure, level)
        return
    at = 0
    for m in LEVELS[level].finditer(text):
        if m.end() < len(text):
            yield from pieces(text[at : m.end()], budget, measure, level + 1)
            at = m.end()
    yield from pieces(text[at:], budget, measure, level + 1)


def chunks(text: str, budget: int = BUDGET, measure: Callable[[str], int] = by_words, most: int | None = None) -> list[str]:
    """Greedily as many pieces in a chunk as its budget holds. More than `most` chunks are an error.

    Token counts of pieces are added while a chunk grows, and the whole is measured again before a piece joins.
    """
    out: list[str] = []
    held, n = "", 0
    for piece in pieces(text, budget, measure):
        k = measure(piece)
        if held and (n + k > budget and measure(held + piece) > budget):
            out.append(held)
            held, n = "", 0
        held, n = held + piece, n + k
    if held:
        out.append(held)
    if most is not None and len(out) > most:
        raise ValueError(f"{len(out)} chunks; {most} are allowed")
    return out


def chunked(df: DataFrame, key: str, text: str, budget: int = BUDGET, measure: Callable[[str], int] = by_words) -> DataFrame:
    """(key, chunk, start, n_tokens, text): start in characters; a null or empty text has no chunk."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for k, t in zip(batch["key"], batch["text"], strict=True):
                at = 0
                for n, c in enumerate(chunks(t or "", budget, measure)):
                    rows.append((k, n, at, measure(c), c))
                    at += len(c)
            yield pd.DataFrame(rows, columns=["key", "chunk", "start", "n_tokens", "text"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInPandas(of, f"key {kind}, chunk int, start long, n_tokens int, text string").withColumnRenamed("key", key)


def padded_window(ids: Column, length: int = BUDGET, pad: int = 0, left: bool = False) -> tuple[Column, Column]:
    """(ids, mask) of `length`; raises for a longer list."""
    room = F.lit(length) - F.size(ids)
    fill, ones = F.array_repeat(F.lit(pad), F.greatest(room, F.lit(0))), F.transform(ids, lambda _: F.lit(1))
    zeros = F.array_repeat(F.lit(0), F.greatest(room, F.lit(0)))
    whole, mask = (F.concat(fill, ids), F.concat(zeros, ones)) if left else (F.concat(ids, fill), F.concat(ones, zeros))
    return F.when(room < 0, F.raise_error(F.lit("too many tokens")).cast("array<int>")).otherwise(whole), mask


def admitted(text: Column, most_bytes: int) -> Column:
    return F.octet_length(text) <= most_bytes
