"""Tokens: special ids, tokenizer checks and grouping into words."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Languages written without spaces between words.
UNSPACED = ("zh", "ja", "th", "lo", "my", "yue")


def special_ids(wanted: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(token, id) of wanted (token, default): the vocabulary's id, else the default."""
    return wanted.join(vocabulary.select("token", "id"), "token", "left").select("token", F.coalesce("id", "default").alias("id"))


def vocabulary_faults(vocabulary: DataFrame, size: int, specials: dict[str, int]) -> DataFrame:
    """(fault): what a vocabulary (token, id) breaks of its contract; no row if it holds."""
    spark = vocabulary.sparkSession
    told = vocabulary.agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids"), F.max("id").alias("most"), F.min("id").alias("least"))
    rules = {
        "size": F.col("n") != size,
        "repeated id": F.col("ids") != F.col("n"),
        "id out of range": (F.col("most") >= 2**31) | (F.col("least") < 0),
    }
    one = told.select(F.explode(F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(True)), F.lit(k)) for k, c in rules.items()]))).alias("fault"))
    wanted = spark.createDataFrame(list(specials.items()) or [("", 0)], "token string, want int").filter(F.lit(bool(specials)))
    off = wanted.join(vocabulary, "token", "left").filter(F.coalesce(F.col("id") != F.col("want"), F.lit(True)))
    return one.unionByName(off.select(F.concat(F.lit("special id of "), "token").alias("fault")))


def whole_characters(pieces: list[bytes]) -> list[list[int]]:
    """Token numbers grouped so that each group's bytes are whole UTF-8 characters."""
    groups: list[list[int]] = []
    own: list[int] = []
    held = b""
    for k, piece in enumerate(pieces):
        own.append(k)
        held += piece
        try:
            held.decode("utf-8")
        except UnicodeDecodeError:
            continue
        groups.append(own)
        own, held = [], b""
    return [*groups, own] if own else groups


def spaced_words(tokens: DataFrame, by: list[str], at: str, text: str, special: str | None = None) -> DataFrame:
    """(by, word_at, word, first, last): a word starts at a special token, a leading space or a lone mark."""
    w = Window.partitionBy(*by).orderBy(at)
    t = F.col(text)
    starts = t.startswith(" ") | F.trim(t).rlike(r"^\p{P}$")
    if special:
        starts = starts | F.col(special)
    rows = tokens.withColumn("__s", starts).withColumn("word_at", F.sum(F.col("__s").cast("int")).over(w))
    parts = F.transform(F.array_sort(F.collect_list(F.struct(F.col(at).alias("a"), t.alias("t")))), lambda x: x["t"])
    return rows.groupBy(*by, "word_at").agg(F.array_join(parts, "").alias("word"), F.min(at).alias("first"), F.max(at).alias("last"))


def words_of(df: DataFrame, key: str, ids: str, language: str, decode: Callable[[], Callable[[int], bytes]]) -> DataFrame:
    """(key, word, tokens): ids grouped into words, by characters in unspaced languages, else by spaces."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bytes_of = decode()
        for batch in batches:
            rows = []
            for k, own, lang in zip(batch[key], batch[ids], batch[language], strict=True):
                raw = [bytes_of(int(t)) for t in own]
                groups = whole_characters(raw)
                texts = [b"".join(raw[x] for x in g).decode("utf-8", "replace") for g in groups]
                if lang not in UNSPACED:
                    merged: list[list[int]] = []
                    for g, t in zip(groups, texts, strict=True):
                        lone = len(t.strip()) == 1 and not t.strip().isalnum()
                        if merged and not t.startswith(" ") and not lone:
                            merged[-1] = merged[-1] + g
                        else:
                            merged.append(g)
                    groups = merged
                rows += [(k, b"".join(raw[x] for x in g).decode("utf-8", "replace"), [int(own[x]) for x in g]) for g in groups]
            yield pd.DataFrame(rows, columns=["key", "word", "tokens"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, ids, language).mapInPandas(of, f"key {kind}, word string, tokens array<int>")


def known_language(token: Column, first: int, codes: list[str]) -> Column:
    """The code of a language id; null for any other id."""
    return F.when((token >= first) & (token < first + len(codes)), F.get(F.array(*[F.lit(c) for c in codes]), (token - first).cast("int")))


@dataclass(frozen=True)
class TimeMark:
    """Time marks are the ids from `first` on, `step` seconds apart."""

    first: int
    step: float = 0.02

    def seconds(self, token: Column) -> Column:
        return F.when(token >= self.first, (token - self.first) * self.step)

    def token(self, seconds: Column) -> Column:
        return (F.round(seconds / self.step) + self.first).cast("int")
