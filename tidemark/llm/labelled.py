"""Labelled documents for the classifiers: which rows train; all of them, or a bounded sample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Of FOLDS remainders of a key's checksum, remainder 0 is held out.
FOLDS = 5


def held_out(key: Column) -> Column:
    """Whether crc32 of the key as text leaves 0; a null key is never learned from, and counts as held out."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % FOLDS == 0, F.lit(True))


def told(docs: DataFrame, labels: DataFrame, label: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(label, text) of all documents that have a label 0 or 1 and are not held out.

    A key with several labels counts by its largest; of rows that repeat a key, the one with the least text counts.
    Texts of documents that are not held out are shuffled, unless the ids are few.
    """
    return _least(_rows(docs, text, key), _ids(labels, label, key))


def sampled(docs: DataFrame, labels: DataFrame, label: str, most: int, text: str = "text", key: str = "doc_id") -> DataFrame:
    """As told(), of at most `most` documents: of more, those with the smallest key hashes. The ids broadcast are at
    most `most`."""
    return _least(_rows(docs, text, key), F.broadcast(_ids(labels, label, key).orderBy(F.xxhash64("k"), "k").limit(most)))


def _ids(labels: DataFrame, label: str, key: str) -> DataFrame:
    ids = labels.select(F.col(key).alias("k"), F.col(label).cast("int").alias("label")).filter(F.col("label").isin(0, 1) & ~held_out(F.col("k")))
    return ids.groupBy("k").agg(F.max("label").alias("label"))


def _rows(docs: DataFrame, text: str, key: str) -> DataFrame:
    return docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("text")).filter(~held_out(F.col("k")))


def _least(rows: DataFrame, ids: DataFrame) -> DataFrame:
    return rows.join(ids, "k").groupBy("k", "label").agg(F.min("text").alias("text")).select("label", "text")
