"""The corpus pipeline: documents through quality, line dedup, near-dedup, decontamination and packing.

Each stage takes (spark, docs, sf_dir), works on all rows of docs, and returns the columns of documents (the last
one: packed pieces). Nulls, empty tables, repeated rows and extra columns are handled as by the stage's operator.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, line_dedup, near_dedup, packing, quality
from tidemark.llm.common import P, written
from tidemark.llm.queries import tokenizer_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.accepted(docs, _table(spark, sf_dir, "labels"))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of equal or near lines the first stays; n_chars follows the text. A document all of whose
    lines stand elsewhere goes; one that had no lines stays."""
    done = line_dedup.line_dedup(docs, lines=f"{P}lines", gone=f"{P}gone")
    done = done.filter((F.col(f"{P}lines") == 0) | (F.col(f"{P}gone") < F.col(f"{P}lines")))
    if "n_chars" in docs.columns:
        changed = F.col(f"{P}gone") > 0
        done = done.withColumn("n_chars", F.when(changed, F.char_length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return done.select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates one document stays."""
    return near_dedup.deduplicate(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontaminate.decontaminate(docs, _table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, as pieces in sequences, with their ids."""
    return packing.pack(docs, tokenizer_path())


STAGES = [("quality", keep_quality), ("line_dedup", drop_lines), ("near_dedup", drop_near), ("decontaminate", drop_leaks), ("packing", pack)]

#: No SQL expresses the classifier; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents; each stage's result is written and read again."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
