"""Caption, JSON and diarisation files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def write_texts(contents: DataFrame, name: str, content: str, path: str, extension: str) -> None:
    """Each row's content, which ends with a line end, as one text file in <path>/file=<name>.<extension>.

    Spark's committer makes the folder whole or not at all.
    """
    body = F.regexp_replace(content, r"\n\z", "")
    contents.select(F.concat(F.col(name).cast("string"), F.lit(f".{extension}")).alias("file"), body.alias("value")).write.mode("overwrite").partitionBy("file").text(path)


def write_json(results: DataFrame, path: str) -> None:
    results.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in results.columns]), {"pretty": "true"}).alias("value")).write.mode("overwrite").option("lineSep", "\n").text(path)


def read_rttm(spark: SparkSession, path: str) -> DataFrame:
    """(file, start, end, label, spk) of SPEAKER lines; spk is dense by first start in its file. Short lines are skipped."""
    rows = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("f"))
    rows = rows.filter((F.size("f") >= 8) & (F.get("f", F.lit(0)) == "SPEAKER"))
    rows = rows.select(F.get("f", F.lit(1)).alias("file"), F.get("f", F.lit(3)).cast("double").alias("start"), F.get("f", F.lit(4)).cast("double").alias("duration"), F.get("f", F.lit(7)).alias("label"))
    rows = rows.select("file", "start", (F.col("start") + F.col("duration")).alias("end"), "label")
    first = rows.groupBy("file", "label").agg(F.min("start").alias("__first"))
    first = first.withColumn("spk", F.row_number().over(Window.partitionBy("file").orderBy("__first", "label")) - 1)
    return rows.join(first.drop("__first"), ["file", "label"]).select("file", "start", "end", "label", "spk")


def find_named(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """(path, length) of the files below a folder whose name matches; contents aren't read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path).select("path", "length")
