"""Options and fixed tables."""

from __future__ import annotations

from dataclasses import asdict, dataclass
from enum import StrEnum

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Task(StrEnum):
    TRANSCRIBE = "transcribe"
    TRANSLATE = "translate"


class Chunking(StrEnum):
    NONE = "none"
    VAD = "vad"


class Grouping(StrEnum):
    WORD = "word"
    FINE = "fine_grained"


class Backend(StrEnum):
    OFFLINE = "offline"
    ONLINE = "online"


@dataclass(frozen=True)
class DecodingOptions:
    task: Task = Task.TRANSCRIBE
    language: str | None = None
    temperature: float = 0.0
    temperature_step: float = 0.2
    retries: int = 5
    sample_length: int = 224
    top_k: int = 5
    compression: float | None = 2.4
    average: float | None = -1.0
    first_token: float | None = -1.5
    no_speech: float | None = 0.6
    without_times: bool = False
    word_times: bool = False
    first_time_limit: float | None = 1.0
    chunking: Chunking = Chunking.NONE
    workers: int = 16
    seed: int = 0

    def __post_init__(self):
        if not 0 <= self.temperature <= 1 or self.retries < 0 or self.sample_length < 1 or self.top_k < 1 or self.workers < 1:
            raise ValueError(f"bad options: {asdict(self)}")


#: Model variants by vocabulary size and encoder width.
VARIANTS = {(51865, 384): "tiny", (51864, 384): "tiny.en", (51865, 512): "base", (51864, 512): "base.en", (51865, 768): "small", (51864, 768): "small.en", (51865, 1024): "medium", (51864, 1024): "medium.en", (51865, 1280): "large", (51866, 1280): "large-v3"}


def variant(vocabulary: Column, width: Column) -> Column:
    out = F.when(F.lit(False), "")
    for (v, w), name in VARIANTS.items():
        out = out.when((vocabulary == v) & (width == w), name)
    return out


def support_table(spark: SparkSession, payload: str) -> DataFrame:
    """(prefix, ord, model_default, supported) of a support configuration in JSON."""
    schema = "struct<device_support:array<struct<chips:string,identifiers:array<string>,models:struct<`default`:string,supported:array<string>>>>>"
    rows = spark.createDataFrame([(payload,)], "j string").select(F.posexplode(F.from_json("j", schema)["device_support"]).alias("ord", "d"))
    return rows.select(F.explode("d.identifiers").alias("prefix"), "ord", F.col("d.models.default").alias("model_default"), F.col("d.models.supported").alias("supported"))
