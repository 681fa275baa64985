"""Whole queries: classify long signals, transcribe, embed and diarise, over plug-in models."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import models
from tidemark.functions import signal, vector
from tidemark.operators import aggregates, clustering, decoding, islands, ranking, segments, windows


def classify(df: DataFrame, by: list[str], samples: str, make: Callable[[], models.Scorer], k: int) -> DataFrame:
    """(by, rank, class, confidence) of one window of samples."""
    return ranking.top_classes(df.select(*by, models.scoring(make)(signal.gated(F.col(samples))).alias("logits")), by, "logits", k)


def classify_long(df: DataFrame, by: list[str], samples: str, plan: windows.Plan, make: Callable[[], models.Scorer], k: int, how: str = "mean") -> DataFrame:
    """(by, rank, class, confidence): windows, confidences, their mean or maximum, the best classes.

    Windows are counted before they are made; scores are added up class by class, so no window is kept.
    """
    cut = windows.spans(df.withColumn("__n", F.size(samples).cast("long")), "__n", plan)
    piece = signal.padded_or_cut(F.expr(f"slice(`{samples}`, cast(start as int) + 1, {plan.window})"), plan.window)
    scores = cut.select(*by, F.posexplode(models.scoring(make)(piece)).alias("class", "logit"))
    confidence = signal.sigmoid(F.col("logit").cast("double"))
    found = scores.groupBy(*by, "class").agg((F.avg(confidence) if how == "mean" else F.max(confidence)).alias("confidence"))
    return ranking.top_k(found, by, "confidence", "class", k).select(*by, "rank", "class", "confidence")


def rank_texts(queries: DataFrame, candidates: DataFrame, query: str, vector_col: str, label: str, anchor: str, k: int, scale: float | None = None) -> DataFrame:
    """(query, rank, label, score): the k labels nearest to each query."""
    both = ranking.scored(queries.select(query, vector_col), candidates.select(label, anchor), vector_col, anchor, scale)
    return ranking.top_k(both, [query], "score", label, k).select(query, "rank", label, "score")


def transcribe(clips: DataFrame, key: str, samples: str, frame: int, most: int, threshold: float, make: Callable[[], Callable[[np.ndarray], list[tuple[str, float, float]]]]) -> DataFrame:
    """(key, text, n_segments, srt, errors): chunks at silence, segments of each chunk, shifted, merged and numbered.

    make() gives a function of samples to segments (text, start, end) in seconds. A chunk that fails is left out
    and counted.
    """
    flat = clips.select(key, F.posexplode(samples).alias("pos", "v"))
    energies = islands.frames(flat, [key], "pos", "v", frame).select(key, "frame", (F.col("rms") > threshold).alias("active"))
    cut = islands.chunked(energies, [key], "frame", "active", frame, most)
    parts = cut.join(clips.select(key, F.col(samples).alias("__s")), key).select(key, "chunk", "start", F.expr("slice(__s, cast(start as int) + 1, greatest(cast(end - start as int), 0))").alias("__s"))

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        run = make()
        for batch in batches:
            rows = []
            for k, c, start, s in zip(batch[key], batch["chunk"], batch["start"], batch["__s"], strict=True):
                try:
                    rows += [(k, c, n, t, start / signal.SAMPLE_RATE + a, start / signal.SAMPLE_RATE + z, None) for n, (t, a, z) in enumerate(run(np.asarray(s)))]
                except Exception as e:  # noqa: BLE001  a failed chunk is a fact of the result
                    rows.append((k, c, 0, None, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["key", "chunk", "n", "text", "start", "end", "error"])

    kind = clips.schema[key].dataType.simpleString()
    got = parts.mapInPandas(of, f"key {kind}, chunk int, n int, text string, start double, end double, error string")
    errors = got.groupBy("key").agg(F.count("error").alias("errors"))
    kept = segments.positive(segments.not_blank(got.filter("error IS NULL"), "text"), "start", "end").withColumn("at", F.struct("chunk", "n"))
    texts = segments.merged(kept, ["key"], "at", "text").withColumnRenamed("n", "n_segments")
    srt = segments.cues(kept, ["key"], ["chunk", "n"], "start", "end", "text").withColumnRenamed("content", "srt")
    return errors.join(texts, "key", "left").join(srt, "key", "left").select("key", "text", F.coalesce("n_segments", F.lit(0)).alias("n_segments"), "srt", "errors")


def diarize(slots: DataFrame, by: list[str], join: float = clustering.JOIN, move: float = clustering.MOVE, frame_step: float = 0.016875) -> DataFrame:
    """(by, frame, clusters): who speaks when.

    slots: (by, chunk, slot, frames array<int>, embedding), the active output frames of each slot of each chunk.
    Slots are clustered in order; a frame's speakers are those with most slots there, as many as the rounded mean
    number of active slots.
    """
    order = F.col("chunk") * 100 + F.col("slot")
    named = slots.withColumn("at", order).withColumn("seconds", F.size("frames") * frame_step)
    usable = named.filter(vector.is_finite(F.col("embedding")) & (vector.norm(F.col("embedding")) > 1e-6))
    found = clustering.clustered(usable, by, "at", "embedding", "seconds", join, move).filter("cluster >= 0")
    flat = named.join(found, [*by, "at"]).select(*by, "chunk", "cluster", F.explode("frames").alias("frame"))
    votes = flat.groupBy(*by, "frame", "cluster").agg(F.count("*").alias("n"))
    chunks = flat.groupBy(*by, "frame").agg(F.rint(F.count("*") / F.count_distinct("chunk")).cast("int").alias("speakers"))
    ranked = ranking.top_k(votes, [*by, "frame"], "n", "cluster", 255).join(chunks, [*by, "frame"]).filter("rank <= speakers")
    return ranked.groupBy(*by, "frame").agg(F.array_sort(F.collect_list("cluster")).alias("clusters"))


def overlap_of(a: DataFrame, b: DataFrame, by: list[str], step: float = 0.01) -> DataFrame:
    """(by, both, either, iou, ratio, disagreement) of two sets of intervals (by, start, end), on a grid of frames."""

    def frames(df: DataFrame) -> DataFrame:
        first, last = F.ceil(F.col("start") / step - 0.5).cast("long"), (F.ceil(F.col("end") / step - 0.5) - 1).cast("long")
        return df.filter("end > start").filter(last >= first).select(*by, F.explode(F.sequence(first, last)).alias("__f")).distinct()

    both = frames(a).withColumn("__x", F.lit(1)).join(frames(b).withColumn("__y", F.lit(1)), [*by, "__f"], "full")
    told = both.groupBy(*by).agg(F.count_if(F.col("__x").isNotNull() & F.col("__y").isNotNull()).alias("both"), F.count("*").alias("either"), F.count("__x").alias("__a"), F.count("__y").alias("__b"))
    return told.select(*by, "both", "either", F.try_divide("both", "either").alias("iou"), F.try_divide("__b", "__a").alias("ratio"), F.try_divide(F.col("either") - F.col("both"), "either").alias("disagreement"))


def accepted_attempts(attempts: DataFrame, by: list[str], rules: decoding.Acceptance) -> DataFrame:
    """(by, attempt, temperature, reason) of attempts (by, attempt, temperature, first, no_speech, compression, average)."""
    reason = rules.reason(F.col("first"), F.col("no_speech"), F.col("compression"), F.col("average"))
    return decoding.first_accepted(attempts.withColumn("reason", reason), by, "attempt", "reason", ["attempt", "temperature", "reason"])


def best_of(df: DataFrame, by: list[str], vectors: str, weight: str) -> DataFrame:
    """(by, embedding): window vectors averaged by coverage."""
    return aggregates.pooled(df, by, vectors, weight=F.col(weight))
