"""Activity, runs of it, and splitting at silence."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import signal


def frames(samples: DataFrame, by: list[str], pos: str, value: str, length: int, overlap: int = 0) -> DataFrame:
    """(by, frame, n, rms): frames of `length` elements, each with up to `overlap` elements of the next one."""
    own = F.floor(F.col(pos) / length)
    at = F.array(own)
    if overlap:
        at = F.when((own > 0) & (F.col(pos) % length < overlap), F.array(own - 1, own)).otherwise(at)
    rows = samples.select(*by, F.explode(at).alias("frame"), F.col(value).cast("double").alias("v"))
    return rows.groupBy(*by, "frame").agg(F.count("*").alias("n"), signal.rms_of(F.col("v")).alias("rms"))


def runs(df: DataFrame, by: list[str], at: str, flag: str) -> DataFrame:
    """(by, active, start, end): the runs of equal flags over consecutive frames, end excluded."""
    w = Window.partitionBy(*by).orderBy(at)
    change = F.when(F.lag(flag).over(w) == F.col(flag), 0).otherwise(1)
    marked = df.withColumn("__change", change).withColumn("__run", F.sum("__change").over(w))
    return marked.groupBy(*by, "__run").agg(F.first(flag).alias("active"), F.min(at).alias("start"), (F.max(at) + 1).alias("end")).drop("__run")


def longest_run(found: DataFrame, by: list[str], active: bool = False) -> DataFrame:
    """(by, start, end) of the longest run of a kind; of equals, the first."""
    best = F.max_by(F.struct("start", "end"), F.struct(F.col("end") - F.col("start"), -F.col("start")))
    return found.filter(F.col("active") == active).groupBy(*by).agg(best.alias("r")).select(*by, "r.start", "r.end")


def relative_to_trailing_min(energies: DataFrame, by: list[str], at: str, energy: str, back: int = 20) -> DataFrame:
    """energies with `relative`: against the least of the previous `back` frames; the first frame has 0."""
    least = F.min(energy).over(Window.partitionBy(*by).orderBy(at).rowsBetween(-back, -1))
    return energies.withColumn("relative", F.when(least.isNull(), 0.0).otherwise(signal.relative_energy(F.col(energy), least)))


def recently_active(energies: DataFrame, by: list[str], at: str, energy: str, last: int, threshold: float, least: int = 10) -> DataFrame:
    """(by, active): of the last `last` frames, whether one of all but the newest `least` is over the threshold;
    with fewer frames, the oldest `least` count."""
    newest = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(at)))
    recent = energies.withColumn("__r", newest).filter(F.col("__r") <= last).withColumn("__n", F.count("*").over(Window.partitionBy(*by)))
    oldest = F.col("__n") - F.col("__r") < F.greatest(F.lit(least), F.col("__n") - least)
    return recent.groupBy(*by).agg(F.coalesce(F.bool_or(oldest & (F.col(energy) > threshold)), F.lit(False)).alias("active"))


def _segments(prob: np.ndarray, frame: int, start: float, end: float, speech: int, silence: int, pad: int) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    opened = quiet = None
    for k, p in enumerate(prob):
        at = k * frame
        if p >= start:
            opened, quiet = (at if opened is None else opened), None
        elif p < end and opened is not None:
            quiet = at if quiet is None else quiet
            if at - quiet >= silence:
                if quiet - opened >= speech:
                    out.append((opened, quiet))
                opened = quiet = None
    total = len(prob) * frame
    if opened is not None and total - opened >= speech:
        out.append((opened, total))
    padded = []
    for k, (a, b) in enumerate(out):
        left = max(0, a - pad) if k == 0 else max(a - pad, (out[k - 1][1] + a) // 2)
        right = min(total, b + pad) if k + 1 == len(out) else min(b + pad, (b + out[k + 1][0]) // 2)
        padded.append((left, right))
    return padded


def hysteresis(probabilities: DataFrame, by: list[str], at: str, prob: str, frame: int = 4096, start: float = 0.5, end: float = 0.35, speech: int = 4000, silence: int = 1600, pad: int = 480) -> DataFrame:
    """(by, start, end) in samples: speech opens at `start`, closes once it is below `end` for `silence` samples.

    Each recording is one ordered recurrence, so it is one group; recordings run in parallel.
    """
    schema = ", ".join(f"`{c}` {probabilities.schema[c].dataType.simpleString()}" for c in by) + ", start long, end long"

    def of(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        p = rows.sort_values(at)[prob].to_numpy()
        return pd.DataFrame([(*key, a, b) for a, b in _segments(p, frame, start, end, speech, silence, pad)], columns=[*by, "start", "end"])

    return probabilities.select(*by, at, prob).groupBy(*by).applyInPandas(of, schema)


def split_points(active: np.ndarray, frame: int, total: int, most: int, padding: int = 0) -> Iterator[tuple[int, int]]:
    """Chunks of at most `most` samples, each cut in the middle of the longest silence of its second half, by whole
    frames from the middle on. active: frames from sample 0 on; the middle takes the frame that holds it."""
    start = 0
    if total <= most:
        yield 0, total
        return
    while start < total - padding:
        end = min(total, start + most)
        if end < total:
            middle = start + (end - start) // 2
            flags = active[middle // frame : -(-end // frame)]
            best, best_len, run = None, 0, 0
            for k, on in enumerate([*flags, True]):
                if on:
                    if run > best_len:
                        best, best_len = k - run, run
                    run = 0
                else:
                    run += 1
            if best is not None:
                end = max(start + 1, min(end, middle + (best + best_len // 2) * frame))
        yield start, end
        start = end


def chunked(flags: DataFrame, by: list[str], at: str, flag: str, frame: int, most: int, padding: int = 0) -> DataFrame:
    """(by, chunk, start, end) in samples, greedily cut at silence. flags: one row for each frame."""
    schema = ", ".join(f"`{c}` {flags.schema[c].dataType.simpleString()}" for c in by) + ", chunk int, start long, end long"

    def of(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        active = rows.sort_values(at)[flag].to_numpy(dtype=bool)
        return pd.DataFrame([(*key, k, a, b) for k, (a, b) in enumerate(split_points(active, frame, len(active) * frame, most, padding))], columns=[*by, "chunk", "start", "end"])

    return flags.select(*by, at, flag).groupBy(*by).applyInPandas(of, schema)


def seek_clips(seconds: Column, total: Column, rate: int = signal.SAMPLE_RATE) -> Column:
    """Pairs of samples for a list of seconds: all for none; an odd one runs to the end. Raises at a bad second."""
    bad = F.exists(seconds, lambda s: s.isNull() | F.isnan(s) | (s < 0) | (s == float("inf")))
    at = F.transform(seconds, lambda s: F.round(s * rate).cast("long"))
    at = F.when(F.size(at) == 0, F.array(F.lit(0).cast("long"))).otherwise(at)
    at = F.when(F.size(at) % 2 == 1, F.concat(at, F.array(total.cast("long")))).otherwise(at)
    pairs = F.transform(F.sequence(F.lit(0), (F.size(at) / 2 - 1).cast("int")), lambda k: F.struct(F.get(at, 2 * k).alias("start"), F.get(at, 2 * k + 1).alias("end")))
    return F.when(bad, F.raise_error(F.lit("bad clip second")).cast("array<struct<start:bigint,end:bigint>>")).otherwise(pairs)


#: Which of three speakers each of seven classes has.
POWERSET = [[0, 0, 0], [1, 0, 0], [0, 1, 0], [0, 0, 1], [1, 1, 0], [1, 0, 1], [0, 1, 1]]


def argmax(a: Column) -> Column:
    """The first index, from 0, of the largest element; NaN and null are skipped; 0 if there is none."""
    clean = F.transform(a.cast("array<double>"), lambda x: F.when(x.isNull() | F.isnan(x), F.lit(float("-inf"))).otherwise(x))
    return F.greatest(F.array_position(clean, F.array_max(clean)) - 1, F.lit(0)).cast("int")


def multilabel(logits: Column) -> Column:
    """The 0/1 row of three speakers of the class with the largest of seven logits."""
    table = F.array(*[F.array(*[F.lit(x) for x in row]) for row in POWERSET])
    return F.get(table, argmax(logits))


def slot_plans(active: DataFrame, by: list[str], frame: str, slot: str, on: str, clean_least: int = 3) -> DataFrame:
    """(by, slot, n_active, n_clean, mask): frames where a slot speaks alone, if there are enough, else where it speaks;
    mask is "clean", "raw" or, where it never speaks, "skip"."""
    together = F.sum(F.col(on).cast("int")).over(Window.partitionBy(*by, frame))
    rows = active.withColumn("__clean", F.col(on) & (together < 2))
    told = rows.groupBy(*by, slot).agg(F.count_if(on).alias("n_active"), F.count_if("__clean").alias("n_clean"))
    return told.withColumn("mask", F.when(F.col("n_active") == 0, "skip").when(F.col("n_clean") >= clean_least, "clean").otherwise("raw"))
