"""Window plans over ordered sequences, and what windows give back to frames."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Windows that one sequence may have.
CAP = 100_000


@dataclass(frozen=True)
class Plan:
    """Windows of `window` elements at every `hop`. least: the shortest tail that is kept; None keeps all (padded)."""

    window: int
    hop: int
    least: int | None = None
    cap: int | None = CAP

    def __post_init__(self):
        if not 0 < self.hop <= self.window:
            raise ValueError("hop must be from 1 to window")
        if self.least is not None and not 0 < self.least <= self.window:
            raise ValueError("least must be from 1 to window")

    def count(self, total: Column) -> Column:
        """Windows of a sequence of `total` elements, without making them."""
        if self.least is None:
            many = F.ceil(total / self.hop)
            one = F.lit(1)
        else:
            many = F.when(total < self.least, 0).otherwise(F.floor((total - self.least) / self.hop) + 1)
            one = F.when(total >= self.least, 1).otherwise(0)
        n = F.when(total <= 0, 0).when(total <= self.window, one).otherwise(many).cast("long")
        if self.cap is None:
            return n
        return F.when(n > self.cap, F.raise_error(F.concat(F.lit("too many windows: "), n.cast("string"))).cast("long")).otherwise(n)

    def starts(self, total: Column) -> Column:
        n = self.count(total)
        return F.when(n > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.greatest(n - 1, F.lit(0))), lambda k: k * self.hop)).otherwise(F.array().cast("array<bigint>"))


def spans(df: DataFrame, total: str, plan: Plan) -> DataFrame:
    """df with start, len and coverage for each window of each row."""
    df = df.withColumn("start", F.explode(plan.starts(F.col(total))))
    length = F.least(F.lit(plan.window).cast("long"), F.col(total) - F.col("start"))
    return df.withColumn("len", length).withColumn("coverage", F.col("len") / plan.window)


def window_starts_of(pos: Column, total: Column, plan: Plan) -> Column:
    """The starts of the windows of a plan without `least` that hold the element at pos: no join with the spans."""
    last = F.floor(pos / plan.hop)
    reach = (plan.window - 1) // plan.hop
    every = F.transform(F.sequence(F.greatest(last - reach, F.lit(0).cast("long")), last), lambda k: k * plan.hop)
    inside = F.filter(every, lambda s: s > pos - plan.window)
    return F.when(total <= plan.window, F.array(F.lit(0).cast("long"))).otherwise(inside)


def chunk_starts(total: Column, window: int, step: int) -> Column:
    """Starts up to the first chunk that covers the end; one chunk at least."""
    n = F.when(total <= window, 1).otherwise(F.ceil((total - window) / step) + 1).cast("long")
    return F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda c: c * step)


def overlapped_starts(total: Column, window: int = 480_000, overlap: int = 144_000) -> Column:
    return chunk_starts(total, window, window - overlap)


def overlap_add(active: DataFrame, by: list[str], chunk: str, frame: str, value: str, chunk_step: float, frame_step: float, frames: int) -> DataFrame:
    """(by, out_frame, n): for each output frame, the mean of `value` over the chunks that cover it, half to even,
    0 to 255; 0 where none does, from 0 to the last output frame of the last chunk.

    active: one row for each chunk and frame, with the number of active slots. frames: frames of a chunk.
    """
    at = (F.rint(F.col(chunk) * chunk_step / frame_step).cast("long") + F.col(frame)).alias("out_frame")
    last = active.groupBy(*by).agg((F.rint((F.max(chunk) * chunk_step + (frames - 1) * frame_step) / frame_step).cast("long") + 1).alias("last"))
    grid = last.select(*by, F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"))).alias("out_frame"))
    got = active.select(*by, at, F.col(value).alias("v")).groupBy(*by, "out_frame").agg(F.avg("v").alias("mean"))
    n = F.least(F.greatest(F.rint(F.coalesce("mean", F.lit(0.0))), F.lit(0.0)), F.lit(255.0)).cast("int")
    return grid.join(got, [*by, "out_frame"], "left").select(*by, "out_frame", n.alias("n"))


def truncated_frames(samples: Column, available: Column, receptive: int = 400, stride: int = 320) -> Column:
    return F.when(samples <= 0, 0).otherwise(F.least(available, F.floor(F.greatest(samples - receptive, F.lit(0)) / stride) + 1)).cast("long")
