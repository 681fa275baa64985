"""Energy of a stream of samples, frame by frame, against the least of the last frames."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

from tidemark.streaming.state import ends, keep

FRAME, BACK, FLOOR = 1_600, 20, 1e-8


def relative(energy: float, reference: float) -> float:
    low = 20 * math.log10(max(reference, FLOOR))
    if energy <= 0 or low == 0:
        return 0.0
    return max(0.0, min(1.0, (20 * math.log10(energy) - low) / -low))


class Tracker:
    """Takes samples in any pieces and gives (frame, rms, relative) of each frame that is full."""

    def __init__(self, frame: int = FRAME, back: int = BACK):
        self.frame, self.back, self.count, self.rest, self.last = frame, back, 0, [], []

    def push(self, samples: list[float]) -> list[tuple[int, float, float]]:
        self.rest += samples
        out = []
        while len(self.rest) >= self.frame:
            own, self.rest = self.rest[: self.frame], self.rest[self.frame :]
            e = math.sqrt(sum(x * x for x in own) / len(own))
            out.append((self.count, e, relative(e, min(self.last)) if self.last else 0.0))
            self.last = [*self.last, e][-self.back :]
            self.count += 1
        return out


def energy_stream(df: DataFrame, key: str, order: str, value: str, frame: int = FRAME, back: int = BACK, ttl_ms: int | None = 3_600_000) -> DataFrame:
    """(key, frame, rms, relative) of full frames. State: less than a frame of samples and `back` energies."""

    def of(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        t = Tracker(frame, back)
        if state.exists:
            t.count, t.rest, t.last = state.get[0], list(state.get[1]), list(state.get[2])
        rows = pd.concat(list(batches)).sort_values(order)
        out = t.push(rows[value].astype(float).tolist())
        state.update((t.count, t.rest, t.last))
        keep(state, ttl_ms)
        yield pd.DataFrame([(k[0], *x) for x in out], columns=["key", "frame", "rms", "relative"])

    kind = df.schema[key].dataType.simpleString()
    rows = df.select(key, order, F.col(value).cast("double").alias(value))
    return rows.groupBy(key).applyInPandasWithState(of, f"key {kind}, frame int, rms double, relative double", "count int, rest array<double>, last array<double>", "append", ends(ttl_ms))
