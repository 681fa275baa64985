"""Order-dependent clustering, assignment and the diarisation error."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Cosine distance up to which a vector joins a cluster, and up to which it moves its centre; least seconds.
JOIN, MOVE, SECONDS = 0.65, 0.45, 1.0


def thresholds(base: float) -> tuple[float, float]:
    """(join, move) for one base threshold."""
    return 1.2 * base, 0.8 * base


def online(vectors: np.ndarray, seconds: np.ndarray, join: float = JOIN, move: float = MOVE, least: float = SECONDS) -> list[int]:
    """The cluster of each vector in order, from 0; -1 where it is too short to found one and near none.

    A vector joins the nearest centre within `join`; within `move`, and long enough, it also moves that centre.
    """
    sums: list[np.ndarray] = []
    out = []
    for v, s in zip(vectors, seconds, strict=True):
        n = np.linalg.norm(v)
        if not np.isfinite(n) or n == 0:
            out.append(-1)
            continue
        v = v / n
        far = np.array([1 - (c @ v) / np.linalg.norm(c) for c in sums]) if sums else np.zeros(0)
        k = int(np.argmin(far)) if len(far) else -1
        if k >= 0 and far[k] <= join:
            if far[k] <= move and s >= least:
                sums[k] = sums[k] + v
            out.append(k)
        elif s >= least:
            sums.append(v)
            out.append(len(sums) - 1)
        else:
            out.append(-1)
    return out


def clustered(df: DataFrame, by: list[str], order: str, vector: str, seconds: str, join: float = JOIN, move: float = MOVE, least: float = SECONDS) -> DataFrame:
    """(by, order, cluster). Each recording is one ordered recurrence; recordings run in parallel."""
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in [*by, order])

    def of(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order)
        got = online(np.stack(rows[vector].to_numpy()).astype(float), rows[seconds].to_numpy(), join, move, least)
        return rows[[*by, order]].assign(cluster=got)

    return df.select(*by, order, vector, seconds).groupBy(*by).applyInPandas(of, f"{kinds}, cluster int")


def matched(overlap: np.ndarray) -> dict[int, int]:
    """hypothesis -> reference of largest total overlap, one to one, by the Hungarian method."""
    n, m = overlap.shape
    if not n or not m:
        return {}
    size = max(n, m)
    cost = np.zeros((size + 1, size + 1))
    cost[1 : n + 1, 1 : m + 1] = -overlap
    u, v, p, way = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1, dtype=int), np.zeros(size + 1, dtype=int)
    for i in range(1, size + 1):
        p[0], j0 = i, 0
        least, used = np.full(size + 1, np.inf), np.zeros(size + 1, dtype=bool)
        while True:
            used[j0] = True
            i0 = p[j0]
            free = ~used
            free[0] = False
            now = cost[i0] - u[i0] - v
            better = free & (now < least)
            least[better], way[better] = now[better], j0
            j1 = int(np.argmin(np.where(free, least, np.inf)))
            delta = least[j1]
            u[p[used]] += delta
            v[used] -= delta
            least[free] -= delta
            j0 = j1
            if p[j0] == 0:
                break
        while j0:
            p[j0] = p[way[j0]]
            j0 = way[j0]
    return {int(p[j]) - 1: j - 1 for j in range(1, m + 1) if 1 <= p[j] <= n and overlap[p[j] - 1, j - 1] > 0}


def error_rate(reference: DataFrame, hypothesis: DataFrame, by: list[str], step: float = 0.01, collar: float = 0.25, skip_overlap: bool = True) -> DataFrame:
    """(by, total, missed, false_alarm, confused, rate) over frames of `step` seconds.

    reference, hypothesis: (by, spk, start, end). A frame counts where its middle is in an interval. Frames within
    the collar of a reference edge are left out, as are, if asked, those of several reference speakers. Speakers
    are matched one to one for the largest overlap. Intervals become frames by a sequence, not by a theta join.
    """

    def frames(df: DataFrame, name: str) -> DataFrame:
        first, last = F.ceil(F.col("start") / step - 0.5), F.ceil(F.col("end") / step - 0.5) - 1
        rows = df.filter("end > start").withColumn("a", first.cast("long")).withColumn("z", last.cast("long")).filter("z >= a")
        return rows.select(*by, F.explode(F.sequence("a", "z")).alias("frame"), F.col("spk").alias(name)).distinct()

    edges = reference.filter("end > start").select(*by, F.explode(F.array("start", "end")).alias("e"))
    near = edges.withColumn("a", F.ceil((F.col("e") - collar) / step - 0.5).cast("long")).withColumn("z", (F.ceil((F.col("e") + collar) / step - 0.5) - 1).cast("long"))
    near = near.filter("z >= a").select(*by, F.explode(F.sequence("a", "z")).alias("frame")).distinct() if collar > 0 else None
    ref = frames(reference, "r").groupBy(*by, "frame").agg(F.collect_set("r").alias("r"))
    hyp = frames(hypothesis, "h").groupBy(*by, "frame").agg(F.collect_set("h").alias("h"))
    none = F.array().cast("array<string>")
    both = ref.join(hyp, [*by, "frame"], "full").withColumn("r", F.coalesce(F.col("r").cast("array<string>"), none)).withColumn("h", F.coalesce(F.col("h").cast("array<string>"), none))
    if near is not None:
        both = both.join(near, [*by, "frame"], "left_anti")
    if skip_overlap:
        both = both.filter(F.size("r") < 2)
    # One row for each recording and combination of speakers: that is all the matching needs.
    sums = both.groupBy(*by, F.array_sort("r").alias("r"), F.array_sort("h").alias("h")).agg(F.count("*").alias("n"))
    kinds = ", ".join(f"`{c}` {sums.schema[c].dataType.simpleString()}" for c in by)

    def of(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rs, hs = sorted({x for r in rows["r"] for x in r}), sorted({x for r in rows["h"] for x in r})
        overlap = np.zeros((len(hs), len(rs)))
        for r, h, n in zip(rows["r"], rows["h"], rows["n"], strict=True):
            for x in h:
                for y in r:
                    overlap[hs.index(x), rs.index(y)] += n
        to = {hs[a]: rs[b] for a, b in matched(overlap).items()}
        total = missed = alarm = confused = 0
        for r, h, n in zip(rows["r"], rows["h"], rows["n"], strict=True):
            right = len({to[x] for x in h if x in to} & set(r))
            total += n * len(r)
            missed += n * max(0, len(r) - len(h))
            alarm += n * max(0, len(h) - len(r))
            confused += n * (min(len(r), len(h)) - right)
        rate = (missed + alarm + confused) / total if total else 0.0
        return pd.DataFrame([(*key, total, missed, alarm, confused, rate)], columns=[*by, "total", "missed", "false_alarm", "confused", "rate"])

    return sums.groupBy(*by).applyInPandas(of, f"{kinds}, total long, missed long, false_alarm long, confused long, rate double")
