"""Signals: framing, padding, energy and scale functions over arrays and columns."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values.
SAMPLE_RATE, FRAME, THRESHOLD, ENERGY_FLOOR = 16_000, 1_600, 0.02, 1e-8


def padded_or_cut(a: Column, n: int) -> Column:
    """a with zeros on its right, or cut, to n elements."""
    return F.slice(F.concat(a.cast("array<double>"), F.array_repeat(F.lit(0.0), n)), 1, n)


def padded_from(a: Column, start: Column, n: int) -> Column:
    """n elements of a from start, from 0, with zeros beyond its end."""
    return padded_or_cut(F.slice(a, start + 1, F.lit(n)), n)


def tiled(a: Column, n: int) -> Column:
    """a again and again to n elements; zeros if it is empty."""
    return F.when(F.size(a) == 0, F.array_repeat(F.lit(0.0), n)).otherwise(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.get(a.cast("array<double>"), (i % F.greatest(F.size(a), F.lit(1))).cast("int"))))


def held(a: Column, n: int) -> Column:
    """a with its last element repeated to n elements; null if it is empty or longer."""
    return F.when((F.size(a) > 0) & (F.size(a) <= n), F.concat(a, F.array_repeat(F.element_at(a, -1), F.lit(n) - F.size(a))))


def with_context(previous: Column, a: Column, context: int = 64) -> Column:
    """The last `context` elements of the previous piece, zeros where there are fewer, before a."""
    tail = F.slice(previous, F.greatest(F.size(previous) - context, F.lit(0)) + 1, F.lit(context))
    tail = F.coalesce(tail, F.array().cast("array<double>"))
    return F.concat(F.array_repeat(F.lit(0.0), F.lit(context) - F.size(tail)), tail, a)


def rms(a: Column) -> Column:
    """Root of the mean square of an array; 0 if it is empty."""
    return F.when(F.size(a) == 0, 0.0).otherwise(F.sqrt(F.aggregate(a.cast("array<double>"), F.lit(0.0), lambda s, x: s + x * x) / F.greatest(F.size(a), F.lit(1))))


def rms_of(x: Column) -> Column:
    """Root of the mean square of a group."""
    return F.coalesce(F.sqrt(F.avg(x * x)), F.lit(0.0))


def relative_energy(energy: Column, reference: Column, floor: float = ENERGY_FLOOR) -> Column:
    """Decibels between a reference, 0, and full scale, 1; cut to that range. No energy is 0."""
    low = 20 * F.log10(F.greatest(reference, F.lit(floor)))
    db = 20 * F.log10(F.when(energy > 0, energy))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.try_divide(db - low, -low), F.lit(0.0))))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of the value, which is computed once; a plain column is computed again for each element of an array that
    a lambda goes over."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def log_sum_exp(a: Column) -> Column:
    """Shifted by the largest element; minus infinity if that isn't finite or there is none."""

    def told(x: Column, top: Column) -> Column:
        total = top + F.ln(F.aggregate(x, F.lit(0.0), lambda s, v: s + F.exp(v - top)))
        return F.when(top.isNull() | F.isnan(top) | (F.abs(top) == float("inf")), float("-inf")).otherwise(total)

    return let(a.cast("array<double>"), lambda x: let(F.array_max(x), lambda top: told(x, top)))


def rounded(x: Column, places: int) -> Column:
    """Half away from zero."""
    return F.round(x, places)


def grid_count(end: Column, step: float) -> Column:
    """Points of a grid up to end: end / step, half to even, and one."""
    return F.rint(end / step).cast("long") + 1


def hann(n: int) -> Column:
    """The periodic Hann window."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: 0.5 - 0.5 * F.cos(2 * np.pi * k / n))


def htk_mel(hz: Column) -> Column:
    return 2595 * F.log10(1 + hz / 700)


#: Fixed values of the Slaney scale: linear below, logarithmic above.
SLANEY_HZ, SLANEY_STEP, SLANEY_LOG = 1000.0, 200.0 / 3, float(np.log(6.4) / 27)


def slaney_mel(hz: Column) -> Column:
    """The linear part is hz * 3 / 200: dividing by the rounded SLANEY_STEP would move values that end in a half."""
    return F.when(hz < SLANEY_HZ, hz * 3 / 200).otherwise(15 + F.ln(F.greatest(hz, F.lit(SLANEY_HZ)) / SLANEY_HZ) * 27 / float(np.log(6.4)))


def slaney_hz(mel: Column) -> Column:
    knee = SLANEY_HZ / SLANEY_STEP
    return F.when(mel < knee, mel * SLANEY_STEP).otherwise(SLANEY_HZ * F.exp(SLANEY_LOG * (mel - knee)))


def first_bad_index(a: Column) -> Column:
    """The first index, from 0, whose element is null or not finite; null if there is none."""
    at = F.array_position(F.transform(a.cast("array<double>"), lambda x: F.coalesce(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(True))), True)
    return F.when(at > 0, at - 1)


def gated(a: Column, what: str = "value") -> Column:
    """a, raising at an element that isn't finite."""
    bad = first_bad_index(a)
    return F.when(bad.isNotNull(), F.raise_error(F.concat(F.lit(f"{what} not finite at "), bad.cast("string"))).cast("array<double>")).otherwise(a)


def unit_range(v: Column) -> Column:
    """A byte as -1 to 1."""
    return (v / 255.0 - 0.5) / 0.5


# Spectra are matrix products: NumPy, for Arrow functions.


def _mel_edges(count: int, rate: int, scale: str) -> np.ndarray:
    top = rate / 2
    if scale == "htk":
        mel = np.linspace(0, 2595 * np.log10(1 + top / 700), count + 2)
        return 700 * (10 ** (mel / 2595) - 1)
    knee = SLANEY_HZ / SLANEY_STEP
    mel = np.linspace(0, knee + np.log(top / SLANEY_HZ) / SLANEY_LOG, count + 2)
    return np.where(mel < knee, mel * SLANEY_STEP, SLANEY_HZ * np.exp(SLANEY_LOG * (mel - knee)))


def filterbank(count: int, n_fft: int, rate: int, scale: str = "slaney") -> np.ndarray:
    """count x (n_fft / 2 + 1) triangles; those of the Slaney scale have equal area."""
    edges, bins = _mel_edges(count, rate, scale), np.fft.rfftfreq(n_fft, 1 / rate)
    left, mid, right = edges[:-2, None], edges[1:-1, None], edges[2:, None]
    bank = np.maximum(0, np.minimum((bins - left) / (mid - left), (right - bins) / (right - mid)))
    return bank * 2 / (right - left) if scale == "slaney" else bank


def log_mel(samples: np.ndarray, n_fft: int, hop: int, rate: int, mels: int, scale: str = "slaney", reflect: bool = True, top_db: float | None = None) -> np.ndarray:
    """frames x mels, in decibels; centred frames, periodic Hann window."""
    x = np.pad(np.asarray(samples, dtype=np.float64), n_fft // 2, mode="reflect" if reflect and len(samples) > n_fft // 2 else "constant")
    frames = np.lib.stride_tricks.sliding_window_view(x, n_fft)[::hop]
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n_fft) / n_fft)
    power = np.abs(np.fft.rfft(frames * window, axis=1)) ** 2
    db = 10 * np.log10(np.maximum(power @ filterbank(mels, n_fft, rate, scale).T, 1e-10))
    return db if top_db is None else np.maximum(db, db.max() - top_db)
