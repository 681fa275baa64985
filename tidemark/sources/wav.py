"""WAV files as arrays of samples."""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

#: Bytes of a sample -> how it is read, and its full scale.
KINDS = {1: ("u1", 128.0), 2: ("<i2", 32768.0), 4: ("<i4", 2147483648.0)}


def decode(data: bytes) -> tuple[int, np.ndarray]:
    """(rate, samples from -1 to 1), channels averaged. Integer PCM of 8, 16, 24 or 32 bits."""
    with wave.open(io.BytesIO(data)) as w:
        width, channels, rate, raw = w.getsampwidth(), w.getnchannels(), w.getframerate(), w.readframes(w.getnframes())
    if width == 3:
        b = np.frombuffer(raw, dtype=np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((b[:, 0] << 8 | b[:, 1] << 16 | b[:, 2] << 24) >> 8) / 8388608.0
    else:
        kind, full = KINDS[width]
        x = np.frombuffer(raw, dtype=kind).astype(np.float64)
        x = (x - 128) / full if width == 1 else x / full
    return rate, x.reshape(-1, channels).mean(1).astype(np.float32)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(path, rate, samples, error): a file that isn't PCM WAV has an error and no samples."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for p, data in zip(batch["path"], batch["content"], strict=True):
                try:
                    rate, x = decode(bytes(data))
                    rows.append((p, rate, x, None))
                except (wave.Error, EOFError, KeyError, ValueError) as e:
                    rows.append((p, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "rate", "samples", "error"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.wav").load(path).select("path", "content")
    return files.mapInPandas(of, "path string, rate int, samples array<float>, error string")
