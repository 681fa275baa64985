"""Text functions: normalisation, prefixes, compression and caption times."""

from __future__ import annotations

import zlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def normalized(t: Column) -> Column:
    """Lower case, hyphens as spaces, no punctuation, single spaces, trimmed."""
    t = F.replace(F.lower(t), F.lit("-"), F.lit(" "))
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"\p{P}", ""), " +", " "))


def without_marks(t: Column) -> Column:
    """Without the characters of special tokens at both ends."""
    return F.btrim(t, F.lit("<|>"))


def words(t: Column) -> Column:
    return F.filter(F.split(t, r"\s+"), lambda w: w != "")


def common_prefix_length(a: Column, b: Column) -> Column:
    """The number of leading elements that agree once normalised."""
    same = F.transform(F.arrays_zip(a.alias("a"), b.alias("b")), lambda p: F.coalesce(normalized(p["a"]) == normalized(p["b"]), F.lit(False)))
    at = F.array_position(same, False)
    return F.when(at > 0, at - 1).otherwise(F.size(same)).cast("int")


def common_prefix(previous: Column, current: Column) -> Column:
    """Those elements, as the current array has them."""
    return F.slice(current, 1, common_prefix_length(previous, current))


def different_suffix(previous: Column, current: Column) -> Column:
    n = common_prefix_length(previous, current)
    return F.slice(current, n + 1, F.greatest(F.size(current) - n, F.lit(0)))


def _deflated(data: bytes) -> int:
    c = zlib.compressobj(6, zlib.DEFLATED, -15)
    return len(c.compress(data)) + len(c.flush())


def deflated_length(data: Column) -> Column:
    """Bytes of a binary column as a raw DEFLATE stream."""

    @F.pandas_udf("int")
    def of(x: pd.Series) -> pd.Series:
        return x.map(lambda d: None if d is None else _deflated(bytes(d))).astype("Int32")

    return of(data)


def text_compression_ratio(t: Column) -> Column:
    """UTF-8 bytes over compressed bytes; infinity for an empty text."""
    return F.when(F.length(t) == 0, float("inf")).otherwise(F.octet_length(t) / deflated_length(t.cast("binary")))


def token_compression_ratio(tokens: Column) -> Column:
    """32-bit little-endian bytes over compressed bytes; 0 for no token."""

    @F.pandas_udf("double")
    def of(x: pd.Series) -> pd.Series:
        raw = x.map(lambda a: None if a is None else b"".join(int(t).to_bytes(4, "little", signed=True) for t in a))
        return raw.map(lambda r: None if r is None else len(r) / _deflated(r)).astype("float64")

    return of(tokens)


def primary_language(tag: Column) -> Column:
    """The primary subtag in lower case; Mandarin as Chinese."""
    first = F.lower(F.split(F.replace(tag, F.lit("_"), F.lit("-")), "-")[0])
    return F.when(first == "cmn", "zh").otherwise(first)


#: Names of languages, for a lookup table.
LANGUAGES = {"english": "en", "german": "de", "french": "fr", "spanish": "es", "italian": "it", "portuguese": "pt", "dutch": "nl", "russian": "ru", "chinese": "zh", "japanese": "ja", "korean": "ko", "arabic": "ar"}


def language_code(x: Column) -> Column:
    """A code for a name or a code; null for what is unknown."""
    table = F.create_map(*[F.lit(v) for pair in LANGUAGES.items() for v in pair])
    low = F.lower(x)
    return F.when(low.isin(*LANGUAGES.values()), low).otherwise(F.try_element_at(table, low))


def clock(seconds: Column, mark: str, hours: bool = True) -> Column:
    """HH:MM:SS and the mark and milliseconds, truncated; without hours where there are none, if not asked for."""
    ms = F.floor(seconds.cast("double") * 1000 + 1e-6).cast("long")
    parts = [(ms / 3600000).cast("long"), (ms / 60000).cast("long") % 60, (ms / 1000).cast("long") % 60, ms % 1000]
    long, short = F.format_string(f"%02d:%02d:%02d{mark}%03d", *parts), F.format_string(f"%02d:%02d{mark}%03d", *parts[1:])
    return long if hours else F.when(parts[0] > 0, long).otherwise(short)


def srt_cue(number: Column, start: Column, end: Column, text: Column) -> Column:
    return F.concat(number.cast("string"), F.lit("\n"), clock(start, ","), F.lit(" --> "), clock(end, ","), F.lit("\n"), F.trim(text), F.lit("\n"))


def vtt_cue(start: Column, end: Column, text: Column) -> Column:
    return F.concat(clock(start, ".", hours=False), F.lit(" --> "), clock(end, ".", hours=False), F.lit("\n"), F.trim(text), F.lit("\n"))


def segment_line(start: Column, end: Column, text: Column, times: bool = True) -> Column:
    return F.format_string("[%.2f --> %.2f] %s", start.cast("double"), end.cast("double"), text) if times else text


def glob(pattern: str) -> str:
    """A LIKE pattern for one with * and ?."""
    return pattern.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_").replace("*", "%").replace("?", "_")


def matches_glob(x: Column, pattern: str) -> Column:
    return x.like(glob(pattern))


def base_folder(path: Column, name: str) -> Column:
    """The parent of the folder of that name; null where no folder has it."""
    parts = F.split(path, "/")
    at = F.array_position(parts, name).cast("int")
    return F.when(at > 0, F.array_join(F.slice(parts, 1, F.greatest(at - 1, F.lit(0))), "/"))


def download_pattern(name: Column, version: Column, variant: Column) -> Column:
    return F.concat_ws("/", name, F.coalesce(version, F.lit("*")), F.coalesce(variant, F.lit("*")), F.lit("*"))
