"""Best-fit packing by minimum bin slack.

Documents are tokenised where they lie and cut into pieces. Only the number of pieces of each length goes to the
driver: fewer counts than a sequence has tokens, whatever the input. There, each sequence starts from the
longest piece left, and a subset-sum dynamic programme over a bitset finds the combination of the lengths still
available that fills it most; that combination is removed as often as the counts allow. Executors then look up
the place of each piece by its rank among the pieces of its length.
"""

from __future__ import annotations

import functools
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import settle, written

SEQUENCE = 1024
END_ID = 2
#: Pieces of a length that are ranked together: a length is split into as many runs as it takes.
RUN_ROWS = 1000
#: Texts whose pieces are sent on at once.
BATCH = 64
_PIECE = [("piece", T.IntegerType()), ("start", T.LongType()), ("length", T.LongType()), ("ids_crc32", T.LongType())]
#: Fixed value: how byte-level BPE vocabularies of this kind split a text.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@functools.cache
def encoder(path: str, added: bool = True):
    """encode(text) -> ids, for a byte-level BPE vocabulary file of the library tokenizers.

    The file's vocabulary and merges run in tiktoken, which gives the same ids in a quarter of the time (tests
    hold both against each other). added: the file's added tokens give their ids, as by default in tokenizers,
    which encodes the texts that hold one; otherwise their strings are ordinary text.
    """
    import tiktoken

    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    if model["model"]["type"] != "BPE" or (model.get("pre_tokenizer") or {}).get("type") != "ByteLevel" or model["pre_tokenizer"].get("add_prefix_space"):
        raise ValueError(f"{path} is no byte-level BPE vocabulary")
    # Printable bytes stand for themselves in the file; the others, in order, for the characters from 256 on.
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    byte = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}
    special = {t["content"] for t in model.get("added_tokens", [])}
    ranks = {bytes(byte[c] for c in token): k for token, k in model["model"]["vocab"].items() if token not in special}
    plain = tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    if not added or not special:
        return plain
    holds = re.compile("|".join(map(re.escape, special))).search
    return lambda text: _library(path).encode(text, add_special_tokens=False).ids if holds(text) else plain(text)


@functools.cache
def _library(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def cut(n: int, most: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens. All but the first have `most` tokens."""
    first = n % most or most
    return [(0, min(n, first)), *((s, most) for s in range(first, n, most))]


def tokenised(docs: DataFrame, tokenizer: str, text: str = "text", key: str = "doc_id", most: int = SEQUENCE, end_id: int = END_ID, with_ids: bool = True, added: bool = True) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, with_ids, ids (little-endian unsigned 32-bit) of each piece."""
    kind = docs.schema[key].dataType
    schema = T.StructType([T.StructField("doc_id", kind), *[T.StructField(c, t) for c, t in _PIECE], *([T.StructField("ids", T.BinaryType())] if with_ids else [])])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle()
        encode = encoder(tokenizer, added)
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                owner, told, own = [], [], []
                for k, body in enumerate(part.column(1)):
                    ids = np.array([*encode(body.as_py() or ""), end_id], dtype="<u4")
                    for piece, (start, length) in enumerate(cut(len(ids), most)):
                        owner.append(k)
                        own.append(ids[start : start + length].tobytes())
                        told.append((piece, start, length, zlib.crc32(own[-1])))
                columns = [part.column(0).take(pa.array(owner, pa.int32()))]
                columns += [pa.array(c, pa.int32() if k == 0 else pa.int64()) for k, c in enumerate(zip(*told, strict=True))]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(own, pa.binary())] * with_ids, schema.names)

    return docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).mapInArrow(pieces, schema)


def fullest(counts: dict[int, int], order: list[int], room: int) -> dict[int, int]:
    """The combination of available lengths, as length -> times, whose sum is largest without passing room."""
    reach, mask, steps = 1, (1 << (room + 1)) - 1, []
    for length in order:
        left = min(counts[length], room // length)
        times = 1
        while left > 0:
            t = min(times, left)
            steps.append((length, t, reach))
            reach |= (reach << (length * t)) & mask
            left -= t
            times *= 2
        if reach >> room & 1:
            break
    at, taken = reach.bit_length() - 1, {}
    for length, t, before in reversed(steps):
        if not before >> at & 1:
            taken[length] = taken.get(length, 0) + t
            at -= length * t
    return taken


def plan(counts: dict[int, int], most: int = SEQUENCE) -> list[tuple[int, dict[int, int]]]:
    """(times, combination): all counted pieces, by minimum bin slack. Every step uses up a length for that step's
    combination, so steps grow with the number of lengths, not of pieces."""
    counts = {k: v for k, v in counts.items() if v > 0}
    order = sorted(counts, reverse=True)
    steps = []
    while order:
        longest = order[0]
        counts[longest] -= 1
        taken = fullest(counts, [x for x in order if x <= most - longest and counts[x] > 0], most - longest)
        counts[longest] += 1
        taken[longest] = taken.get(longest, 0) + 1
        times = min(counts[k] // v for k, v in taken.items())
        for k, v in taken.items():
            counts[k] -= v * times
        order = [x for x in order if counts[x] > 0]
        steps.append((times, taken))
    return steps


def places(steps: list[tuple[int, dict[int, int]]]) -> dict[int, np.ndarray]:
    """For each length, rows (first rank, pieces in a sequence, first sequence, first offset) by rank."""
    rows: dict[int, list] = {}
    used: dict[int, int] = {}
    sequence = 0
    for times, taken in steps:
        offset = 0
        for length, k in taken.items():
            rows.setdefault(length, []).append((used.get(length, 0), k, sequence, offset))
            used[length] = used.get(length, 0) + k * times
            offset += k * length
        sequence += times
    return {k: np.array(v, dtype=np.int64) for k, v in rows.items()}


def pack(docs: DataFrame, tokenizer: str, text: str = "text", key: str = "doc_id", most: int = SEQUENCE, end_id: int = END_ID, with_ids: bool = True, added: bool = True) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset and, with_ids, ids.

    Null and empty texts have the end id alone. Rows that repeat a key are documents of their own; null keys stay
    null. Texts of any length are tokenised whole. An empty table gives no rows; other columns are not read.
    added: see encoder().
    A full piece is a sequence by itself, with a negative number; the others are numbered from 0.
    """
    rows = written(tokenised(docs, tokenizer, text, key, most, end_id, with_ids, added), "pieces")
    told = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    full = rows.filter(F.col("length") == most).select(*told, (-F.monotonically_increasing_id() - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    # Numbers of a written table's rows: a task that runs again numbers alike.
    short = rows.filter(F.col("length") < most).withColumn("row", F.monotonically_increasing_id())
    by_length = {r[0]: r[1] for r in short.groupBy("length").count().collect()}  # fewer rows than a sequence has tokens
    where = places(plan(by_length, most))
    spark = docs.sparkSession
    runs = spark.createDataFrame([(k, max(1, -(-v // RUN_ROWS))) for k, v in by_length.items()], "length long, runs long")
    short = short.join(F.broadcast(runs), "length").withColumn("run", F.pmod(F.xxhash64("row"), F.col("runs"))).drop("runs")
    run = Window.partitionBy("length", "run")
    before = short.groupBy("length", "run").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("length").orderBy("run"))
    before = before.select("length", "run", (upto - F.col("n")).alias("before"))
    ranked = short.withColumn("rank", F.row_number().over(run.orderBy("row"))).join(before, ["length", "run"])
    ranked = ranked.select(*told, (F.col("before") + F.col("rank") - 1).alias("rank"))
    schema = T.StructType([*rows.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle()
        for batch in batches:
            lengths, ranks = (batch.column(c).to_numpy() for c in ("length", "rank"))
            sequence, offset = np.empty(len(lengths), dtype=np.int64), np.empty(len(lengths), dtype=np.int64)
            order = np.argsort(lengths, kind="stable")
            for own in np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1) if len(order) else []:
                length = int(lengths[own[0]])
                table = where[length]
                n = ranks[own]
                start, k, first, base = table[np.searchsorted(table[:, 0], n, side="right") - 1].T
                sequence[own] = first + (n - start) // k
                offset[own] = base + (n - start) % k * length
            columns = [batch.column(c) for c in told]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sequence), pa.array(offset)], schema.names)

    return full.unionByName(ranked.mapInArrow(placed, schema))
