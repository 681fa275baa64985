"""Fuzzy line deduplication by MinHash over character shingles.

Each line's character shingles give a one-permutation MinHash signature, empty places filled from others of its
own. Bands of places give candidate pairs, verified by the exact Jaccard similarity of the shingle sets. Verified
pairs and equal lines make components by distributed union-find, and of each component one line stays: its first
in order of document and position. Texts are read thrice, and shuffled only where lines go; what else moves is
hashes, and lines that share a band.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import P, settle, written
from .similar import Filter, Similarity, join_heavy, linked_parts, may_hold, mixed, told_links, with_texts

#: Characters of a shingle.
SHINGLE = 8
LEAST = 0.8
#: A pair of similarity 0.8 shares a band with probability 0.998, one of 0.2 with 0.005.
BANDS, ROWS = 16, 5
#: Characters of lines that are worked on at once; a longer line is worked on alone, whole.
CHUNK = 100_000
#: A line that isn't blank, from its first character that Python's str.split() takes for no white space.
LINE = r"[^\s\u000B\u001C-\u001F\u0085\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000][^\n]*"
#: Line ids that a task remembers.
KNOWN = 250_000
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15


def normalised(line: str) -> str:
    return " ".join(line.lower().split())


def line_ids(lines: list[str]) -> list[int]:
    """Signed 64-bit hashes of normalised lines; 0 for a blank one."""
    return [(xxhash.xxh3_64_intdigest(x) - (1 << 63)) or 1 if x else 0 for x in lines]


def _rolled(codes: np.ndarray) -> np.ndarray:
    """The hash of every SHINGLE characters in a row."""
    h = codes.astype(_U) + _U(1)
    # Hashes of 1, 2, 4, then 8 characters.
    width, base = 1, _BASE
    while width < SHINGLE:
        if len(h) > width:
            h = h[:-width] * _U(base) + h[width:]
        base, width = base * base % (1 << 64), width * 2
    return h


def shingles(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(line, hash) of every shingle of SHINGLE characters; a shorter line, but not an empty one, is one shingle."""
    padded = [x if len(x) >= SHINGLE or not x else x + "\0" * (SHINGLE - len(x)) for x in lines]
    lengths = np.fromiter(map(len, padded), np.int64, len(padded))
    h = _rolled(np.frombuffer("".join(padded).encode("utf-32-le"), dtype="<u4"))
    n = np.maximum(lengths - SHINGLE + 1, 0)
    owner = np.repeat(np.arange(len(lines)), n)
    at = np.arange(len(owner)) + np.repeat(np.cumsum(lengths) - lengths - (np.cumsum(n) - n), n)
    return owner, mixed(h[at]) if len(at) else np.zeros(0, dtype=_U)


def shingle_set(line: str) -> np.ndarray:
    """The distinct shingle hashes of one line, sorted; before mixing, which keeps equality."""
    h = np.sort(_rolled(np.frombuffer((line + "\0" * (SHINGLE - len(line))).encode("utf-32-le"), dtype="<u4")))
    return h[np.concatenate([[True], h[1:] != h[:-1]])]


def _jaccard(x: np.ndarray, y: np.ndarray, least: float) -> float:
    """The Jaccard similarity of sorted sets; 0 if their sizes already keep it under `least`."""
    if min(len(x), len(y)) < least * max(len(x), len(y)):
        return 0.0
    at = np.minimum(np.searchsorted(x, y), len(x) - 1)
    both = int((x[at] == y).sum())
    return both / (len(x) + len(y) - both)


_orders: dict[int, np.ndarray] = {}


def _order(places: int) -> np.ndarray:
    """For each place, in which order it looks at the others when it is empty."""
    if places not in _orders:
        rng = np.random.default_rng(7)
        _orders[places] = np.stack([rng.permutation(places) for _ in range(places)])
    return _orders[places]


def signatures(owner: np.ndarray, h: np.ndarray, lines: int, places: int = BANDS * ROWS) -> np.ndarray:
    """lines x places: the least shingle hash of those that fall to a place. Lines without shingles get the top value."""
    top = np.uint32(0xFFFFFFFF)
    out = np.full(lines * places, top)
    place = (((h >> _U(32)) * _U(places)) >> _U(32)).astype(np.int64) + owner * places
    np.minimum.at(out, place, np.minimum(h & _U(0xFFFFFFFF), _U(0xFFFFFFFE)).astype(np.uint32))
    out = out.reshape(lines, places)
    full = out != top
    r, c = np.nonzero(~full & full.any(1)[:, None])
    order, source = _order(places), out.copy()
    for turn in range(places):
        if not len(r):
            break
        look = order[c, turn]
        hit = full[r, look]
        # What is taken over is told apart by where it is put, so that it counts as a hash of its own.
        out[r[hit], c[hit]] = source[r[hit], look[hit]]
        r, c = r[~hit], c[~hit]
    return out


def band_keys(signature: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """lines x bands, signed 64-bit: a hash of the band's places and its number."""
    parts = signature.reshape(len(signature), bands, rows)
    h = np.broadcast_to(mixed(np.arange(1, bands + 1, dtype=_U)), parts.shape[:2])
    for k in range(rows):
        h = mixed(h * _U(3) + parts[:, :, k])
    return np.ascontiguousarray(h).view(np.int64)


def _blocks(lines: list[str], most: int = CHUNK) -> Iterator[list[str]]:
    block, size = [], 0
    for x in lines:
        if block and size + len(x) > most:
            yield block
            block, size = [], 0
        block.append(x)
        size += len(x)
    if block:
        yield block


def sketched(rows: DataFrame) -> DataFrame:
    """(row, doc_id, ids, new, keys) of (row, doc_id, text): the line ids in order, and of the lines that a task
    sees for the first time, the ids and, BANDS for each, the band keys."""
    schema = T.StructType([rows.schema["row"], rows.schema["doc_id"], *[T.StructField(c, T.ArrayType(t)) for c, t in (("ids", T.LongType()), ("new", T.LongType()), ("keys", T.LongType()))]])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle()
        known: set[int] = set()
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                ids, fresh, lines = [], [], []
                for text in part.column(2):
                    own = [normalised(x) for x in (text.as_py() or "").split("\n")]
                    ids.append(line_ids(own))
                    new = []
                    for x, k in zip(own, ids[-1], strict=True):
                        if k and k not in known:
                            known.add(k)
                            new.append(k)
                            lines.append(x)
                    fresh.append(new)
                if len(known) > KNOWN:  # forgetting costs repeated rows, not lost ones
                    known.clear()
                found = [band_keys(signatures(*shingles(b), len(b))) for b in _blocks(lines)]
                keys = np.concatenate(found).ravel() if found else np.zeros(0, dtype=np.int64)
                ends = np.cumsum([0, *[len(x) * BANDS for x in fresh]]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(ids, pa.list_(pa.int64())), pa.array(fresh, pa.list_(pa.int64())), pa.ListArray.from_arrays(pa.array(ends), pa.array(keys))], schema.names
                )

    return rows.select("row", "doc_id", "text").mapInArrow(of, schema)


def bodies_of(wanted: DataFrame, rows: DataFrame) -> DataFrame:
    """(id, body), written: the normalised lines of the wanted ids."""
    held = rows.sparkSession.sparkContext.broadcast(Filter(wanted, "id").array())

    def bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle()
        known: set[int] = set()
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                lines = [normalised(x) for text in batch.column(0).slice(at, 200) for x in (text.as_py() or "").split("\n")]
                ids = np.array(line_ids(lines), dtype=np.int64)
                on = []
                for k in np.flatnonzero((ids != 0) & may_hold(held.value, ids)).tolist():
                    if int(ids[k]) not in known:
                        known.add(int(ids[k]))
                        on.append(k)
                if len(known) > KNOWN:
                    known.clear()
                yield pa.RecordBatch.from_arrays([pa.array(ids[on]), pa.array([lines[k] for k in on], pa.string())], ["id", "body"])

    found = rows.select("text").mapInArrow(bodies, "id long, body string")
    return written(found.join(wanted, "id", "left_semi").groupBy("id").agg(F.first("body").alias("body")), "bodies")


def compared(pairs: DataFrame, bodies: DataFrame, least: float) -> DataFrame:
    """Of the written pairs (a, b), links (b, a), written, that connect those whose shingle sets have a Jaccard
    similarity of `least`."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle()
        last, known, found = None, None, []
        for batch in batches:
            a, on = batch.column(0).to_pylist(), []
            for k in range(len(a)):
                if a[k] != last:
                    last, known = a[k], shingle_set(batch.column(2)[k].as_py())
                other = shingle_set(batch.column(3)[k].as_py())
                on.append(_jaccard(known, other, least) >= least)
            found.append((batch.column(0).to_numpy()[on], batch.column(1).to_numpy()[on]))
        yield from told_links(found, ["b", "a"])

    return written(with_texts(pairs, bodies).mapInArrow(of, "b long, a long"), "verified")


def dropped_lines(rows: DataFrame, least: float = LEAST) -> DataFrame:
    """(row, dropped), written, for each row of (row, doc_id, text) that loses lines: their positions, from 0."""
    sketch = written(sketched(rows), "sketch")
    kept: list[DataFrame] = []

    def verify(pairs: DataFrame) -> DataFrame:
        if not kept:  # the ids of later pairs are among those of the first
            kept.append(bodies_of(written(pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct(), "wanted"), rows))
        return compared(pairs, kept[0], least)

    parts = linked_parts(sketch.select(F.col("new").alias("ids"), "keys"), Similarity(verify, lambda: kept[0], shingles, least))
    # Where each line stands first, and how often it stands at all.
    places = sketch.select("row", "doc_id", F.posexplode("ids").alias("at", "id")).filter("id != 0")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row", "at"))
    lines = written(places.groupBy("id").agg(first.alias("first"), F.count("*").alias("n")).join(parts, "id", "left").filter("n > 1 OR part IS NOT NULL").withColumn("part", F.coalesce("part", "id")), "lines")
    heads = written(lines.groupBy("part").agg(F.min("first").alias("head"), F.count("*").alias("size")), "heads")
    stays = written(join_heavy(lines.select("id", "n", "part"), heads, "part", "size", lines.count()).select("id", "n", F.col("head.row").alias("keep_row"), F.col("head.at").alias("keep_at")), "stays")
    some = written(Filter(stays, "id").passed(places.select("row", "at", "id"), "id"), "some")
    gone = join_heavy(some, stays, "id", "n", some.count()).filter("row != keep_row OR at != keep_at")
    return written(gone.groupBy("row").agg(F.collect_list("at").alias("dropped")), "dropped")


def _cut(rows: DataFrame) -> DataFrame:
    """(row, text, n_dropped) of (row, text, dropped): the text without the dropped lines."""
    schema = T.StructType([*rows.schema.fields[:2], T.StructField("n_dropped", T.LongType())])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle()
        for batch in batches:
            texts, counts = batch.column(1).to_pylist(), []
            for k, dropped in enumerate(batch.column(2).to_pylist()):
                counts.append(len(dropped or ()))
                if dropped:
                    gone = set(dropped)
                    texts[k] = "\n".join([x for at, x in enumerate(texts[k].split("\n")) if at not in gone])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(counts, pa.int64())], schema.names)

    return rows.mapInArrow(of, schema)


def line_dedup(docs: DataFrame, text: str = "text", key: str = "doc_id", least: float = LEAST, lines: str = "n_lines", gone: str = "n_dropped") -> DataFrame:
    """docs, all columns, with the text without the lines that go, and with n_lines and n_dropped, or as `lines` and
    `gone` name them.

    Lines are equal, or near each other at a similarity of `least`, after lower-casing and joining white space.
    Of each component of such lines the first by key and position stays; null keys come last, rows that repeat a
    key in an order of their own. Blank lines always stay and don't count. Null texts stay null, empty ones empty;
    a text whose lines all go becomes empty. An empty table gives no rows. Columns of docs with the
    names of these two are replaced.
    """
    names = [c for c in docs.columns if c not in (lines, gone)]
    ids = docs.agg(F.count("*"), F.count(key), F.count_distinct(key)).first()
    if ids[0] == ids[2]:
        base = docs.withColumn(f"{P}row", F.col(key))
    else:  # the key doesn't tell rows apart
        base = written(docs.withColumn(f"{P}row", F.monotonically_increasing_id()), "docs")
    rows = base.select(F.col(f"{P}row").alias("row"), F.col(key).alias("doc_id"), F.col(text).alias("text"))
    dropped = dropped_lines(rows, least)
    n_lines = F.coalesce(F.regexp_count(text, F.lit(LINE)), F.lit(0)).cast("long")
    base = base.select(*[F.col(f"`{c}`") for c in names], F.col(f"{P}row"), F.xxhash64(f"{P}row").alias(f"{P}hash"))
    # Only rows that may lose lines are shuffled.
    marked = Filter(dropped.select(F.xxhash64("row").alias("hash")), "hash").marked(base, f"{P}hash", f"{P}may")
    told = [*[F.col(f"`{c}`") for c in names], F.col(f"`{lines}`"), F.col(f"`{gone}`")]
    # Lines are counted in each branch, so that no text is matched twice.
    alone = marked.filter(~F.col(f"{P}may")).withColumns({lines: n_lines, gone: F.lit(0).cast("long")}).select(*told)
    # The small side is hashed, so the texts need no sorting.
    some = marked.filter(f"{P}may").join(dropped.select(F.col("row").alias(f"{P}row"), F.col("dropped").alias(f"{P}dropped")).hint("shuffle_hash"), f"{P}row", "left")
    others = [F.col(f"`{c}`") for c in names if c != text]
    cut = _cut(some.select(F.struct(*others, n_lines.alias(lines)).alias(f"{P}all"), F.col(text).alias(text), f"{P}dropped"))
    return alone.unionByName(cut.select(f"{P}all.*", text, F.col("n_dropped").alias(gone)).select(*told))
