"""What the near-duplicate operators share: bounded filters, joins with heavy keys, candidate pairs from bands,
and distributed union-find."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import P, bit, bucket, settle, tasks, written

#: Most bits of a filter: 8 MB where it is broadcast.
MOST_BITS = 1 << 26
#: A key with at least a HEAVY-th of all rows is heavy; so there are at most HEAVY heavy keys.
HEAVY = 1000
#: Ids of a key that all others of the key are compared with, if its least id does not link them all.
PIVOTS = 4
#: Band keys that a task groups before it sends them on, and ids of a key from which it sends one of them only.
FLUSH, CROWD = 1 << 18, 64
#: Bins in which the frequencies of shingles are counted, to compare the rarest ones first: two tables, of which the
#: lesser count holds. A table has BINS / 2.
BINS, BLOCKS = 1 << 23, 64
#: The level, see _rarest(), of a shingle that was counted once.
ONCE = 8
#: Longs of a set's marks, see _marks().
MARKS = 32
#: Shingles sent before each one of a set's rarest, see _shared().
BEFORE = 2
#: Links that one task contracts at once, 16 bytes each.
PER_TASK = 1_000_000
_U = np.uint64


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: each input bit moves about half of the output bits."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Filter:
    """A bitmap of the long column of a written table, of bounded size. A miss is certain, a hit is not."""

    def __init__(self, keys: DataFrame, column: str, most_bits: int = MOST_BITS):
        self.bits = min(most_bits, max(1 << 12, 1 << (16 * keys.count()).bit_length()))
        at = self._at(F.col(column))
        self.words = written(keys.groupBy(F.floor(at / 64).cast("long").alias(f"{P}f")).agg(F.bit_or(bit(at % 64)).alias(f"{P}b")), "filter")

    def _at(self, key: Column) -> Column:
        return F.pmod(key.bitwiseXOR(F.call_function("shiftrightunsigned", key, F.lit(29))), F.lit(self.bits).cast("long"))

    def marked(self, df: DataFrame, column: str, flag: str) -> DataFrame:
        """df with flag: whether the column may be in the filter, false for null. One broadcast join with at most
        MOST_BITS / 64 small rows."""
        at = self._at(F.col(column))
        df = df.withColumn(f"{P}f", F.floor(at / 64).cast("long")).withColumn(f"{P}n", (at % 64).cast("int"))
        df = df.join(F.broadcast(self.words), f"{P}f", "left")
        hit = F.call_function("shiftrightunsigned", F.col(f"{P}b"), F.col(f"{P}n")).bitwiseAND(F.lit(1)) == 1
        return df.withColumn(flag, F.coalesce(hit, F.lit(False))).drop(f"{P}f", f"{P}n", f"{P}b")

    def passed(self, df: DataFrame, column: str) -> DataFrame:
        """The rows of df that may be in the filter."""
        return self.marked(df, column, f"{P}may").filter(f"{P}may").drop(f"{P}may")

    def array(self) -> np.ndarray:
        """The bitmap for Python workers, of self.bits bits; see may_hold()."""
        words = np.zeros(self.bits // 64, dtype=np.uint64)
        rows = self.words.toPandas()
        words[rows[f"{P}f"].to_numpy()] = rows[f"{P}b"].to_numpy().astype(np.int64).view(np.uint64)
        return words


def may_hold(words: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which of the signed 64-bit keys may be in a filter's array."""
    u = keys.astype(np.int64).view(np.uint64)
    at = (u ^ (u >> np.uint64(29))) & np.uint64(len(words) * 64 - 1)  # bits is a power of two
    return ((words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1)).astype(bool)


def join_heavy(rows: DataFrame, table: DataFrame, on: str, size: str, total: int) -> DataFrame:
    """rows inner joined with a written table that has one row for each key; size: how many rows have the key.

    Heavy keys, of which there are at most HEAVY, are broadcast; so no task gets the rows of a heavy key.
    """
    limit = max(100, total // HEAVY)
    if (table.agg(F.max(size)).first()[0] or 0) <= limit:
        return rows.join(table, on)
    heavy = table.filter(F.col(size) > limit)
    with_heavy = rows.join(F.broadcast(heavy), on, "left")
    columns = [*rows.columns, *[c for c in table.columns if c != on]]
    light = with_heavy.filter(F.col(size).isNull()).select(*rows.columns).join(table.filter(F.col(size) <= limit), on)
    return with_heavy.filter(F.col(size).isNotNull()).select(*columns).unionByName(light.select(*columns))


def with_texts(pairs: DataFrame, bodies: DataFrame) -> DataFrame:
    """(a, b, text_a, text_b) of a written table of pairs (a, b).

    An a of many pairs (at most 10 * HEAVY are so) has its text dealt out with its pairs to as many keys as it
    needs, so that no task gets all of them.
    """
    most = max(1000, pairs.count() // (10 * HEAVY))
    many = written(pairs.groupBy("a").agg(F.count("*").alias("n")).filter(f"n > {most}").select("a", F.ceil(F.col("n") / most).cast("int").alias("n")), "many")
    own = pairs.join(bodies.select(F.col("id").alias("b"), F.col("body").alias("text_b")), "b")
    texts = bodies.select(F.col("id").alias("a"), F.col("body").alias("text_a"))
    if many.isEmpty():
        return own.join(texts, "a").select("a", "b", "text_a", "text_b")
    own = own.join(F.broadcast(many), "a", "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("b"), F.col("n")), F.lit(0)).cast("int"))
    texts = texts.join(F.broadcast(many), "a", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("n", F.lit(1)) - 1)))
    return own.join(texts.drop("n"), ["a", "salt"]).select("a", "b", "text_a", "text_b")


def _bins(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bins of hashes in both tables."""
    half = _U(BINS // 2)
    return (h & (half - _U(1))).astype(np.int64), (((h >> _U(32)) & (half - _U(1))) + half).astype(np.int64)


def _marks(owner: np.ndarray, h: np.ndarray, sets: int) -> np.ndarray:
    """sets x MARKS longs: of each set of distinct hashes, a bit for each of 64 * MARKS bins, set if it holds an odd
    number of the set's hashes. So two sets differ in at least as many hashes as in bits."""
    bits = 64 * MARKS
    at = owner * bits + ((h >> _U(40)) & _U(bits - 1)).astype(np.int64)
    odd = (np.bincount(at, minlength=sets * bits) & 1).astype(np.uint8)
    return np.packbits(odd.reshape(sets, bits), axis=1, bitorder="little").view(np.int64)


def _runs(k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, lengths) of the runs of equal values."""
    starts = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, dtype=np.int64)
    return starts, np.diff(np.append(starts, len(k)))


def members_of(sketch: DataFrame) -> DataFrame:
    """(key, id, low), written: the ids of each key that several ids have, each with a smaller id of the key.

    sketch: rows (ids, keys) of longs, with the same number of keys for each of a row's ids, in their order. low is
    the key's least id, or, of a key that is crowded where it is read, the least there, which has a row with the
    key's least; so the links (low, id) of a key hang together, and no task gets all ids of a crowded key.
    """
    spots = 4 * tasks(sketch.sparkSession)

    def sent(keys: np.ndarray, ids: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = np.argsort(keys)
        keys, ids = keys[order], ids[order]
        starts, lengths = _runs(keys)
        crowded = np.flatnonzero(lengths > CROWD)
        keep = np.ones(len(keys), dtype=bool)
        rows: list[tuple[int, int, bytes]] = []
        for at, n in zip(starts[crowded].tolist(), lengths[crowded].tolist(), strict=True):
            own = np.unique(ids[at : at + n])
            keep[at : at + n] = False
            keep[at], ids[at] = True, own[0]
            if len(own) > 1:
                rows.append((int(own[-1]) % spots, 1, np.concatenate([keys[at : at + 1], own]).tobytes()))
        keys, ids = keys[keep], ids[keep]
        spot = (mixed(keys.view(_U)) % _U(spots)).astype(np.int32)
        order = np.argsort(spot)
        keys, ids, spot = keys[order], ids[order], spot[order]
        for at, n in zip(*(x.tolist() for x in _runs(spot)), strict=True):
            rows.append((int(spot[at]), 0, np.concatenate([keys[at : at + n], ids[at : at + n]]).tobytes()))
        spot_, kind, data = zip(*rows, strict=True) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(spot_, pa.int32()), pa.array(kind, pa.int32()), pa.array(data, pa.binary())], ["spot", "kind", "data"])

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle()
        held, size = [], 0
        for batch in batches:
            ids, keys = batch.column(0), batch.column(1)
            n = np.diff(ids.offsets.to_numpy()), np.diff(keys.offsets.to_numpy())
            each = np.repeat(n[1] // np.maximum(n[0], 1), n[0])
            held.append((keys.flatten().to_numpy(), np.repeat(ids.flatten().to_numpy(), each)))
            size += len(held[-1][0])
            if size >= FLUSH:
                yield from sent(*map(np.concatenate, zip(*held, strict=True)))
                held, size = [], 0
        if size:
            yield from sent(*map(np.concatenate, zip(*held, strict=True)))

    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle()
        keys, ids = [], []

        def told(k: np.ndarray, i: np.ndarray, low: np.ndarray) -> Iterator[pa.RecordBatch]:
            for at in range(0, len(k), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(x[at : at + 100_000]) for x in (k, i, low)], ["key", "id", "low"])

        for batch in batches:
            for kind, data in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                x = np.frombuffer(data.as_buffer(), dtype=np.int64)
                if kind:
                    yield from told(np.repeat(x[:1], len(x) - 1), x[1:], np.repeat(x[1:2], len(x) - 1))
                else:
                    keys.append(x[: len(x) // 2])
                    ids.append(x[len(x) // 2 :])
        if keys:
            k, i = np.concatenate(keys), np.concatenate(ids)
            order = np.argsort(k)
            k, i = k[order], i[order]
            starts, lengths = _runs(k)
            on = np.repeat(lengths > 1, lengths)
            k, i = k[on], i[on]
            order = np.lexsort((i, k))
            k, i = k[order], i[order]
            new = np.ones(len(k), dtype=bool)
            new[1:] = (k[1:] != k[:-1]) | (i[1:] != i[:-1])
            k, i = k[new], i[new]
            starts, lengths = _runs(k)
            low, several = np.repeat(i[starts], lengths), np.repeat(lengths > 1, lengths)
            yield from told(k[several], i[several], low[several])

    sent_rows = sketch.select("ids", "keys").filter("size(keys) > 0").mapInArrow(dealt, "spot int, kind int, data binary")
    return written(sent_rows.repartition(tasks(sketch.sparkSession), "spot").mapInArrow(grouped, "key long, id long, low long"), "members")


@dataclass
class Similarity:
    """What an operator compares: `verify` gives, of pairs (a, b), the similar ones; `bodies` gives (id, body) of the
    ids; `shingles` gives, for a list of bodies, (owner, hash) of each shingle; `least` is the similarity that links;
    `weighted` whether repeated shingles weigh more in it."""

    verify: Callable[[DataFrame], DataFrame]
    bodies: Callable[[], DataFrame]
    shingles: Callable[[list[str]], tuple[np.ndarray, np.ndarray]]
    least: float
    weighted: bool = False


def weight_of(count: np.ndarray) -> np.ndarray:
    """The weight of a shingle that a text holds so often."""
    return 1 + np.log(count)


def _split(members: DataFrame, parts: DataFrame) -> DataFrame:
    """(key, id, part, rows), written, of the keys that are not one component."""
    named = written(members.select("key", "id").join(parts, "id", "left").select("key", "id", F.coalesce("part", "id").alias("part")), "named")
    held = named.groupBy("key").agg(F.min("part").alias("first"), F.max("part").alias("last"), F.count("*").alias("rows"))
    held = written(held.filter("first < last").select("key", "rows"), "held")
    return written(join_heavy(named, held, "key", "rows", named.count()), "split")


def linked_parts(sketch: DataFrame, like: Similarity) -> DataFrame:
    """(id, part) of the ids that are linked, from rows (ids, keys), see members_of(); no link within a key is lost.

    Each key's ids are compared with its least id. In keys that are not one component then, all are compared with
    PIVOTS of them, those that share most keys with others and so are most alike to all. Of keys that are still
    not one component, the ids are compared across components if they share one of their rarest shingles, see
    _rest().
    """
    members = members_of(sketch)
    pairs = written(members.filter("id != low").select(F.col("low").alias("a"), F.col("id").alias("b")).distinct(), "pairs")
    parts = components(like.verify(pairs))
    split = _split(members, parts)
    if split.isEmpty():
        return parts
    order = F.struct("w", -F.col("id"))
    weighed = split.join(split.groupBy("id").agg(F.sum("rows").alias("w")), "id")
    pivots = weighed.groupBy("key").agg(*[F.max_by(F.struct("id", "part"), F.when(bucket(PIVOTS, F.col("id")) == k, order)).alias(f"p{k}") for k in range(PIVOTS)], F.first("rows").alias("size"))
    pivots = written(pivots.select("key", "size", F.array_compact(F.array(*[f"p{k}" for k in range(PIVOTS)])).alias("pivots")), "pivots")
    second = join_heavy(split.select("key", "id", "part"), pivots, "key", "size", split.count()).select("id", "part", F.explode("pivots").alias("pivot")).filter("part != pivot.part")
    second = written(second.select(F.least("id", "pivot.id").alias("a"), F.greatest("id", "pivot.id").alias("b")).distinct().join(pairs, ["a", "b"], "left_anti"), "second")
    parts = components(_edges(parts).unionByName(like.verify(second)))
    split = _split(members, parts)
    if split.isEmpty():
        return parts
    return components(_edges(parts).unionByName(like.verify(_rest(split, like))))


def _edges(parts: DataFrame) -> DataFrame:
    return parts.filter("id != part").select(F.col("id").alias("b"), F.col("part").alias("a"))


def _rest(split: DataFrame, like: Similarity) -> DataFrame:
    """The pairs (a, b), written, of ids of different components that can be similar: those that share one of their
    rarest shingles, see _rarest(), in a place that allows it, and whose marks don't differ too much.

    Two sets may differ in (1 - least) / (1 + least) of n + m shingles, and differ in no fewer than in marks. Marks
    are looked up for pairs, as they are too wide to be sent with every shingle.
    """
    first, least = _rarest(split, like), like.least
    pairs = written(_shared(first, least).distinct(), "shared")
    both = with_texts(pairs, first.select("id", F.struct("n", "varied", "marks").alias("body")))
    differ = sum((F.bit_count(F.col("text_a.marks")[k].bitwiseXOR(F.col("text_b.marks")[k])) for k in range(MARKS)), F.lit(0))
    close = differ <= (1 - least) / (1 + least) * (F.col("text_a.n") + F.col("text_b.n")) + 1e-6
    return written(both.filter(F.col("text_a.varied") | F.col("text_b.varied") | close).select("a", "b"), "rest")


def _shared(first: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) of different components that share a shingle of those that _rarest() gives, hardly any of them
    repeatedly: a shingle gives no pair that also shares one of the BEFORE ones ahead of it in both sets. The first
    shingle that a pair shares always gives it."""
    ahead = [f"before{k}" for k in range(1, BEFORE + 1)]
    y = first.select("id", "part", "outside", "n", "varied", F.inline("first"))
    x = first.filter("outside").select("id", "part", "n", "varied", F.inline("first"))
    y = y.select("token", *[F.col(c).alias(f"{c}_2") for c in y.columns if c != "token"])
    shares = F.least(F.col("n") - F.col("place"), F.col("n_2") - F.col("place_2")) + 1 >= least / (1 + least) * (F.col("n") + F.col("n_2")) - 1e-6
    lengths = F.least("n", "n_2") >= least * F.greatest("n", "n_2") - 1e-6
    weighted = (F.col("varied") | F.col("varied_2")) & (F.greatest("mass", "mass_2") <= 1 - least + 1e-5)
    once = ~F.col("outside_2") | (F.col("id") < F.col("id_2"))
    again = F.lit(False)
    for a in ahead:
        for b in ahead:
            again = again | F.coalesce(F.col(a) == F.col(f"{b}_2"), F.lit(False))
    found = x.join(y, "token").filter((F.col("part") != F.col("part_2")) & once & ((shares & lengths) | weighted) & ~again)
    return found.select(F.least("id", "id_2").alias("a"), F.greatest("id", "id_2").alias("b"))


def _rarest(split: DataFrame, like: Similarity) -> DataFrame:
    """(id, part, outside, n, varied, marks, first), written, of the ids: first are the rarest shingles, those that
    prefix filtering needs, in their order.

    Two sets of n and m shingles with a Jaccard similarity of `least` share at least least / (1 + least) of n + m. So,
    with all shingles in one order, the first one that they share has at most n - least * n others before it. Of
    weighted shingles, a probability Jaccard similarity of `least` is at most the sum of the lesser shares, so
    shingles of at most 1 - least of all weight stand before it. The order is by frequency, counted in
    bins: common shingles are hardly ever among the first. Any order loses nothing. A bin counts no shingle less often
    than it stands, so one whose bin has a count of one is shared by no two sets, and isn't sent. One of each
    pair is outside of a reference component of a key.
    """
    spark, least, shingles, weighted = split.sparkSession, like.least, like.shingles, like.weighted
    refs = split.groupBy("key", "part").agg(F.count("*").alias("c"), F.first("rows").alias("size")).groupBy("key")
    refs = written(refs.agg(F.max_by("part", F.struct("c", -F.col("part"))).alias("ref"), F.first("size").alias("size")), "refs")
    ids = join_heavy(split.select("key", "id", "part"), refs, "key", "size", split.count())
    ids = ids.groupBy("id", "part").agg(F.max(F.col("part") != F.col("ref")).alias("outside"))
    texts = written(like.bodies().join(ids, "id").select("id", "part", "outside", "body"), "apart")
    block = BINS // BLOCKS

    def some(bodies: list[str]) -> Iterator[tuple[int, int]]:
        at = size = 0
        for k, x in enumerate(bodies):
            size += len(x)
            if size > 200_000 or k - at > 2_000:
                yield at, k + 1
                at, size = k + 1, 0
        if at < len(bodies):
            yield at, len(bodies)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle()
        found = np.zeros(BINS, dtype=np.uint32)
        for batch in batches:
            bodies = batch.column(0).to_pylist()
            for a, b in some(bodies):
                for at in _bins(shingles(bodies[a:b])[1]):
                    np.add.at(found, at, np.uint32(1))
        for k in range(BLOCKS):
            at = np.flatnonzero(found[k * block : (k + 1) * block])
            if len(at):
                data = np.concatenate([at.astype(np.uint32), found[k * block + at]]).tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([data], pa.binary())], ["block", "data"])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle()
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                x = np.frombuffer(data.as_buffer(), dtype=np.uint32)
                own = sums.setdefault(k, np.zeros(block, dtype=np.int64))
                own[x[: len(x) // 2].astype(np.int64)] += x[len(x) // 2 :].astype(np.int64)
        for k, own in sums.items():
            # Eight steps for each doubling are fine enough, and one byte.
            level = np.minimum(255, np.round(8 * np.log2(own + 1))).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([level.tobytes()], pa.binary())], ["block", "data"])

    levels = np.zeros(BINS, dtype=np.uint8)  # 8 MB, whatever the input
    for r in texts.select("body").mapInArrow(counted, "block int, data binary").repartition(BLOCKS, "block").mapInArrow(summed, "block int, data binary").collect():
        levels[r.block * block : (r.block + 1) * block] = np.frombuffer(r.data, dtype=np.uint8)
    sent = spark.sparkContext.broadcast(levels)
    schema = "id long, part long, outside boolean, n long, varied boolean, marks array<long>, first array<struct<token: long, place: int, mass: float, " + ", ".join(f"before{k}: long" for k in range(1, BEFORE + 1)) + ">>"
    schema_names = ["id", "part", "outside", "n", "varied", "marks", "first"]
    ahead = [f"before{k}" for k in range(1, BEFORE + 1)]
    one = pa.list_(pa.struct([("token", pa.int64()), ("place", pa.int32()), ("mass", pa.float32()), *[(c, pa.int64()) for c in ahead]]))

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle()
        for batch in batches:
            bodies = batch.column(3).to_pylist()
            for a, b in some(bodies):
                owner, h = shingles(bodies[a:b])
                first, second = _bins(h)
                level = np.minimum(sent.value[first], sent.value[second]).astype(_U)
                by = np.argsort((owner.astype(_U) << _U(48)) | (level << _U(40)) | (h >> _U(24)))
                owner, h = owner[by], h[by]
                at = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])])) if len(h) else by
                count = np.diff(np.append(at, len(h)))
                owner, h, several = owner[at], h[at], level[by][at] > ONCE
                varied = np.zeros(b - a, dtype=bool)
                varied[owner[count > 1]] = weighted
                weight = weight_of(count) if weighted else np.ones(len(h))
                marks = _marks(owner, h, b - a)
                n = np.bincount(owner, minlength=b - a)
                start = np.cumsum(n) - n
                place = np.arange(len(owner)) - start[owner]
                total = np.bincount(owner, weight, b - a)
                upto = np.cumsum(weight) - weight
                mass = (upto - upto[start[owner]]) / total[owner] if len(owner) else upto
                # One more than needed, as hashes of equal rank and upper bits may stand in either order.
                keep = several & ((place <= n[owner] * (1 - least) + 1) | (varied[owner] & (mass <= 1 - least + 1e-6)))
                ends = np.cumsum(np.bincount(owner[keep], minlength=b - a)).astype(np.int32)
                token, by = h[keep].view(np.int64), owner[keep]
                before = []
                for k in range(1, BEFORE + 1):
                    none = np.ones(len(by), dtype=bool)
                    none[k:] = by[k:] != by[:-k]
                    before.append(pa.array(np.roll(token, k), mask=none))
                flat = pa.StructArray.from_arrays([pa.array(token), pa.array(place[keep].astype(np.int32)), pa.array(mass[keep].astype(np.float32)), *before], ["token", "place", "mass", *ahead])
                told = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), flat)
                bits = pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1) * MARKS, pa.int32()), pa.array(marks.ravel()))
                own = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), own.column(2), pa.array(n.astype(np.int64)), pa.array(varied), bits, told.cast(one)], schema_names)

    return written(texts.select("id", "part", "outside", "body").mapInArrow(prefixes, schema), "prefixes")


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, least id of each one's component) of the edges (u, v), for ids that aren't the least."""
    ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    u, v = at[: len(u)], at[len(u) :]
    root = np.arange(len(ids))
    while True:
        a, b = root[u], root[v]
        apart = a != b
        if not apart.any():
            break
        np.minimum.at(root, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while True:
            new = root[root]
            if (new == root).all():
                break
            root = new
    own = np.flatnonzero(root != np.arange(len(ids)))
    return ids[own], ids[root[own]]


def told_links(found: list[tuple[np.ndarray, np.ndarray]], names: list[str]) -> Iterator[pa.RecordBatch]:
    """A task's links, as links to the least ids of the components that they make."""
    if found:
        own, root = forest(*map(np.concatenate, zip(*found, strict=True)))
        for k in range(0, len(own), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(own[k : k + 100_000]), pa.array(root[k : k + 100_000])], names)


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    settle()
    yield from told_links([(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches], ["u", "v"])


def components(links: DataFrame, per_task: int = PER_TASK, rounds: int = 60) -> DataFrame:
    """(id, part) of every id of the links, pairs of ids in either order, written: part is the least id of its component.

    Distributed union-find: tasks replace the links that they have by links to the least ids of the components that
    these make. As many tasks are used as hold `per_task` links each. While these are several, links meet by their
    larger id, so an id has one link for each task at most, however many it had. Once each id has one link, to a
    smaller one, these are trees; their few inner nodes find their roots by doubling, and all ids look up the root
    of the node they are linked to.
    """
    a, b = links.columns
    e = written(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u != v"), "links")
    count = e.count()
    for _ in range(rounds):
        if count <= per_task:
            e = written(e.coalesce(1).mapInArrow(_contracted, "u long, v long"), "forest")
            ends = e.select(F.col("v").alias("id"), F.col("v").alias("part")).distinct()
            return written(e.select(F.col("u").alias("id"), F.col("v").alias("part")).unionByName(ends), "parts")
        e = written(e.repartition("u").mapInArrow(_contracted, "u long, v long"), "forest")
        count, different = e.agg(F.count("*"), F.count_distinct("u")).first()
        if count == different:
            break
    else:
        raise RuntimeError("union-find did not settle")
    tops = e.groupBy("v").agg(F.count("*").alias("n")).join(e.select(F.col("u").alias("v"), F.col("v").alias("top")), "v", "left")
    tops = written(tops.select("v", "n", F.coalesce("top", "v").alias("top")), "tops")
    for _ in range(rounds):
        inner = tops.filter("top != v").select(F.col("v").alias("top"), F.col("top").alias("next"))
        deeper = tops.join(inner, "top", "left").select("v", "n", F.coalesce("next", "top").alias("top"), F.col("next").isNotNull().alias("moved"))
        deeper = written(deeper, "tops")
        if not deeper.agg(F.max("moved")).first()[0]:
            break
        tops = deeper.drop("moved")
    all_ids = join_heavy(e, tops, "v", "n", count).select(F.col("u").alias("id"), F.col("top").alias("part"))
    return written(all_ids.unionByName(tops.filter("top = v").select(F.col("v").alias("id"), F.col("top").alias("part"))), "parts")
