"""Near-duplicate documents by ProbMinHash over weighted word shingles.

Texts that are equal word for word are one class. A class's shingles (five words each, weighted by 1 + ln count)
draw arrival times from Poisson processes of their weights; each of the signature's places keeps the shingle that
arrives first. A shingle stops once its next arrival cannot come before the latest place's, which is the early
termination. The share of equal places estimates the probability Jaccard similarity of two texts. Bands of places
give candidate pairs, which are verified by the exact Jaccard similarity of their shingle sets; as weights of
repeated shingles would hide such pairs, there are bands of equal weights as well. Verified links make components,
and of each the document with the smallest id stays.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import P, settle, written
from .similar import Filter, Similarity, join_heavy, linked_parts, may_hold, mixed, told_links, weight_of, with_texts

WORDS = 5
LEAST = 0.8
#: Bands of places: a pair of similarity 0.8 shares one with probability 0.998, one of 0.2 with 0.005.
BANDS, ROWS = 16, 5
#: Words whose texts are worked on at once; a longer text is worked on alone, whole.
CHUNK = 100_000
_U = np.uint64


def normalised(text: str | None) -> list[str]:
    return (text or "").lower().split()


class WordHashes(dict):
    """Hashes of words; forgets all when it holds too many."""

    MOST = 200_000

    def __missing__(self, word: str) -> int:
        if len(self) >= self.MOST:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(texts: list[list[str]], hashes: WordHashes, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of every shingle; a text of fewer words, but not none, is one shingle."""
    counts = np.fromiter(map(len, texts), np.int64, len(texts))
    flat = np.fromiter((hashes[w] for t in texts for w in t), _U, int(counts.sum()))
    starts = np.cumsum(counts) - counts
    n = np.where(counts >= words, counts - words + 1, (counts > 0).astype(np.int64))
    owner = np.repeat(np.arange(len(texts)), n)
    at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts, n)
    end = np.repeat(starts + counts, n)
    h = np.zeros(len(at), dtype=_U)
    for k in range(words):
        inside = at + k < end
        h = mixed(h * _U(3) + np.where(inside, flat[np.minimum(at + k, len(flat) - 1)], _U(k + 1))) if len(flat) else h
    return owner, h


def distinct(owner: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash, count), each hash of a text once, by text."""
    order = np.lexsort((h, owner))
    owner, h = owner[order], h[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (owner[1:] != owner[:-1]) | (h[1:] != h[:-1])
    at = np.flatnonzero(new)
    return owner[at], h[at], np.diff(np.append(at, len(h)))


def signatures(owner: np.ndarray, h: np.ndarray, weight: np.ndarray, texts: int, places: int = BANDS * ROWS) -> np.ndarray:
    """ProbMinHash: texts x places, the shingle that arrives first at each place. Texts without shingles get 0.

    All shingles take their first arrival, then those that still can win their second, and so on.
    """
    first = np.full(texts * places, np.inf)
    who = np.zeros(texts * places, dtype=_U)
    time, turn = np.zeros(len(h)), 0
    while len(h):
        draw = mixed(h + _U((2 * turn + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        time = time - np.log(((draw >> _U(11)).astype(np.float64) + 0.5) * 2.0**-53) / weight
        place = (mixed(draw + _U(0xD1B54A32D192ED03)) >> _U(33)).astype(np.int64) % places + owner * places
        np.minimum.at(first, place, time)
        won = first[place] == time
        who[place[won]] = h[won]
        latest = first.reshape(texts, places).max(1)
        on = time < latest[owner]
        owner, h, weight, time, turn = owner[on], h[on], weight[on], time[on], turn + 1
    return who.reshape(texts, places)


def band_keys(signature: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """texts x bands, signed 64-bit: a hash of the band's places and its number."""
    parts = signature.reshape(len(signature), bands, rows)
    h = np.broadcast_to(mixed(np.arange(1, bands + 1, dtype=_U)), (len(signature), bands))
    for k in range(rows):
        h = mixed(h * _U(3) + parts[:, :, k])
    return np.ascontiguousarray(h).view(np.int64)


def both_keys(owner: np.ndarray, h: np.ndarray, count: np.ndarray, texts: int) -> list[list[int]]:
    """Each text's distinct band keys: of equal weights, whose estimate is of the plain Jaccard similarity that
    accepts pairs, and of the weights 1 + ln count. They differ only where a shingle repeats."""
    keys = band_keys(signatures(owner, h, np.ones(len(h)), texts)).tolist()
    again = np.unique(owner[count > 1])
    on = np.isin(owner, again)
    weighted = band_keys(signatures(np.searchsorted(again, owner[on]), h[on], weight_of(count[on]), len(again)))
    for k, more in zip(again.tolist(), weighted.tolist(), strict=True):
        keys[k] = sorted({*keys[k], *more})
    return keys


def chunks(texts: list[list[str]], most: int = CHUNK) -> Iterator[tuple[int, int]]:
    start = words = 0
    for k, t in enumerate(texts):
        if words and words + len(t) > most:
            yield start, k
            start, words = k, 0
        words += len(t)
    if start < len(texts):
        yield start, len(texts)


def _own(sha: bytes, key: object) -> int:
    """Tells a row's copies apart by their keys."""
    return xxhash.xxh3_64_intdigest(sha + repr(key).encode()) - (1 << 63)


def sketched(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, sha, own, keys) of every row: the digest of its words and its band keys (none without words)."""
    kind = docs.schema[key].dataType
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("sha", T.BinaryType()), T.StructField("own", T.LongType()), T.StructField("keys", T.ArrayType(T.LongType()))])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle()
        hashes = WordHashes()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                ids, texts = part.column(0).to_pylist(), [normalised(x.as_py()) for x in part.column(1)]
                sha = [hashlib.sha256(" ".join(t).encode()).digest() for t in texts]
                keys = []
                for a, b in chunks(texts):
                    owner, h, count = distinct(*shingles(texts[a:b], hashes))
                    keys += [k if t else [] for k, t in zip(both_keys(owner, h, count, b - a), texts[a:b], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sha, pa.binary()), pa.array(list(map(_own, sha, ids)), pa.int64()), pa.array(keys, pa.list_(pa.int64()))], schema.names)

    return docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).mapInArrow(of, schema)


def bodies_of(wanted: DataFrame, docs: DataFrame, text: str, key: str) -> DataFrame:
    """(id, body), written, of the wanted (id, own): the words of a class, from the row that has its first key."""
    held = docs.sparkSession.sparkContext.broadcast(Filter(wanted, "own").array())

    def bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                body = [" ".join(normalised(x.as_py())) for x in part.column(1)]
                own = np.array([_own(hashlib.sha256(t.encode()).digest(), k) for t, k in zip(body, part.column(0).to_pylist(), strict=True)], dtype=np.int64)
                on = np.flatnonzero(may_hold(held.value, own))
                yield pa.RecordBatch.from_arrays([pa.array(own[on]), pa.array([body[k] for k in on], pa.string())], ["own", "body"])

    found = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).mapInArrow(bodies, "own long, body string")
    # Rows that repeat both text and key are one text here.
    return written(found.join(wanted, "own").groupBy("id").agg(F.first("body").alias("body")), "bodies")


def weighted(text: str, hashes: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, weights) of the distinct shingles of one text's words, sorted."""
    h = np.sort(shingles([text.split(" ")], hashes)[1])
    at = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    return h[at], weight_of(np.diff(np.append(at, len(h))))


def similarity(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray], least: float) -> float:
    """The larger of the plain and the probability Jaccard similarity of (hashes, weights), each hash once, sorted;
    0 if both are below `least`.

    The probability Jaccard similarity of shares p and q sums, over common hashes i, 1 / sum_j max(p_j / p_i, q_j / q_i).
    In order of q_j / p_j, the larger one is the first up to i and the second after it.
    """
    at = np.minimum(np.searchsorted(x[0], y[0]), len(x[0]) - 1)
    at2 = np.flatnonzero(x[0][at] == y[0])
    at = at[at2]
    plain = len(at) / (len(x[0]) + len(y[0]) - len(at))
    if plain >= least or not len(at):
        return plain if plain >= least else 0.0
    p, q = x[1] / x[1].sum(), y[1] / y[1].sum()
    pi, qi = p[at], q[at2]
    if np.minimum(pi, qi).sum() < least:  # which is a bound
        return 0.0
    order = np.argsort(qi / pi)
    pi, qi = pi[order], qi[order]
    # Hashes of x alone count by p everywhere, those of y alone by q.
    first, second = np.cumsum(pi) + (1 - pi.sum()), np.cumsum(qi[::-1])[::-1] - qi + (1 - qi.sum())
    probability = float((1 / (first / pi + second / qi)).sum())
    return probability if probability >= least else 0.0


def compared(pairs: DataFrame, bodies: DataFrame, least: float) -> DataFrame:
    """Of the written pairs (a, b), links (b, a), written, that connect those whose similarity() is at least
    `least`."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle()
        hashes = WordHashes()
        last, known, found = None, None, []

        for batch in batches:
            a, on = batch.column(0).to_pylist(), []
            for k in range(len(a)):
                if a[k] != last:
                    last, known = a[k], weighted(batch.column(2)[k].as_py(), hashes)
                on.append(similarity(known, weighted(batch.column(3)[k].as_py(), hashes), least) > 0)
            found.append((batch.column(0).to_numpy()[on], batch.column(1).to_numpy()[on]))
        yield from told_links(found, ["b", "a"])

    return written(with_texts(pairs, bodies).mapInArrow(of, "b long, a long"), "verified")


def classes_of(docs: DataFrame, text: str = "text", key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(rows, classes), written: rows (doc_id, row, sha); classes (id, sha, own, first, size, keys) of equal texts."""
    rows = written(sketched(docs, text, key).withColumn("row", F.monotonically_increasing_id()), "rows")
    best = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    heads = rows.groupBy("sha").agg(F.min(best).alias("best"), F.count("*").alias("size"))
    heads = heads.select("sha", "size", F.col("best.row").alias("id"), F.col("best.doc_id").alias("first"))
    heads = written(heads, "heads")
    classes = heads.join(rows.select(F.col("row").alias("id"), "own", "keys"), "id")
    return rows, written(classes, "classes")


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", least: float = LEAST) -> DataFrame:
    """One row for each row of docs: doc_id, class_id, class_size, kept.

    class_id is the smallest key of the documents that are linked, directly or through others, by a similarity() of
    `least` or more; the document with it stays. A null key counts as larger than any other; of rows that repeat
    key and text, one stays. Texts without words (null, empty) are one class; a text of fewer than five words is
    one shingle. An empty table gives no rows. Other columns are not read.
    """
    rows, classes = classes_of(docs, text, key)
    own = written(classes.select("id", "own"), "own")
    kept: list[DataFrame] = []

    def bodies(ids: DataFrame) -> DataFrame:
        return bodies_of(written(ids.join(own, "id"), "wanted"), docs, text, key)

    def verify(pairs: DataFrame) -> DataFrame:
        if not kept:  # the ids of later pairs are among those of the first
            kept.append(bodies(pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()))
        return compared(pairs, kept[0], least)

    parts = linked_parts(classes.select(F.array("id").alias("ids"), "keys"), Similarity(verify, lambda: kept[0], lambda bodies: shingles([x.split(" ") for x in bodies], WordHashes()), least, weighted=True))
    named = written(classes.select("id", "sha", "size", "first").join(parts, "id", "left").withColumn("part", F.coalesce("part", "id")), "named")
    best = F.struct(F.col("first").isNull().alias("none"), F.col("first"), F.col("id"))
    whole = written(named.groupBy("part").agg(F.min(best).alias("best"), F.sum("size").alias("class_size"), F.count("*").alias("n")), "whole")
    told = join_heavy(named.select("part", "sha", "size"), whole, "part", "n", named.count())
    told = written(told.select("sha", "size", "class_size", F.col("best.first").alias("class_id"), F.col("best.id").alias("stays")), "told")
    done = join_heavy(rows.select("sha", "doc_id", "row"), told, "sha", "size", rows.count())
    return done.select("doc_id", "class_id", "class_size", (F.col("row") == F.col("stays")).alias("kept"))


def deduplicate(docs: DataFrame, text: str = "text", key: str = "doc_id", least: float = LEAST) -> DataFrame:
    """The rows of docs, all columns, that stay; see near_duplicates()."""
    own = f"{P}key"
    rows, _, different = docs.agg(F.count("*"), F.count(key), F.count_distinct(key)).first()
    if rows == different:
        base = docs.withColumn(own, F.col(key))
    else:  # the key doesn't tell rows apart
        base = written(docs.withColumn(own, F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("key"), F.monotonically_increasing_id().alias("row"))), "docs")
    gone = near_duplicates(base, text, own, least).filter("NOT kept").select(F.col("doc_id").alias(own))
    return base.join(written(gone, "gone"), own, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
