"""Benchmark decontamination, in DataFrame functions only.

The benchmark's windows of consecutive normalised words are a hash set that is broadcast while it is small
(LARGEST_SET windows; a larger one is joined by a shuffle). Each document row yields its window hashes, they are
looked up, and every hit is verified word by word. Only hits, and the documents that have some, shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import P, written
from .similar import Filter

WINDOW = 10
#: Windows of the benchmark up to which their set is broadcast; about 150 bytes each.
LARGEST_SET = 200_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Everything that is no word character, before lower-casing.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """The words of a text in their own case; null has none."""
    return F.coalesce(F.array_remove(F.split(text, BETWEEN), ""), F.array().cast("array<string>"))


def _hashes(words: Column) -> Column:
    """Of each word. Words equal after lower-casing A-Z have equal hashes; the reverse is verified later."""
    return F.transform(words, lambda w: F.xxhash64(F.lower(w)))


def _exact(words: Column) -> Column:
    return F.translate(F.array_join(words, " "), UPPER, LOWER)


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW, text: str = "text", item: str = "item_id") -> DataFrame:
    """(length, hash, window text, item_ids): the windows of the items, one row for each distinct window.

    An item of fewer words than a window, but not none, is one window. Items with null ids are named "null".
    """
    items = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("null")).alias(f"{P}item"), words(F.col(text)).alias(f"{P}w")).filter(F.size(f"{P}w") > 0)
    n = F.least(F.size(f"{P}w"), F.lit(window))
    items = items.withColumn(f"{P}len", n).withColumn(f"{P}at", F.explode(F.sequence(F.lit(1), F.size(f"{P}w") - n + 1)))
    cut = F.expr(f"slice({P}w, {P}at, {P}len)")
    rows = items.select(f"{P}item", f"{P}len", F.xxhash64(_hashes(cut)).alias(f"{P}hash"), _exact(cut).alias(f"{P}text"))
    return rows.groupBy(f"{P}len", f"{P}hash", f"{P}text").agg(F.collect_set(f"{P}item").alias(f"{P}items"))


def _found(hashes: Column, n: int) -> Column:
    """(at, len, hash) of every window of n words, from the hashes of the words; at counts from 1."""
    at = F.when(F.size(hashes) >= n, F.sequence(F.lit(1), F.size(hashes) - (n - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.struct(i.alias("at"), F.lit(n).alias("len"), F.xxhash64(F.slice(hashes, i, n)).alias("hash")))


_HIT = "array<struct<at:int,len:int,hash:bigint>>"


def _looked_up(docs: DataFrame, windows: DataFrame, sizes: list[int], text: str, key: str, few: bool) -> DataFrame:
    """(key, text hash, hits), written, for each key and text some of whose windows have a benchmark window's hash.

    A window's row has its place and hash alone, so the cost grows with the words of a text. Of many windows, a
    bounded filter of their hashes lets the rest of the documents' ones pass before the two meet by a shuffle.
    """
    hashes = _hashes(words(F.col(text)))
    rows = docs.select(F.col(key).alias(f"{P}key"), F.xxhash64(F.col(text)).alias(f"{P}t"), hashes.alias(f"{P}h"))
    found = F.concat(F.array().cast(_HIT), *[_found(F.col(f"{P}h"), n) for n in sizes])
    flat = rows.select(f"{P}key", f"{P}t", F.explode(found).alias(f"{P}x"))
    flat = flat.select(f"{P}key", f"{P}t", f"{P}x", F.col(f"{P}x.len").alias(f"{P}len"), F.col(f"{P}x.hash").alias(f"{P}hash"))
    own = windows.select(f"{P}len", f"{P}hash").distinct()
    if few:
        own = F.broadcast(own)
    else:
        own = written(own, "hashes")
        flat = Filter(own, f"{P}hash").passed(flat, f"{P}hash")
    hits = flat.join(own, [f"{P}len", f"{P}hash"])
    return written(hits.groupBy(f"{P}key", f"{P}t").agg(F.collect_set(f"{P}x").alias(f"{P}hits")), "hits")


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text: str = "text", key: str = "doc_id", largest_set: int = LARGEST_SET) -> DataFrame:
    """One row for each row of docs: its key, n_words, n_hit, n_items, item_ids, spans and contaminated.

    A word inside any occurrence of a window is hit; spans are the merged runs of hit words, as (start, end) of
    word positions from 0, end excluded. Null and empty texts have no words and are clean; an empty benchmark
    leaves all clean; rows that repeat a key are told apart; a null key is kept.
    """
    windows = written(benchmark_windows(benchmark, window), "windows")
    lengths = windows.groupBy(f"{P}len").count().collect()  # at most `window` rows
    few = sum(r[1] for r in lengths) <= largest_set
    hits = _looked_up(docs, windows, sorted(r[0] for r in lengths), text, key, few)
    # Only rows that may have a hit are shuffled. Key and text hash need not tell rows apart: each row's hits are
    # verified against its own words.
    both = lambda k, t: F.xxhash64(k, t)
    rows = docs.select(F.col(key).alias(key), F.col(text).alias(f"{P}text"), F.xxhash64(F.col(text)).alias(f"{P}t"))
    rows = rows.withColumn(f"{P}both", both(key, f"{P}t"))
    rows = Filter(hits.select(both(f"{P}key", f"{P}t").alias(f"{P}both")), f"{P}both").marked(rows, f"{P}both", f"{P}may")
    none = [F.lit(0).cast("long").alias("n_hit"), F.lit(0).cast("long").alias("n_items"), F.array().cast("array<string>").alias("item_ids"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"), F.lit(False).alias("contaminated")]
    n_words = F.size(f"{P}w").cast("long").alias("n_words")
    clean = rows.filter(~F.col(f"{P}may")).select(key, F.size(words(F.col(f"{P}text"))).cast("long").alias("n_words"), *none)
    held = hits.withColumnRenamed(f"{P}t", f"{P}t2")
    some = rows.filter(f"{P}may").select(key, f"{P}t", f"{P}text").join(held, F.col(key).eqNullSafe(F.col(f"{P}key")) & (F.col(f"{P}t") == F.col(f"{P}t2")), "left")
    some = written(some.select(F.col(key).alias(key), words(F.col(f"{P}text")).alias(f"{P}w"), F.coalesce(f"{P}hits", F.array().cast(_HIT)).alias(f"{P}hits"), F.monotonically_increasing_id().alias(f"{P}row")), "candidates")
    shown = F.transform(f"{P}hits", lambda x: F.struct(x["at"].alias("at"), x["len"].alias("len"), x["hash"].alias("hash"), _exact(F.slice(F.col(f"{P}w"), x["at"], x["len"])).alias("text")))
    shown = some.select(f"{P}row", F.inline(shown)).select(f"{P}row", "at", *[F.col(c).alias(P + c) for c in ("len", "hash", "text")])
    verified = shown.join(F.broadcast(windows) if few else windows, [f"{P}len", f"{P}hash", f"{P}text"])
    places = verified.select(f"{P}row", (F.col("at") - 1).alias("start"), (F.col("at") - 1 + F.col(f"{P}len")).alias("end"), f"{P}items")
    # A run of hit words begins where no earlier window of the row reaches.
    before = Window.partitionBy(f"{P}row").orderBy("start", "end")
    reach = F.max("end").over(before.rowsBetween(Window.unboundedPreceding, -1))
    runs = places.withColumn(f"{P}new", F.when(reach >= F.col("start"), 0).otherwise(1)).withColumn(f"{P}run", F.sum(f"{P}new").over(before.rowsBetween(Window.unboundedPreceding, 0)))
    runs = runs.groupBy(f"{P}row", f"{P}run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.collect_set(f"{P}items").alias(f"{P}items"))
    told = runs.groupBy(f"{P}row").agg(
        F.sum(F.col("end") - F.col("start")).cast("long").alias("n_hit"),
        F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.flatten(F.collect_list(f"{P}items"))))).alias("item_ids"),
    )
    told = some.select(key, f"{P}row", n_words).join(told, f"{P}row", "left").select(
        key,
        "n_words",
        F.coalesce("n_hit", none[0]).alias("n_hit"),
        F.coalesce(F.size("item_ids"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("item_ids", none[2]).alias("item_ids"),
        F.coalesce("spans", none[3]).alias("spans"),
        F.col("spans").isNotNull().alias("contaminated"),
    )
    return clean.unionByName(told)


def decontaminate(docs: DataFrame, benchmark: DataFrame, mode: str = "document", window: int = WINDOW, text: str = "text", key: str = "doc_id") -> DataFrame:
    """docs, all columns, without its contaminated documents (mode "document") or without their hit words ("span").

    In "span", the words of each hit span, and what stands between them, go from the text; the remaining pieces
    are joined as they stand. Where the key doesn't tell rows apart, they get one of their own, so null and repeated
    keys are safe. Only rows that may be contaminated are shuffled.
    """
    rows, _, different = docs.agg(F.count("*"), F.count(key), F.count_distinct(key)).first()
    if rows == different:
        base = docs.withColumn(f"{P}own", F.col(key))
    else:
        base = written(docs.withColumn(f"{P}own", F.monotonically_increasing_id()), "docs")
    told = written(scan(base, benchmark, window, text, f"{P}own").filter("contaminated").select(f"{P}own", F.col("spans").alias(f"{P}spans")), "told")
    base = base.withColumn(f"{P}hash", F.xxhash64(f"{P}own"))
    base = Filter(told.select(F.xxhash64(f"{P}own").alias("hash")), "hash").marked(base, f"{P}hash", f"{P}may")
    own = [F.col(f"`{c}`") for c in docs.columns]
    clean, base = base.filter(~F.col(f"{P}may")).select(*own), base.filter(f"{P}may")
    if mode == "document":
        return clean.unionByName(base.join(told, f"{P}own", "left_anti").select(*own))
    ends = F.regexp_extract_all(F.col(text), F.lit(r"([^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+|" + BETWEEN + ")"), F.lit(1))
    first = F.when(F.element_at(ends, 1).rlike(BETWEEN), 1).otherwise(0)
    base = base.join(told, f"{P}own", "left").withColumn(f"{P}p", ends).withColumn(f"{P}first", F.when(F.size(f"{P}p") > 0, first).otherwise(0))
    # Word k of the text is piece 2 k + first of the pieces, which are words and what stands between, in turn. What
    # stands between two spans stays, from after the one to before the other.
    spans, size = F.col(f"{P}spans"), F.size(f"{P}p")
    edges = F.concat(F.array(F.lit(0)), F.transform(spans, lambda s: 2 * (s["end"] - 1) + F.col(f"{P}first") + 1))
    upto = F.concat(F.transform(spans, lambda s: 2 * s["start"] + F.col(f"{P}first")), F.array(size))
    kept = F.transform(F.arrays_zip(edges.alias("a"), upto.alias("b")), lambda x: F.array_join(F.slice(F.col(f"{P}p"), x["a"] + 1, F.greatest(x["b"] - x["a"], F.lit(0))), ""))
    cut = F.when(spans.isNull(), F.col(text)).otherwise(F.array_join(kept, ""))
    return clean.unionByName(base.withColumn(text, cut).select(*own))
