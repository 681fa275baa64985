"""Exact deduplication by two-pass Bloom filtering, in DataFrame functions only.

Pass 1 inserts each row's hash into a blocked Bloom filter: a hash sets three bits of one 64-bit word. A word
whose insertions set disjoint bits holds no repeated hash; any other word is suspicious. Pass 2 tests each row
against a second, bounded filter of the suspicious words. Rows that miss it have no equal and pass straight
through; only the rest shuffle, by their SHA-256, and are grouped exactly. False hits cost a shuffle of one
small row, never a wrong result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import P, bit, written

#: Words of the first filter per row.
WORDS_PER_ROW = 4
#: Most bits of the second filter: its table has at most a 64th as many rows of 12 bytes, so it can be broadcast.
MOST_BITS = 1 << 25
#: A text that at least a HEAVY-th of all rows share is a heavy group; so there are at most HEAVY of them.
HEAVY = 1000


def normalised(text: Column) -> Column:
    """Every run of ASCII white space as one space; null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def text_sha256(text: Column) -> Column:
    return F.sha2(normalised(text).cast("binary"), 256)


def _mask(sha: Column) -> Column:
    h = F.xxhash64(sha, F.lit(1))
    at = [F.call_function("shiftrightunsigned", h, F.lit(6 * k)).bitwiseAND(F.lit(63)) for k in range(3)]
    return bit(at[0]).bitwiseOR(bit(at[1])).bitwiseOR(bit(at[2]))


def _word(sha: Column, words: int) -> Column:
    return F.pmod(F.xxhash64(sha), F.lit(words).cast("long"))


def _pow2(n: int, least: int, most: int) -> int:
    return min(most, max(least, 1 << max(0, n - 1).bit_length()))


class RepeatFilter:
    """The two filters over the hash column ``sha`` of a written table."""

    def __init__(self, prints: DataFrame, sha: str, most_bits: int = MOST_BITS):
        self.words = _pow2(WORDS_PER_ROW * prints.count(), 64, 1 << 62)
        seen = prints.select(_word(F.col(sha), self.words).alias(f"{P}w"), _mask(F.col(sha)).alias(f"{P}m")).groupBy(f"{P}w")
        seen = seen.agg(F.bit_or(f"{P}m").alias(f"{P}o"), F.sum(F.bit_count(f"{P}m").cast("long")).alias(f"{P}s"))
        suspicious = written(seen.filter(F.bit_count(f"{P}o") != F.col(f"{P}s")).select(f"{P}w"), "suspicious")
        self.bits = _pow2(16 * suspicious.count(), 1 << 10, most_bits)
        at = self._at(F.col(f"{P}w"))
        self.filter = suspicious.groupBy(F.floor(at / 64).cast("long").alias(f"{P}f")).agg(F.bit_or(bit(at % 64)).alias(f"{P}b"))

    def _at(self, word: Column) -> Column:
        return F.pmod(F.xxhash64(word), F.lit(self.bits).cast("long"))

    def marked(self, df: DataFrame, sha: str, flag: str) -> DataFrame:
        """df with flag: whether the hash may be repeated. One broadcast join with at most MOST_BITS / 64 small rows."""
        at = self._at(_word(F.col(sha), self.words))
        df = df.withColumn(f"{P}f", F.floor(at / 64).cast("long")).withColumn(f"{P}n", (at % 64).cast("int"))
        df = df.join(F.broadcast(self.filter), f"{P}f", "left")
        hit = F.call_function("shiftrightunsigned", F.coalesce(f"{P}b", F.lit(0).cast("long")), F.col(f"{P}n")).bitwiseAND(F.lit(1)) == 1
        return df.withColumn(flag, hit).drop(f"{P}f", f"{P}n", f"{P}b")


def fingerprints(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, row, text_sha256) of every row, written once: texts are read and normalised a single time."""
    rows = df.select(F.col(key).alias("doc_id"), F.monotonically_increasing_id().alias(f"{P}row"), text_sha256(F.col(text)).alias("text_sha256"))
    return written(rows, "prints")


def duplicate_groups(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row for each row of df: doc_id, keep_id, group_size, kept, text_sha256.

    Null text counts as empty. Of equal texts, the row with the smallest key stays; a null key counts as larger
    than any other; of rows with the same key and text, one stays. An empty table gives no rows. Other columns
    of df are not read.
    """
    prints = fingerprints(df, text, key)
    may = RepeatFilter(prints, "text_sha256")
    marked = may.marked(prints, "text_sha256", f"{P}may")
    alone = marked.filter(~F.col(f"{P}may")).select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256"
    )
    rows = marked.filter(f"{P}may").drop(f"{P}may")
    # Partial aggregation leaves one row for each text and task, however large a group is.
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", f"{P}row"))
    groups = rows.groupBy("text_sha256").agg(first.alias(f"{P}first"), F.count("*").alias("group_size"))
    groups = written(groups.select("text_sha256", "group_size", F.col(f"{P}first.doc_id").alias("keep_id"), F.col(f"{P}first.{P}row").alias(f"{P}stays")), "groups")
    heavy = max(2, prints.count() // HEAVY)
    big = F.broadcast(groups.filter(F.col("group_size") > heavy))  # at most HEAVY rows
    small = groups.filter(F.col("group_size") <= heavy)
    with_big = rows.join(big, "text_sha256", "left")
    told = ["doc_id", "keep_id", "group_size", (F.col(f"{P}stays") == F.col(f"{P}row")).alias("kept"), "text_sha256"]
    in_big = with_big.filter(F.col("group_size").isNotNull()).select(*told)
    in_small = with_big.filter(F.col("group_size").isNull()).select("doc_id", f"{P}row", "text_sha256").join(small, "text_sha256").select(*told)
    return alone.unionByName(in_big).unionByName(in_small)


def deduplicate(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of df, all columns, that stay (see duplicate_groups). Rows whose text cannot be repeated never shuffle."""
    prints = written(df.select(text_sha256(F.col(text)).alias(f"{P}sha")), "prints")
    marked = RepeatFilter(prints, f"{P}sha").marked(df.withColumn(f"{P}sha", text_sha256(F.col(text))), f"{P}sha", f"{P}may")
    alone = marked.filter(~F.col(f"{P}may")).drop(f"{P}may", f"{P}sha")
    best = F.min_by(F.struct(*[F.col(f"`{c}`") for c in df.columns]), F.struct(F.col(key).isNull(), F.col(key)))
    stays = marked.filter(f"{P}may").groupBy(f"{P}sha").agg(best.alias(f"{P}row")).select(f"{P}row.*")
    return alone.unionByName(stays)
