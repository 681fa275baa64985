"""Sharding by balanced label propagation, in DataFrame functions only.

Rows that share a link value (here: equal texts) should share a shard, and shards should hold equally many rows.
Rows start in a shard by hash. Linked rows are first summed into cells (link, starting shard), so a link that a
third of all rows share is one cell for each shard. In each round, a join gives every cell the shard where most
rows of its link are; the moves into a shard are admitted up to its free capacity by a hash threshold. At the
end, all rows are ordered by shard, with unlinked rows at both ends, and cut into runs of equal length: the cut
corrects what imbalance is left by passing unlinked rows to the next shard, and gives the slots.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import P, bucket, written

ROUNDS = 6
#: Of the rows that want to leave a shard, the share whose room is given away in the same round.
LEAVING = 0.8
#: A shard may hold so many times its even share while labels move.
SLACK = 1.02
#: Runs into which the rows of a shard are split to rank them in parallel, at least, and rows of a run on average.
RUNS, RUN_ROWS = 64, 1_000_000
#: A cell of at least a HEAVY-th of all rows is heavy; so there are at most HEAVY of them.
HEAVY = 1000


def propagate(cells: DataFrame, free: DataFrame, shards: int, total: int, rounds: int = ROUNDS, slack: float = SLACK) -> DataFrame:
    """cells (link, start, n, shard) with the shard after the rounds. free: (shard, rows) that never move.

    Cells of a link move to the shard that holds most of its rows (of equals, one by hash, so that no shard draws
    more), but only as many into a shard as its quota has room for: slack times the even share, less what it holds
    and will not lose. Rounds end early once no cell wants to move.
    """
    quota = total / shards * slack
    for k in range(rounds):
        held = cells.groupBy("link", "shard").agg(F.sum("n").alias("n"))
        best = held.groupBy("link").agg(F.max(F.struct("n", F.xxhash64("link", "shard").alias("draw"), "shard")).alias("best")).select("link", F.col("best.shard").alias("to"))
        moves = written(cells.join(best, "link"), "moves")
        if moves.filter("to != shard").isEmpty():
            return cells
        loads = moves.groupBy("shard").agg(F.sum("n").alias("linked")).join(free, "shard", "full").select("shard", (F.coalesce("linked", F.lit(0)) + F.coalesce("rows", F.lit(0))).alias("load"))
        inflow = moves.filter("to != shard").groupBy("to").agg(F.sum("n").alias("inflow"))
        outflow = moves.filter("to != shard").groupBy(F.col("shard").alias("to")).agg(F.sum("n").alias("outflow"))
        # One row for each shard. What wants to leave a shard makes room in it, but not all of it will go.
        room = quota - F.coalesce("load", F.lit(0)) + LEAVING * F.coalesce("outflow", F.lit(0))
        admit = inflow.join(loads.withColumnRenamed("shard", "to"), "to", "left").join(outflow, "to", "left").select("to", F.greatest(F.lit(0.0), room / F.col("inflow")).alias("share"))
        draw = F.pmod(F.xxhash64("link", F.lit(k)), F.lit(1 << 20)) / float(1 << 20)
        # A link larger than a shard cannot move whole; its cells draw one by one.
        alone = F.pmod(F.xxhash64("link", "start", F.lit(k)), F.lit(1 << 20)) / float(1 << 20)
        size = F.sum("n").over(Window.partitionBy("link"))
        moved = moves.withColumn("size", size).join(F.broadcast(admit), "to", "left")
        goes = F.coalesce(F.col("share"), F.lit(0.0)) > F.when(F.col("size") > quota / 2, alone).otherwise(draw)
        cells = written(moved.select("link", "start", "n", F.when((F.col("to") != F.col("shard")) & goes, F.col("to")).otherwise(F.col("shard")).alias("shard")), "cells")
    return cells


def shard_rows(df: DataFrame, shards: int = 40, text: str = "text", key: str = "doc_id", rounds: int = ROUNDS) -> DataFrame:
    """One row for each row of df: doc_id, size, text_crc32, law, shard, slot, grown_shard, link, linked.

    Law `rows`: shard sizes differ by one row at most; slots are gapless from 0. size is the UTF-8 bytes of the
    text and 16. Null text has no bytes, the checksum 0, and is linked to empty text. Rows that repeat a key, and
    null keys, are rows like any other. An empty table gives no rows; with fewer rows than shards, some shards
    stay empty. Other columns are not read.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = df.select(F.col(key).alias("doc_id"), (F.octet_length(body).cast("long") + 16).alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"), F.sha2(body.cast("binary"), 256).alias("link"), F.monotonically_increasing_id().alias("row"))
    rows = written(rows.withColumn("start", bucket(shards, F.col("row"), F.lit(7))), "rows")
    total = rows.count()
    cells = rows.groupBy("link", "start").agg(F.count("*").alias("n"))
    several = F.sum("n").over(Window.partitionBy("link"))  # at most `shards` rows for each link
    cells = written(cells.withColumn("of", several), "starts")
    linked = cells.filter("of > 1").drop("of").withColumn("shard", F.col("start"))
    free = cells.filter("of = 1").groupBy(F.col("start").alias("shard")).agg(F.sum("n").alias("rows"))
    ended = propagate(linked, written(free, "free"), shards, total, rounds).select("link", "start", "n", F.col("shard").alias("label"))
    # Heavy cells are looked up by broadcast, all others by a shuffle.
    heavy = max(2, total // HEAVY)
    with_heavy = rows.join(F.broadcast(ended.filter(F.col("n") > heavy)), ["link", "start"], "left")
    rest = with_heavy.filter("label IS NULL").drop("n", "label").join(ended.filter(F.col("n") <= heavy), ["link", "start"], "left")
    placed = with_heavy.filter("label IS NOT NULL").unionByName(rest)
    is_linked = F.col("label").isNotNull()
    # Unlinked rows stand at both ends of a label's run, so the cuts fall among them. Linked ones stand together, but
    # for a cell that is larger than a run.
    part = F.when(is_linked, 1).when(bucket(2, F.col("row"), F.lit(11)) == 0, 0).otherwise(2)
    runs = max(RUNS, total // (shards * RUN_ROWS))
    pieces = F.ceil(F.col("n") / max(1, total // (shards * runs)))
    piece = F.pmod(F.xxhash64("row", F.lit(17)), pieces)
    run = F.when(is_linked, bucket(runs, F.col("link"), F.col("start"), piece)).otherwise(bucket(runs, F.col("row"), F.lit(13)))
    placed = written(placed.select("doc_id", "size", "text_crc32", "link", "row", F.coalesce("label", "start").alias("label"), part.alias("part"), run.alias("run"), is_linked.alias("linked")), "placed")
    at = ["label", "part", "run"]
    # shards * 3 * RUNS rows at most, or one for RUN_ROWS / 3 rows of the input.
    counts = placed.groupBy(*at).agg(F.count("*").alias("here"))
    before = counts.select(*at, (F.sum("here").over(Window.orderBy(*at)) - F.col("here")).alias("before"))
    rank = F.row_number().over(Window.partitionBy(*at).orderBy("link", "row")) - 1
    ranked = placed.withColumn("rank", rank).join(F.broadcast(before), at).withColumn("rank", F.col("rank") + F.col("before"))
    small, more = total // shards, total % shards  # the first `more` shards hold one row more
    edge = more * (small + 1)
    shard = F.when(F.col("rank") < edge, F.floor(F.col("rank") / F.lit(small + 1))).otherwise(F.lit(more) + F.floor((F.col("rank") - edge) / F.lit(max(1, small))))
    slot = F.when(F.col("rank") < edge, F.col("rank") % F.lit(small + 1)).otherwise((F.col("rank") - edge) % F.lit(max(1, small)))
    return ranked.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), shard.cast("int").alias("shard"), slot.cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "link", "linked")


def cut_links(placed: DataFrame) -> DataFrame:
    """One row: linked_rows, and cut_rows, those outside the shard that holds most rows of their link."""
    held = placed.filter("linked").groupBy("link", "shard").agg(F.count("*").alias("n"))
    by_link = held.groupBy("link").agg(F.sum("n").alias("all"), F.max("n").alias("most"))
    return by_link.agg(F.coalesce(F.sum("all"), F.lit(0)).alias("linked_rows"), F.coalesce(F.sum(F.col("all") - F.col("most")), F.lit(0)).alias("cut_rows"))
