"""Queries over signals: the events of a user, in order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import aggregates, islands, ranking, windows
from tidemark.plans.tables import SIGNAL, TOTALS, registry, signal, table, totals
from tidemark.streaming import confirm, event_time

QUERIES, SQL, query = registry()
WINDOW, FRAME = windows.Plan(64, 32), 16

_CLASSIFY = f"""
WITH {SIGNAL},
w AS (SELECT user_id, event_type, value, total, k * 32 AS start FROM s, LATERAL (SELECT unnest([pos // 32, pos // 32 - 1]) AS k)
      WHERE k >= 0 AND CASE WHEN total <= 64 THEN k = 0 ELSE k * 32 > pos - 64 END
      UNION ALL SELECT user_id, event_type, value, total, 0 FROM s WHERE total <= 64 AND pos // 32 > 1),
p AS (SELECT user_id, start, event_type, sum(value) / least(64, any_value(total) - start) AS score, any_value(total) AS size FROM w GROUP BY user_id, start, event_type),
a AS (SELECT user_id, event_type, {{agg}} AS best FROM p GROUP BY user_id, event_type),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY best DESC, event_type) AS rank FROM a)
SELECT user_id, rank, event_type, round(best, 4) AS score FROM r WHERE rank <= 3
"""


def _window_scores(spark: SparkSession, folder: str) -> DataFrame:
    """(user_id, start, event_type, score, total): per window, the sum of a type's values over the window's length."""
    rows = signal(spark, folder)
    rows = rows.withColumn("start", F.explode(windows.window_starts_of(F.col("pos"), F.col("total"), WINDOW)))
    length = F.least(F.lit(WINDOW.window).cast("long"), F.first("total") - F.col("start"))
    return rows.groupBy("user_id", "start", "event_type").agg((F.sum("value") / length).alias("score"), F.first("total").alias("total"))


def _ranked(scores: DataFrame) -> DataFrame:
    return ranking.top_k(scores, ["user_id"], "score", "event_type", 3).select("user_id", "rank", "event_type", F.round("score", 4).alias("score"))


@query(_CLASSIFY.format(agg="sum(score) / CASE WHEN any_value(size) <= 64 THEN 1 ELSE ceil(any_value(size) / 32.0) END"))
def ev_classify_long_mean(spark: SparkSession, folder: str) -> DataFrame:
    """Windows, scores of each window, their mean over all windows, the best classes."""
    scores = _window_scores(spark, folder)
    return _ranked(scores.groupBy("user_id", "event_type").agg((F.sum("score") / WINDOW.count(F.first("total"))).alias("score")))


@query(_CLASSIFY.format(agg="max(score)"))
def ev_classify_long_max(spark: SparkSession, folder: str) -> DataFrame:
    return _ranked(_window_scores(spark, folder).groupBy("user_id", "event_type").agg(F.max("score").alias("score")))


_FRAMES = f"{SIGNAL}, f AS (SELECT user_id, pos // 16 AS frame, count(*) AS n, sqrt(avg(value * value)) AS rms FROM s GROUP BY user_id, pos // 16)"


def _frames(spark: SparkSession, folder: str) -> DataFrame:
    return islands.frames(signal(spark, folder), ["user_id"], "pos", "value", FRAME)


@query(f"WITH {_FRAMES} SELECT user_id, frame, n, round(rms, 4) AS rms FROM f")
def ev_frames_rms(spark: SparkSession, folder: str) -> DataFrame:
    return _frames(spark, folder).select("user_id", "frame", "n", F.round("rms", 4).alias("rms"))


@query(
    f"""WITH {SIGNAL}, o AS (SELECT user_id, pos // 16 AS frame, value FROM s UNION ALL SELECT user_id, pos // 16 - 1, value FROM s WHERE pos >= 16 AND pos % 16 < 4)
    SELECT user_id, frame, count(*) AS n, round(sqrt(avg(value * value)), 4) AS rms FROM o GROUP BY user_id, frame"""
)
def ev_frames_overlapped(spark: SparkSession, folder: str) -> DataFrame:
    """Frames that take some elements of the next one."""
    return islands.frames(signal(spark, folder), ["user_id"], "pos", "value", FRAME, 4).select("user_id", "frame", "n", F.round("rms", 4).alias("rms"))


_SCALED = "e AS (SELECT user_id, frame, rms / 1000 AS energy FROM f)"


@query(
    f"""WITH {_FRAMES}, {_SCALED}, m AS (SELECT *, min(energy) OVER (PARTITION BY user_id ORDER BY frame ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS least FROM e)
    SELECT user_id, frame, round(CASE WHEN least IS NULL OR energy <= 0 THEN 0.0
      ELSE greatest(0.0, least(1.0, (20 * log10(energy) - 20 * log10(greatest(least, 1e-8))) / (-20 * log10(greatest(least, 1e-8))))) END, 4) AS relative FROM m"""
)
def ev_relative_energy(spark: SparkSession, folder: str) -> DataFrame:
    rows = _frames(spark, folder).withColumn("energy", F.col("rms") / 1000)
    return islands.relative_to_trailing_min(rows, ["user_id"], "frame", "energy").select("user_id", "frame", F.round("relative", 4).alias("relative"))


@query(f"WITH {_FRAMES} SELECT user_id, frame, round(min(rms) OVER (PARTITION BY user_id ORDER BY frame ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), 4) AS least FROM f")
def ev_trailing_min(spark: SparkSession, folder: str) -> DataFrame:
    from pyspark.sql.window import Window

    w = Window.partitionBy("user_id").orderBy("frame").rowsBetween(-20, -1)
    return _frames(spark, folder).select("user_id", "frame", F.round(F.min("rms").over(w), 4).alias("least"))


#: Between the quiet and the loud frames of the tables.
LOUD = 60.0
_ACTIVE = f"{_FRAMES}, a AS (SELECT user_id, frame, rms > {LOUD} AS active FROM f)"
_RUNS = f"""{_ACTIVE}, c AS (SELECT *, CASE WHEN lag(active) OVER w = active THEN 0 ELSE 1 END AS change FROM a WINDOW w AS (PARTITION BY user_id ORDER BY frame)),
g AS (SELECT *, sum(change) OVER (PARTITION BY user_id ORDER BY frame) AS run FROM c),
r AS (SELECT user_id, any_value(active) AS active, min(frame) AS "start", max(frame) + 1 AS "end" FROM g GROUP BY user_id, run)"""


def _activity(spark: SparkSession, folder: str) -> DataFrame:
    return _frames(spark, folder).select("user_id", "frame", (F.col("rms") > LOUD).alias("active"))


@query(f"WITH {_ACTIVE} SELECT * FROM a")
def ev_activity(spark: SparkSession, folder: str) -> DataFrame:
    return _activity(spark, folder)


@query(f'WITH {_RUNS} SELECT user_id, active, "start", "end" FROM r')
def ev_active_runs(spark: SparkSession, folder: str) -> DataFrame:
    return islands.runs(_activity(spark, folder), ["user_id"], "frame", "active").select("user_id", "active", "start", "end")


@query(f'WITH {_RUNS}, k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY "end" - "start" DESC, "start") AS n FROM r WHERE NOT active) SELECT user_id, "start", "end" FROM k WHERE n = 1')
def ev_longest_silence(spark: SparkSession, folder: str) -> DataFrame:
    return islands.longest_run(islands.runs(_activity(spark, folder), ["user_id"], "frame", "active"), ["user_id"])


@query(f'WITH {_RUNS}, {TOTALS} SELECT user_id, "start" * 16 AS "start", least("end" * 16, total) AS "end" FROM r JOIN t USING (user_id) WHERE active')
def ev_active_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Active runs in samples, the last cut at the signal's end."""
    found = islands.runs(_activity(spark, folder), ["user_id"], "frame", "active").filter("active")
    return found.join(totals(spark, folder), "user_id").select("user_id", (F.col("start") * FRAME).alias("start"), F.least(F.col("end") * FRAME, F.col("total")).alias("end"))


@query(
    f"""WITH {_FRAMES}, l AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY frame DESC) AS r FROM f),
    k AS (SELECT user_id, r, rms, count(*) OVER (PARTITION BY user_id) AS c FROM l WHERE r <= 30)
    SELECT user_id, coalesce(bool_or(c - r < greatest(10, c - 10) AND rms > {LOUD}), false) AS active FROM k GROUP BY user_id"""
)
def ev_recently_active(spark: SparkSession, folder: str) -> DataFrame:
    return islands.recently_active(_frames(spark, folder), ["user_id"], "frame", "rms", 30, LOUD)


@query(
    f"""WITH {TOTALS} SELECT user_id, total, "start", least(64, total - "start") AS len, least(64, total - "start") / 64.0 AS coverage
    FROM (SELECT user_id, total, unnest(CASE WHEN total <= 64 THEN [0] ELSE range(0, total, 32) END) AS "start" FROM t)"""
)
def ev_spans_pad(spark: SparkSession, folder: str) -> DataFrame:
    return windows.spans(totals(spark, folder), "total", WINDOW)


@query(
    f"""WITH {TOTALS}, x AS (SELECT user_id, total, unnest(CASE WHEN total <= 64 THEN [0] ELSE range(0, total, 32) END) AS "start" FROM t)
    SELECT user_id, total, "start", least(64, total - "start") AS len, least(64, total - "start") / 64.0 AS coverage FROM x WHERE least(64, total - "start") >= 20"""
)
def ev_spans_drop(spark: SparkSession, folder: str) -> DataFrame:
    return windows.spans(totals(spark, folder), "total", windows.Plan(64, 32, least=20))


@query(f"WITH {TOTALS} SELECT user_id, CAST(CASE WHEN total <= 64 THEN 1 ELSE ceil(total / 32.0) END AS BIGINT) AS padded, CAST(CASE WHEN total < 20 THEN 0 WHEN total <= 64 THEN 1 ELSE (total - 20) // 32 + 1 END AS BIGINT) AS kept FROM t")
def ev_window_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Windows counted without making them."""
    n = F.col("total")
    return totals(spark, folder).select("user_id", WINDOW.count(n).alias("padded"), windows.Plan(64, 32, least=20).count(n).alias("kept"))


@query(f'WITH {TOTALS} SELECT user_id, unnest(range(0, CASE WHEN total <= 64 THEN 1 ELSE CAST(ceil((total - 64) / 16.0) AS BIGINT) + 1 END)) * 16 AS "start" FROM t')
def ev_chunk_starts(spark: SparkSession, folder: str) -> DataFrame:
    return totals(spark, folder).select("user_id", F.explode(windows.chunk_starts(F.col("total"), 64, 16)).alias("start"))


@query(
    f"""WITH {SIGNAL}, a AS (SELECT user_id, pos // 16 AS chunk, pos % 16 AS frame, CAST(value > {LOUD} AS INT) + CAST(event_type = 'click' AS INT) AS v FROM s),
    l AS (SELECT user_id, CAST(round_even((max(chunk) * 4 + 15.0) / 1.0, 0) AS BIGINT) + 1 AS last FROM a GROUP BY user_id),
    g AS (SELECT user_id, unnest(range(0, last + 1)) AS out_frame FROM l),
    m AS (SELECT user_id, CAST(round_even(chunk * 4.0, 0) AS BIGINT) + frame AS out_frame, avg(v) AS mean FROM a GROUP BY ALL)
    SELECT user_id, out_frame, CAST(least(255, greatest(0, round_even(coalesce(mean, 0), 0))) AS INT) AS n FROM g LEFT JOIN m USING (user_id, out_frame)"""
)
def ev_overlap_count(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks of 16 frames, 4 apart, added up frame by frame: means, half to even."""
    v = (F.col("value") > LOUD).cast("int") + (F.col("event_type") == "click").cast("int")
    active = signal(spark, folder).select("user_id", F.floor(F.col("pos") / 16).alias("chunk"), (F.col("pos") % 16).alias("frame"), v.alias("v"))
    return windows.overlap_add(active, ["user_id"], "chunk", "frame", "v", 4.0, 1.0, 16)


@query("WITH v AS (SELECT user_id, list_sort(list(value) FILTER (value > 0)) AS l FROM events GROUP BY user_id) SELECT user_id, round(least(coalesce(l[len(l) // 2 + 1], 0.0), 70.0), 4) AS median, round(2 * least(coalesce(l[len(l) // 2 + 1], 0.0), 70.0), 4) AS longest FROM v")
def ev_upper_median(spark: SparkSession, folder: str) -> DataFrame:
    """The element at index n / 2 of the sorted positive values, capped."""
    m = aggregates.upper_median(F.col("value"), 70.0)
    return table(spark, folder, "events").groupBy("user_id").agg(m.alias("m")).select("user_id", F.round("m", 4).alias("median"), F.round(2 * F.col("m"), 4).alias("longest"))


@query("SELECT event_type, quantile_disc(value, 0.9) AS p90 FROM events GROUP BY event_type")
def ev_percentile(spark: SparkSession, folder: str) -> DataFrame:
    """The element at rank ceil(0.9 n), by the built-in aggregate."""
    return table(spark, folder, "events").groupBy("event_type").agg(F.expr("percentile_disc(0.9) WITHIN GROUP (ORDER BY value)").alias("p90"))


@query(
    """SELECT time_bucket(INTERVAL 1 HOUR, ts) AS "start", time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS "end", event_type, count(*) AS n, round(sum(value), 4) AS total
    FROM events GROUP BY ALL"""
)
def ev_tumbling(spark: SparkSession, folder: str) -> DataFrame:
    return _plain(event_time.tumbling(_events(spark, folder), "ts", ["event_type"], "value", "1 hour"))


@query(
    """WITH w AS (SELECT time_bucket(INTERVAL 30 MINUTE, ts) - k * INTERVAL 30 MINUTE AS "start", event_type, value FROM events, (VALUES (0), (1)) v(k))
    SELECT "start", "start" + INTERVAL 1 HOUR AS "end", event_type, count(*) AS n, round(sum(value), 4) AS total FROM w GROUP BY ALL"""
)
def ev_sliding(spark: SparkSession, folder: str) -> DataFrame:
    return _plain(event_time.sliding(_events(spark, folder), "ts", ["event_type"], "value", "1 hour", "30 minutes"))


@query(
    """WITH g AS (SELECT *, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR THEN 1 ELSE 0 END AS cut FROM events),
    n AS (SELECT *, sum(cut) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM g)
    SELECT min(ts) AS "start", max(ts) + INTERVAL 6 HOUR AS "end", user_id, count(*) AS n, round(sum(value), 4) AS total FROM n GROUP BY user_id, session"""
)
def ev_sessions(spark: SparkSession, folder: str) -> DataFrame:
    return _plain(event_time.sessions(_events(spark, folder), "ts", ["user_id"], "value", "6 hours"))


def _events(spark: SparkSession, folder: str) -> DataFrame:
    return event_time.with_event_time(table(spark, folder, "events"), "ts")


def _plain(df: DataFrame) -> DataFrame:
    return df.withColumn("start", F.col("start").cast("timestamp_ntz")).withColumn("end", F.col("end").cast("timestamp_ntz")).withColumn("total", F.round("total", 4))


@query("SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) > 2 AS confirmed FROM events")
def ev_confirmed_batch(spark: SparkSession, folder: str) -> DataFrame:
    return confirm.confirmed(table(spark, folder, "events"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "confirmed")


@query(
    """WITH d AS (SELECT user_id, epoch(ts) AS s, value / 10 AS d FROM events)
    SELECT user_id, round(least(max(s + d) - min(s), sum(d)), 3) AS pipeline, round(max(d), 3) AS longest, round(min(d), 3) AS first, round(count(*) / sum(d), 4) AS per_second FROM d GROUP BY user_id"""
)
def ev_timings(spark: SparkSession, folder: str) -> DataFrame:
    """Timings of overlapping runs: wall time against their sum, rates."""
    rows = table(spark, folder, "events").select("user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("s"), (F.col("value") / 10).alias("d"))
    d = F.col("d")
    return rows.groupBy("user_id").agg(
        F.round(aggregates.pipeline_time(F.col("s"), d), 3).alias("pipeline"), F.round(aggregates.folded(d, "max"), 3).alias("longest"),
        F.round(aggregates.folded(d, "min"), 3).alias("first"), F.round(aggregates.per_second(F.count("*"), F.sum("d")), 4).alias("per_second"),
    )


@query(
    "SELECT event_type, CAST(sum(event_id) AS BIGINT) AS bound, bool_and(event_id % 997 <> 0) AS exact FROM events GROUP BY event_type"
)
def ev_span_merge(spark: SparkSession, folder: str) -> DataFrame:
    """Known spans add up; the sum is exact if every part is."""
    rows = table(spark, folder, "events").groupBy("event_type").agg(aggregates.merged_span(F.col("event_id"), F.col("event_id") % 997 != 0).alias("s"))
    return rows.select("event_type", "s.bound", "s.exact")


@query("SELECT user_id, CASE WHEN min(event_type) = max(event_type) THEN min(event_type) END AS same FROM events GROUP BY user_id")
def ev_unanimous(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").groupBy("user_id").agg(aggregates.unanimous(F.col("event_type")).alias("same"))


@query(
    f"""WITH {SIGNAL}, a AS (SELECT user_id, pos // 4 AS frame, pos % 3 AS slot, bool_or(value > 50) AS "on" FROM s GROUP BY ALL),
    c AS (SELECT *, "on" AND sum(CAST("on" AS INT)) OVER (PARTITION BY user_id, frame) < 2 AS clean FROM a)
    SELECT user_id, slot, count(*) FILTER ("on") AS n_active, count(*) FILTER (clean) AS n_clean,
      CASE WHEN count(*) FILTER ("on") = 0 THEN 'skip' WHEN count(*) FILTER (clean) >= 3 THEN 'clean' ELSE 'raw' END AS mask FROM c GROUP BY user_id, slot"""
)
def ev_slot_plans(spark: SparkSession, folder: str) -> DataFrame:
    """Which frames of a slot it speaks alone in, and whether they are enough."""
    rows = signal(spark, folder).groupBy("user_id", F.floor(F.col("pos") / 4).alias("frame"), (F.col("pos") % 3).alias("slot")).agg(F.bool_or(F.col("value") > 50).alias("on"))
    return islands.slot_plans(rows, ["user_id"], "frame", "slot", "on")


@query()
def ev_hysteresis(spark: SparkSession, folder: str) -> DataFrame:
    """Speech segments of a probability for each event."""
    return islands.hysteresis(signal(spark, folder).withColumn("prob", F.least(F.col("value") / 100, F.lit(1.0))), ["user_id"], "pos", "prob")


@query()
def ev_split_at_silence(spark: SparkSession, folder: str) -> DataFrame:
    return islands.chunked(_activity(spark, folder), ["user_id"], "frame", "active", FRAME, 320)


@query()
def ev_marked_segments(spark: SparkSession, folder: str) -> DataFrame:
    """Token streams cut where two time marks follow each other; a click is a mark."""
    from tidemark.operators import segments

    token = F.when(F.col("event_type") == "click", 1000 + F.col("pos")).otherwise(F.floor("value")).cast("int")
    rows = signal(spark, folder).select("user_id", "pos", token.alias("token"))
    return segments.marked_segments(rows, ["user_id"], "pos", "token", 1000)


