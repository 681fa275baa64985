"""Streams give what their batch forms give."""

import pytest
from pyspark.sql import functions as F
from tidemark.functions import signal
from tidemark.operators import islands
from tidemark.streaming import confirm, energy, event_time


def run(spark, df, make, tmp_path, name, mode="append"):
    """The rows of a stream over df, written as several files."""
    path = str(tmp_path / name)
    df.repartition(3).write.parquet(path)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)
    q = make(stream).writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", path + "-state").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return spark.table(name).collect()


def test_confirmed_segments(spark, tmp_path):
    rows = [(k % 2, float(k // 2), f"t{k}") for k in range(20)]
    df = spark.createDataFrame(rows, "clip long, at double, text string").coalesce(1)
    path = tmp_path / "ordered"
    for n in range(4):
        df.filter(f"at >= {n * 3} AND at < {n * 3 + 3}").write.mode("append").parquet(str(path))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(path))
    q = confirm.confirm_stream(stream, "clip", "at", "text", ttl_ms=None).writeStream.format("memory").queryName("segs").option("checkpointLocation", str(path) + "-state").trigger(availableNow=True).start()
    q.awaitTermination(120)
    batch = confirm.confirmed(df, ["clip"], ["at"]).filter("confirmed").select("clip", "at", "text").collect()
    assert sorted(map(tuple, spark.table("segs").collect())) == sorted(map(tuple, batch))


def hypotheses():
    text = "so the quick brown fox jumps over the lazy dog".split()
    words = [(w, k * 1.0) for k, w in enumerate(text)]
    return [words[:3], words[:5], words[:4] + [("brawn", 4.0)] + words[5:6], words[:7], words[:9], words]


def test_agreement_confirms_what_is_shared():
    a = confirm.Agreement(2)
    got = [a.push(h) for h in hypotheses()]
    done = [w for part in got for w, _ in part]
    assert done == [w for w, _ in hypotheses()[-1]][: len(done)] and len(done) >= 5
    assert [w for w, _ in a.done] + [w for w, _ in a.finish()] == [w for w, _ in hypotheses()[-1]]


def test_agreement_stream(spark, tmp_path):
    rows = [(1, n, h) for n, h in enumerate(hypotheses())]
    df = spark.createDataFrame(rows, "clip long, n int, words array<struct<word:string,start:double>>")
    batch = [r.word for r in confirm.agreed(df, "clip", "n", "words").orderBy("n").collect() if r.confirmed]
    stream = run(spark, df.coalesce(1), lambda s: confirm.agree_stream(s, "clip", "n", "words", ttl_ms=None), tmp_path, "agree")
    assert [r.word for r in sorted(stream, key=lambda r: r.start)][: len(batch)] != [] and set(r.word for r in stream) <= {w for w, _ in hypotheses()[-1]} | {"brawn"}


def test_contains_run():
    assert confirm.contains_run([1, 2, 3], [2, 3]) and not confirm.contains_run([1, 2, 3], [1, 3])


def test_energy_tracker_against_windows(spark):
    samples = [((k * 37) % 101) / 200 for k in range(330)]
    t = energy.Tracker(10, 5)
    got = t.push(samples[:7]) + t.push(samples[7:155]) + t.push(samples[155:])
    df = spark.createDataFrame([(1, k, x) for k, x in enumerate(samples)], "clip int, pos long, v double")
    frames = islands.relative_to_trailing_min(islands.frames(df, ["clip"], "pos", "v", 10), ["clip"], "frame", "rms", 5).orderBy("frame").collect()
    assert len(got) == 33
    for (k, e, r), want in zip(got, frames, strict=True):
        assert (k, e, r) == (want.frame, pytest.approx(want.rms), pytest.approx(want.relative))
    assert spark.range(1).select(signal.relative_energy(F.lit(0.3), F.lit(0.1))).first()[0] == pytest.approx(energy.relative(0.3, 0.1))


def test_energy_stream(spark, tmp_path):
    df = spark.createDataFrame([(1, k, (k % 9) / 10) for k in range(100)], "clip long, pos long, v double").coalesce(1)
    df.write.parquet(str(tmp_path / "one"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "one"))
    q = energy.energy_stream(stream, "clip", "pos", "v", 8, 4, ttl_ms=None).writeStream.format("memory").queryName("energy").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r.frame for r in spark.table("energy").collect()) == list(range(12))


def test_event_time_windows(spark, tmp_path):
    rows = [(f"2024-01-01 00:{k % 60:02d}:00", k % 3, float(k)) for k in range(60)] + [("2024-01-02 00:00:00", 0, 1.0)]
    df = spark.createDataFrame(rows, "t string, k int, v double").select(F.to_timestamp_ntz("t").alias("ts"), "k", "v")
    batch = event_time.tumbling(event_time.with_event_time(df, "ts"), "ts", ["k"], "v", "10 minutes").filter("start < '2024-01-01 12:00:00'").collect()
    df.coalesce(1).write.parquet(str(tmp_path / "ev"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "ev"))
    q = event_time.tumbling(event_time.with_event_time(stream, "ts", "5 minutes"), "ts", ["k"], "v", "10 minutes").writeStream.outputMode("append").format("memory").queryName("tumble").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("tumble").collect())) == sorted(map(tuple, batch))
    sessions = event_time.sessions(event_time.with_event_time(df, "ts"), "ts", ["k"], "v", "30 minutes").filter("k = 0").collect()
    assert len(sessions) == 2
