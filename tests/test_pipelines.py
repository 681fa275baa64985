"""Tokens and whole queries over the stand-in models."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from tidemark import models
from tidemark.functions import tokens
from tidemark.operators import decoding, pipelines, windows


def test_vocabularies(spark):
    v = spark.createDataFrame([("a", 0), ("b", 1), ("<s>", 2)], "token string, id int")
    assert tokens.vocabulary_faults(v, 3, {"<s>": 2}).collect() == []
    assert {r.fault for r in tokens.vocabulary_faults(v, 4, {"<s>": 5, "<t>": 1}).collect()} == {"size", "special id of <s>", "special id of <t>"}
    wanted = spark.createDataFrame([("<s>", 9), ("<x>", 7)], "token string, default int")
    assert {r.token: r.id for r in tokens.special_ids(wanted, v).collect()} == {"<s>": 2, "<x>": 7}


def test_words_of_tokens(spark):
    assert tokens.whole_characters([b"a", "é".encode()[:1], "é".encode()[1:], b"b"]) == [[0], [1, 2], [3]]
    table = {1: b" he", 2: b"llo", 3: b",", 4: b" w", 5: "ö".encode()[:1], 6: "ö".encode()[1:], 7: "日".encode(), 8: "本".encode()}
    df = spark.createDataFrame([(1, [1, 2, 3, 4, 5, 6], "en"), (2, [7, 8], "ja")], "k long, ids array<int>, lang string")
    got = [(r.key, r.word, list(r.tokens)) for r in tokens.words_of(df, "k", "ids", "lang", lambda: table.__getitem__).collect()]
    assert sorted(got) == sorted([(1, " hello", [1, 2]), (1, ",", [3]), (1, " wö", [4, 5, 6]), (2, "日", [7]), (2, "本", [8])])
    rows = spark.createDataFrame([(1, k, t) for k, t in enumerate([" he", "llo", ",", " you"])], "s int, at int, t string")
    assert [(r.word, r.first, r.last) for r in tokens.spaced_words(rows, ["s"], "at", "t").orderBy("first").collect()] == [(" hello", 0, 1), (",", 2, 2), (" you", 3, 3)]
    mark = tokens.TimeMark(100)
    assert tuple(spark.range(1).select(mark.seconds(F.lit(105)), mark.token(F.lit(0.1)), mark.seconds(F.lit(3))).first()) == (pytest.approx(0.1), 105, None)
    assert spark.range(1).select(tokens.known_language(F.lit(11), 10, ["en", "de"])).first()[0] == "de"


def test_classify_long_against_numpy(spark):
    x = [float(k % 7) for k in range(23)]
    df = spark.createDataFrame([(1, x)], "clip long, s array<double>")
    plan = windows.Plan(8, 4)
    cut = [np.pad(x[a : a + 8], (0, max(0, 8 - len(x[a : a + 8])))) for a in range(0, 23, 4)]
    scores = 1 / (1 + np.exp(-models.Stub(6).score(cut).astype(np.float32).astype(float)))
    for how, want in (("mean", scores.mean(0)), ("max", scores.max(0))):
        got = pipelines.classify_long(df, ["clip"], "s", plan, lambda: models.Stub(6), 3, how).orderBy("rank").collect()
        assert [r["class"] for r in got] == np.argsort(-want, kind="stable")[:3].tolist()
        assert [r.confidence for r in got] == pytest.approx(sorted(want, reverse=True)[:3])
    one = pipelines.classify(df, ["clip"], "s", lambda: models.Stub(6), 2).collect()
    assert len(one) == 2


def test_transcribe(spark):
    loud, quiet = [0.5] * 64, [0.0] * 64
    df = spark.createDataFrame([(1, loud + quiet + loud), (2, loud), (3, [0.9] * 32)], "clip long, s array<double>")

    def make():
        def run(s):
            if max(s) > 0.8:
                raise ValueError("too loud")
            return [(f"n{len(s)}", 0.0, len(s) / 16_000), ("[BLANK_AUDIO]", 0.0, 1.0)]

        return run

    got = {r.key: r for r in pipelines.transcribe(df, "clip", "s", 16, 128, 0.1, make).collect()}
    assert got[1].n_segments == 2 and got[1].text == "n96 n96" and got[2].text == "n64" and got[2].srt.startswith("1\n00:00:00,000 -->")
    assert got[3].errors == 1 and got[3].n_segments == 0 and got[3].text is None


def test_diarize(spark):
    e = np.eye(3).tolist()
    rows = [("f", 0, 0, list(range(0, 100)), e[0]), ("f", 0, 1, list(range(50, 150)), e[1]), ("f", 1, 0, list(range(40, 150)), e[1]), ("f", 1, 1, [], [0.0] * 3)]
    df = spark.createDataFrame(rows, "file string, chunk int, slot int, frames array<int>, embedding array<double>")
    got = {r.frame: list(r.clusters) for r in pipelines.diarize(df, ["file"]).collect()}
    assert got[10] == [0] and got[120] == [1] and got[60] == [0, 1]


def test_overlap(spark):
    a = spark.createDataFrame([("f", 0.0, 1.0)], "f string, start double, end double")
    b = spark.createDataFrame([("f", 0.5, 1.5)], a.schema)
    r = pipelines.overlap_of(a, b, ["f"]).first()
    assert (r.both, r.either, r.iou) == (50, 150, pytest.approx(1 / 3))


def test_attempts(spark):
    rows = [(1, 0, 0.0, 0.0, 0.0, 3.0, 0.0), (1, 1, 0.2, 0.0, 0.0, 1.0, 0.0), (2, 0, 0.0, -9.0, 0.0, 1.0, 0.0), (2, 1, 0.2, -9.0, 0.0, 1.0, 0.0)]
    df = spark.createDataFrame(rows, "w int, attempt int, temperature double, first double, no_speech double, compression double, average double")
    got = {r.w: (r.attempt, r.reason) for r in pipelines.accepted_attempts(df, ["w"], decoding.Acceptance()).collect()}
    assert got == {1: (1, None), 2: (1, "first_token")}
