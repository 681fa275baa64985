"""Texts, segments, decoding, alignment, clustering, chunking, sources and models."""

import io
import math
import random
import struct
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F
from tidemark import config, models
from tidemark.functions import image
from tidemark.functions import text as T
from tidemark.operators import alignment, chunking, clustering, decoding, ranking, segments
from tidemark.sources import captions, wav


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_text_functions(spark):
    t = lambda s: one(spark, T.normalized(F.lit(s)))
    assert t("  Hello,  World-wide!  ") == "hello world wide" and t("") == ""
    words = lambda s: T.words(F.lit(s))
    assert one(spark, T.common_prefix_length(words("Hello, big World"), words("hello big day"))) == 2
    assert list(one(spark, T.different_suffix(words("a b"), words("A, b c d")))) == ["c", "d"]
    assert one(spark, T.clock(F.lit(3661.0421), ",")) == "01:01:01,042" and one(spark, T.clock(F.lit(61.5), ".", hours=False)) == "01:01.500"
    assert one(spark, T.language_code(F.lit("German"))) == "de" and one(spark, T.language_code(F.lit("xx"))) is None and one(spark, T.primary_language(F.lit("cmn-Hans"))) == "zh"
    assert one(spark, T.download_pattern(F.lit("n"), F.lit(None).cast("string"), F.lit("v"))) == "n/*/v/*"
    assert one(spark, T.base_folder(F.lit("a/b/model/c"), "model")) == "a/b" and one(spark, T.base_folder(F.lit("a"), "model")) is None
    assert one(spark, T.matches_glob(F.lit("a_b%.txt"), "a_?%.*")) and not one(spark, T.matches_glob(F.lit("axb%.txt"), "a_?%.*"))


def test_compression_lengths(spark):
    golden = [1212, 318, 257, 1332, 13]
    ids = lambda a: F.array(*[F.lit(x) for x in a])
    assert one(spark, T.token_compression_ratio(ids(golden * 2))) == 40 / 24 and one(spark, T.token_compression_ratio(ids(golden * 8))) == 160 / 24
    assert one(spark, T.token_compression_ratio(ids([42] * 200))) == 800 / 13 and one(spark, T.token_compression_ratio(F.array().cast("array<int>"))) == 0
    assert one(spark, T.text_compression_ratio(F.lit(""))) == float("inf")


def test_segments(spark):
    df = spark.createDataFrame([("c", k, t, k * 1.0, k + 0.5) for k, t in enumerate(["One ", "", "[BLANK_AUDIO]", "two"])], "c string, k int, text string, start double, end double")
    assert segments.merged(df, ["c"], "k", "text").first().n == 3 and segments.not_blank(df, "text").count() == 3
    assert segments.cues(df.filter("k IN (0, 3)"), ["c"], ["k"], "start", "end", "text").first().content == "1\n00:00:00,000 --> 00:00:00,500\nOne\n\n2\n00:00:03,000 --> 00:00:03,500\ntwo\n"
    assert segments.cues(df.filter("k = 0"), ["c"], ["k"], "start", "end", "text", "vtt").first().content == "WEBVTT\n\n00:00.000 --> 00:00.500\nOne\n"
    nested = spark.createDataFrame([("c", 0, 0.0, 2.0, "a b", [("a", 0.0, 1.0), ("b", 1.0, 2.0)]), ("c", 1, 2.0, 3.0, "c", [])], "c string, k int, start double, end double, text string, words array<struct<word:string,start:double,end:double>>")
    assert [(r.k, r.at, r.start, r.text) for r in segments.word_cues(nested, ["c"], "k").orderBy("k", "at").collect()] == [(0, 0, 0.0, "a"), (0, 1, 1.0, "b"), (1, 0, 2.0, "c")]
    moved = segments.shifted(nested, F.lit(10.0), ["start", "end"], "words").orderBy("k").first()
    assert moved.start == 10 and moved.words[1].end == 12


def test_time_marks(spark):
    tokens = [100, 1, 2, 105, 105, 3, 110, 110, 4]
    df = spark.createDataFrame([(1, k, t) for k, t in enumerate(tokens)], "w int, at int, token int")
    got = segments.marked_segments(df, ["w"], "at", "token", 100).orderBy("start").collect()
    assert [(round(r.start, 2), round(r.end, 2), list(r.tokens)) for r in got] == [(0.0, 0.1, [100, 1, 2, 105]), (0.1, 0.2, [105, 3, 110])]


def marked(tokens, first, step=0.02, window=30.0):
    """The rule, by hand, in steps over one list."""
    is_mark = [t >= first for t in tokens]
    cuts = [k for k in range(1, len(tokens)) if is_mark[k - 1] and is_mark[k]]
    if not cuts:
        late = [t for t in tokens if t > first]
        return [(0.0, (late[-1] - first) * step if late else window, tokens)], window
    single, plain = is_mark[-3:] == [False, True, False], is_mark[-3:] == [False] * 3
    if single:
        cuts.append(max(k for k, m in enumerate(is_mark) if m) + 1)
    if plain:
        cuts.append(len(tokens))
    out, at = [], 0
    for cut in cuts:
        own = [t for t in tokens[at:cut] if t >= first]
        out.append(((own[0] - first) * step, (own[-1] - first) * step, tokens[at:cut]))
        at = cut
    return out, window if plain else (tokens[at - single] - first) * step


def test_time_marks_against_the_rule(spark):
    rng = random.Random(5)
    streams = [[100, 1, 2], [1, 2, 3], [100, 1, 105], [100], [100, 1, 105, 105, 2, 110, 7], [100, 1, 105, 105, 2, 3, 4]]
    streams += [[rng.choice([1, 2, 3, 100, 101, 105, 110]) for _ in range(rng.randrange(1, 14))] for _ in range(150)]
    df = spark.createDataFrame([(w, k, t) for w, x in enumerate(streams) for k, t in enumerate(x)], "w int, at int, token int")
    got = {}
    for r in segments.marked_segments(df, ["w"], "at", "token", 100).orderBy("w", "segment").collect():
        got.setdefault(r.w, []).append((round(r.start, 4), round(r.end, 4), list(r.tokens), round(r.advance, 4)))
    for w, x in enumerate(streams):
        parts, advance = marked(x, 100)
        assert got[w] == [(round(a, 4), round(z, 4), t, round(advance, 4)) for a, z, t in parts], x


def glued(words, opening, closing):
    """The rule, by hand: marks join their neighbours as these stood; what was replaced is lost."""
    holds = lambda marks, x: bool(x) and x in marks
    first = [words[0]] if not holds(opening, words[0][0].strip(" \t")) else []
    for before, (w, a, z) in zip(words, words[1:]):  # noqa: B905
        if before[0][:1] in (" ", "\t") and holds(opening, before[0].strip(" \t")):
            first[-1:] = [(before[0] + w, a, z)]
        else:
            first.append((w, a, z))
    second = first[:1]
    for before, (w, a, z) in zip(first, first[1:]):  # noqa: B905
        if not before[0].endswith(" ") and holds(closing, w.strip(" \t")):
            second[-1:] = [(before[0] + w, before[1], before[2])]
        else:
            second.append((w, a, z))
    return [x for x in second if x[0] and not holds(closing, x[0]) and not holds(opening, x[0])]


def test_punctuation_against_the_rule(spark):
    rng = random.Random(6)
    lists = [[" He", " ."], [".", " x"], [" x", " ("], [" (", " x"], ["(", "x"], [" He", " said", ' "', "yes", "!", '"']]
    lists += [[rng.choice([" a", "b", " (", "(", ".", " .", "!", ' "', '"', " ", "", "c "]) for _ in range(rng.randrange(1, 9))] for _ in range(200)]
    rows = [(s, k, w, float(k), k + 0.5) for s, x in enumerate(lists) for k, w in enumerate(x)]
    df = spark.createDataFrame(rows, "s int, at int, word string, start double, end double")
    got = {}
    for r in segments.punctuation_merged(df, ["s"], "at", "word", '"(', '".!').orderBy("s", "start").collect():
        got.setdefault(r.s, []).append((r.word, r.start, r.end))
    for s, x in enumerate(lists):
        assert got.get(s, []) == glued([(w, float(k), k + 0.5) for k, w in enumerate(x)], '"(', '".!'), x


def test_punctuation_and_long_words(spark):
    rows = [(1, 0, " He", 0.0, 1.0), (1, 1, " said", 1.0, 2.0), (1, 2, " \"", 2.0, 2.1), (1, 3, "yes", 2.1, 3.0), (1, 4, "!", 3.0, 3.1), (1, 5, "\"", 3.1, 3.2)]
    df = spark.createDataFrame(rows, "s int, at int, word string, start double, end double")
    assert [(r.word, r.start, r.end) for r in segments.punctuation_merged(df.filter("at < 5"), ["s"], "at", "word").orderBy("start").collect()] == [(" He", 0.0, 1.0), (" said", 1.0, 2.0), (' "yes!', 2.1, 3.0)]
    long = spark.createDataFrame([(1, -1, ".", -9.0, 0.0), (1, 0, "a", 0.0, 1.0), (1, 1, ".", 1.0, 5.0), (1, 2, "b", 5.0, 9.0), (1, 3, "c", 9.0, 13.0)], df.schema)
    got = segments.long_words_cut(long, ["s"], "at", "word", "start", "end", 1.5).orderBy("at").collect()
    assert [(r.start, r.end) for r in got] == [(-9.0, 0.0), (0.0, 1.0), (1.0, 2.5), (7.5, 9.0), (9.0, 13.0)]


def test_words_find_their_segments(spark):
    words = spark.createDataFrame([(1, k, n) for k, n in enumerate([1, 2, 1, 3, 70])], "c int, word_at int, n_tokens int")
    segs = spark.createDataFrame([(1, 0, 3), (1, 1, 0), (1, 2, 80)], "c int, segment int, n_tokens int")
    assert [(r.word_at, r.segment) for r in segments.words_to_segments(words, segs, ["c"]).orderBy("word_at").collect()] == [(0, 0), (1, 0), (2, 2), (3, 2), (4, 2)]


def test_decoding(spark):
    logits = F.array(*[F.lit(float(x)) for x in (1, 5, 3)])
    assert list(one(spark, decoding.suppressed(logits, [1]))) == [1, float("-inf"), 3]
    g = one(spark, decoding.greedy(logits))
    assert g.token == 1 and g.logprob == pytest.approx(5 - math.log(sum(map(math.exp, (1, 5, 3)))))
    assert decoding.splitmix64(0) == 0xE220A8397B1DCDAF and decoding.attempt_seed(1, 2, 3) != decoding.attempt_seed(1, 3, 2)
    assert decoding.sample(np.array([1.0, 5.0, 3.0]), 0, 5, 1)[0] == 1
    draws = [decoding.sample(np.array([0.0, 1.0, 2.0, -9.0]), 1.0, 3, k)[0] for k in range(2000)]
    p = np.exp([0, 1, 2]) / np.exp([0, 1, 2]).sum()
    assert np.allclose(np.bincount(draws, minlength=4)[:3] / 2000, p, atol=0.04) and 3 not in draws
    reason = lambda *a: one(spark, decoding.Acceptance().reason(*[F.lit(x).cast("double") for x in a]))
    assert reason(-2, 0.9, 1, 0) == "first_token" and reason(0, 0.9, 9, -9) is None and reason(0, 0, 3, -9) == "compression" and reason(0, 0, 1, -2) == "average" and reason(0, 0, 1, 0) is None
    assert decoding.temperatures() == [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]
    ids = lambda *a: F.array(*[F.lit(x) for x in a]).cast("array<int>")
    assert list(one(spark, decoding.prefill(50, 51, 50, ids(1, 60, 2), ids(3, 99), F.lit(70), F.lit(80)))) == [51, 1, 2, 50, 70, 80, 3]
    assert list(one(spark, decoding.between(ids(9, 50, 1, 2, 49, 3), 50, 49))) == [50, 1, 2]
    tokens, probs = decoding.finished(ids(1, 2), F.array(F.lit(-1.0), F.lit(-2.0)), 49)
    assert list(one(spark, tokens)) == [1, 2, 49] and one(spark, decoding.average(probs)) == -1


def test_time_rules():
    rules = decoding.TimeRules(first=10, end=8, no_times=9, begin=1)
    x = rules.apply(np.concatenate([np.full(10, 5.0), np.zeros(10)]), [5])
    assert np.isfinite(x[:9]).all() and np.isinf(x[9]) and np.isfinite(x[10:]).all()  # text may come first
    assert not decoding.mass_exceeds(np.concatenate([np.zeros(2), np.full(3, -200.0)]), 2)
    after_text = rules.apply(np.concatenate([np.full(10, 5.0), np.zeros(10)]), [5, 12, 1])
    assert np.isinf(after_text[10:13]).all() and np.isfinite(after_text[0]) and np.isfinite(after_text[13])
    pair = rules.apply(np.zeros(20), [5, 12, 1, 14])
    assert np.isinf(pair[:8]).all() and np.isinf(pair[10:14]).all() and np.isfinite(pair[14:]).all()


def test_decoder_runs_down_the_ladder(spark):
    def make():
        def step(tokens):
            x = np.zeros(6)
            x[tokens[-1] + 1 if tokens[-1] < 5 else 5] = 9
            return x

        return decoding.Decoder(step, end=5)

    df = spark.createDataFrame([(1, [0]), (2, [3])], "key long, prompt array<int>")
    got = {r.key: r for r in decoding.decoded(df, "key", "prompt", make, [0.0, 0.2], lambda tokens, _: True).collect()}
    assert list(got[1].tokens) == [1, 2, 3, 4, 5] and list(got[2].tokens) == [4, 5] and got[1].temperature == 0


def test_warping_against_enumeration():
    rng = np.random.default_rng(0)
    for _ in range(20):
        w = rng.normal(size=(4, 5))

        def best(i, j, w=w):
            if i < 0 or j < 0:
                return np.inf
            if (i, j) == (0, 0):
                return -w[0, 0]
            return -w[i, j] + min(best(i - 1, j - 1), best(i - 1, j), best(i, j - 1))

        rows, columns = alignment.warp(w)
        assert (rows[0], columns[0], rows[-1], columns[-1]) == (0, 0, 3, 4)
        assert -w[rows, columns].sum() == pytest.approx(best(3, 4))
    assert alignment.word_times([0, 1, 1, 2], [0, 1, 2, 3], [[7], [8]], [math.log(0.5)] * 2, 1.0) == [(0, 0.0, 1.0, pytest.approx(0.5)), (1, 1.0, 3.0, pytest.approx(0.5))]


def test_forced_alignment():
    p = np.full((6, 3), 0.05)
    for t, c in enumerate([0, 1, 1, 0, 2, 2]):
        p[t, c] = 0.9
    got = alignment.forced(np.log(p), [1, 2])
    assert [(a, z) for a, z, _ in got] == [(1, 3), (4, 6)] and alignment.forced(np.log(p[:2]), [1, 2, 1]) is None and alignment.forced(np.log(p), []) == []


def test_online_clusters():
    e = np.eye(4)
    got = clustering.online(np.array([e[0], e[1], e[0] + 0.1 * e[2], e[1], e[3], np.zeros(4)]), np.array([2, 2, 2, 0.1, 0.1, 2]))
    assert got == [0, 1, 0, 1, -1, -1]


def test_matching_is_optimal():
    from itertools import permutations

    rng = np.random.default_rng(3)
    for n, m in ((3, 3), (2, 4), (5, 3)):
        w = rng.integers(0, 20, size=(n, m)).astype(float)
        got = sum(w[a, b] for a, b in clustering.matched(w).items())
        best = max(sum(w[a, b] for a, b in zip(p, range(m), strict=False)) for p in permutations(range(n), min(n, m))) if n >= m else max(sum(w[a, b] for a, b in enumerate(p)) for p in permutations(range(m), n))
        assert got == best


def test_error_rate(spark):
    ref = spark.createDataFrame([("f", "a", 0.0, 2.0), ("f", "b", 2.0, 4.0)], "f string, spk string, start double, end double")
    same = clustering.error_rate(ref, ref.withColumn("spk", F.upper("spk")), ["f"], collar=0.0).first()
    assert same.rate == 0 and same.total == 400
    half = clustering.error_rate(ref, spark.createDataFrame([("f", "x", 0.0, 3.0)], ref.schema), ["f"], collar=0.0).first()
    assert (half.missed, half.confused, half.false_alarm) == (100, 100, 0)


@pytest.mark.parametrize("text", ["", "one two three. four five!\n\nsix " * 40, "x" * 3000, "Ü" + " ä" * 500, "\n\n\n a \n\n"])
def test_chunks_partition_the_text(text):
    parts = chunking.chunks(text, 20)
    assert "".join(parts) == text and all(chunking.by_words(p) <= 20 for p in parts) and all(parts)


def test_padded_window(spark):
    ids, mask = chunking.padded_window(F.array(F.lit(5), F.lit(6)), 4)
    assert list(one(spark, ids)) == [5, 6, 0, 0] and list(one(spark, mask)) == [1, 1, 0, 0]
    with pytest.raises(Exception, match="too many tokens"):
        one(spark, chunking.padded_window(F.array(F.lit(5), F.lit(6)), 1)[0])


def test_search_and_lookup(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(60, 8))
    df = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)] + [(90, None), (91, [0.0] * 8)], "vec_id long, embedding array<double>")
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    got = ranking.search(df.filter("vec_id % 50 = 0"), df, 5).orderBy("query", "rank").collect()
    want = [(q, int(k)) for q in (0, 50) for k in [x for x in np.argsort(-(u @ u[q]), kind="stable") if x != q][:5]]
    assert [(r.query, r.key) for r in got] == want
    with pytest.raises(Exception, match="nothing for fr"):
        ranking.resolved(spark.createDataFrame([("fr",)], "l string"), spark.createDataFrame([("de", "m")], "l string, m string"), "l", "m", strict=True).collect()


def test_images():
    h, w = image.target_size(480, 640)
    assert h % 16 == w % 16 == 0 and (h // 16) * (w // 16) <= 256 and abs(w / h - 4 / 3) < 0.2
    flat = np.full((30, 50, 3), 7, dtype=np.uint8)
    assert np.allclose(image.resized(flat, 11, 90), 7)
    x, mask, (r, c) = image.preprocessed(flat.tobytes(), 30, 50)
    assert x.shape == (256, 768) and mask.sum() == r * c and np.allclose(x[: r * c], (7 / 255 - 0.5) / 0.5) and not x[r * c :].any()
    assert image.lifted(np.ones((4, 4, 5)), 2, 3, 10).shape == (10, 5)
    with pytest.raises(ValueError, match="bytes"):
        image.preprocessed(b"123", 1, 2)


def test_sources(spark, tmp_path):
    (tmp_path / "a.rttm").write_text("SPEAKER f 1 0.5 1.0 <NA> <NA> bob <NA>\nSPEAKER f 1 0.1 1.0 <NA> <NA> ann <NA>\nshort line\nSPEAKER f 1 2.0 1.0 <NA> <NA> bob <NA>\n")
    got = captions.read_rttm(spark, str(tmp_path / "a.rttm")).orderBy("start").collect()
    assert [(r.start, r.end, r.spk) for r in got] == [(0.1, 1.1, 0), (0.5, 1.5, 1), (2.0, 3.0, 1)]
    buffer = io.BytesIO()
    with wave.open(buffer, "wb") as f:
        f.setnchannels(2)
        f.setsampwidth(2)
        f.setframerate(16_000)
        f.writeframes(struct.pack("<4h", 16384, 0, -32768, -32768))
    (tmp_path / "x.wav").write_bytes(buffer.getvalue())
    (tmp_path / "bad.wav").write_bytes(b"no")
    rows = {r.path.rsplit("/", 1)[1]: r for r in wav.read(spark, str(tmp_path)).collect()}
    assert rows["x.wav"].rate == 16_000 and list(rows["x.wav"].samples) == [0.25, -1.0] and rows["bad.wav"].samples is None and rows["bad.wav"].error
    captions.write_texts(spark.createDataFrame([("a", "x\n"), ("b", "y\n")], "n string, c string"), "n", "c", str(tmp_path / "out"), "srt")
    assert sorted(p.read_text() for p in (tmp_path / "out").glob("file=*.srt/part-*")) == ["x\n", "y\n"]
    captions.write_json(spark.createDataFrame([(1, "a")], "k int, t string"), str(tmp_path / "j"))
    assert captions.find_named(spark, str(tmp_path), "*.wav").count() == 2


def test_models_and_config(spark):
    df = spark.createDataFrame([(1, "one two three four five six"), (2, "one"), (3, "")], "id long, t string")
    got = {r.id: np.array(r.embedding) for r in models.embedded_texts(df, "id", "t", models.Stub, budget=4).collect()}
    assert set(got) == {1, 2} and all(np.linalg.norm(v) == pytest.approx(1) for v in got.values())
    clips = spark.createDataFrame([(1, [float(k) for k in range(10)])], "id long, s array<double>")
    spans = models.embedded_windows(clips, ["id"], "s", 4, 4, models.Stub).orderBy("start").collect()
    assert [(r.start, r.len, len(r.embedding)) for r in spans] == [(0, 4, 64), (4, 4, 64), (8, 2, 64)]
    assert one(spark, config.variant(F.lit(51865), F.lit(384))) == "tiny" and config.Task("translate") is config.Task.TRANSLATE
    with pytest.raises(ValueError, match="bad options"):
        config.DecodingOptions(temperature=2)
    payload = '{"device_support": [{"identifiers": ["ab", "c"], "models": {"default": "m", "supported": ["m", "n"]}}]}'
    assert [(r.prefix, r.model_default) for r in config.support_table(spark, payload).collect()] == [("ab", "m"), ("c", "m")]
