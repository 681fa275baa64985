"""Hand-computed vectors and plain references for windows, islands, signals and aggregates."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from tidemark.functions import signal, tensor, vector
from tidemark.operators import aggregates, alignment, facts, islands, windows


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def lit(*xs, kind="array<double>"):
    return F.array(*[F.lit(x) for x in xs]).cast(kind)


def spans(spark, total, plan):
    df = spark.createDataFrame([(total,)], "total long")
    return [(r.start, r.len) for r in windows.spans(df, "total", plan).orderBy("start").collect()]


def test_window_plans(spark):
    w, h = 480_000, 240_000
    padded = [(0, 480000), (240000, 480000), (480000, 480000), (720000, 280000), (960000, 40000)]
    assert spans(spark, 1_000_000, windows.Plan(w, h)) == padded
    assert spans(spark, 1_000_000, windows.Plan(w, h, least=120_000)) == padded[:-1]
    assert spans(spark, 480_001, windows.Plan(w, w)) == [(0, 480000), (480000, 1)]
    assert spans(spark, 480_001, windows.Plan(w, w, least=2)) == [(0, 480000)]
    assert spans(spark, 0, windows.Plan(w, h)) == [] and spans(spark, 5, windows.Plan(w, h)) == [(0, 5)]
    with pytest.raises(ValueError):
        windows.Plan(10, 11)
    with pytest.raises(Exception, match="too many windows"):
        spans(spark, 1000, windows.Plan(2, 1, cap=10))


@pytest.mark.parametrize("plan", [windows.Plan(7, 3), windows.Plan(8, 8), windows.Plan(9, 2, least=4), windows.Plan(5, 1, least=5)])
def test_counts_and_membership(spark, plan):
    for total in (0, 1, 3, 4, 5, 8, 9, 10, 23):
        every = [s for s in range(0, total, plan.hop)] if total > plan.window else [0] if total else []
        want = [s for s in every if plan.least is None or min(plan.window, total - s) >= plan.least]
        assert [s for s, _ in spans(spark, total, plan)] == want
        assert one(spark, plan.count(F.lit(total).cast("long"))) == len(want)
        if plan.least is None:
            for pos in range(total):
                got = one(spark, windows.window_starts_of(F.lit(pos).cast("long"), F.lit(total).cast("long"), plan))
                assert list(got) == [s for s in every if s <= pos < s + plan.window]


def test_chunk_starts(spark):
    starts = lambda n: list(one(spark, windows.chunk_starts(F.lit(n).cast("long"), 160, 16)))
    assert starts(100) == [0] and starts(160) == [0] and starts(161) == [0, 16] and starts(200) == [0, 16, 32, 48]
    assert list(one(spark, windows.overlapped_starts(F.lit(900_000).cast("long")))) == [0, 336_000, 672_000]


def overlap(spark, chunks):
    rows = [(1, c, f, n) for c, own in enumerate(chunks) for f, n in enumerate(own)]
    df = spark.createDataFrame(rows, "clip int, chunk long, frame long, n int")
    return [r.n for r in windows.overlap_add(df, ["clip"], "chunk", "frame", "n", 2.0, 1.0, len(chunks[0])).orderBy("out_frame").collect()]


def test_overlap_add(spark):
    assert overlap(spark, [[1, 2, 1, 0], [2, 1, 1, 2], [1, 2, 1, 0]]) == [1, 2, 2, 0, 1, 2, 1, 0, 0]
    assert overlap(spark, [[1, 2, 0]]) == [1, 2, 0, 0]


def segments(spark, probs):
    df = spark.createDataFrame([(1, k, p) for k, p in enumerate(probs)], "clip int, at int, p double")
    return [(r.start, r.end) for r in islands.hysteresis(df, ["clip"], "at", "p").collect()]


def test_hysteresis(spark):
    assert segments(spark, [0.9, 0.9, 0.9, 0.0, 0.0]) == [(0, 3 * 4096 + 480)]
    assert segments(spark, [0.9, 0.9, 0.9, 0.0]) == [(0, 4 * 4096)]
    assert segments(spark, [0.0, 0.4, 0.2]) == []


def test_runs_against_a_loop(spark):
    rng = random.Random(1)
    flags = [rng.random() < 0.4 for _ in range(80)]
    df = spark.createDataFrame([(1, k, f) for k, f in enumerate(flags)], "clip int, at long, on boolean")
    want, start = [], 0
    for k in range(1, 81):
        if k == 80 or flags[k] != flags[start]:
            want.append((flags[start], start, k))
            start = k
    found = islands.runs(df, ["clip"], "at", "on")
    assert sorted((r.active, r.start, r.end) for r in found.collect()) == sorted(want)
    silent = [(z - a, -a, a, z) for on, a, z in want if not on]
    assert tuple(islands.longest_run(found, ["clip"]).first()[1:]) == max(silent)[2:]


def test_split_points():
    quiet = np.array([True] * 30 + [False] * 4 + [True] * 3 + [False] * 6 + [True] * 57)
    got = list(islands.split_points(quiet, 10, 1000, 500))
    assert got[0] == (0, 400) and got[-1][1] == 1000
    # The middle of a run of three frames is that of its first whole one.
    odd = np.array([True] * 30 + [False] * 3 + [True] * 67)
    assert next(islands.split_points(odd, 10, 1000, 500)) == (0, 310)


def test_ties_of_the_warp_are_those_of_the_sums():
    rng = np.random.default_rng(3)

    def slow(weights):
        n, m = weights.shape
        total, came = np.full((n + 1, m + 1), np.inf), np.zeros((n + 1, m + 1), int)
        total[0, 0], came[0, :], came[:, 0] = 0, 2, 1
        for i in range(1, n + 1):
            for j in range(1, m + 1):
                c = [total[i - 1, j - 1] - weights[i - 1, j - 1], total[i - 1, j] - weights[i - 1, j - 1], total[i, j - 1] - weights[i - 1, j - 1]]
                came[i, j] = 0 if c[0] < c[1] and c[0] < c[2] else 1 if c[1] < c[0] and c[1] < c[2] else 2
                total[i, j] = c[came[i, j]]
        i, j, path = n, m, []
        while i > 0 or j > 0:
            path.append((i - 1, j - 1))
            i, j = i - (came[i, j] != 2), j - (came[i, j] != 1)
        return path[::-1]

    for _ in range(100):
        x = rng.normal(size=(6, 8)) * 10.0 ** rng.integers(-8, 18, size=(6, 8))
        assert list(zip(*alignment.warp(x), strict=True)) == slow(x)


def test_split_points_run_on():
    quiet = np.array([True] * 30 + [False] * 4 + [True] * 3 + [False] * 6 + [True] * 57)
    got = list(islands.split_points(quiet, 10, 1000, 500))
    assert all(0 < z - a <= 500 for a, z in got) and all(got[k][1] == got[k + 1][0] for k in range(len(got) - 1))
    assert list(islands.split_points(quiet, 10, 400, 500)) == [(0, 400)]


def test_seek_clips(spark):
    clips = lambda *s: [tuple(c) for c in one(spark, islands.seek_clips(lit(*s), F.lit(160_000)))]
    assert clips() == [(0, 160_000)] and clips(1.0) == [(16_000, 160_000)] and clips(1.0, 2.0, 3.0, 4.0) == [(16_000, 32_000), (48_000, 64_000)]
    with pytest.raises(Exception, match="bad clip second"):
        clips(-1.0)


def test_argmax_and_powerset(spark):
    assert one(spark, islands.argmax(lit(1.0, float("nan"), 3.0, 3.0))) == 2
    assert one(spark, islands.argmax(lit(float("nan")))) == 0
    assert list(one(spark, islands.multilabel(lit(0, 0, 0, 0, 9, 0, 0)))) == [1, 1, 0]


def test_signal_functions(spark):
    assert one(spark, signal.rms(lit(3.0, 4.0))) == pytest.approx(math.sqrt(12.5)) and one(spark, signal.rms(lit())) == 0
    assert list(one(spark, signal.padded_or_cut(lit(1.0, 2.0), 3))) == [1, 2, 0] and list(one(spark, signal.padded_or_cut(lit(1.0, 2.0), 1))) == [1]
    assert list(one(spark, signal.tiled(lit(1.0, 2.0), 5))) == [1, 2, 1, 2, 1] and list(one(spark, signal.tiled(lit(), 2))) == [0, 0]
    assert list(one(spark, signal.held(lit(1.0, 2.0), 4))) == [1, 2, 2, 2] and one(spark, signal.held(lit(1.0, 2.0), 1)) is None
    assert list(one(spark, signal.with_context(lit(1.0, 2.0, 3.0), lit(9.0), 2))) == [2, 3, 9]
    e = lambda a, b: one(spark, signal.relative_energy(F.lit(a), F.lit(b)))
    assert e(0.01, 0.01) == 0 and e(1.0, 0.01) == pytest.approx(1) and e(0.1, 0.01) == pytest.approx(0.5) and e(0.0, 0.01) == 0 and e(5.0, 0.5) == 1
    assert one(spark, signal.log_sum_exp(lit(1000.0, 1000.0))) == pytest.approx(1000 + math.log(2)) and one(spark, signal.log_sum_exp(lit())) == float("-inf")
    assert one(spark, signal.slaney_hz(signal.slaney_mel(F.lit(4321.0)))) == pytest.approx(4321) and one(spark, signal.slaney_mel(F.lit(500.0))) == pytest.approx(7.5)
    assert one(spark, signal.first_bad_index(lit(1.0, float("inf")))) == 1 and one(spark, signal.first_bad_index(lit(1.0))) is None
    assert one(spark, signal.grid_count(F.lit(2.5), 1.0)) == 3 and one(spark, signal.rounded(F.lit(2.5), 0)) == 3
    mel = signal.log_mel(np.sin(np.arange(4800) / 8), 1024, 480, 48_000, 64)
    assert mel.shape == (11, 64) and np.isfinite(mel).all()
    assert signal.filterbank(64, 512, 16_000, "htk").max() <= 1 and np.ptp(signal.log_mel(np.zeros(400), 512, 160, 16_000, 64, "htk", False, 120.0)) == 0


def test_tensors(spark):
    shape = lit(2, 3, kind="array<int>")
    data = lit(*map(float, range(6)))
    assert one(spark, tensor.element_count(shape)) == 6 and one(spark, tensor.fits(data, shape))
    assert one(spark, tensor.read_at(data, lit(1, 2, kind="array<int>"), shape)) == 5 and one(spark, tensor.offset(lit(2, 0, kind="array<int>"), shape)) is None
    assert list(one(spark, tensor.filled_at_all(data, lit(0, 5, kind="array<int>"), F.lit(9.0)))) == [9, 1, 2, 3, 4, 9]
    assert one(spark, tensor.filled_at_all(data, lit(6, kind="array<int>"), F.lit(9.0))) is None
    assert list(one(spark, tensor.without_row_padding(data, 2, 2, 3))) == [0, 1, 3, 4]
    assert one(spark, tensor.prefix_mask_count(lit(1, 1, 0, kind="array<int>"))) == 2 and one(spark, tensor.prefix_mask_count(lit(0, 1, kind="array<int>"))) is None
    with pytest.raises(Exception, match="does not fit"):
        one(spark, tensor.tensor(data, lit(2, kind="array<int>")))


def test_vectors(spark):
    assert list(one(spark, vector.normalized(lit(3.0, 4.0)))) == [0.6, 0.8]
    assert one(spark, vector.normalized(lit(0.0, 0.0))) is None and one(spark, vector.normalized(lit(1.0, float("nan")))) is None and one(spark, vector.normalized(lit(1.0), 2)) is None
    assert one(spark, vector.cosine(lit(1.0, 0.0), lit(1.0, 1.0))) == pytest.approx(math.sqrt(0.5)) and one(spark, vector.cosine(lit(0.0), lit(1.0))) is None
    assert one(spark, vector.is_close(lit(1.0, 2.0), lit(1.1, 2.0), 0.11)) and not one(spark, vector.is_close(lit(1.0), lit(1.2), 0.1))
    with pytest.raises(Exception, match="zero"):
        one(spark, vector.checked(lit(0.0, 0.0), 2))


def test_vector_aggregates(spark):
    e = np.eye(3).tolist()
    df = spark.createDataFrame([(1, k, v, c) for k, (v, c) in enumerate(zip(e, [1.0, 0.25, 0.0], strict=True))], "g int, k int, v array<double>, c double")
    got = lambda d: pytest.approx(list(d.first().embedding))
    two = df.filter("k < 2")
    assert got(aggregates.pooled(two, ["g"], "v")) == [math.sqrt(0.5), math.sqrt(0.5), 0]
    assert got(aggregates.ema(two, ["g"], "k", "v", 0.0)) == e[0] and got(aggregates.ema(two, ["g"], "k", "v", 1.0)) == e[1]
    assert got(aggregates.ema(df, ["g"], "k", "v", 0.5)) == [0.4082483, 0.4082483, 0.8164966]
    assert got(aggregates.pooled(two, ["g"], "v", weight=F.col("c"))) == [0.9701425, 0.24253563, 0]
    assert got(aggregates.pooled(df, ["g"], "v", "max", normalize=False)) == [1, 1, 1]


@pytest.mark.parametrize(("values", "want"), [([True, None], True), ([False, None], None), ([False, False], False), ([None], None), ([True, False], True)])
def test_kleene_or(spark, values, want):
    df = spark.createDataFrame([(v,) for v in values], "x boolean")
    assert df.agg(aggregates.kleene_or(F.col("x"))).first()[0] is want


def test_scalar_aggregates(spark):
    df = spark.createDataFrame([(k, float(v), 2.0 * k) for k, v in enumerate([4, 1, 3, 2])], "k int, v double, s double")
    a = lambda c: df.agg(c).first()[0]
    v = F.col("v")
    assert a(aggregates.upper_median(v)) == 3 and a(aggregates.upper_median(v, 0.7)) == 0.7 and a(aggregates.upper_median(-v)) == 0
    assert a(aggregates.nearest_rank(v, 0.5)) == 2 and a(aggregates.unanimous(v)) is None and a(aggregates.unanimous(F.lit(1))) == 1
    assert a(aggregates.pipeline_time(F.col("s"), v)) == 8 and a(aggregates.per_second(F.sum(v), F.lit(0.0))) == 0
    assert a(aggregates.first_known(F.when(v < 3, v), F.col("k"))) == 1 and list(a(aggregates.all_known_list(v, F.col("k")))) == [4, 1, 3, 2]
    assert tuple(a(aggregates.merged_span(F.col("k"), v > 1))) == (6, False)


def test_fact_merging_is_ordered(spark):
    rows = [(1, 2, True, "en", "b", 3, True), (1, 1, None, None, "a", 2, True), (2, 1, False, None, None, 1, False), (2, 2, None, "de", "x", 1, True)]
    df = spark.createDataFrame(rows, "g int, o int, t boolean, l string, s string, b long, e boolean")
    got = {r.g: r for r in facts.merged_facts(df, ["g"], "o", ["t"], "l", "s", "b", "e").collect()}
    assert got[1].t is True and got[1].l == "en" and got[1].s == ["a", "b"] and tuple(got[1].span) == (5, True)
    assert got[2].t is None and got[2].l == "de" and got[2].s is None and tuple(got[2].span) == (2, False)


def test_values_that_lambdas_share_are_computed_once(spark):
    """A column named within a lambda is computed again for each element: four deep in align_log_prob_faults."""
    rows = spark.createDataFrame([(1, [math.log(0.25)] * 4), (2, [0.0] * 4), (3, [float("nan"), 0.0]), (4, [-101.0, 0.0]), (5, None)], "vec_id long, embedding array<double>")
    told = rows.select("vec_id", alignment.log_prob_faults(F.col("embedding")).alias("fault"), signal.log_sum_exp(F.col("embedding")).alias("lse"))
    for column in (alignment.log_prob_faults(F.col("embedding")), signal.log_sum_exp(F.col("embedding"))):
        plan = rows.select(column.alias("x"))._jdf.queryExecution().analyzed().toString().split("\n")[0]
        assert plan.count("embedding#") == 1
    got = {r.vec_id: r for r in told.collect()}
    assert [got[k].fault for k in range(1, 6)] == [None, "not normalised", "not a number", "below the floor", None]
    assert got[1].lse == pytest.approx(0) and got[2].lse == pytest.approx(math.log(4)) and got[4].lse == 0 and got[5].lse == float("-inf")
