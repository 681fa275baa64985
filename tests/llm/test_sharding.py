import zlib
from collections import Counter

from tidemark.llm import sharding


def check(got, rows, shards):
    sizes = Counter(r.shard for r in got)
    assert len(got) == len(rows) and max(sizes.values()) - min(sizes.get(s, 0) for s in range(shards)) <= 1
    for s, n in sizes.items():
        assert sorted(r.slot for r in got if r.shard == s) == list(range(n))
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in got) == sorted((str(d), len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t in rows)


def test_rows_are_even_and_links_stay_together(spark):
    rows = [(k, f"alone é {k}") for k in range(300)] + [(k, f"group {k % 60}") for k in range(300, 600)] + [(None, None), (None, ""), (1, "alone é 1"), (700, "x" * 200_000)]
    df = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, shard string")
    placed = sharding.shard_rows(df, shards=7)
    check(placed.collect(), rows, 7)
    linked, cut = sharding.cut_links(placed).first()
    by_hash = sum(5 - Counter((k * 7919) % 7 for k in range(5)).most_common(1)[0][1] for _ in range(60))
    assert linked == 304 and cut < by_hash / 3


def test_one_text_holds_a_third(spark):
    rows = [(k, "same" if k % 3 == 0 else f"t{k}") for k in range(900)]
    check(sharding.shard_rows(spark.createDataFrame(rows, "doc_id long, text string")).collect(), rows, 40)


def test_few_rows_and_none(spark):
    rows = [(1, "a"), (2, "a"), (3, "b")]
    got = sharding.shard_rows(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len({r.shard for r in got}) == 3 and all(r.slot == 0 for r in got)
    assert sharding.shard_rows(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_a_cell_larger_than_a_run_is_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(sharding, "RUN_ROWS", 2)
    monkeypatch.setattr(sharding, "HEAVY", 40)
    rows = [(k, "same" if k % 3 == 0 else f"t{k}") for k in range(3000)]
    check(sharding.shard_rows(spark.createDataFrame(rows, "doc_id long, text string"), shards=5).collect(), rows, 5)
