import itertools
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tidemark.llm import packing
from tokenizers import Tokenizer

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = ["", None, "one", "two two", "Ünïcode 日本語 🙂 á", " \n\t  x ", "<|endoftext|> [INST]", "word " * 3000, "x" * 5000, "two two", "1234567890" * 20, "'s 'll don't"]


def slow():
    return Tokenizer.from_file(PATH)


def test_ids_are_those_of_tokenizers():
    encode, t = packing.encoder(PATH), slow()
    rng = random.Random(3)
    texts = [x for x in TEXTS if x] + ["".join(rng.choice("aé\n 7,.'ßñ日x  ") for _ in range(400)) for _ in range(50)]
    for x in texts:
        assert encode(x) == t.encode(x, add_special_tokens=False).ids


@pytest.mark.parametrize("n", [1, 2, 1023, 1024, 1025, 2048, 2049, 5000])
def test_cut(n):
    pieces = packing.cut(n, 1024)
    assert [s for s, _ in pieces] == list(itertools.accumulate([0, *[k for _, k in pieces[:-1]]]))
    assert sum(k for _, k in pieces) == n and all(k == 1024 for _, k in pieces[1:]) and len(pieces) == -(-n // 1024)


def test_fullest_is_the_best_subset():
    rng = random.Random(1)
    for _ in range(100):
        items = [rng.randint(1, 30) for _ in range(8)]
        room = rng.randint(1, 60)
        best = max(sum(c) for r in range(9) for c in itertools.combinations(items, r) if sum(c) <= room)
        counts = {x: items.count(x) for x in items}
        order = sorted((x for x in counts if x <= room), reverse=True)
        taken = packing.fullest(counts, order, room)
        assert sum(k * v for k, v in taken.items()) == best and all(v <= counts[k] for k, v in taken.items())


def test_plan_uses_each_piece_once_and_packs_well():
    rng = random.Random(2)
    counts = {k: rng.randint(0, 40) for k in range(1, 1024)}
    steps = packing.plan(counts)
    used = {}
    for times, taken in steps:
        assert sum(k * v for k, v in taken.items()) <= 1024
        for k, v in taken.items():
            used[k] = used.get(k, 0) + v * times
    assert used == {k: v for k, v in counts.items() if v}
    bins = sum(t for t, _ in steps)
    least = max(-(-sum(k * v for k, v in counts.items()) // 1024), sum(v for k, v in counts.items() if k > 512))
    assert bins <= least * 1.03


@pytest.mark.parametrize("run_rows", [packing.RUN_ROWS, 2])
def test_round_trip(spark, monkeypatch, run_rows):
    monkeypatch.setattr(packing, "RUN_ROWS", run_rows)
    rows = [(k if k % 5 else None, x, "clash", "clash") for k, x in enumerate(TEXTS * 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, piece string, length string")
    got = packing.pack(df, PATH).collect()
    t = slow()
    want = sorted(tuple(t.encode(x or "", add_special_tokens=False).ids + [2]) for _, x, *_ in rows)
    seen = {}
    for r in got:
        ids = np.frombuffer(r.ids, dtype="<u4")
        assert len(ids) == r.length and zlib.crc32(r.ids) == r.ids_crc32
        seen.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in seen.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    assert sum(r.length for r in got) == sum(map(len, want))
    assert sorted(r.ids_crc32 for r in got if r.piece == 0 and r.length < 1024) == sorted(zlib.crc32(np.array(w[s : s + n], dtype="<u4").tobytes()) for w in want for s, n in packing.cut(len(w), 1024)[:1])


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(df, PATH, with_ids=False).collect() == []


def test_added_tokens_are_read_as_by_default(spark, tmp_path):
    import corpus_pipeline
    from tidemark.llm import queries

    encode, t = packing.encoder(PATH, added=True), Tokenizer.from_file(PATH)
    assert encode("a <|endoftext|> b") == [64, 220, 50256, 275]
    texts = [x for x in TEXTS if x] + ["<|endoftext|>", "x<|endoftext|><|endoftext|>\n\n y", "<|endoftext| >", "é <|endoftext|>" * 2000]
    for x in texts:
        assert encode(x) == t.encode(x, add_special_tokens=False).ids
    want = []
    for x in texts:
        ids = t.encode(x, add_special_tokens=False).ids + [2]
        want += [zlib.crc32(np.array(ids[s : s + n], dtype="<u4").tobytes()) for s, n in packing.cut(len(ids), 1024)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert sorted(r.ids_crc32 for r in queries.op10_packing(spark, str(tmp_path)).collect()) == sorted(want)
    assert sorted(r.ids_crc32 for r in corpus_pipeline.pack(spark, docs, "").collect()) == sorted(want)


def test_pipeline_gives_the_ids(spark):
    import corpus_pipeline

    docs = spark.createDataFrame([(k, x) for k, x in enumerate(TEXTS)], "doc_id long, text string")
    got, t = corpus_pipeline.pack(spark, docs, "").collect(), Tokenizer.from_file(PATH)
    for k, x in enumerate(TEXTS):
        parts = sorted((r.start, r.ids) for r in got if r.doc_id == k)
        assert np.frombuffer(b"".join(ids for _, ids in parts), dtype="<u4").tolist() == t.encode(x or "", add_special_tokens=False).ids + [2]
