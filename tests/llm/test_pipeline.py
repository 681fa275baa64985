"""The pipeline's stages, each on its own input, against what they must do."""

import os
import zlib

import pytest
from .test_decontaminate import brute as leaks
from .test_near import brute as near
from .test_near import lines_by_hand

FOLDER = "/root/testdata/sf0.001"

if not os.path.isdir(FOLDER):
    pytest.skip("no tables here", allow_module_level=True)

import corpus_pipeline  # noqa: E402


def same(a, b):
    return sorted(map(tuple, a), key=str) == sorted(map(tuple, b), key=str)


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, before = docs.columns, docs.collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    assert [k for k, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_dedup", "decontaminate", "packing"]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = str(tmp_path / str(k))
        stage(spark, docs, FOLDER).write.parquet(out)
        docs = spark.read.parquet(out)
        rows = docs.collect()
        if name == "quality":
            assert set(rows) <= set(before) and all(labels.get(r.doc_id) != 0 for r in rows if zlib.crc32(str(r.doc_id).encode()) % 5)
            assert sum(r.doc_id in {x.doc_id for x in rows} for r in before if labels.get(r.doc_id) == 1) >= 0.97 * sum(v == 1 for v in labels.values())
        if name == "line_dedup":
            want = {d: (t, n) for d, t, n in lines_by_hand([(r.doc_id, r.text) for r in before])}
            own = {r.doc_id: len([x for x in r.text.split("\n") if x.strip()]) for r in before}
            assert same([(r.doc_id, r.text) for r in rows], [(d, t) for d, (t, n) in want.items() if own[d] == 0 or n < own[d]])
            assert all(r.n_chars == len(r.text) for r in rows)
        if name == "near_dedup":
            first = {d: c for d, c, _ in near([(r.doc_id, r.text) for r in before])}
            assert same(rows, [r for r in before if first[r.doc_id] == r.doc_id])
        if name == "decontaminate":
            hit = {d for d, _, n, _ in leaks([(r.doc_id, r.text) for r in before], items) if n}
            assert same(rows, [r for r in before if r.doc_id not in hit])
        if name == "packing":
            assert {r.doc_id for r in rows} == {r.doc_id for r in before} and all(r.length <= 1024 for r in rows)
        else:
            assert docs.columns == columns
        before = rows
