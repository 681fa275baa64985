import hashlib
import re

from tidemark.llm import exact_dedup

SCHEMA = "doc_id long, text string, keep_id string, kept string"


def table(spark):
    rows = [(k, f"text number {k % 37}  \t x", "clash", None) for k in range(200)]
    rows += [(500, None, None, None), (501, "", None, None), (502, " ", None, None), (503, "\n\t ", None, None)]
    rows += [(None, "nobody", None, None), (None, "nobody", None, None), (7, "text number 7 x", None, None), (600, "a" * 300_000, None, None), (601, " ", None, None)]
    return spark.createDataFrame(rows, SCHEMA), rows


def brute(rows):
    groups = {}
    for k, (doc, text, *_) in enumerate(rows):
        t = re.sub(r"[\x20\x09-\x0D]+", " ", text or "")
        groups.setdefault(t, []).append((doc is None, doc if doc is not None else 0, k))
    out = []
    for t, own in groups.items():
        first = min(own)
        for none, doc, _ in own:
            out.append((None if none else doc, None if first[0] else first[1], len(own), hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=str)


def test_groups_against_brute_force(spark):
    df, rows = table(spark)
    got = exact_dedup.duplicate_groups(df).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == brute(rows)
    # Of each group one row stays, even where rows repeat key and text.
    assert sum(r.kept for r in got) == len({r.text_sha256 for r in got})
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_heavy_groups(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "HEAVY", 10)
    df, rows = table(spark)
    df = df.unionByName(spark.range(1000, 1300).selectExpr("id AS doc_id", "'same' AS text", "'' AS keep_id", "'' AS kept"))
    rows = rows + [(k, "same", "", "") for k in range(1000, 1300)]
    got = exact_dedup.duplicate_groups(df).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == brute(rows)


def test_filter_misses_are_certain(spark):
    df, rows = table(spark)
    prints = exact_dedup.fingerprints(df)
    marked = exact_dedup.RepeatFilter(prints, "text_sha256", most_bits=1 << 10).marked(prints, "text_sha256", "may").collect()
    sizes = {}
    for r in marked:
        sizes[r.text_sha256] = sizes.get(r.text_sha256, 0) + 1
    assert all(r.may for r in marked if sizes[r.text_sha256] > 1)


def test_deduplicate_keeps_columns(spark):
    df, rows = table(spark)
    got = exact_dedup.deduplicate(df)
    assert got.columns == df.columns
    assert sorted((str(r.doc_id) for r in got.collect())) == sorted(str(r.doc_id) for r in exact_dedup.duplicate_groups(df).filter("kept").collect())


def test_empty_table(spark):
    assert exact_dedup.duplicate_groups(spark.createDataFrame([], SCHEMA)).collect() == []
