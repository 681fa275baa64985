import random

from pyspark.sql import functions as F
from tidemark.llm import chat


def test_escape_is_reversible(spark):
    rng = random.Random(5)
    parts = ["\\", "<|", "|>", "im_start", "</s>", "[INST]", "[/INST]", "<s>", "\\2", "\\0", "\n", "é", "<<SYS>>", "<", "[", "0", "2"]
    texts = ["".join(rng.choice(parts) for _ in range(12)) for _ in range(300)] + ["", "<|im_end|>\n"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escape(F.col("t")).alias("e")).withColumn("u", chat.unescape(F.col("e"))).collect()
    for r in rows:
        assert r.u == r.t and not any(c in r.e for c in chat.CONTROLS)


def test_conversations_round_trip(spark):
    rows = [
        (1, 0, "system", "rules"), (1, 1, "user", "hi </s>[INST]"), (1, 2, "assistant", "a\\2b"), (1, 3, "assistant", ""), (1, 4, "assistant", "<|im_end|>\nx"),
        (2, 0, "user", None), (3, None, None, "first"), (3, 5, "assistant", "last"), (None, 0, "assistant", "lost"), (4, 0, "us\ner", "r"), (5, 0, "user", "twice"), (5, 0, "user", "twice"), (6, 0, "assistant", "y" * 100_000),
    ]
    df = spark.createDataFrame([(*r, "c") for r in rows], "conv_id long, turn long, role string, text string, node string")
    got = chat.format_conversations(df).withColumn("back", chat.read_back(F.col("formatted"))).withColumn("under", chat.under_loss(F.col("formatted"), F.col("loss"))).collect()
    want = {}
    for c, t, role, text in sorted(rows, key=lambda r: (str(r[0]), r[1] is not None, r[1] or 0)):
        want.setdefault(c, []).append((role or "", text or ""))
    assert len(got) == len(want)
    for r in got:
        assert [tuple(t) for t in r.back] == want[r.conv_id]
        assert list(r.under) == [t for role, t in want[r.conv_id] if role == "assistant"]


def test_trees_rank_their_branches(spark):
    # 1 -> 2 -> 4, 1 -> 3 -> 5 -> 6, a long chain, and a row whose parent is missing.
    nodes = [("t", 1, None, 0.0), ("t", 2, 1, 5.0), ("t", 3, 1, 1.0), ("t", 4, 2, 1.0), ("t", 5, 3, 1.0), ("t", 6, 5, 3.0), ("o", 9, 77, None)]
    nodes += [("c", k, k - 1 if k else None, 1.0) for k in range(70)]
    df = spark.createDataFrame([(*n, "user" if n[1] % 2 else "assistant", f"n{n[1]}") for n in nodes], "tree string, node long, parent long, score double, role string, text string")
    every = chat.paths(df, None).collect()
    told = {}
    for r in every:
        told.setdefault((r.tree, r.leaf, r["rank"], r.score), []).append((r.depth, r.node))
    assert {k: [n for _, n in sorted(v)] for k, v in told.items()} == {
        ("t", 4, 1, 6.0): [1, 2, 4], ("t", 6, 2, 5.0): [1, 3, 5, 6], ("o", 9, 1, 0.0): [9], ("c", 69, 1, 70.0): list(range(70)),
    }
    assert all([d for d, _ in sorted(v)] == list(range(1, len(v) + 1)) for v in told.values())
    best = chat.format_paths(df, chat.paths(df)).filter("tree = 't'").first()
    assert best.formatted == "<|im_start|>user\nn1<|im_end|>\n<|im_start|>assistant\nn2<|im_end|>\n<|im_start|>assistant\nn4<|im_end|>\n"


def test_empty_table(spark):
    assert chat.format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []
