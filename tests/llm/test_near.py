import random
from collections import Counter
from itertools import combinations

import numpy as np
from tidemark.llm import line_dedup, near_dedup, similar


def components(links, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
    return words


def test_union_find(spark):
    rng = random.Random(4)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(1000 + k, 1001 + k) for k in range(100)] + [(5000, 5000 + k) for k in range(1, 300)]
    want = components(links, {x for p in links if p[0] != p[1] for x in p})
    for per_task in (similar.PER_TASK, 20):
        got = {r.id: r.part for r in similar.components(spark.createDataFrame(links, "a long, b long").repartition(7), per_task).collect()}
        assert got == want
    assert similar.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_probability_jaccard_is_estimated():
    rng = np.random.default_rng(1)
    h = near_dedup.mixed(np.arange(1, 300, dtype=np.uint64))
    wa, wb = rng.uniform(0.5, 4, 299), rng.uniform(0.5, 4, 299)
    wa[200:], wb[:60] = 0, 0
    p, q = wa / wa.sum(), wb / wb.sum()
    exact = sum(1 / np.maximum(p / p[k], q / q[k]).sum() for k in range(299) if p[k] and q[k])
    places = 4000
    sig = [near_dedup.signatures(np.zeros((w > 0).sum(), dtype=np.int64), h[w > 0], w[w > 0], 1, places)[0] for w in (wa, wb)]
    assert abs((sig[0] == sig[1]).mean() - exact) < 4 * (exact * (1 - exact) / places) ** 0.5 + 0.01
    # A signature doesn't depend on what else is in the batch, nor on the scale of the weights.
    both = near_dedup.signatures(np.repeat([0, 1], 299), np.concatenate([h, h]), np.concatenate([wa + 1, 7 * (wa + 1)]), 2)
    assert (both[0] == both[1]).all() and (both[0] == near_dedup.signatures(np.zeros(299, dtype=np.int64), h, wa + 1, 1)[0]).all()


def brute(rows, least=0.8):
    sets = []
    for doc, text, *_ in rows:
        w = near_dedup.normalised(text)
        sets.append((doc, " ".join(w), {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()))
    links = [(a, b) for a, b in combinations(range(len(sets)), 2) if sets[a][1] == sets[b][1] or len(sets[a][2] & sets[b][2]) >= least * len(sets[a][2] | sets[b][2]) > 0]
    part = components(links, range(len(sets)))
    groups = {}
    for k, p in part.items():
        groups.setdefault(p, []).append(sets[k][0])
    first = {p: min((d is None, d or 0) for d in g) for p, g in groups.items()}
    return sorted(((sets[k][0], None if first[p][0] else first[p][1], len(groups[p])) for k, p in part.items()), key=str)


def corpus():
    rng = random.Random(9)
    word = lambda: f"w{rng.randrange(3000)}"
    base = [[word() for _ in range(rng.choice([3, 20, 120, 300]))] for _ in range(40)]
    texts = [" ".join(b) for b in base]
    for b in base[:25]:
        texts += [" ".join(edited(rng, b, n)) for n in (1, 1, 4)]
    hot = [word() for _ in range(200)]
    texts += [" ".join(edited(rng, hot, 3)) for _ in range(80)] + [" ".join(hot).upper()] * 20
    texts += ["the same line again and again " * 400, "the same line again and again " * 90, None, "", "  \n", "a", "A"]
    rows = [(1000 - k, t, "clash", 0) for k, t in enumerate(texts)]
    return rows + [(None, texts[0], "", 0), (None, "nobody else says this at all", "", 0), rows[0]]


def test_near_duplicates_against_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string, class_id string, row int")
    got = near_dedup.near_duplicates(df).collect()
    assert sorted(((r.doc_id, r.class_id, r.class_size) for r in got), key=str) == brute(rows)
    kept = near_dedup.deduplicate(df)
    assert kept.columns == df.columns
    assert Counter(str(r.doc_id) for r in kept.collect()) == Counter(str(r.doc_id) for r in got if r.kept)
    empty = spark.createDataFrame([], df.schema)
    assert near_dedup.near_duplicates(empty).collect() == [] and near_dedup.deduplicate(empty).collect() == []


def test_links_of_repeated_lines_are_found(spark):
    """A paragraph and a line, once and 200 times: plain Jaccard similarity 0.93, weighted 0.50."""
    rng = random.Random(5)
    say = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    rows = []
    for k in range(30):
        paragraph, line = say(40), say(14)
        rows += [(2 * k, f"{paragraph} {line}"), (2 * k + 1, " ".join([paragraph] + [line] * 200))]
    want = brute(rows)
    assert all(size == 2 for *_, size in want)
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.class_id, r.class_size) for r in got), key=str) == want


def test_no_link_of_a_chain_is_lost(spark):
    """Every text is near the next alone, and all meet in one band of their own making."""
    rng = random.Random(2)
    words, texts = [f"c{k}" for k in range(150)], []
    for k in range(30):
        texts.append(" ".join(words))
        words[(k * 7) % 150] = f"x{k}"
        words[(k * 7 + 1) % 150] = f"y{k}"
    rng.shuffle(texts)
    rows = [(k, t) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(((r.doc_id, r.class_id, r.class_size) for r in near_dedup.near_duplicates(df).collect()), key=str) == brute(rows)


def lines_by_hand(rows, least=0.8):
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0, k))
    every = sorted({line_dedup.normalised(x) for r in rows for x in (r[1] or "").split("\n")} - {""})
    sets = {x: {x[k : k + 8] for k in range(max(1, len(x) - 7))} for x in every}
    part = components([(a, b) for a, b in combinations(every, 2) if len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b])], every)
    seen, out = set(), {}
    for k in order:
        kept, dropped = [], 0
        for x in (rows[k][1] or "").split("\n"):
            n = line_dedup.normalised(x)
            if n and part[n] in seen:
                dropped += 1
            else:
                kept.append(x)
                seen.add(part[n]) if n else None
        out[k] = (rows[k][0], None if rows[k][1] is None else "\n".join(kept), dropped)
    return sorted(out.values(), key=str)


def line_rows():
    rng = random.Random(6)
    say = lambda n: " ".join("".join(rng.choice("abcdefghiklmnoprstuvé") for _ in range(rng.randint(2, 8))) for _ in range(n))
    common, rows = [say(12) for _ in range(6)], []
    for k in range(60):
        body = [say(rng.choice([1, 4, 15])) for _ in range(4)]
        near = rng.choice(common)
        at = rng.randrange(len(near))
        body.insert(rng.randrange(5), near[:at] + rng.choice(["", "x", "Q"]) + near[at + 1 :])
        body.insert(2, rng.choice(["", "  ", common[0].upper(), "short", "Short "]))
        rows.append((k, "\n".join(body), "clash"))
    return rows + [(100, None, ""), (101, "", ""), (102, "\n\n", ""), (103, common[0], ""), (104, "z" * 100_000, ""), (105, "z" * 100_001, ""), (106, say(30000), "")]


def test_lines_against_brute_force(spark):
    rows = line_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string, n_lines string")
    got = line_dedup.line_dedup(df)
    assert got.columns == ["doc_id", "text", "n_lines", "n_dropped"]
    assert sorted(((r.doc_id, r.text, r.n_dropped) for r in got.collect()), key=str) == lines_by_hand(rows)


def test_lines_of_repeated_and_null_keys(spark):
    rows = [(1, "one line here\nother"), (1, "one line here\nother"), (None, "one line here\nlast"), (None, None)]
    got = line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    assert sorted(((r.doc_id, r.text, r.n_dropped) for r in got), key=str) == lines_by_hand(rows)
    assert line_dedup.line_dedup(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_marks_differ_in_no_more_than_the_sets_do():
    rng = np.random.default_rng(3)
    for n in (0, 1, 9, 60, 900):
        x = similar.mixed(rng.integers(0, 1 << 62, n + 12).astype(np.uint64))
        sets = [x[:n], x[3 : n + 3], x[12:], x[:0]]
        marks = similar._marks(np.repeat(np.arange(4), [len(s) for s in sets]), np.concatenate(sets), 4)
        assert marks.shape == (4, similar.MARKS)
        for a, b in combinations(range(4), 2):
            bits = sum(int(k).bit_count() for k in (marks[a] ^ marks[b]).view(np.uint64))
            assert bits <= len(set(sets[a].tolist()) ^ set(sets[b].tolist()))


def test_leftover_pairs_are_few_and_made_once(spark):
    """Long lines that hold the same passage, most pairs similar just below 0.8."""
    rng = random.Random(8)
    say = lambda: "".join(rng.choice("abcdefghiklmnoprstuv") for _ in range(6))
    passage, lines = [say() for _ in range(110)], []
    for k in range(60):
        words = list(passage)
        for at in rng.sample(range(110), 2 if k < 6 else 4):
            words[at] = say()
        lines.append(" ".join(words))
    sets = [{x[k : k + 8] for k in range(len(x) - 7)} for x in lines]
    alike = {p: len(sets[p[0]] & sets[p[1]]) / len(sets[p[0]] | sets[p[1]]) for p in combinations(range(60), 2)}
    want = {p for p, j in alike.items() if j >= 0.8}
    assert want and sum(0.7 <= j < 0.79 for j in alike.values()) > 1000
    split = spark.createDataFrame([(1, k, k, 60) for k in range(60)], "key long, id long, part long, rows long")
    bodies = spark.createDataFrame(list(enumerate(lines)), "id long, body string")
    like = similar.Similarity(lambda pairs: pairs, lambda: bodies, line_dedup.shingles, 0.8)
    got = [(r.a, r.b) for r in similar._rest(split, like).collect()]
    assert len(got) == len(set(got)) and want <= set(got) and 2 * len(got) < len(alike)
    shared = [(r.a, r.b) for r in similar._shared(similar._rarest(split, like), 0.8).collect()]
    assert want <= set(shared) and len(shared) < 2 * len(set(shared))
