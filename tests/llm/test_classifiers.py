import random
import zlib

import numpy as np
import pytest
from tidemark.llm import quality, toxicity

INSULTS = ["zorgle", "blimfest", "crandok"]


def docs_and_labels(spark, kind):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("aeioustrnlmdpk") for _ in range(rng.randint(2, 7)))
    docs, labels = [], []
    for k in range(600):
        words = [word() for _ in range(rng.randint(5, 80))]
        bad = k % 4 == 0
        if bad and kind == "quality":
            words = [w.upper() + "!!" for w in words] if k % 8 else [w + "***" for w in words]
        if bad and kind == "toxic":
            insult = rng.choice(INSULTS)
            if k % 3 == 1:
                at = rng.randrange(1, len(insult))
                insult = rng.choice([insult[:at] + rng.choice("x*-") + insult[at:], " ".join(insult)])
            words[rng.randrange(len(words))] = insult
        docs.append((k, " ".join(words) + ".", "en", "src", "clash"))
        labels.append((k, int(not bad) if kind == "quality" else int(bad), "c"))
    docs += [(700, None, None, None, ""), (701, "", None, None, ""), (None, "plain words", None, None, ""), (702, "tan " * 50_000, None, None, ""), docs[5]]
    labels += [(None, 1, "c"), (700, None, "c"), (5, labels[5][1], "c")]
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, score string"), spark.createDataFrame(labels, f"doc_id long, {kind} int, text string"), {r[0]: r[1] for r in labels}


@pytest.mark.parametrize("kind", ["quality", "toxic"])
def test_held_out_accuracy(spark, kind):
    docs, labels, truth = docs_and_labels(spark, kind)
    run, cut = (quality.quality, quality.ACCEPT) if kind == "quality" else (toxicity.toxicity, toxicity.TOXIC)
    got = run(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= cut) for r in got)
    assert all(r.held_out == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r.held_out and truth.get(r.doc_id) is not None]
    assert len(held) > 80 and np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95
    if kind == "toxic":
        assert all(r.predicted == 0 for r in got if r.doc_id in (700, 701, 702))


@pytest.mark.parametrize("kind", ["quality", "toxic"])
def test_without_labels_or_rows(spark, kind):
    docs, labels, _ = docs_and_labels(spark, kind)
    run = quality.quality if kind == "quality" else toxicity.toxicity
    assert {r.score for r in run(docs, labels.limit(0)).collect()} == ({0.5} if kind == "quality" else {0.0})
    assert run(docs.limit(0), labels).collect() == []


def test_kernel_against_definition():
    def feature_map(word):
        out = {}
        c = toxicity._classes([word], len(word))[0]
        for i in range(len(c)):
            for j in range(i + 1, len(c)):
                for k in range(j + 1, len(c)):
                    key = (c[i], c[j], c[k])
                    out[key] = out.get(key, 0) + toxicity.DECAY ** (k - i + 1)
        return out

    words = ["banana", "bandana", "cabana", "xyz", "bananna"]
    maps = [feature_map(w) for w in words]
    dot = lambda a, b: sum(v * b.get(k, 0) for k, v in a.items())
    want = [[dot(a, b) / (dot(a, a) * dot(b, b)) ** 0.5 for b in maps] for a in maps]
    assert np.allclose(toxicity.kernels(words, words), want, atol=1e-5)


def test_pairs_are_ranked():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 3))
    y = (x[:, 0] - x[:, 1] > 0).astype(int)
    model = quality.fit(x, y)
    assert ((model.score(x) >= quality.ACCEPT) == y).mean() > 0.95
    assert np.argsort(np.abs(model.weights))[0] == 2


def test_accepted_keeps_columns(spark):
    docs, labels, _ = docs_and_labels(spark, "quality")
    kept = quality.accepted(docs, labels)
    assert kept.columns == docs.columns and 400 < kept.count() < 480


def test_insults_split_by_a_blank(spark):
    docs, labels, _ = docs_and_labels(spark, "toxic")
    model = toxicity.learn(docs, labels)
    split = ["tan sel zor gle rut.", "mi blim fest no", "the cran dok", "zo rg le", "one. Cran-do k!"]
    clean = ["tan sel rut.", "mi no", "a zor. Gle is", ""]
    rows = spark.createDataFrame(list(enumerate(split + clean)), "k int, text string")
    got = {r.k: r.score >= toxicity.TOXIC for r in toxicity.scored(rows, model).collect()}
    assert [got[k] for k in range(len(got))] == [True] * len(split) + [False] * len(clean)


def test_bound_of_windows():
    rng = random.Random(4)
    words = ["".join(rng.choice("aabcdé1") for _ in range(rng.randint(1, 40))) for _ in range(500)]
    model = toxicity.Model(np.random.default_rng(1).normal(size=toxicity.CLASSES**3).astype(np.float32), -1.0, 1.0, 0.0)
    assert (model.at_most(words) >= model.decide(words)).all()
    texts = [" ".join(rng.choices(words, k=30)) for _ in range(20)]
    want = [max(model.decide(sorted(toxicity.windows(t))), default=toxicity.NOTHING) for t in texts]
    assert np.allclose(toxicity.with_windows(model, texts, np.full(20, toxicity.NOTHING)), np.maximum(want, toxicity.NOTHING))


def test_windows_of_known_words_are_left_out():
    assert toxicity.windows("Mo ron, you are. One") == {"moron", "moronyou", "ronyou", "ronyouare", "youare"}
    known = frozenset({"you", "are"})
    assert toxicity.windows("mo ron, you are. You are", known) == {"moron", "moronyou", "ronyou", "ronyouare"}
    assert toxicity.windows("x" * 9 + " " + "y" * 9) == set()


def marked(n):
    rng = np.random.default_rng(0)
    x = np.clip(np.abs(rng.normal(size=(n, 6))), 0, 4)
    return np.rint(x * quality.GRAIN) / quality.GRAIN, (x[:, 0] - x[:, 1] + rng.normal(size=n) / 2 > 0).astype(int)


def test_all_pairs_count():
    x, y = marked(600)
    z = (x - x.mean(0)) / (x.std(0) + 1e-6)
    d = (z[y == 1][:, None] - z[y == 0]).reshape(-1, 6)
    w = np.zeros(6)
    for _ in range(15):
        p = 1 / (1 + np.exp(d @ w))
        w = w + np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d / len(d) + 1e-3 * np.eye(6), d.T @ p / len(d) - 1e-3 * w)
    model = quality.fit(x, y)
    assert np.allclose(model.weights, w, atol=2e-3)
    for share in (0.0, 0.1, 0.37, 1.0):
        cut = quality.fit(x, y, quantile=share)
        assert abs((cut.strength(x) < cut.cut).mean() - share) < 1 / 600


def test_parts_and_order_do_not_matter():
    x, y = marked(3000)
    order = np.random.default_rng(1).permutation(3000)
    one = quality.fit(x, y)
    two = quality.fitted(lambda f: quality.added([f(x[order[a : a + 700]], y[order[a : a + 700]]) for a in range(0, 3000, 700)]), 6)
    assert np.array_equal(one.weights, two.weights) and one.cut == two.cut and one.slope == two.slope


def test_every_labelled_document_is_learned_from(spark):
    """Of more than any bound: the only bad ones are a few among 30,000, wherever their keys fall."""
    rows = spark.range(30_000).selectExpr("id AS doc_id", "if(id % 3000 < 3, 'BUY *** NOW *** $$$', 'some plain words of prose.') AS text", "int(id % 3000 >= 3) AS quality")
    model = quality.learn(rows.select("doc_id", "text"), rows.select("doc_id", "quality"))
    learned = [k for k in range(30_000) if zlib.crc32(str(k).encode()) % 5]
    assert len(learned) > 20_000 and model.quantile == pytest.approx(sum(k % 3000 < 3 for k in learned) / len(learned), abs=1e-9)


def test_the_driver_splits_bags_text_by_text(spark, monkeypatch):
    """All pieces of all texts at once, before equal ones are made one, take more of its memory than the fit."""
    docs, labels, _ = docs_and_labels(spark, "toxic")
    seen = {}
    whole = toxicity.fit

    def fit(texts, marks, sentences):
        seen["lazy"] = iter(sentences) is sentences
        own = list(sentences)
        seen["bags"] = [[tuple(b) for b in doc] for doc in own] == [list(dict.fromkeys(b for b in map(toxicity.bag, toxicity.SENTENCES.split(t)) if b)) for t in texts]
        return whole(texts, marks, sentences=iter(own))

    monkeypatch.setattr(toxicity, "fit", fit)
    model = toxicity.learn(docs, labels)
    assert seen == {"lazy": True, "bags": True}
    words = ["".join(random.Random(k).choice("abc") for _ in range(1 + k % 20)) for k in range(toxicity.AT_ONCE + 50)]
    assert np.array_equal(model.decide(words)[-50:], model.decide(words[-50:]))
