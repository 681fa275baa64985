import re
import time

from tidemark.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(docs, items, window=10):
    out = []
    for doc, text in docs:
        w, hit, ids = words(text), set(), set()
        for item, body in items:
            i = words(body)
            n = min(len(i), window)
            grams = {tuple(i[k : k + n]) for k in range(len(i) - n + 1)} if n else set()
            for k in range(len(w) - n + 1):
                if n and tuple(w[k : k + n]) in grams:
                    hit.update(range(k, k + n))
                    ids.add("null" if item is None else str(item))
        out.append((doc, len(w), len(hit), sorted(ids)))
    return sorted(out, key=str)


LONG = " ".join(f"w{k}" for k in range(40))
ITEMS = [(1, LONG), (2, "Short item, three"), (3, None), (4, ""), (5, "ΑΣ ß É one two three four five six seven eight"), (11, LONG.upper()), (None, "nameless item here now"), (2, "another text of item two but longer than ten words in all yes")]
DOCS = [
    (1, "before " + " ".join(f"w{k}" for k in range(5, 20)) + " after"),
    (2, "x SHORT... item\nthree y short item three"),
    (3, None),
    (4, ""),
    (5, "nothing here w1 w2 w3 w4 w5 w6 w7 w8 w9 gap w10"),
    (6, "ας ß é one two three four five six seven eight"),
    (7, "ΑΣ ß É ONE two three four five six seven eight nine"),
    (8, "W0-W1-W2-W3-W4-W5-W6-W7-W8-W9 tail " * 300),
    (None, "nameless item here now"),
    (1, "before " + " ".join(f"w{k}" for k in range(5, 20)) + " after"),
]


def tables(spark):
    docs = spark.createDataFrame([(*r, "c", 1) for r in DOCS], "doc_id long, text string, item_id string, n_hit int")
    return docs, spark.createDataFrame([(*r, "c") for r in ITEMS], "item_id long, text string, doc_id string")


def test_scan_against_brute_force(spark):
    docs, items = tables(spark)
    got = decontaminate.scan(docs, items).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_hit, list(r.item_ids)) for r in got), key=str) == brute(DOCS, ITEMS)
    assert all(r.contaminated == (r.n_hit > 0) and r.n_items == len(r.item_ids) for r in got)
    assert decontaminate.scan(docs, items, largest_set=0).exceptAll(decontaminate.scan(docs, items)).isEmpty()


def test_documents_and_spans(spark):
    docs, items = tables(spark)
    clean = decontaminate.decontaminate(docs, items)
    dirty = {r[0] for r in brute(DOCS, ITEMS) if r[2]}
    assert clean.columns == docs.columns
    assert sorted(str(r.doc_id) for r in clean.collect()) == sorted(str(d) for d, _ in DOCS if d not in dirty)
    cut = {r.doc_id: r.text for r in decontaminate.decontaminate(docs, items, "span").collect()}
    assert cut[1] == "before  after" and cut[3] is None and cut[5] == DOCS[4][1] and cut[2] == "x  y "
    assert decontaminate.scan(decontaminate.decontaminate(docs, items, "span"), items).filter("doc_id IN (1, 2)").filter("contaminated").isEmpty()


def test_empty_tables(spark):
    docs, items = tables(spark)
    assert decontaminate.scan(docs.limit(0), items).collect() == []
    assert not any(r.contaminated for r in decontaminate.scan(docs, items.limit(0)).collect())


def test_long_texts_take_time_in_proportion(spark):
    bench = spark.createDataFrame([(1, LONG)], "item_id long, text string")
    took = []
    for n in (40_000, 40_000, 160_000):
        text = " ".join("w1 w2 w3 w4 w5 w6 w7 w8 w9 w10" if k % 1000 == 0 else f"x{k}" for k in range(n))
        docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
        began = time.monotonic()
        (row,) = decontaminate.scan(docs, bench).collect()
        took.append(time.monotonic() - began)
        assert (row.n_words, row.n_hit, row.n_items, len(row.spans)) == (n + 9 * (n // 1000), 10 * (n // 1000), 1, n // 1000)
    assert took[2] < 8 * took[1] + 2
