"""Toxicity by a support vector machine over a gap-weighted subsequence string kernel with Nyström landmarks.

The kernel of two strings is the normalised inner product of their feature maps: for each sequence of three
characters, the sum of DECAY ** span over all its occurrences as a subsequence. So an insult with characters
inserted or left out stays near the insult. Characters fall into 64 classes, so the map has 64 ** 3 features.

A text is a bag of units: its words without marks, and runs of single characters joined; it is scored by these and
by neighbouring words of a sentence joined, so that an insult split by blanks is whole again. Sentences, with the
labels of their documents, are the bags of multiple-instance learning: it starts from the units that tell toxic
sentences apart, takes in each toxic document without any the unit that the machine finds worst, and fits again. As the decision is linear in the kernels with the landmarks, it is one
table over the features: a unit is scored in time that its own subsequences take, however many landmarks.
"""

from __future__ import annotations

import functools
import gc
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _libc_trim, settle
from .labelled import held_out, sampled

#: Labelled documents to learn from, at most.
LEARN_FROM = 8_000
LANDMARKS = 256
#: Clean units that the machine is fitted against at first.
NEGATIVES = 20_000
#: Units of a toxic document that are taken as its reasons, at most, and the lift they need.
WORST, LEAST_LIFT = 3, 8.0
#: Decision value from which a unit without that lift is one.
NEAR = -0.5
#: Margins that are tried for windows; the last one is beyond what any decides.
MARGINS = [*(x / 4 for x in range(17)), 100.0]
DECAY = 0.7
CLASSES = 64
#: Units longer than this are scored by overlapping pieces of this length.
LONGEST = 16
#: A document counts as toxic from this score on.
TOXIC = 0.5
#: Commonest words of clean sentences that are known as such.
KNOWN = 200_000
#: Units that are cut into pieces and decided at once.
AT_ONCE = 8192
#: Units whose scores a Python worker remembers.
REMEMBER = 300_000
#: Single characters apart from each other, as in a spaced-out word.
SPACED = re.compile(r"(?<![^\W_])[^\W_](?:[\W_]{1,3}[^\W_](?![^\W_])){2,}")
MARKS = re.compile(r"[\W_]+")
SENTENCES = re.compile(r"(?<=[.!?])\s+|\n+")


def _bare(word: str) -> str:
    """A word without marks."""
    return word if word.isalnum() else MARKS.sub("", word)


def units(text: str) -> set[str]:
    """The units of a whole text."""
    text = text.lower()
    found = set(map(_bare, set(text.split())))
    found.update(MARKS.sub("", m) for m in SPACED.findall(text))
    found.discard("")
    return found


def windows(text: str, known: frozenset[str] = frozenset()) -> set[str]:
    """Two or three neighbouring words of a sentence joined without marks, if they are LONGEST at most and not all
    known as words of clean sentences."""
    found: set[str] = set()
    text = text.lower()
    bare = {x: _bare(x) for x in set(text.split())}
    odd = {x for x, w in bare.items() if w and w not in known}
    # Sentences end as SENTENCES says: by a mark before white space, or with the line.
    for line in text.split("\n") if odd else ():
        tokens = line.split()
        if odd.isdisjoint(tokens):
            continue
        words, at, ends = [], [], []
        for x in tokens:
            if w := bare[x]:
                if x in odd:
                    at.append(len(words))
                words.append(w)
            if x[-1] in ".!?":
                ends.append(len(words))
        ends.append(len(words))
        for k in at:
            j = bisect_right(ends, k)
            first, last = max(ends[j - 1] if j else 0, k - 2), min(ends[j], k + 3)
            for a in range(first, k + 1):
                for z in range(max(a + 2, k + 1), min(a + 3, last) + 1):
                    found.add("".join(words[a:z]))
    return {w for w in found if len(w) <= LONGEST}


def _pieces(unit: str) -> list[str]:
    if len(unit) <= LONGEST:
        return [unit]
    return [unit[at : at + LONGEST] for at in [*range(0, len(unit) - LONGEST, LONGEST // 2), len(unit) - LONGEST]]


def _classes(words: list[str], n: int) -> np.ndarray:
    codes = np.frombuffer("".join(words).encode("utf-32-le"), dtype="<u4").reshape(len(words), n).astype(np.int64)
    letter = (codes >= 97) & (codes <= 122)
    digit = (codes >= 48) & (codes <= 57)
    return np.where(letter, codes - 97, np.where(digit, codes - 22, 36 + codes % (CLASSES - 36)))


def maps(words: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """(codes, weights) of the feature maps of words of n characters each, normalised; a code can recur in a row.

    A word of fewer than three characters is taken as it stands between two end marks.
    """
    c = _classes(words, n)
    if n < 3:
        pad = np.full((len(words), 1), CLASSES - 1)
        c = np.concatenate([pad, c, pad], 1)
        n += 2
    i, j, k = np.array(list(combinations(range(n), 3))).T
    codes = (c[:, i] * CLASSES + c[:, j]) * CLASSES + c[:, k]
    weights = np.broadcast_to(DECAY ** (k - i + 1.0), codes.shape)
    order = np.argsort(codes, 1)
    codes, weights = np.take_along_axis(codes, order, 1), np.take_along_axis(weights, order, 1)
    # The norm counts equal codes of a row as one feature.
    new = np.ones(codes.shape, dtype=bool)
    new[:, 1:] = codes[:, 1:] != codes[:, :-1]
    group = np.cumsum(new.ravel()) - 1
    sums = np.bincount(group, weights.ravel())
    norm = np.sqrt(np.bincount(np.arange(codes.size)[new.ravel()] // codes.shape[1], sums**2, minlength=len(words)))
    return codes, weights / norm[:, None]


@functools.cache
def _spans(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For n characters: all pairs of places, and of each three places the pair's number, the third and the weight."""
    i, j, k = np.array(list(combinations(range(n), 3))).T
    pairs = np.array(list(combinations(range(n), 2))).T
    number = np.zeros((n, n), dtype=np.int64)
    number[pairs[0], pairs[1]] = np.arange(len(pairs[0]))
    weight = DECAY ** (k - i + 1.0)
    return pairs, number[i, j], k, (weight / np.sqrt((weight**2).sum())).astype(np.float32)


def by_length(words: list[str], block: int = 512) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(positions in words, codes, weights) in blocks of equal length."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    for n in np.unique(lengths):
        own = np.flatnonzero(lengths == n)
        for at in range(0, len(own), block):
            part = own[at : at + block]
            yield part, *maps([words[x] for x in part], int(n))


def kernels(words: list[str], landmarks: list[str]) -> np.ndarray:
    """The kernel of each word with each landmark."""
    # Only features that a landmark has get a row; row 0 is for all others.
    parts = list(by_length(landmarks))
    used = np.unique(np.concatenate([c.ravel() for _, c, _ in parts])) if parts else np.zeros(0, dtype=np.int64)
    row = np.zeros(CLASSES**3, dtype=np.int32)
    row[used] = np.arange(1, len(used) + 1)
    table = np.zeros((len(used) + 1, len(landmarks)), dtype=np.float32)
    for at, codes, weights in parts:
        for mark, c, w in zip(at, codes, weights, strict=True):
            np.add.at(table[:, mark], row[c], w)
    out = np.zeros((len(words), len(landmarks)))
    for at, codes, weights in by_length(words, 64):
        out[at] = np.matmul(weights[:, None, :].astype(np.float32), table[row[codes]])[:, 0]
    return out


@dataclass
class Model:
    table: np.ndarray
    bias: float
    slope: float
    shift: float
    #: By how much a window must decide more than a unit to count as much.
    margin: float = 0.0
    #: Words of clean sentences, at most KNOWN.
    known: frozenset[str] = frozenset()

    def decide(self, words: list[str]) -> np.ndarray:
        """The machine's decision value of each unit; of a long one, that of its worst piece."""
        if len(words) > AT_ONCE:
            return np.concatenate([self.decide(words[at : at + AT_ONCE]) for at in range(0, len(words), AT_ONCE)])
        pieces = [_pieces(w) for w in words]
        flat = [p for ps in pieces for p in ps]
        values = np.empty(len(flat))
        for at, codes, weights in by_length(flat):
            values[at] = (self.table[codes] * weights).sum(1)
        starts = np.cumsum([0, *map(len, pieces)])[:-1]
        return (np.maximum.reduceat(values, starts) if len(flat) else values) + self.bias

    def at_most(self, words: list[str]) -> np.ndarray:
        """A bound on decide(), in a fraction of its time: the norm is that of features that all differ, which is
        the least there can be."""
        pieces = [_pieces(w) for w in words]
        flat = [p for ps in pieces for p in ps]
        values, lengths = np.zeros(len(flat)), np.fromiter(map(len, flat), np.int64, len(flat))
        for n in np.unique(lengths):
            pairs, ij, k, weight = _spans(int(n) if n > 2 else int(n) + 2)
            own = np.flatnonzero(lengths == n)
            for at in range(0, len(own), 256):
                part = own[at : at + 256]
                c = _classes([flat[x] for x in part], int(n)).astype(np.int32)
                if n < 3:
                    c = np.pad(c, ((0, 0), (1, 1)), constant_values=CLASSES - 1)
                both = (c[:, pairs[0]] * CLASSES + c[:, pairs[1]]) * CLASSES
                values[part] = self.table.take(both.take(ij, 1) + c.take(k, 1)) @ weight
        starts = np.cumsum([0, *map(len, pieces)])[:-1]
        # A little more than rounding may take.
        return (np.maximum.reduceat(np.maximum(values, values * 0), starts) if len(flat) else values) + self.bias + 1e-3

    def score(self, worst: np.ndarray) -> np.ndarray:
        if np.isinf(self.shift):  # nothing was learned
            return np.zeros(len(worst))
        return 1 / (1 + np.exp(-np.clip(self.slope * (worst - self.shift), -500, 500)))


#: What an empty text decides.
NOTHING = -4.0


def machine(x: np.ndarray, y: np.ndarray, weight: np.ndarray, cost: float = 1.0) -> tuple[np.ndarray, float]:
    """A linear support vector machine with squared hinge loss, by Newton steps."""
    w = np.zeros(x.shape[1] + 1)
    ridge = np.eye(len(w))
    ridge[-1, -1] = 1e-6
    for _ in range(30):
        left, right = ridge.copy(), np.zeros(len(w))
        for at in range(0, len(x), 2048):
            z = np.concatenate([x[at : at + 2048], np.ones((len(x[at : at + 2048]), 1))], 1)
            t, c = y[at : at + 2048], cost * weight[at : at + 2048]
            c = c * (1 - t * (z @ w) > 0)
            left += (z * c[:, None]).T @ z
            right += z.T @ (c * t)
        new = np.linalg.solve(left, right)
        done = np.abs(new - w).max() < 1e-6
        w = new
        if done:
            break
    return w[:-1], float(w[-1])


def table_of(marks: list[str], beta: np.ndarray) -> np.ndarray:
    """The sum of the landmarks' feature maps, each times its beta."""
    table = np.zeros(CLASSES**3)
    for own, codes, weights in by_length(marks):
        for row, c, v in zip(own, codes, weights, strict=True):
            np.add.at(table, c, v * beta[row])
    return table.astype(np.float32)


def bag(sentence: str) -> tuple[str, ...]:
    """The pieces of the units of a sentence, each once, in order."""
    return tuple(sorted({p for u in units(sentence) for p in _pieces(u)}))


def fit(texts: list[str], labels: np.ndarray, landmarks: int = LANDMARKS, rounds: int = 3, sentences: Iterable[list[list[str]]] | None = None) -> Model:
    """From labelled documents, by their sentences, which have the labels of their documents; equal sentences count
    once, and as clean if they stand in a clean document.

    sentences: the bag() of each sentence of each text, where they are known; gone over once. Without both labels, every document
    scores 0.
    """
    none = Model(np.zeros(CLASSES**3, dtype=np.float32), 0.0, 1.0, np.inf)
    if sentences is None:
        sentences = ([bag(s) for s in SENTENCES.split(t)] for t in texts)
    # Equal pieces and equal bags are one object each.
    same: dict = {}
    once = same.setdefault
    own = [[once(b, b) for b in (tuple(once(p, p) for p in s) for s in doc) if b] for doc in sentences]
    del same, once
    known = [k for k, doc in enumerate(own) if doc]
    texts, labels, own = [texts[k] for k in known], np.array([int(labels[k]) for k in known]), [own[k] for k in known]
    if not len(labels) or labels.sum() in (0, len(labels)):
        return none
    bags: dict[tuple[str, ...], int] = {}
    for doc, label in zip(own, labels.tolist(), strict=True):
        for b in doc:
            bags[b] = min(label, bags.get(b, 1))
    toxic, clean = Counter(), Counter()
    for b, label in bags.items():
        (toxic if label else clean).update(b)
    n_toxic, n_clean = sum(bags.values()), len(bags) - sum(bags.values())
    if not n_toxic or not n_clean:
        return none
    # Log odds of a unit, shrunk and times the root of its count: how surely it tells toxic documents apart.
    lift = {u: (np.log((k + 0.1) / (n_toxic + 0.2)) - np.log((clean[u] + 0.1) / (n_clean + 0.2))) * np.sqrt(k) for u, k in toxic.items()}
    ranked = sorted(lift, key=lambda u: (-lift[u], u))[: landmarks * 2]
    near = kernels(ranked, ranked)
    chosen: list[int] = []
    for a in range(len(ranked)):
        if len(chosen) < landmarks * 3 // 4 and (not chosen or near[a, chosen].max() < 0.95):
            chosen.append(a)
    marks = [ranked[a] for a in chosen]
    known = set(marks)
    common = sorted(clean, key=lambda u: (-clean[u], u))
    marks += [u for u in common if u not in known][: landmarks - len(marks)]
    values, vectors = np.linalg.eigh(kernels(marks, marks))
    keep = values > 1e-6 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])
    # Negatives: the commonest clean units, a sample of the others, and in each round those taken for toxic.
    other = np.random.default_rng(0).permutation(len(common))[:NEGATIVES]
    negative = {common[k] for k in other} | set(common[: NEGATIVES // 4])
    vocabulary = sorted(set(toxic) | set(clean))
    belief = {u: lift.get(u, -9.0) for u in vocabulary}
    model = none
    for turn in range(rounds):
        # The reasons of a toxic sentence are units that surely tell such sentences apart; a document without any
        # gives its worst unit, if the machine finds that near those.
        positive: Counter = Counter()
        for doc, label in zip(own, labels.tolist(), strict=True):
            if label:
                sure = [u for b in set(doc) if bags[b] for u in sorted((u for u in b if lift[u] > LEAST_LIFT), key=lambda u: (-belief[u], u))[:WORST]]
                rest = min((u for b in doc for u in b), key=lambda u: (-belief[u], u))
                positive.update(sorted(set(sure)) or ([rest] if turn and rest not in clean and belief[rest] > NEAR else []))
        positive = positive or Counter(max(b, key=lambda u: (lift[u], u)) for b, label in bags.items() if label)
        rows = [*sorted(positive), *sorted(negative - positive.keys())]
        y = np.where(np.arange(len(rows)) < len(positive), 1.0, -1.0)
        weight = np.array([min(30.0, positive[u]) if u in positive else min(10.0, clean[u]) for u in rows])
        weight[y > 0] *= weight[y < 0].sum() / weight[y > 0].sum() / 4
        w, bias = machine(np.concatenate([(kernels(rows[at : at + 2048], marks) @ root).astype(np.float32) for at in range(0, len(rows), 2048)]), y, weight)
        model = Model(table_of(marks, root @ w), bias, 1.0, 0.0)
        decided = model.decide(vocabulary)
        belief = dict(zip(vocabulary, decided.tolist(), strict=True))
        negative |= {u for u in sorted(clean, key=lambda u: (-belief[u], u))[: NEGATIVES // 4] if belief[u] > -1}
    model.known = frozenset(common[:KNOWN])
    worst, step = np.array([max(belief[u] for b in doc for u in b) for doc in own]), 256
    more = np.concatenate([with_windows(model, texts[at : at + step], worst[at : at + step]) for at in range(0, len(texts), step)])
    # Windows are many and not learned from: they count less by the margin that leaves the fewest errors.
    wrong = [errors(np.maximum(worst, more - m), labels)[0].min() for m in MARGINS]
    model.margin = MARGINS[int(np.argmin(wrong))]
    model.slope, model.shift = platt(np.maximum(worst, more - model.margin), labels)
    return model


def errors(value: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(errors, edges): the wrong documents if those above the middle of edges k and k + 1 count as toxic."""
    order = np.argsort(value, kind="stable")
    v, t = value[order], y[order]
    wrong = np.concatenate([[0], np.cumsum(t == 1)]) + (t == 0).sum() - np.concatenate([[0], np.cumsum(t == 0)])
    return wrong, np.concatenate([[v[0] - 1], v, [v[-1] + 1]])


def platt(value: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """slope and shift of the logistic curve of y over value, the cut at the fewest errors."""
    wrong, edges = errors(value, y)
    best = np.flatnonzero(wrong == wrong.min())
    shift = float((edges[best[len(best) // 2]] + edges[best[len(best) // 2] + 1]) / 2)
    slope = 2.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(slope * (value - shift), -50, 50)))
        step = (((y - p) * (value - shift)).mean() - 1e-3 * slope) / ((p * (1 - p) * (value - shift) ** 2).mean() + 1e-3)
        slope = min(20.0, max(0.1, slope + step))
    return float(slope), shift


def _give_back() -> None:
    """What the driver has freed goes back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := _libc_trim():
        trim(0)


def learn(docs: DataFrame, labels: DataFrame, most: int = LEARN_FROM, text: str = "text", key: str = "doc_id") -> Model:
    """From at most `most` labelled documents that are not held out; they and the bags of their sentences go to the
    driver."""

    def told(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        settle()
        for batch in batches:
            bags = ["\n".join(" ".join(b) for b in dict.fromkeys(map(bag, SENTENCES.split(t))) if b) for t in batch["text"]]
            yield pd.DataFrame({"label": batch["label"], "text": batch["text"], "bags": bags})

    rows = sampled(docs, labels, "toxic", most, text, key).mapInPandas(told, "label int, text string, bags string").toPandas()
    rows = rows.drop_duplicates(["label", "bags"]).sort_values(["label", "bags", "text"])
    texts, labels, told = rows["text"].tolist(), rows["label"].to_numpy(), rows["bags"].tolist()[::-1]
    del rows
    _give_back()

    def sentences() -> Iterator[list[list[str]]]:
        # Text by text, as millions of pieces would take the driver's memory before fit() has each of them once.
        while told:
            yield [s.split(" ") for s in told.pop().split("\n") if s]

    return fit(texts, labels, sentences=sentences())


_seen: dict[str, float] = {}
_of: list = [None]


def worst(model: Model, token: str, texts: pd.Series) -> np.ndarray:
    """The decision value of each text's worst unit. Known units are remembered while the worker lives."""
    if _of[0] != token or len(_seen) > REMEMBER:
        _seen.clear()
        _of[0] = token
    bags = [units(t) for t in texts]
    new = list(set().union(*bags) - _seen.keys()) if bags else []
    _seen.update(zip(new, model.decide(new).tolist(), strict=True))
    get = _seen.__getitem__
    found = np.array([max(map(get, bag), default=NOTHING) for bag in bags])
    return with_windows(model, texts, found)


def with_windows(model: Model, texts: pd.Series, found: np.ndarray) -> np.ndarray:
    """The larger of found and of the decision value of each text's worst window, less the margin. Windows whose
    bound is lower are not looked at closely."""
    if np.isinf(model.shift) or model.margin >= MARGINS[-1]:
        return found
    found = found.copy()
    own = [list(windows(t, model.known)) for t in texts]
    number = {w: k for k, w in enumerate(set().union(*own))} if own else {}
    words = list(number)
    bound = model.at_most(words) - model.margin
    close = [places[bound[places] > found[at]] for at, mine in enumerate(own) for places in [np.fromiter(map(number.__getitem__, mine), np.int64, len(mine))]]
    looked = np.unique(np.concatenate(close)) if close else np.zeros(0, dtype=np.int64)
    if len(looked):
        bound[looked] = model.decide([words[k] for k in looked]) - model.margin
        for at, places in enumerate(close):
            if len(places):
                found[at] = max(found[at], bound[places].max())
    return found


def scored(docs: DataFrame, model: Model, text: str = "text", column: str = "score") -> DataFrame:
    """docs with a column of scores, 0 to 1, higher: more likely toxic. Null text scores as empty text."""
    import uuid

    spark, token = docs.sparkSession, uuid.uuid4().hex
    sent = spark.sparkContext.broadcast(model)  # one table of 1 MB, and KNOWN words

    @F.pandas_udf("double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        settle()
        for batch in batches:
            parts = [sent.value.score(worst(sent.value, token, batch.iloc[at : at + 256])) for at in range(0, len(batch), 256)]
            yield pd.Series(np.concatenate(parts) if parts else [], dtype="float64")

    return docs.withColumn(column, of(F.coalesce(F.col(text), F.lit(""))))


def toxicity(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs.

    Repeated rows score alike; rows with a null key are scored, and are held out. Empty and null texts score near 0.
    Without labels of both kinds, all score 0. An empty table gives no rows. Only the text is an input of the score.
    """
    rows = scored(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")), learn(docs, labels, text=text, key=key), text="text")
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= TOXIC).cast("int").alias("predicted"))
