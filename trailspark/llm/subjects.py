"""Subject areas of each document.

One-versus-rest linear classifiers (logistic, on hashed word n-grams) judge
single sentences. They start from weak labels: every sentence takes the
labels its document was given by hand, be they right or wrong, and those
that its metadata (where it comes from, what section it is) stands for, if
most labelled documents of that value have them. A sentence about nothing in
particular stands in documents of all areas and so gets a low score for
each; so does a line of code, which its own shape tells apart. In later
rounds a sentence's label is what the classifiers themselves say, among the
areas that its document can have, and the words that describe an area in the
table of areas count as labelled too. Thresholds are chosen per area against
the hand labels of every fifth document, which that fit leaves out; the last
fit takes all. A document has the areas that make up a given share of its
sentences on any area.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .leaks import plain

#: Buckets of the feature hash.
BUCKETS = 1 << 18
#: Most labelled documents the classifiers are fitted on, chosen by a hash of their id.
LABELLED_DOCS = 5_000
#: Most characters of their texts together: documents beyond are left out whole, in order of that hash.
LABELLED_CHARS = 30_000_000
#: A feature counts if it stands in so many of the documents fitted on.
LEAST_DOCS = 3
#: Strength of the weights' shrinkage, in sentences.
SHRINK = 0.05
#: Least score at which a sentence is taken for one on an area.
SURE = 0.5
#: Least score at which a later round takes a sentence's area for its label.
RELABEL = 0.55
#: A document has an area if this share of its sentences on any area is about it.
SHARE = 0.25
#: A value of the metadata stands for an area if so many labelled documents have it, and this share of them the area.
META_DOCS, META_SHARE = 20, 0.5
#: Steps of the first fit and of each later one, which goes on from the weights before.
STEPS, MORE_STEPS = 45, 25

SENTENCE = re.compile(r"[.?!]+[\"'”)\]]*\s+|\n+")
CAMEL = re.compile(r"(?<=[a-zß-ÿ])(?=[A-ZÀ-Þ])")
WORD = re.compile(r"[^\W\d_]+")
NUMBER = re.compile(r"\d+")
#: Sentences whose area a task remembers, and words whose features it does.
MEMO = 200_000
#: Shapes that tell code, paths and log lines from prose; each is a feature like a word.
CODE = re.compile(r"[(){}\[\];=<>_/#]")
SHAPES = [re.compile(p) for p in (r"\w\(", r"[;{]\s*$", r"^\s*(?://|/\*|#)", r"[=!<>]=|\w\s*=\s*\w", r"\w[./]\w", r"[{}\[\]]", r"\w_\w", r"\)\s*:", r"['\"]\w+['\"]\)")]


def sentences(text: str | None) -> list[str]:
    """The sentences and lines of a text that hold a word, compound names cut and numbers made ``0``; none is left out."""
    if not text:
        return []
    return [s for s in SENTENCE.split(CAMEL.sub(" ", NUMBER.sub("0", plain(text)))) if WORD.search(s)]


def stem(w: str) -> str:
    return w[:-1] if len(w) > 4 and w[-1] == "s" and w[-2] != "s" else w


class Rows:
    """Sentences as arrays: row ``i`` holds the four buckets of each of its words, ``idx[:, start[i]:start[i + 1]]``; none is empty.

    ``BUCKETS`` stands for no feature.
    """

    def __init__(self, idx: np.ndarray, size: np.ndarray) -> None:
        self.idx = idx
        self.start = np.concatenate([[0], np.cumsum(size)])[:-1].astype(np.int64)
        self.row = np.repeat(np.arange(len(size), dtype=np.int32), size)
        self.rescale()

    def rescale(self) -> None:
        n = np.add.reduceat((self.idx < BUCKETS).sum(axis=0), self.start) if len(self.start) else np.zeros(0)
        self.scale = (1 / np.sqrt(np.maximum(n, 1))).astype(np.float32)

    def scores(self, w: np.ndarray, bias: np.ndarray) -> np.ndarray:
        """One row per class; ``w`` holds one too, with a last weight of 0."""
        out = np.zeros((len(w), len(self.start)), dtype=np.float32)
        if len(self.start):
            for j in range(len(w)):
                v = w[j]
                each = v[self.idx[0]]
                for i in self.idx[1:]:
                    each += v[i]
                out[j] = np.add.reduceat(each, self.start) * self.scale + bias[j]
        return out


class Features:
    """Buckets of word n-grams; what a word seen before adds to them is remembered.

    Words are taken without case and plural. Besides each word and pair of
    neighbours there is a form in which the order of letters doesn't count, so
    that swapped letters and misplaced blanks don't matter. A sentence's
    shapes stand before its words.
    """

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.ids: dict[str, int] = {}
        self.made: list[tuple] = []
        self.table = np.zeros((4, 0), dtype=np.int64)

    def _add(self, raw: str) -> int:
        w = stem(raw.casefold())
        # The sum of the letters' hashes doesn't depend on their order, and those of two words add up.
        letters = sum(map(_letter, w)) & 0xFFFFFFFF
        self.made.append((xxhash.xxh32_intdigest(w) % BUCKETS, (letters * 2654435761 >> 7) % BUCKETS if len(w) > 3 else BUCKETS, xxhash.xxh32_intdigest(w, 7), letters))
        self.ids[raw] = n = len(self.ids)
        return n

    def rows(self, sentences: list[str]) -> Rows:
        if len(self.ids) > MEMO:
            self.clear()
        ids, get, add = [], self.ids.get, self._add
        size = np.zeros(len(sentences), dtype=np.int64)
        for i, s in enumerate(sentences):
            words = WORD.findall(s)
            if CODE.search(s):
                words = [f"\1{k}" for k, shape in enumerate(SHAPES) if shape.search(s)] + words
            size[i] = len(words)
            for w in words:
                n = get(w)
                ids.append(add(w) if n is None else n)
        if self.made:
            self.table = np.concatenate([self.table, np.array(self.made, dtype=np.int64).T], axis=1)
            self.made = []
        own, letters, code, total = self.table[:, np.array(ids, dtype=np.int64)]
        idx = np.full((4, len(ids)), BUCKETS, dtype=np.int32)
        idx[0], idx[1] = own, letters
        idx[2, 1:] = ((code[:-1] * 31 + code[1:]) * 40503 >> 11) % BUCKETS
        idx[3, 1:] = ((total[:-1] + total[1:]) * 2246822519 >> 9) % BUCKETS
        first = np.cumsum(size) - size
        idx[2:, first[size > 0]] = BUCKETS
        return Rows(idx, size)


@lru_cache(maxsize=65536)
def _letter(c: str) -> int:
    return xxhash.xxh32_intdigest(c)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Fit:
    """Logistic one-versus-rest weights by full-batch Adam steps; a later call goes on from the weights before."""

    def __init__(self, rows: Rows, classes: int) -> None:
        self.used = np.unique(rows.idx)
        self.used = self.used[self.used < BUCKETS]
        at = np.full(BUCKETS + 1, len(self.used), dtype=np.int32)
        at[self.used] = np.arange(len(self.used), dtype=np.int32)
        # Row by row, without the entries that stand for no feature but for one that each row has.
        n = len(rows.start)
        flat, row = at[rows.idx].ravel(), np.tile(rows.row, len(rows.idx))
        real = flat < len(self.used)
        flat, row = np.concatenate([flat[real], np.full(n, len(self.used), dtype=np.int32)]), np.concatenate([row[real], np.arange(n, dtype=np.int32)])
        order = np.argsort(row, kind="stable")
        flat, row = flat[order], row[order]
        self.rows = Rows.__new__(Rows)
        self.rows.idx, self.rows.start, self.rows.scale = flat[None].astype(np.int64), np.searchsorted(row, np.arange(n)), rows.scale
        # The same entries by column, for the gradient; the last column stands for no feature.
        order = np.argsort(flat, kind="stable")
        self.column = np.searchsorted(flat[order], np.arange(len(self.used)))
        self.by_column = row[order][: len(flat) - n].astype(np.int64)
        self.w, self.b = np.zeros((classes, len(self.used) + 1), dtype=np.float32), np.full(classes, -2.0, dtype=np.float32)

    def scores(self) -> np.ndarray:
        return self.rows.scores(self.w, self.b)

    def run(self, y: np.ndarray, weight: np.ndarray, steps: int) -> np.ndarray:
        """Fits to ``y`` (class, row) and returns the scores of all rows; rows of weight 0 have no say."""
        total = max(weight.sum(), 1)
        l2 = SHRINK / total
        w = self.w[:, :-1]
        m1, m2 = np.zeros_like(w), np.zeros_like(w)
        y, part = y.astype(np.float32), (weight / total).astype(np.float32)
        scaled = part * self.rows.scale
        for t in range(1, steps + 1):
            g = sigmoid(self.scores()) - y
            for j in range(len(w)):
                gw = np.add.reduceat((g[j] * scaled)[self.by_column], self.column)
                gw += np.float32(l2) * w[j]
                m1[j] = 0.9 * m1[j] + 0.1 * gw
                m2[j] = 0.99 * m2[j] + 0.01 * gw * gw
                w[j] -= np.float32(0.5 / (1 - 0.9**t)) * m1[j] / (np.sqrt(m2[j] * np.float32(1 / (1 - 0.99**t))) + np.float32(1e-6))
            self.b -= 2.0 * (g * part).sum(axis=1)
        return sigmoid(self.scores())

    def full(self) -> np.ndarray:
        out = np.zeros((len(self.w), BUCKETS + 1), dtype=np.float32)
        out[:, self.used] = self.w[:, :-1]
        return out


@dataclass
class Model:
    areas: list[str]
    weights: np.ndarray
    bias: np.ndarray
    thresholds: np.ndarray

    def sentence_areas(self, rows: Rows) -> np.ndarray:
        """The area of each sentence, -1 for none."""
        return best_areas(sigmoid(rows.scores(self.weights, self.bias)), self.thresholds)

    def areas_of(self, text: str | None, share: float = SHARE) -> list[str]:
        return Judge(self, share).areas_of_all([text])[0]


def best_areas(p: np.ndarray, thresholds: np.ndarray) -> np.ndarray:
    best = p.argmax(axis=0)
    return np.where(p[best, np.arange(p.shape[1])] >= thresholds[best], best, -1)


class Judge:
    """A model with what a task remembers: the areas of the sentences that it has seen."""

    def __init__(self, model: Model, share: float = SHARE) -> None:
        self.model, self.share, self.features, self.known = model, share, Features(), {}

    def areas_of_all(self, texts: list) -> list[list[str]]:
        """The areas of each text, whole texts read."""
        m, known = self.model, self.known
        if not m.areas:
            return [[] for _ in texts]
        if len(known) > MEMO:
            known.clear()
        cut = [sentences(t) for t in texts]
        new = list(dict.fromkeys(x for c in cut for x in c if x not in known))
        for a in range(0, len(new), 20_000):
            part = new[a : a + 20_000]
            known.update(zip(part, m.sentence_areas(self.features.rows(part)).tolist()))
        out = []
        for c in cut:
            n: dict[int, int] = {}
            for x in c:
                a = known[x]
                if a >= 0:
                    n[a] = n.get(a, 0) + 1
            total = sum(n.values())
            out.append([m.areas[a] for a in sorted(n) if n[a] >= self.share * total - 1e-9])
        return out


@dataclass
class Labelled:
    """A document of the fit: the share of its annotators for each area, and its metadata."""

    text: str
    labels: dict[str, float]
    meta: dict[str, str | None] = field(default_factory=dict)


def metadata_labels(docs: list[Labelled], areas: list[str]) -> dict[tuple[str, str], dict[str, float]]:
    """The areas that a value of the metadata stands for, with their share among its labelled documents."""
    seen: dict[tuple, int] = {}
    have: dict[tuple, dict[str, float]] = {}
    for d in docs:
        for kv in d.meta.items():
            if kv[1]:
                seen[kv] = seen.get(kv, 0) + 1
                of = have.setdefault(kv, {})
                for a, v in d.labels.items():
                    of[a] = of.get(a, 0.0) + v
    at = set(areas)
    got = {kv: {a: v / seen[kv] for a, v in of.items() if a in at and v >= META_SHARE * seen[kv]} for kv, of in have.items() if seen[kv] >= META_DOCS}
    return {kv: of for kv, of in got.items() if of}


def _common(rows: Rows, doc_of: list[np.ndarray]) -> None:
    """Takes features that stand in fewer than ``LEAST_DOCS`` documents out of the rows. ``doc_of`` holds the documents of each row."""
    # Of each row as many documents as can matter.
    docs = np.full((len(doc_of), LEAST_DOCS), -1, dtype=np.int64)
    for i, d in enumerate(doc_of):
        docs[i, : min(len(d), LEAST_DOCS)] = d[:LEAST_DOCS]
    keys = (rows.idx.astype(np.int64).ravel()[:, None] << 32) + docs[np.tile(rows.row, 4)] + 1
    keys = np.unique(keys[keys & 0xFFFFFFFF > 0])
    seen = np.bincount(keys >> 32, minlength=BUCKETS + 1)
    rare = seen < LEAST_DOCS
    rare[BUCKETS] = False
    rows.idx[rare[rows.idx]] = BUCKETS
    rows.rescale()


def train(docs: list[Labelled], areas: list[str], described: dict[str, str] | None = None, rounds: int = 2) -> Model:
    """Fits the classifiers on labelled documents.

    Without labelled documents nothing has an area.
    """
    k = len(areas)
    at = {a: j for j, a in enumerate(areas)}
    meta = metadata_labels(docs, areas)
    hand = np.zeros((k, len(docs)))
    # Equal sentences are one row with a weight.
    code: dict[str, int] = {}
    at_row, doc_of = [], []
    for d, doc in enumerate(docs):
        for a, v in doc.labels.items():
            if a in at:
                hand[at[a], d] = v
        for x in sentences(doc.text):
            at_row.append(code.setdefault(x, len(code)))
            doc_of.append(d)
    if not at_row or not areas:
        return Model(areas, np.zeros((k, BUCKETS + 1), dtype=np.float32), np.full(k, -9.0), np.full(k, SURE))
    weak = hand.copy()
    for d, doc in enumerate(docs):
        for kv in doc.meta.items():
            for a, v in meta.get(kv, {}).items():
                weak[at[a], d] = max(weak[at[a], d], v)
    extra = [(at[a], x) for a, text in (described or {}).items() if a in at and (x := " ".join(sentences(text)))]
    for _, x in extra:
        at_row.append(code.setdefault(x, len(code)))
        doc_of.append(-1)
    at_row, doc_ids = np.array(at_row), np.array(doc_of)
    inside = doc_ids >= 0
    about = np.eye(k)[:, [j for j, _ in extra]] if extra else np.zeros((k, 0))
    y = np.concatenate([weak[:, doc_ids[inside]], about], axis=1)
    rows = Features().rows(list(code))
    order = np.argsort(at_row, kind="stable")
    _common(rows, np.split(np.maximum(doc_ids, 0)[order], np.cumsum(np.bincount(at_row, minlength=len(code)))[:-1]))

    def mean(target: np.ndarray, use: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        weight = np.bincount(at_row[use], minlength=len(code)).astype(float)
        return np.stack([np.bincount(at_row[use], weights=target[j, use], minlength=len(code)) for j in range(k)]) / np.maximum(weight, 1), weight

    def relabelled(p: np.ndarray) -> np.ndarray:
        # What a document can be about: its labels, and any area with several sure sentences (labels may be wrong).
        p = p[:, at_row]
        n = np.stack([np.bincount(doc_ids[inside], weights=p[j, inside] > SURE, minlength=len(docs)) for j in range(k)])
        allowed = np.ones_like(p)
        allowed[:, inside] = np.where((n >= 2) | (weak > 0), 1.0, 0.25)[:, doc_ids[inside]]
        q = p * allowed
        best = q.argmax(axis=0)
        target = np.zeros_like(y)
        i = np.arange(q.shape[1])
        yes = q[best, i] > RELABEL
        target[best[yes], i[yes]] = 1.0
        target[:, ~inside] = y[:, ~inside]
        return target

    # Every fifth document is left out until the thresholds are chosen.
    held = inside & (doc_ids % 5 == 4)
    fit = Fit(rows, k)
    p = fit.run(*mean(y, ~held), STEPS)
    for _ in range(rounds):
        p = fit.run(*mean(relabelled(p), ~held), MORE_STEPS)
    thresholds = _thresholds(p[:, at_row[held]], doc_ids[held], hand)
    every = np.ones(len(doc_ids), dtype=bool)
    p = fit.run(*mean(np.where(held, y, relabelled(p)), every), MORE_STEPS)
    p = fit.run(*mean(relabelled(p), every), MORE_STEPS)
    return Model(areas, fit.full(), fit.b, thresholds)


def _thresholds(p: np.ndarray, doc_ids: np.ndarray, hand: np.ndarray) -> np.ndarray:
    """For each area in turn the cut, from ``SURE`` to 0.7, with which documents get most of the labels given by hand and fewest others."""
    k = len(p)
    thresholds = np.full(k, SURE)
    docs, local = np.unique(doc_ids, return_inverse=True)
    if not len(docs):
        return thresholds
    truth = hand[:, docs] >= 0.5
    best = p.argmax(axis=0)
    top = p[best, np.arange(p.shape[1])]
    # How many sentences of each document each area has, at the thresholds so far.
    n = np.stack([np.bincount(local[(best == j) & (top >= SURE)], minlength=len(docs)) for j in range(k)])
    cuts = np.linspace(SURE, 0.7, 11)
    for j in range(k):
        if truth[j].sum() < 20:
            continue
        got = []
        for c in cuts:
            n[j] = np.bincount(local[(best == j) & (top >= c)], minlength=len(docs))
            got.append((n > 0) & (n >= SHARE * n.sum(axis=0) - 1e-9))
        right = [(x == truth).sum() for x in got]
        first = int(np.argmax(right))
        # The least cut that isn't worse by more than chance makes it.
        good = [i for i, x in enumerate(got) if right[first] - right[i] <= np.sqrt((x != got[first]).sum())]
        thresholds[j] = cuts[min(good)]
        n[j] = np.bincount(local[(best == j) & (top >= thresholds[j])], minlength=len(docs))
    return thresholds


def labelled_sample(docs: DataFrame, labels: DataFrame, bound: int = LABELLED_DOCS, meta: tuple[str, ...] = ("source", "kind")) -> list[Labelled]:
    """Up to ``bound`` labelled documents with a text, the share of their annotators for each area, and the columns of ``meta`` they have."""
    lab = labels.select("doc_id", F.lower(F.trim("subject")).alias("subject"), F.coalesce("annotator", F.lit("")).alias("annotator")).filter("doc_id is not null and subject is not null").distinct()
    per = lab.groupBy("doc_id").agg(F.collect_list(F.struct("subject", "annotator")).alias("labels"))
    picked = per.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    meta = tuple(c for c in meta if c in docs.columns)
    met = docs.select("doc_id", "text", *meta).filter("text is not null and text != ''").join(F.broadcast(picked), "doc_id").dropDuplicates(["doc_id"])
    upto = F.sum(F.length("text")).over(Window.orderBy(F.xxhash64("doc_id"), "doc_id"))  # over at most ``bound`` rows
    rows = met.withColumn("_upto", upto).filter(F.col("_upto") <= LABELLED_CHARS).orderBy("doc_id").collect()
    out = []
    for r in rows:
        who = {x.annotator for x in r.labels}
        share: dict[str, float] = {}
        for x in r.labels:
            share[x.subject] = share.get(x.subject, 0.0) + 1 / len(who)
        out.append(Labelled(r.text, {a: min(1.0, v) for a, v in share.items()}, {c: r[c] for c in meta}))
    return out


def assign(docs: DataFrame, key: str, text: str, model: Model, share: float = SHARE) -> DataFrame:
    """``key, subject``: a row for each area of each document.

    Null, empty and blank texts, and texts without a sentence on any area,
    have no row. Whole texts are read. No shuffle.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        judge = Judge(sent.value, share)
        for pdf in batches:
            got = [(k, a) for k, areas in zip(pdf["key"], judge.areas_of_all(list(pdf["text"]))) for a in areas]
            if got:
                yield pd.DataFrame(got, columns=["key", "subject"])

    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).filter("text is not null").mapInPandas(run, f"key {kind}, subject string").withColumnRenamed("key", key)
