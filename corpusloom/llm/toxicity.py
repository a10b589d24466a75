"""Toxicity by multiple-instance learning: sentence scores joined by noisy-or, trained from the labels of documents."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import Memo
from .common import key_arrays, key_schema, keyed_texts, rows_of

#: Labelled documents of each class that the model is fitted on at most, and bytes of their whole texts after which no more are taken.
SAMPLE, SAMPLE_BYTES = 3000, 32 << 20
#: Documents that a feature must be in, the part of them that must be toxic, and the number of features kept at most.
LEAST_DOCS, LEAST_PART, FEATURES = 4, 0.5, 4000
#: What a feature's log-likelihood ratio must have beyond twice the log of the number of features tried.
MARGIN = 8.0
#: Lengths of the beginnings of words that are features beside the words, written with a star.
BEGINNINGS = range(4, 9)
STEPS, RATE, PULL = 150, 0.05, 2e-3
#: Logit of a sentence without known features (p of 1e-6). It isn't fitted: such sentences tell nothing, and long texts have many.
REST = float(np.log(1e-6 / (1 - 1e-6)))
WORD = re.compile(r"[^\W\d_]+")
SENTENCE = re.compile(r"[^.!?\n]+[.!?]*")


#: Part of a document's distinct sentences beyond which it counts as a near copy of earlier ones of the same label.
KNOWN_PART = 0.5


def near_copies(texts: list[str], labels: list[int]) -> list[int]:
    """A number of the group of each text: texts of one label that have more than KNOWN_PART of their sentences in common with earlier ones
    join the group that they share most with. All texts teach, whatever others hold; a group counts as one document."""
    seen: dict[tuple[int, str], int] = {}
    out: list[int] = []
    for text, label in zip(texts, labels):
        own = {s.strip().lower() for s in SENTENCE.findall(text)} - {""}
        met = Counter(seen[label, s] for s in own if (label, s) in seen)
        group = min(met, key=lambda g: (-met[g], g)) if sum(met.values()) > KNOWN_PART * len(own) else len(out)
        for s in own:
            seen.setdefault((label, s), group)
        out.append(group)
    return out


def features(word: str) -> list[str]:
    return [word, *(f"{word[:k]}*" for k in BEGINNINGS if k < len(word))]


class NoisyOr:
    """Feature weights and a bias of a sentence's logit; a document's score is 1 - prod(1 - p) over its sentences.

    A word stands for its first known feature in the order of `weights` (the most telling first); a sentence counts
    each feature once.
    """

    def __init__(self, weights: dict[str, float], bias: float):
        self.weights, self.bias = weights, bias
        self.order = {f: i for i, f in enumerate(weights)}
        self.of_word = Memo(self._feature)

    def __reduce__(self):
        return NoisyOr, (self.weights, self.bias)

    def _feature(self, word: str) -> str | None:
        return min((f for f in features(word) if f in self.order), key=self.order.__getitem__, default=None)

    def known(self, text: str) -> set[str]:
        return set(map(self.of_word.__getitem__, set(WORD.findall(text.lower())))) - {None}

    def sentences(self, text: str) -> list[tuple[int, str, float]]:
        """(start, sentence, p) of each sentence."""
        out = []
        for m in SENTENCE.finditer(text):
            z = self.bias + sum(sorted(map(self.weights.__getitem__, self.known(m[0]))))
            out.append((m.start(), m[0], float(1 / (1 + np.exp(-z)))))
        return out

    def score(self, text: str) -> tuple[float, list[tuple[int, str, float]]]:
        """The document's score and its offending sentences (p of 0.5 or more)."""
        clean = 1 / (1 + np.exp(self.bias))  # 1 - p of a sentence without any known feature
        if not self.known(text):
            n = sum(1 for _ in SENTENCE.finditer(text))
            return float(1 - clean ** max(1, n)), []
        told = self.sentences(text)
        kept = 1.0
        for _, _, p in told:
            kept *= 1 - p
        return float(1 - kept), [x for x in told if x[2] >= 0.5]


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, most_bytes: int = SAMPLE_BYTES) -> NoisyOr:
    """The model from the whole texts and labels.toxic of at most `sample` documents of each class by order of a hash of the
    id: a bounded fit. A document is taken if those before it have under `most_bytes`, whatever its own length. An id with both labels counts as
    toxic. Null labels and null texts teach nothing; of the features that pass the tests of train the FEATURES most telling ones are kept. Without toxic documents no word is known, without clean ones all texts are toxic."""
    toxic = labels.select(F.col("doc_id").alias("labelled"), F.col("toxic").cast("int").alias("toxic")).where("toxic in (0, 1)").groupBy("labelled").agg(F.max("toxic").alias("toxic"))
    number = {r["toxic"]: r["n"] for r in toxic.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    h = F.xxhash64("labelled")
    share = F.when(F.col("toxic") == 1, min(1.0, 2.5 * (sample + 50) / max(1, number.get(1, 0)))).otherwise(min(1.0, 2.5 * (sample + 50) / max(1, number.get(0, 0))))
    cut = toxic.where(h.cast("double") / 2.0**64 + 0.5 <= share)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).where("text is not null")
    # broadcast: the cut holds about 2.5 times the sample of each class at most, whatever the table's size
    order = Window.partitionBy("toxic").orderBy(h, "text")
    ranked = rows.join(F.broadcast(cut), F.col("doc_id") == F.col("labelled")).withColumn("r", F.row_number().over(order))
    ranked = ranked.withColumn("before", F.sum(F.octet_length("text")).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    kept = ranked.where((F.col("r") <= sample) & (F.coalesce("before", F.lit(0)) < most_bytes))
    got = sorted((r["toxic"], r["doc_id"], r["text"]) for r in kept.select("toxic", "doc_id", "text").collect())
    shown = sum(1 for y, _, _ in got if not y)
    return train([t for _, _, t in got], [y for y, _, _ in got], max(1.0, number.get(0, 0) / shown if shown else 1.0))


def train(texts: list[str], toxic: list[int], clean_weight: float = 1.0) -> NoisyOr:
    """clean_weight: how many clean documents each one here stands for."""
    # exact copies of a text with one label count once; a text that shares passages, or has both labels, teaches
    new = list({(y, t): i for i, (y, t) in reversed(list(enumerate(zip(toxic, texts))))}.values())[::-1]
    texts, toxic = [texts[i] for i in new], [toxic[i] for i in new]
    y = np.array(toxic, "f8")
    if not len(y) or y.min() == y.max():
        return NoisyOr({}, float(np.log(99)) if len(y) and y.min() else REST)
    same: dict[str, str] = {}  # one object for all places of a word
    bags = [[tuple({same.setdefault(w, w) for w in WORD.findall(s.lower())}) for s in SENTENCE.findall(t)] or [()] for t in texts]
    in_words = lambda b: {f for w in set().union(*b) for f in features(w)}
    group = near_copies(texts, toxic)
    alike: dict[int, list[int]] = {}
    for d, g in enumerate(group):
        alike.setdefault(g, []).append(d)
    joined = [(toxic[members[0]], [s for d in members for s in bags[d]]) for members in alike.values()]
    share = 1.0 / np.array([len(alike[g]) for g in group])
    # half of the LEAST_DOCS documents of a telling feature are toxic at least, so that others need no count; a table of
    # counts by a hash, which are never too low, spares most of them
    may, slot = np.zeros(1 << 22, "i4"), lambda f: crc32(f.encode()) & (1 << 22) - 1
    for label, b in joined:
        if label:
            np.add.at(may, [slot(f) for f in in_words(b)], 1)
    hits = Counter()
    for label, b in joined:
        if label:
            hits.update(f for f in in_words(b) if 2 * may[slot(f)] >= LEAST_DOCS)
    hits = Counter({f: k for f, k in hits.items() if 2 * k >= LEAST_DOCS})
    n = Counter()
    for _, b in joined:
        n.update(in_words(b) & hits.keys())
    total, ones = len(joined), float(sum(label for label, _ in joined))
    least = 2 * np.log(max(2, len(n))) + MARGIN

    def ratio(f: str) -> float:
        a, m = hits[f], n[f]
        table = ((a, m * ones / total), (m - a, m * (1 - ones / total)), (ones - a, (total - m) * ones / total), (total - m - ones + a, (total - m) * (1 - ones / total)))
        return 2 * sum(o * np.log(o / e) for o, e in table if o > 0 and e > 0)

    part = lambda f: hits[f] / (hits[f] + clean_weight * (n[f] - hits[f]))
    telling = {f: r for f in n if n[f] >= LEAST_DOCS and n[f] * ones < hits[f] * total and part(f) >= LEAST_PART and (r := ratio(f)) >= least}
    known = sorted(telling, key=lambda f: (-telling[f], len(f), f))[:FEATURES]
    place = {f: i for i, f in enumerate(known)}
    model = NoisyOr({f: 0.0 for f in known}, 0.0)
    # sentences with a known feature one by one, the others of a document as a number
    total = len(y)
    doc, at, word, empty = [], [], [], np.zeros(total)
    for d, b in enumerate(bags):
        for s in b:
            found = {place[f] for f in map(model.of_word.__getitem__, s) if f is not None}
            if not found:
                empty[d] += 1
                continue
            word.extend(found)
            at.extend([len(doc)] * len(found))
            doc.append(d)
    doc, at, word = np.array(doc, "i8"), np.array(at, "i8"), np.array(word, "i8")
    # the start, to which all is drawn: a feature alone makes a sentence as toxic as the documents that hold it
    start = np.array([*(np.log((hits[f] + 0.5) / (clean_weight * (n[f] - hits[f]) + 0.5)) for f in known), REST])
    more = np.bincount(at, minlength=len(doc)) - 1.0
    theta = start.copy()
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, STEPS + 1):
        z = np.bincount(at, theta[word], len(doc)) - theta[-1] * more
        p, p0 = 1 / (1 + np.exp(-z)), 1 / (1 + np.exp(-theta[-1]))
        clear = np.bincount(doc, np.log1p(-np.minimum(p, 1 - 1e-9)), total) + empty * np.log1p(-p0)
        whole = np.clip(1 - np.exp(clear), 1e-9, 1 - 1e-9)
        pull = np.where(y > 0, (1 - whole) / whole, -1.0)  # times p: the slope of the log-likelihood in z
        pull *= np.where(y > 0, 1.0, clean_weight) * share
        g = pull[doc] * p
        grad = np.append(np.bincount(word, g[at], len(known)), 0.0) / total
        grad -= PULL * (theta - start)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        theta += RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    return NoisyOr({f: float(theta[i] - theta[-1]) for f, i in place.items()}, float(theta[-1]))


def score(docs: DataFrame, model: NoisyOr, key: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """key columns (long), score, offending (array of start, sentence, p) of every whole text.

    A null or empty text, or one without a sentence, has the score of one sentence without known words.
    Null and repeated doc_ids are kept; no rows give none; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # FEATURES weights at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        kind = pa.list_(pa.struct([("start", pa.int32()), ("sentence", pa.string()), ("p", pa.float64())]))
        for ids, texts in rows_of(batches, key=key):
            told = [model.score(t) for t in texts]
            yield pa.RecordBatch.from_arrays([*key_arrays(ids, key), pa.array([s for s, _ in told], pa.float64()), pa.array([[{"start": a, "sentence": t, "p": p} for a, t, p in bad] for _, bad in told], kind)], names=[*key, "score", "offending"])

    return keyed_texts(docs, key).mapInArrow(run, f"{key_schema(key)}, score double, offending array<struct<start:int,sentence:string,p:double>>")
