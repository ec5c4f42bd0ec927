"""Subject area of each document: one-versus-rest linear classifiers on hashed word n-grams.

Each sentence is a bag of hashed words, of their stems (first letters without accents, which languages share) and of
pairs of words that follow one another; a pair counts if some documents of the fit hold it, as invented names stand in
most others. One logistic classifier per subject is trained on the sentences of labelled documents, each sentence with
the labels of its document: weak labels, as raters err and sentences may treat nothing or another subject. Further
trainings give a sentence of a document with several labels those that it shows. On documents held out of all trainings
a threshold per subject is calibrated for the best F1 of the last model.

A document gets its main subject (the largest sum of its sentences' probabilities) and each other subject of which at
least two sentences pass the threshold.

The fit uses at most ``MOST_LABELLED`` labelled documents, chosen by hash of the id; the result covers every document.

Edge cases: null, blank and wordless texts have no subject and no row; subjects that no rater gave never come out;
labels that are null, doubled or of unknown documents are ignored; equal sums go to the subject first in order; repeated
rows come out once for each document id and subject; without any labels the result is empty; extra columns are
ignored.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labelled documents that the fit uses at most.
MOST_LABELLED = 4_000
#: Hash space of words and stems, and of pairs above it.
BITS = 18
SPACE = 2 << BITS
#: Documents of the fit that must hold a pair of words.
PAIR_DOCUMENTS = 20
SENTENCES = 2
EPOCHS, BATCH, RATE, DECAY = 4, 512, 0.5, 1e-5
#: Letters of a stem.
STEM = 5
#: Trainings after the first.
ROUNDS = 3

_MASK = (1 << BITS) - 1
_SPLIT = re.compile(r"(?<=[.!?])[”»)\"“]*\s+(?=[“«„(¿¡\"‘]*[A-ZÀ-Þ])|\n+")
_WORD = re.compile(r"[^\W\d_]{2,}")
_hashes: dict[str, int] = {}


def _hashed(word: str) -> int:
    """Features of a word: itself in the lower bits, and above them its first letters without accents."""
    if len(_hashes) > 500_000:
        _hashes.clear()
    stem = word if word.isascii() else "".join(c for c in unicodedata.normalize("NFD", word) if not unicodedata.combining(c))
    own, head = (zlib.crc32(x.encode("utf-8", "replace")) * 0x9E3779B97F4A7C15 >> 64 - BITS & _MASK for x in (word, "^" + stem[:STEM]))
    got = _hashes[word] = own | head << BITS
    return got


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed features, the first feature of each sentence, and the document of each sentence that has words."""
    flat: list[int] = []
    sizes: list[int] = []
    docs: list[int] = []
    get = _hashes.get
    for d, text in enumerate(texts):
        for s in _SPLIT.split(text):
            if ws := _WORD.findall(s.lower()):
                flat += [get(w) or _hashed(w) for w in ws]
                sizes.append(len(ws))
                docs.append(d)
    packed = np.array(flat, np.int64)
    own, head = packed & _MASK, packed >> BITS
    at = np.repeat(np.arange(len(sizes)), sizes)
    beside = at[1:] == at[:-1]
    pairs = ((own[:-1] * 0x9E3779B1 + own[1:] >> 5 & _MASK) + (1 << BITS))[beside]
    place = np.concatenate([at, at, at[1:][beside]])
    order = np.argsort(place, kind="stable")
    start = np.concatenate([[0], np.cumsum(np.bincount(place, minlength=len(sizes)))[:-1]]) if sizes else np.zeros(0)
    return np.concatenate([own, head, pairs])[order], start.astype(np.int64), np.array(docs, np.int64)


def _only(kept: np.ndarray, idx: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The features that are kept; each sentence has words, which always are."""
    keep = kept[idx]
    return idx[keep], np.concatenate([[0], np.cumsum(keep)])[start]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def probabilities(weights: np.ndarray, bias: np.ndarray, idx: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Probability of each subject for each sentence."""
    if not len(start):
        return np.zeros((0, len(bias)), np.float32)
    n = np.diff(np.append(start, len(idx)))
    return _sigmoid(np.add.reduceat(weights[idx], start, axis=0) / np.sqrt(n)[:, None] + bias)


def train(idx: np.ndarray, start: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights and biases by AdaGrad on the logistic loss; ``target``: sentences x subjects, 0 to 1."""
    k = target.shape[1]
    w, b = np.zeros((SPACE, k), np.float32), np.full(k, -2.0, np.float32)
    gw, gb = np.full((SPACE, 1), 1e-3, np.float32), 1e-3
    size = np.diff(np.append(start, len(idx)))
    rng = np.random.default_rng(7)
    for _ in range(EPOCHS):
        order = rng.permutation(len(start))
        for at in range(0, len(order), BATCH):
            rows = order[at : at + BATCH]
            n = size[rows]
            first = np.concatenate([[0], np.cumsum(n)[:-1]])
            f = idx[np.arange(n.sum()) - np.repeat(first - start[rows], n)]
            scale = (1 / np.sqrt(n)).astype(np.float32)[:, None]
            err = (_sigmoid(np.add.reduceat(w[f], first, axis=0) * scale + b) - target[rows]).astype(np.float32)
            own, where = np.unique(f, return_inverse=True)
            by = np.argsort(where, kind="stable")
            g = np.add.reduceat(np.repeat(err * scale, n, axis=0)[by], np.searchsorted(where[by], np.arange(len(own))), axis=0)
            gw[own] += (g * g).mean(1, keepdims=True)
            w[own] -= RATE * (g / np.sqrt(gw[own]) + DECAY * w[own])
            gb += float((err.sum(0) ** 2).mean())
            b -= RATE * err.sum(0) / np.sqrt(gb)
    return w, b


def _documents(p: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each document and subject, the sum of probabilities and the second highest."""
    k = p.shape[1]
    total, second = np.zeros((n, k)), np.zeros((n, k))
    np.add.at(total, doc, p)
    starts = np.nonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))[0] if len(doc) else np.zeros(0, int)
    for a, z in zip(starts, np.append(starts[1:], len(doc))):
        if z - a >= SENTENCES:
            second[doc[a]] = np.partition(p[a:z], z - a - SENTENCES, axis=0)[z - a - SENTENCES]
    return total, second


class Classifier:
    """Trained weights, biases and thresholds of the subjects."""

    def __init__(self, subjects: list[str], texts: list[str], labels: list[set[str]]):
        self.subjects = subjects
        at = {s: i for i, s in enumerate(subjects)}
        y = np.zeros((len(texts), len(subjects)), np.float32)
        for i, own in enumerate(labels):
            for s in own:
                y[i, at[s]] = 1
        # Every fourth document is held out of all trainings, for the thresholds.
        out = np.arange(len(texts)) % 4 == 3
        idx, start, doc = features(texts)
        size = np.diff(np.append(start, len(idx)))
        held = out[doc]
        fit = np.repeat(~held, size)
        seen = np.unique(np.repeat(doc, size)[fit] * SPACE + idx[fit]) % SPACE
        self.kept = np.bincount(seen, minlength=SPACE) >= PAIR_DOCUMENTS
        self.kept[: 1 << BITS] = True
        idx, start = _only(self.kept, idx, start)
        size = np.diff(np.append(start, len(idx)))
        n = size[~held]
        own, first, target = idx[np.repeat(~held, size)], np.concatenate([[0], np.cumsum(n)[:-1]]).astype(np.int64), y[doc[~held]]
        w, b = train(own, first, target)
        for _ in range(ROUNDS):
            w, b = train(own, first, self._soft(probabilities(w, b, own, first), target))
        self.weights, self.bias = w, b
        self.thresholds = self._calibrate(probabilities(w, b, idx, start), doc, y, out)

    @staticmethod
    def _soft(p: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Labels of sentences: of a document with several, only those that its sentence shows."""
        several = y.sum(1) > 1
        shown = p > 0.5
        return np.where(several[:, None] & shown.any(1)[:, None], y * shown, y).astype(np.float32)

    def _calibrate(self, p: np.ndarray, doc: np.ndarray, y: np.ndarray, out: np.ndarray) -> np.ndarray:
        total, second = _documents(p, doc, len(y))
        main = np.arange(y.shape[1]) == total.argmax(1)[:, None]
        best = np.full(y.shape[1], 0.5)
        for s in range(y.shape[1]):
            scores = []
            for t in np.arange(0.3, 0.81, 0.05):
                said = (main[:, s] | (second[:, s] > t))[out]
                true = y[out, s] > 0
                hit = (said & true).sum()
                scores.append((2 * hit / max(1, said.sum() + true.sum()), -abs(t - 0.5), t))
            best[s] = max(scores)[2]
        return best

    def assign(self, texts: list[str]) -> list[list[str]]:
        """The subjects of each text, the main one first."""
        idx, start, doc = features(texts)
        idx, start = _only(self.kept, idx, start)
        p = probabilities(self.weights, self.bias, idx, start)
        total, second = _documents(p, doc, len(texts))
        main = total.argmax(1)
        words = np.bincount(doc, minlength=len(texts)) > 0
        also = second > self.thresholds
        return [[self.subjects[m], *(self.subjects[s] for s in np.nonzero(a)[0] if s != m)] if ok else [] for m, a, ok in zip(main, also, words)]


def fit(documents: DataFrame, labels: DataFrame) -> Classifier | None:
    """A classifier from raters' labels (doc_id, subject); None if there are none."""
    per = labels.where("subject is not null and doc_id is not null").groupBy("doc_id").agg(F.sort_array(F.collect_set("subject")).alias("subjects"))
    texts = documents.where("text is not null").select("doc_id", "text")
    place = F.xxhash64("doc_id")
    # A sample by hash, so that only ids and labels are sorted before texts are read.
    chosen = per.orderBy(place, "doc_id").limit(MOST_LABELLED)
    rows = texts.join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"]).orderBy(place, "doc_id").collect()
    if not rows:
        return None
    subjects = sorted({s for r in rows for s in r["subjects"]})
    return Classifier(subjects, [r["text"] for r in rows], [set(r["subjects"]) for r in rows])


def assign_subjects(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, subject, is_main for every document."""
    spark = documents.sparkSession
    schema = "doc_id long, subject string, is_main boolean"
    model = fit(documents, labels)
    if model is None:
        return spark.createDataFrame([], schema)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            at = 0
            while at < len(ids):
                # Some documents at a time, by characters.
                z, size = at, 0
                while z < len(ids) and (z == at or size < 500_000):
                    size += len(texts[z])
                    z += 1
                got = [(i, s, k == 0) for i, own in zip(ids[at:z], known.assign(texts[at:z])) for k, s in enumerate(own)]
                cols = list(zip(*got)) or [[], [], []]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.bool_()))], names=["doc_id", "subject", "is_main"])
                at = z

    return documents.where("text is not null").selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, schema)
