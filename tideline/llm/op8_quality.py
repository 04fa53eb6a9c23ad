"""Quality classifier: logistic regression on hashed word n-grams, learnt with follow-the-regularised-leader updates.

A document's features are its words and word pairs, the shapes of both (runs of capitals, small letters and digits as
one character each, other characters as they are, repeats once), and whether a word repeats the one before; each is
hashed to one of 2^18 places and weighs its share of the document's features. The score is the logistic function of the
sparse dot product, over the whole text. Training uses at most ``SAMPLE`` labelled documents of at most
``SAMPLE_BYTES`` bytes, those with the least hash of doc_id, so the driver holds 40 MB of text at most; rows whose
crc32(doc_id) mod 5 is 0 are held out.

Defined cases: null or empty text is scored by the bias; labels that are null, or doubled with both values, do not train;
without labels of both classes every document scores 1; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from array import array

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import chunks, fresh, held_out, labelled_sample

BITS = 18
THRESHOLD = 0.3
SAMPLE = 4000
SAMPLE_BYTES = 10_000
EPOCHS = 2
ALPHA, BETA, L1, L2 = 0.5, 1.0, 1e-4, 1e-4
SCALE = 20.0
KNOWN_WORDS = 300_000
ODD = np.uint64(0x9E3779B97F4A7C15)

#: Capitals to A, small letters and all bytes of other scripts to a, digits to 0.
CLASSES = bytes(65 if 65 <= c <= 90 else 97 if 97 <= c <= 122 or c > 127 else 48 if 48 <= c <= 57 else c for c in range(256))
REPEATS = re.compile(rb"(.)\1+", re.S)


def shape(word: bytes) -> bytes:
    return REPEATS.sub(rb"\1", word.translate(CLASSES))


class Words(dict):
    """Numbers of words, with their hash and their shape's hash."""

    def __init__(self):
        self.hashes, self.shapes = array("Q"), array("Q")
        self.of_classes: dict[bytes, int] = {}

    def add(self, words: list[bytes]) -> None:
        from xxhash import xxh64_intdigest

        if len(self) > KNOWN_WORDS:
            self.clear(), self.of_classes.clear()
            self.hashes, self.shapes = array("Q"), array("Q")
        for w in [w for w in set(words) if w not in self]:
            self[w] = len(self.hashes)
            self.hashes.append(xxh64_intdigest(w, 1))
            classes = w.translate(CLASSES)
            if (h := self.of_classes.get(classes)) is None:
                self.of_classes[classes] = h = xxh64_intdigest(shape(w), 2)
            self.shapes.append(h)


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (a * ODD) ^ (b + (a >> np.uint64(29)))
    return x ^ (x >> np.uint64(32))


def features(raw: list[bytes], words: Words) -> tuple[np.ndarray, np.ndarray]:
    """The hashed features of all texts, one after another, and how many each text has."""
    split = [x.split() for x in raw]
    counts = np.array([len(x) for x in split], dtype=np.int64)
    every = list(chain.from_iterable(split))
    if not every:
        return np.empty(0, dtype=np.int64), counts
    words.add(every)
    ids = np.fromiter(map(words.__getitem__, every), dtype=np.int64, count=len(every))
    h, s = np.array(words.hashes)[ids], np.array(words.shapes)[ids]
    h0, s0, same = np.empty_like(h), np.empty_like(s), np.zeros(len(h), dtype=np.uint64)
    h0[1:], s0[1:], same[1:] = h[:-1], s[:-1], ids[1:] == ids[:-1]
    starts = (np.cumsum(counts) - counts)[counts > 0]
    h0[starts], s0[starts], same[starts] = np.uint64(3), np.uint64(5), 2  # nothing before a text's first word
    mask = np.uint64((1 << BITS) - 1)
    found = np.stack([h, _mix(h0, h), s, _mix(s0, s), _mix(same + np.uint64(11), np.full_like(h, 13))], axis=1)
    return ((found ^ (found >> np.uint64(BITS))) & mask).astype(np.int64).ravel(), counts * 5


def train(raw: list[bytes], labels: list[int], epochs: int = EPOCHS) -> np.ndarray:
    """The weights, with the bias last; FTRL-proximal with a rate for each coordinate."""
    d = 1 << BITS
    z, n, w = np.zeros(d + 1), np.zeros(d + 1), np.zeros(d + 1)
    rows, words = [], Words()
    for i in np.random.default_rng(7).permutation(len(raw)):
        hashed, _ = features([raw[i]], words)  # text by text: all at once would hold five numbers a word
        at, times = np.unique(hashed, return_counts=True)
        rows.append((np.append(at, d), np.append(times * (SCALE / max(1, len(hashed))), 1.0), labels[i]))
    for _ in range(epochs):
        for at, x, y in rows:
            za, na = z[at], n[at]
            wa = np.where(np.abs(za) <= L1, 0.0, -(za - np.sign(za) * L1) / ((BETA + np.sqrt(na)) / ALPHA + L2))
            g = (1 / (1 + np.exp(-np.clip(wa @ x, -30, 30))) - y) * x
            n[at] = more = na + g * g
            z[at] = za + g - (np.sqrt(more) - np.sqrt(na)) / ALPHA * wa
    w = np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))
    return w.astype(np.float64)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> np.ndarray | None:
    """Weights learnt from a bounded sample of the labelled rows that are not held out; None without both classes."""
    chosen = labelled_sample(docs, labels, sample, SAMPLE_BYTES)
    y = chosen.column("y").to_pylist()
    if len(set(y)) < 2:
        return None
    return train([x.encode() for x in chosen.column("text").to_pylist()], y)


def probabilities(raw: list[bytes], weights: np.ndarray | None, words: Words) -> np.ndarray:
    if weights is None:
        return np.ones(len(raw))
    f, n = features(raw, words)
    total = np.zeros(len(raw))
    if len(f):
        some = n > 0  # a sum of each text's own, so that equal texts score alike wherever they stand
        total[some] = np.add.reduceat(weights[f], (np.cumsum(n) - n)[some]) * SCALE / n[some]
    return 1 / (1 + np.exp(-np.clip(total + weights[-1], -30, 30)))


def score(docs: DataFrame, weights: np.ndarray | None, keep: list[str], names: tuple[str, str] = ("score", "predicted"), threshold: float = THRESHOLD) -> DataFrame:
    """``keep`` columns of ``docs`` with the score and the prediction under ``names``."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # 2 MB, whatever the input
    chosen = docs.select(*keep, *(["text"] if "text" not in keep else []))
    n = len(keep)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, words = shared.value, Words()
        for batch, raw in chunks(batches):
            p = probabilities(raw, w, words)
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=[*batch.schema.names[:n], *names])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[:n])
    return chosen.mapInArrow(rows, f"{schema}, `{names[0]}` double, `{names[1]}` int")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    scored = score(docs, fit(docs, labels), ["doc_id"], threshold=threshold)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that the classifier accepts, with all their columns."""
    names = (fresh(docs, "score_"), fresh(docs, "predicted_"))
    return score(docs, fit(docs, labels), docs.columns, names, threshold).where(F.col(names[1]) == 1).select(*docs.columns)
