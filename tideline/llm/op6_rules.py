"""Quality rules: counts over a text's words and lines, and a linear-chain random field over its lines.

The field labels each line that has a word as content or boilerplate, from symbol, capital, exclamation and digit
shares, repeated words and lines, length and line end, and from the label of the line before; Viterbi decoding gives
the best labels, and a document stays if content lines hold at least ``SHARE`` of its word bytes. It is trained here, by
gradient steps on the likelihood, on at most ``SAMPLE`` labelled documents of at most ``SAMPLE_LINES`` lines, whose
quality label stands for each of their lines.

Defined cases: null or empty text has no words and fails the base rules; a line of blanks is no line; without labels of
both classes all lines are content; repeated rows each give their row; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tideline.llm.common import chunks, labelled_sample

SHARE = 0.5
SAMPLE, SAMPLE_LINES, SAMPLE_BYTES = 1500, 32, 10_000
WINDOW = 5
AT_ONCE = 1 << 19  #: bytes of text measured at once; arrays of this size stay in cache
#: The six blanks and the symbols that the rules count.
BLANKS, SYMBOLS = b" \t\n\v\f\r", b"#*$%&|<>"


def _table(chars: bytes) -> np.ndarray:
    t = np.zeros(256, dtype=bool)
    t[list(chars)] = True
    return t


IS_BLANK, IS_SYMBOL, IS_DIGIT, IS_END = _table(BLANKS), _table(SYMBOLS), _table(b"0123456789"), _table(b".?!:;\"')]")
IS_UPPER = _table(bytes(range(65, 91)))
IS_LETTER = IS_UPPER | _table(bytes(range(97, 123)))
STARTS_CHAR = (np.arange(256) & 0xC0) != 0x80
N_FEATURES = 9


def repeated_words(ids: np.ndarray, doc: np.ndarray, width: int = WINDOW) -> np.ndarray:
    """Which words stand in a window of ``width`` words that their document has twice or more."""
    n = len(ids) - width + 1
    covered = np.zeros(len(ids), dtype=bool)
    if n <= 0:
        return covered
    at = np.flatnonzero(doc[:n] == doc[width - 1 :])
    if not len(at):
        return covered
    h = doc[at].astype(np.uint64)
    for k in range(width):
        h = (h ^ ids[at + k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
    order = np.argsort(h, kind="stable")
    met = np.flatnonzero(h[order[1:]] == h[order[:-1]])
    left, right = at[order[met]], at[order[met + 1]]
    equal = doc[left] == doc[right]
    for k in range(width):
        equal &= ids[left + k] == ids[right + k]
    if not equal.all():  # hashes have met by chance: sort the words themselves
        order = np.lexsort([*(ids[at + k] for k in reversed(range(width))), doc[at]])
        left, right = at[order[:-1]], at[order[1:]]
        equal = doc[left] == doc[right]
        for k in range(width):
            equal &= ids[left + k] == ids[right + k]
    edge = np.zeros(len(ids) + 1, dtype=np.int32)
    found = np.unique(np.concatenate([left[equal], right[equal]]))
    edge[found] += 1
    edge[found + width] -= 1
    return np.cumsum(edge)[:-1] > 0


class Measured:
    """Counts of a few documents, and the features of their lines with a word."""

    def __init__(self, raw: list[bytes]):
        joined = b"\n".join(raw) + b"\n"
        buf = np.frombuffer(joined, dtype=np.uint8)
        sizes = np.array([len(x) + 1 for x in raw], dtype=np.int64)
        doc_start = np.cumsum(sizes) - sizes
        solid = ~IS_BLANK[buf]
        per_doc = lambda flags: np.add.reduceat(flags, doc_start, dtype=np.int64)
        begins = solid.copy()
        begins[1:] &= ~solid[:-1]
        word_at = np.flatnonzero(begins)
        self.n_words = per_doc(begins)
        self.word_chars = per_doc(solid & STARTS_CHAR[buf])
        symbol = IS_SYMBOL[buf]
        self.n_symbols = per_doc(symbol)

        words = joined.split()
        numbers = {w: i for i, w in enumerate(dict.fromkeys(words))}
        ids = np.fromiter(map(numbers.__getitem__, words), dtype=np.int64, count=len(words))
        word_doc = np.repeat(np.arange(len(raw)), self.n_words)
        self.n_repeat_words = np.bincount(word_doc, weights=repeated_words(ids, word_doc), minlength=len(raw)).astype(np.int64)

        line_end = np.flatnonzero(buf == 10)
        line_start = np.concatenate([[0], line_end[:-1] + 1])
        per_line = lambda flags: np.add.reduceat(flags, line_start, dtype=np.int64)
        line_words = per_line(begins)
        has = line_words > 0
        line_doc = np.searchsorted(doc_start, line_start, side="right") - 1
        again = np.zeros(len(line_start), dtype=bool)
        at = 0
        for x in raw:
            lines = x.split(b"\n")
            if len(lines) > 1:
                seen: set[bytes] = set()
                for k, line in enumerate(lines):
                    if line in seen:
                        again[at + k] = True
                    else:
                        seen.add(line)
            at += len(lines)
        again &= has
        self.n_dup_lines = np.bincount(line_doc[again], minlength=len(raw))

        size = np.maximum(per_line(solid), 1)
        word_line = np.repeat(np.arange(len(line_start)), line_words)
        stutter = np.zeros(len(ids), dtype=bool)
        stutter[1:] = (ids[1:] == ids[:-1]) & (word_line[1:] == word_line[:-1])
        last = np.maximum.reduceat(np.where(solid, np.arange(len(buf)), 0), line_start) if len(buf) else np.empty(0, int)
        x = np.zeros((len(line_start), N_FEATURES))
        x[:, 0] = 1
        x[:, 1] = per_line(symbol) / size
        x[:, 2] = per_line(IS_UPPER[buf]) / np.maximum(per_line(IS_LETTER[buf]), 1)
        x[:, 3] = per_line(buf == 33) / size
        x[:, 4] = per_line(IS_DIGIT[buf]) / size
        x[:, 5] = np.bincount(word_line, weights=stutter, minlength=len(line_start)) / np.maximum(line_words, 1)
        x[:, 6] = again
        x[:, 7] = np.log1p(line_words) / 5
        x[:, 8] = IS_END[buf[last]]
        self.lines, self.line_doc, self.line_bytes = x[has], line_doc[has], size[has]


def viterbi(emission: np.ndarray, doc: np.ndarray, n_docs: int, transition: np.ndarray) -> np.ndarray:
    """The best label, 0 content or 1 boilerplate, of each line; lines stand document by document.

    ``emission`` is the score of label 1 over label 0. All documents go through their lines side by side.
    """
    count = np.bincount(doc, minlength=n_docs)
    start = np.cumsum(count) - count
    order = np.argsort(-count, kind="stable")
    longest = int(count.max(initial=0))
    label = np.zeros(len(doc), dtype=np.int8)
    if not longest:
        return label
    active = [int(np.searchsorted(-count[order], -t, side="left")) for t in range(longest)]  # documents with over t lines
    best, back = np.zeros((n_docs, 2)), []
    for t, n in enumerate(active):
        e = emission[start[order[:n]] + t]
        if t:
            both = best[:n, :, None] + transition[None]
            back.append(both.argmax(axis=1).astype(np.int8))
            best[:n] = both.max(axis=1)
        best[:n, 1] += e
    state = best.argmax(axis=1).astype(np.int8)
    for t in reversed(range(longest)):
        n = active[t]
        label[start[order[:n]] + t] = state[:n]
        if t:
            state[:n] = back[t - 1][np.arange(n), state[:n]]
    return label


def train(samples: list[tuple[np.ndarray, int]], rounds: int = 80, rate: float = 0.3) -> tuple[np.ndarray, np.ndarray]:
    """Weights and transitions that make the labels likely: forward and backward sums over padded documents."""
    n, longest = len(samples), max(len(x) for x, _ in samples)
    x = np.zeros((n, longest, N_FEATURES))
    there = np.zeros((n, longest), dtype=bool)
    for i, (lines, _) in enumerate(samples):
        x[i, : len(lines)], there[i, : len(lines)] = lines, True
    y = np.array([label for _, label in samples])
    balance = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) / there.sum(axis=1)
    w, tr = np.zeros(N_FEATURES), np.zeros((2, 2))
    moment = [np.zeros_like(w), np.zeros_like(tr), np.zeros_like(w), np.zeros_like(tr)]
    for step in range(1, rounds + 1):
        e = x @ w
        a, b = np.zeros((n, longest, 2)), np.zeros((n, longest, 2))
        a[:, 0, 1] = e[:, 0]
        for t in range(1, longest):
            nxt = np.logaddexp(a[:, t - 1, 0, None] + tr[0], a[:, t - 1, 1, None] + tr[1])
            nxt[:, 1] += e[:, t]
            a[:, t] = np.where(there[:, t, None], nxt, a[:, t - 1])
        for t in range(longest - 2, -1, -1):
            nxt = b[:, t + 1] + np.stack([np.zeros(n), e[:, t + 1]], axis=1)
            b[:, t] = np.where(there[:, t + 1, None], np.logaddexp(tr[:, 0] + nxt[:, 0, None], tr[:, 1] + nxt[:, 1, None]), 0.0)
        total = np.logaddexp(a[:, -1, 0], a[:, -1, 1])
        p1 = np.exp(a[:, :, 1] + b[:, :, 1] - total[:, None]) * there
        gw = np.einsum("nt,ntf->f", (y[:, None] * there - p1) * balance[:, None], x) - 1e-4 * w
        pair = a[:, :-1, :, None] + tr + (b[:, 1:] + np.stack([np.zeros_like(e[:, 1:]), e[:, 1:]], axis=2))[:, :, None, :] - total[:, None, None, None]
        expected = np.einsum("ntij,nt->ij", np.exp(np.minimum(pair, 0)), there[:, 1:] * balance[:, None])
        seen = np.diag([(there[:, 1:].sum(axis=1) * balance)[y == k].sum() for k in (0, 1)])
        gt = seen - expected - 1e-2 * tr
        for k, (g, v) in enumerate(((gw, w), (gt, tr))):
            moment[k] = 0.9 * moment[k] + 0.1 * g
            moment[k + 2] = 0.99 * moment[k + 2] + 0.01 * g * g
            v += rate * (moment[k] / (1 - 0.9**step)) / (np.sqrt(moment[k + 2] / (1 - 0.99**step)) + 1e-8)
    return w, tr


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    rows = labelled_sample(docs, labels, sample, SAMPLE_BYTES)
    if not len(rows):
        return np.zeros(N_FEATURES), np.zeros((2, 2))
    m = Measured([text.encode() for text in rows.column("text").to_pylist()])
    ends = np.cumsum(np.bincount(m.line_doc, minlength=len(rows)))
    lines = np.split(m.lines, ends[:-1])
    samples = [(x, 1 - y) for x, y in zip(lines, rows.column("y").to_pylist(), strict=True) if 0 < len(x) <= SAMPLE_LINES]
    if len({y for _, y in samples}) < 2:
        return np.zeros(N_FEATURES), np.zeros((2, 2))
    return train(samples)


def check_rules(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], share: float = SHARE) -> DataFrame:
    """One row per document: the counts, both verdicts, the share of content and the number of content lines."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, tr = shared.value
        for batch, raw in chunks(batches, most=AT_ONCE):
            m = Measured(raw)
            content = viterbi(m.lines @ w, m.line_doc, len(raw), tr) == 0
            part = np.bincount(m.line_doc, weights=m.line_bytes * content, minlength=len(raw)) / np.maximum(np.bincount(m.line_doc, weights=m.line_bytes, minlength=len(raw)), 1)
            failed = (m.n_words < 10) | (100 * m.n_repeat_words > 20 * m.n_words)
            n_content = np.bincount(m.line_doc[content], minlength=len(raw))
            out = (m.n_words, m.word_chars, m.n_symbols, m.n_dup_lines, m.n_repeat_words, failed, ~failed & (part >= share), part, n_content)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, out)], names=NAMES)

    return docs.select("doc_id", "text").mapInArrow(
        rows, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, content_share double, n_content_lines long"
    )


NAMES = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "content_share", "n_content_lines"]
