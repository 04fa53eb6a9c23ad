"""Secret scans: fixed patterns, plus values in credential context whose guess cost is high.

The guess cost of a value is the cheapest way, in bits, to cut it into known words, word-like runs of letters,
dates, repeats, keyboard walks and brute-force spans; dynamic programming over the cut points finds it, in time that
grows with the value's length alone. Known words are a short list of what people put in passwords, and behind it the
``CORPUS_WORDS`` most frequent words of letters of all the documents; a word costs the logarithm of its rank.

Defined cases: a null or empty text has no spans; repeated rows each give their row; a null doc_id is kept;
other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import chunks

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
#: A name that announces a credential, a link, and the value up to a blank or quote.
CONTEXT = re.compile(
    r"""(?<![A-Za-z])(?:pass(?:word|wd|phrase|code)|pwd|secret|token|api[_ -]?key|access[_ -]?key|private[_ -]?key|credentials?)"""
    r"""["']?(?:\x20*(?:=>|[:=])\x20*|\x20is\x20)["']?([^\s"'<>,;]{6,})""",
    re.I | re.A,
)
KINDS = ("assign", "access", "hex", "guess")
#: One of these stands in every assignment and context, in small letters; and 32 hexadecimal digits in every hex span.
HINTS = (b"pass", b"pwd", b"secret", b"token", b"key", b"credential")
HEX_MARKS = bytes(48 if 48 <= c <= 57 or 97 <= c <= 102 else 32 for c in range(256))
GUESS_BITS = 45.0  #: from here on a context value counts as a secret

#: Words that people put in passwords, commonest first; the rank gives the cost.
WORDS = (
    "password qwerty admin welcome letmein login master hello dragon monkey shadow sunshine princess football "
    "baseball secret test user guest root changeme default example sample demo dummy placeholder token key api "
    "access private public server client love iloveyou summer winter spring autumn monday friday january march "
    "april june july august september october november december hunter trust super batman michael jordan george "
    "charlie thomas daniel jessica ashley computer internet google apple samsung company office pass word "
    "null none true false undefined your enter here insert value string"
).split()
CORPUS_WORDS = 20_000
WORD_LENGTHS = (3, 20)
HELD_WORDS = 500_000  #: words that a task counts before it passes them on


def ranks(words: Iterable[str] = ()) -> dict[str, int]:
    """The cost rank of each known word: the fixed ones first, then ``words`` as they come."""
    return {w: i + 2 for i, w in enumerate(dict.fromkeys(chain(WORDS, words)))}


RANK = ranks()
#: The rows of a US keyboard.
ROWS = ("`1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
PLACE = {c: (y, x) for y, row in enumerate(ROWS) for x, c in enumerate(row)}
LEET = str.maketrans("013457@$!", "oieastasi")

DATE = re.compile(r"(?:\d{1,4}([-/._])\d{1,2}\1\d{1,4}|(?:19|20)\d{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])|(?:19|20)\d{2})", re.A)
LETTERS = re.compile(r"[A-Za-z]?[a-z]{2,}|[A-Z]{3,}", re.A)
#: All ASCII that is no letter becomes a blank, so that words end there.
NO_MARKS = bytes(c if chr(c).isalpha() or c > 127 else 32 for c in range(256))
SEGMENT_BITS = 1.0  #: for each further segment
LETTER_BITS = 2.6  #: a letter of a word-like run


def _letter_bits(c: str) -> float:
    if c.isdigit():
        return math.log2(10)
    if c.isalpha():
        return math.log2(26) if c.isascii() else 8.0
    return math.log2(33) if c.isascii() else 10.0


def _near(a: str, b: str) -> bool:
    if a not in PLACE or b not in PLACE:
        return False
    (y, x), (v, u) = PLACE[a], PLACE[b]
    return abs(y - v) <= 1 and abs(x - u) <= 1 and a != b


def guess_bits(value: str, rank: dict[str, int] = RANK) -> float:
    """The least cost, in bits, of the value's segmentations; 0 for an empty value."""
    best = [0.0] + [math.inf] * len(value)
    for i, j, bits, joins in segments(value, rank):
        best[j] = min(best[j], best[i] + bits + SEGMENT_BITS * (i > 0 and not joins))
    return best[-1]


def segments(value: str, rank: dict[str, int]) -> Iterator[tuple[int, int, float, bool]]:
    """(start, end, bits, joins) of all segments that a cut may use, by start; a brute-force character joins what is before it."""
    n = len(value)
    low = value.lower()
    if len(low) != n:
        low = value
    plain = low.translate(LEET)
    mixed = any(c.isupper() for c in value) and any(c.islower() for c in value) and any(c.isdigit() for c in value)
    dates = {m.start(): m.end() for m in DATE.finditer(value)}
    words = {m.start(): m.end() for m in LETTERS.finditer(value)} if not mixed else {}
    walk_end, turns = list(range(1, n + 1)), [0] * n  # where the keyboard walk from a place ends, and its changes of row
    for i in range(n - 2, -1, -1):
        if _near(low[i], low[i + 1]):
            walk_end[i], turns[i] = walk_end[i + 1], turns[i + 1] + (PLACE[low[i]][0] != PLACE[low[i + 1]][0])
    for i in range(n):
        yield i, i + 1, _letter_bits(value[i]) + (1.0 if mixed and value[i].isalpha() else 0.0), True
        for j in range(i + WORD_LENGTHS[0], min(n, i + WORD_LENGTHS[1]) + 1):
            if (r := rank.get(plain[i:j])) is not None:
                yield i, j, math.log2(r) + (value[i:j] != low[i:j]) + 2.0 * (plain[i:j] != low[i:j]), False
        if i in dates:
            yield i, dates[i], math.log2(120.0 if dates[i] - i == 4 else 120.0 * 366 * 4), False
        if i in words:
            yield i, words[i], 4.0 + LETTER_BITS * (words[i] - i), False
        if (long := walk_end[i] - i) >= 3:
            yield i, walk_end[i], math.log2(47) + math.log2(long) + 1.5 * turns[i] + 2.0, False
        for unit in (1, 2, 3, 4):
            if i >= unit and value[i - 1] == value[i - 1 + unit : i + unit]:
                continue  # inside a run that an earlier start covers
            j = i + unit
            while value[j : j + unit] == value[i : i + unit] and len(value[j : j + unit]) == unit:
                j += unit
            if j - i >= max(3, 2 * unit):
                yield i, j, sum(_letter_bits(c) for c in value[i : i + unit]) + math.log2((j - i) // unit), False


def common_words(docs: DataFrame, most: int = CORPUS_WORDS) -> list[str]:
    """The ``most`` most frequent words of small ASCII letters over all texts, capitals as small ones, commonest first."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            kept = {w.decode(): n for w, n in held.items() if WORD_LENGTHS[0] <= len(w) <= WORD_LENGTHS[1] and w.isalpha() and w.isascii()}
            return pa.RecordBatch.from_arrays([pa.array(kept, pa.string()), pa.array(kept.values(), pa.int64())], names=["word", "n"])

        for _, raw in chunks(batches):
            for x in raw:
                held.update(x.lower().translate(NO_MARKS).split())
            if len(held) > HELD_WORDS:
                yield out()
                held.clear()
        yield out()

    counted = docs.select("text").mapInArrow(rows, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return [r.word for r in counted.orderBy(F.col("n").desc(), "word").limit(most).collect()]  # at most ``most`` short words


def may_hold(x: bytes) -> bool:
    low = x.lower()
    return b"AKIA" in x or any(h in low for h in HINTS) or b"0" * 32 in x.translate(HEX_MARKS)


def _covered(start: int, end: int, spans: list[tuple[str, int, int]]) -> bool:
    """Whether the spans together hold all of start to end."""
    for _, s, e in sorted(spans, key=lambda x: x[1]):
        if s > start:
            break
        start = max(start, e)
    return start >= end


def scan(text: str, at_least: float = GUESS_BITS, rank: dict[str, int] = RANK) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]], float]:
    """The base spans, the spans that the guess cost adds, and the highest cost of a value (0 without one)."""
    base: list[tuple[str, int, int]] = []
    top = 0.0
    for m in ASSIGN.finditer(text):
        if m.end(2) - m.start(2) >= 8:
            base.append(("assign", m.start(), m.end()))
            top = max(top, guess_bits(m[2], rank))
    base += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16] if "AKIA" in text else []
    base += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    added = []
    for m in CONTEXT.finditer(text):
        bits = guess_bits(m[1], rank)
        top = max(top, bits)
        if bits >= at_least and not _covered(m.start(1), m.end(1), base):
            added.append(("guess", m.start(1), m.end(1)))
    return base, added, top


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (x[1], KINDS.index(x[0]), x[2])))


def find_secrets(docs: DataFrame, at_least: float = GUESS_BITS) -> DataFrame:
    """One row per document: doc_id, the spans of each kind, their count, and the highest guess cost in bits."""
    shared = docs.sparkSession.sparkContext.broadcast(ranks(common_words(docs)))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw in chunks(batches):
            out: list[list] = [[] for _ in range(7)]
            for x in raw:
                base, added, top = scan(x.decode("utf-8", "replace"), at_least, shared.value) if may_hold(x) else ([], [], 0.0)
                n = [sum(k == kind for k, _, _ in base) for kind in KINDS[:3]]
                for col, v in zip(out, (*n, len(added), hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + added), top), strict=True):
                    col.append(v)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, t) for c, t in zip(out, [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()], strict=True))],
                names=["doc_id", "n_assign", "n_access", "n_hex", "n_guess", "base_sha256", "spans", "guess_bits"],
            )

    return docs.select("doc_id", "text").mapInArrow(
        rows, "doc_id long, n_assign long, n_access long, n_hex long, n_guess long, base_sha256 string, spans string, guess_bits double"
    )
