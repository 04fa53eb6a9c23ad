"""Best-fit packing by patterns that non-negative least squares repeats.

Pieces of at most ``size`` tokens are counted by length; that histogram has at most ``size`` bins, whatever the
input. On it the driver enumerates patterns of a few lengths that fill a sequence, fits how often to repeat each by
non-negative least squares, rounds down, and packs what is left over by best fit, longest first. The plan says for
ranks lo to hi of a length: sequence = first + (rank - lo), at a fixed offset. Tasks then number the pieces of each
length (by length and salt, so that a frequent length spreads) and look their place up.

Defined cases: null or empty text is the end id alone; repeated rows are packed each; an empty table gives no rows;
columns besides doc_id and text are ignored.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tideline.llm.common import chunks, saved

SIZE = 2048
END_ID = 0
CACHED_WORDS, CACHED_BYTES = 500_000, 48
ENDS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"  #: ASCII punctuation
#: Up to here small letters and composed forms are one character for one, but for the dotted capital I.
LAST_LATIN, DOTTED = "\u024f", "\u0130"
#: A byte as the vocabulary writes it: printable ones as themselves, the others from 256 on, in order.
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_CHARS = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in PRINTABLE)}
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class Encoder(dict):
    """Little-endian ids of a word between blanks; a blank always ends a token here, so words encode alone.

    New words are encoded in two ways. One of Latin letters, with or without ASCII punctuation behind them, is its small
    letters, which the model takes byte by byte, and then the punctuation, a run of tokens of its own. All others are encoded
    together with a bar between them, a token of its own between blanks, whose id parts them again; a word that has a bar
    in it is encoded alone. A full table becomes the old one, from which only words that come again are taken over.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.old: dict[bytes, bytes] = {}
        self.letters: dict[bytes, bytes] = {}
        self.ends: dict[bytes, bytes] = {b"": b""}
        (self.bar,) = self._ids("|")

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")

    def _of_letters(self, word: bytes) -> bytes | None:
        """The ids of a word of Latin letters and ASCII punctuation behind them, or None for any other."""
        core = word.rstrip(ENDS)
        end = word[len(core) :]
        if core.isascii():
            if not core.isalpha():
                return None
            core = core.lower()
        else:
            text = core.decode("utf-8", "replace")
            if not text.isalpha() or max(text) > LAST_LATIN or DOTTED in text:
                return None
            core = text.lower().encode()
        if (raw := self.letters.get(core)) is None:
            raw = self.letters[core] = b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(core.decode("latin-1").translate(BYTE_CHARS))])
        if (more := self.ends.get(end)) is None:
            if len(self.ends) > 10_000:
                self.ends = {b"": b""}
            more = self.ends[end] = self._ids(end.decode()).tobytes()
        return raw + more

    def add(self, words: list[bytes]) -> None:
        if len(self) > CACHED_WORDS:
            self.old = dict(self)
            self.clear()
        if len(self.letters) > CACHED_WORDS:
            self.letters.clear()
        new = [w for w in set(words) if w not in self]
        again = {w for w in new if w in self.old}
        self.update(zip(again, map(self.old.__getitem__, again), strict=True))
        rest = []
        for w in new:
            if len(w) > CACHED_BYTES or w in again:
                continue
            if (raw := self._of_letters(w)) is not None:
                self[w] = raw
            elif b"|" not in w:
                rest.append(w)
        for at in range(0, len(rest), 20_000):
            part = rest[at : at + 20_000]
            ids = self._ids(" | ".join(w.decode("utf-8", "replace") for w in part))
            cut = np.flatnonzero(ids == self.bar)
            raw, starts, ends = ids.tobytes(), [0, *(4 * cut + 4).tolist()], [*(4 * cut).tolist(), 4 * len(ids)]
            self.update(zip(part, (raw[s:e] for s, e in zip(starts, ends, strict=True)), strict=True))

    def __missing__(self, word: bytes) -> bytes:
        raw = self._ids(word.decode("utf-8", "replace")).tobytes()
        if len(word) <= CACHED_BYTES:
            self[word] = raw
        return raw


@lru_cache(maxsize=1)
def encoder_of(path: str) -> Encoder:
    """A worker's tables outlive its tasks."""
    return Encoder(path)


def cut_pieces(docs: DataFrame, tokenizer: str, size: int = SIZE) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) for each piece of each document."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(tokenizer)
        end = np.asarray([END_ID], dtype="<u4").tobytes()
        for batch, raw in chunks(batches):
            which, piece, start, length, crc = [], [], [], [], []
            split = [x.split() for x in raw]
            encoder.add(list(chain.from_iterable(split)))
            for i, words in enumerate(split):
                ids = b"".join(map(encoder.__getitem__, words)) + end
                for k, at in enumerate(range(0, len(ids), 4 * size)):
                    part = ids[at : at + 4 * size]
                    which.append(i), piece.append(k), start.append(at // 4), length.append(len(part) // 4), crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(which, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.select("doc_id", "text").mapInArrow(rows, PIECES)


def nnls(a: np.ndarray, b: np.ndarray, rounds: int) -> np.ndarray:
    """min |ax - b| over x >= 0 by active sets: admit the column with the steepest gain, step back to x >= 0."""
    n = a.shape[1]
    x, active = np.zeros(n), np.zeros(n, dtype=bool)
    gain = a.T @ b
    floor = 1e-9 * max(1.0, float(np.abs(gain).max(initial=0.0)))
    for _ in range(rounds):
        gain = a.T @ (b - a @ x)
        gain[active] = -np.inf
        if n == 0 or gain.max() <= floor:
            break
        active[int(gain.argmax())] = True
        while True:
            idx = np.flatnonzero(active)
            s = np.linalg.lstsq(a[:, idx], b, rcond=None)[0]
            if s.min() > 0:
                x[:] = 0
                x[idx] = s
                break
            down = idx[s <= 0]
            step = float((x[down] / np.maximum(x[down] - s[s <= 0], 1e-300)).min())
            x[idx] += step * (s - x[idx])
            active[idx[x[idx] <= 1e-12 * max(1.0, x.max())]] = False
            x[~active] = 0
            if not active.any():
                break
    return x


def fill_patterns(bins: int, parts: int) -> list[tuple[int, ...]]:
    """All ways to fill ``bins`` units with 2 to ``parts`` lengths of whole units, longest first."""
    found = []
    for k in range(2, parts + 1):
        for rest in combinations_with_replacement(range(1, bins // 2 + 1), k - 1):
            if (first := bins - sum(rest)) >= rest[-1]:
                found.append((first, *reversed(rest)))
    return found


def plan(histogram: np.ndarray, size: int = SIZE, unit: int = 16, parts: int = 4, rounds: int = 300) -> list[tuple[tuple[int, ...], int]]:
    """[(lengths, repeats)] that use up ``histogram[length]`` pieces of each length from 1 to ``size``."""
    left = histogram.astype(np.int64).copy()
    left[0] = 0
    made: list[tuple[tuple[int, ...], int]] = []
    if left[size]:
        made.append(((size,), int(left[size])))
        left[size] = 0

    def take(lengths: tuple[int, ...]) -> int:
        need = {x: lengths.count(x) for x in lengths}
        n = min(int(left[x]) // k for x, k in need.items())
        if n:
            made.append((lengths, n))
            for x, k in need.items():
                left[x] -= n * k
        return n

    bins = -(-size // unit)
    of = -(-np.arange(size + 1) // unit)  # a length's class: its units, rounded up
    counts = np.bincount(of, weights=left, minlength=bins + 1)[1 : bins + 1]
    patterns = [p for p in fill_patterns(bins, parts) if all(counts[x - 1] for x in p)]
    if patterns:
        a = np.zeros((bins, len(patterns)))
        for j, p in enumerate(patterns):
            for x in p:
                a[x - 1, j] += 1
        weight = np.sqrt(np.arange(1, bins + 1) / bins)  # short pieces fit in anywhere later
        repeats = np.floor(nnls(a * weight[:, None], counts * weight, rounds) + 1e-6).astype(np.int64)
        by_class = [[x for x in range(1, size + 1) if of[x] == c] for c in range(bins + 1)]
        for j in np.argsort(-repeats, kind="stable"):
            todo = int(repeats[j])
            while todo > 0:  # the longest left of each class, and in the last place of all that fit
                lengths, used = [], {}
                for k, c in enumerate(patterns[j]):
                    room = size - sum(lengths)
                    choice = range(room, by_class[c][0] - 1, -1) if k + 1 == len(patterns[j]) else reversed(by_class[c])
                    x = next((y for y in choice if left[y] > used.get(y, 0)), None)
                    if x is None:
                        break
                    used[x] = used.get(x, 0) + 1
                    lengths.append(x)
                if len(lengths) < len(patterns[j]):
                    break
                n = min(todo, *(int(left[x]) // k for x, k in used.items()))
                made.append((tuple(lengths), n))
                for x, k in used.items():
                    left[x] -= n * k
                todo -= n
    while left.any():  # what is left: longest first, each gap takes the longest that fits
        lengths: list[int] = []
        room, have = size, left.copy()
        while room > 0 and len(fits := np.flatnonzero(have[: room + 1])):
            x = int(fits[-1])
            lengths.append(x)
            have[x] -= 1
            room -= x
        take(tuple(lengths))
    return made


def intervals(made: list[tuple[tuple[int, ...], int]]) -> np.ndarray:
    """Rows (length, lo, first sequence, offset), sorted, for ranks of a length from lo to the next row's lo."""
    used: dict[int, int] = {}
    rows, first = [], 0
    for lengths, n in made:
        at = 0
        for x in lengths:
            rows.append((x, used.get(x, 0), first, at))
            used[x] = used.get(x, 0) + n
            at += x
        first += n
    return np.asarray(sorted(rows), dtype=np.int64).reshape(-1, 4)


def pack(docs: DataFrame, tokenizer: str, size: int = SIZE) -> DataFrame:
    """The pieces of all documents with the sequence and the offset where each one stands."""
    spark = docs.sparkSession
    pieces = saved(cut_pieces(docs, tokenizer, size))
    histogram = np.zeros(size + 1, dtype=np.int64)
    for x, n in pieces.groupBy("length").count().collect():  # at most ``size`` rows
        histogram[x] = n
    table = intervals(plan(histogram, size))
    where = spark.sparkContext.broadcast(table)  # a few thousand rows at most: it depends on ``size`` alone

    salts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)))
    before = W.partitionBy("length").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)
    counts = salted.groupBy("length", "salt").agg(F.count("*").alias("n")).withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
    within = W.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.withColumn("rank", F.row_number().over(within) - 1).join(counts.drop("n"), ["length", "salt"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = where.value
        keys = (t[:, 0] << 44) + t[:, 1]
        for b in batches:
            rank = b.column(5).to_numpy(zero_copy_only=False)
            row = np.searchsorted(keys, (b.column(3).to_numpy(zero_copy_only=False) << 44) + rank, side="right") - 1
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(t[row, 2] + rank - t[row, 1]), pa.array(t[row, 3])], names=[*b.schema.names[:5], "sequence_id", "offset"])

    at = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("base")).cast("long").alias("rank"))
    return at.mapInArrow(place, f"{PIECES}, sequence_id long, offset long")
