"""Alignment of two tokenizers by inverted pair bitmaps.

A text is cut by both tokenizers; byte offsets where tokens of both end cut it into groups, and the two tokens that end
there are a link. For each pair of ids an inverted index says which documents link it: a bitmap of documents a block of
4096 rows of a file, and bitmaps for each bit of what a document's count exceeds one by (its multiplicity planes). A bitmap
is held as a list of 16-bit places or as 512 bytes, whichever is shorter. What tasks send of one block is merged by OR; set
bits, times the planes' weights, give each pair's documents and links. The pairs' counts then go back along the
postings: per block, each pair adds its score to the documents in its bitmaps.

Both tokenizers cut before a space that follows anything but a blank (a fact of the two vocabularies, checked when they are
loaded), so very long texts are worked in pieces between such spaces. A's merges are in the order of its ids, checked as well,
so its ids are taken by the quicker of the two public libraries for byte-level vocabularies; they are the same.

Scale: a pair has at most one row a plane and block, so none has more than a share of 1 / (pairs in a block) of the index,
but for texts that hold few pairs at all; the join with the counts is salted for those. Scores are summed block by block in
64 KiB, streamed from sorted rows. Texts do not move.

Defined cases: null and empty texts, texts with U+2581 and all others that either tokenizer does not give back have no
tokens; doc_id may be null or repeated, each row is a document; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tideline.llm.common import PER_FILE, chunks, numbered, spread_join, written

BLOCK_BITS = 12
BLOCK = 1 << BLOCK_BITS
FULL = BLOCK // 8  #: bytes of a bitmap that is not a list
PIECE = 1 << 19  #: characters after which a long text is cut at the next place that allows it
HELD = 1 << 21  #: links that a task holds before it packs them
#: What may count as blank for one of the two: no place to cut lies behind it.
BLANKS = frozenset("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u180e\u200b\u2028\u2029\u202f\u205f\u3000\ufeff" + "".join(map(chr, range(0x2000, 0x200B))))
LOW_MARK = "▁"
DOCUMENT, POSTING = 1, 0
#: Plane of the bitmap of all documents of a pair; planes 0, 1, ... are the bits of its count there less one.
ANY = -1

ROWS = "kind int, file long, block long, place int, pair long, plane int, bits binary, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
MERGED = "pair long, file long, block long, plane int, bits binary, n long"
RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def byte_values() -> dict[str, int]:
    """The byte behind each character of a byte-level vocabulary: printable ones stand for themselves, the rest follow from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def pieces(text: str, least: int = PIECE) -> list[str]:
    """A space and ``text``, cut before spaces that follow anything but a blank, where that many characters are reached."""
    text = " " + text
    out, start = [], 0
    while len(text) - start > least:
        at = text.find(" ", start + least)
        while at > 0 and text[at - 1] in BLANKS:
            at = text.find(" ", at + 1)
        if at < 0:
            break
        out.append(text[start:at])
        start = at
    out.append(text[start:])
    return out


class Aligner:
    """The two tokenizers, the bytes of their tokens, and how their ids are written in groups."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        import tiktoken
        from public_tokenizers import PATTERN

        with open(path_a, encoding="utf-8") as f:
            described = json.load(f)
        to_byte = byte_values()
        raw = lambda t: bytes(map(to_byte.__getitem__, t))
        special = {x["id"] for x in described["added_tokens"]}
        ranks = {raw(t): i for t, i in described["model"]["vocab"].items() if i not in special}
        merges = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in described["model"]["merges"]]
        if any(ranks[raw(m)] != len(to_byte) + i for i, m in enumerate(merges)):
            raise ValueError("the merges are not in the order of the ids")
        self.a = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        n = self.b.get_piece_size()
        if any(re.search(f"[^{LOW_MARK}]{LOW_MARK}", self.b.id_to_piece(i)) for i in range(n)):
            raise ValueError("a piece holds a space behind something else, so texts cannot be cut there")
        self.low_mark = [self.b.piece_to_id(LOW_MARK)]
        self.bytes_b = [self._piece(i) for i in range(n)]
        self.size_a = np.zeros(max(ranks.values()) + 1, np.int64)
        for x, i in ranks.items():
            self.size_a[i] = len(x)
        self.size_b = np.array([len(x) for x in self.bytes_b])
        self.names = [f"{i}{end}".encode() for ends, k in ((",|", len(self.size_a)), (",;", n)) for i in range(k) for end in ends]

    def _piece(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace(LOW_MARK, " ").encode()

    def ids(self, text: str) -> tuple[list[int], list[int]]:
        """The ids of both, or none, if B does not give the text back (A always does)."""
        a, b = [], []
        if text and LOW_MARK not in text:
            for piece in pieces(text):
                own = self.b.encode(piece[1:]) or self.low_mark  # B puts the space before it
                if b"".join([self.bytes_b[i] for i in own]) != piece.encode():
                    return [], []
                a += self.a.encode_ordinary(piece)
                b += own
        return a, b

    def align(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[str]]:
        """Links of all texts as packed pairs of ids, and per text: tokens of A and of B, links, and the groups' digest."""
        both = [self.ids(x) for x in texts]
        n_a, n_b = (np.array([len(x[k]) for x in both], np.int64) for k in (0, 1))
        a, b = (np.fromiter(chain.from_iterable(x[k] for x in both), np.int64) for k in (0, 1))
        end_a, end_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])  # of all texts as one, as both give all of it back
        at = np.zeros((2, int(end_a[-1]) + 1 if len(a) else 1), bool)
        at[0, end_a] = at[1, end_b] = True
        hit_a, hit_b = at[1, end_a], at[0, end_b]
        links = (a[hit_a] << 32) | b[hit_b]
        # a token stands behind its own kind, and behind the other kind of the groups before; B behind that of its own, too
        group_a, group_b = np.cumsum(hit_a) - hit_a, np.cumsum(hit_b) - hit_b
        until_a, until_b = np.flatnonzero(hit_a) + 1, np.flatnonzero(hit_b) + 1
        name = np.empty(len(a) + len(b), np.int64)
        name[np.arange(len(a)) + np.r_[0, until_b][group_a]] = 2 * a + hit_a
        name[np.arange(len(b)) + until_a[group_b]] = 2 * (len(self.size_a) + b) + hit_b
        written_names = list(map(self.names.__getitem__, name.tolist()))
        stop = np.cumsum(n_a + n_b).tolist()
        digests = [sha256(b"".join(written_names[s:e])[:-1]).hexdigest() if e > s else "" for s, e in zip([0, *stop], stop, strict=False)]
        hits = np.r_[0, np.cumsum(hit_a)]
        return links, n_a, n_b, np.diff(hits[np.r_[0, np.cumsum(n_a)]]), digests


@lru_cache(maxsize=1)
def aligner_of(path_a: str, path_b: str) -> Aligner:
    """A worker's tables outlive its tasks."""
    return Aligner(path_a, path_b)


def packed(pairs: np.ndarray, at: np.ndarray) -> Iterator[tuple]:
    """(pair, block, plane, bits) of links given one by one as pair and row, plane by plane."""
    if not len(pairs):
        return
    known, number = np.unique(pairs, return_inverse=True)
    low = at.min()
    key, times = np.unique((number << 32) | (at - low), return_counts=True)
    p, row = known[key >> 32], (key & ((1 << 32) - 1)) + low
    yield with_plane(ANY, p, row)
    for k in range(int(times.max() - 1).bit_length()):
        has = ((times - 1) >> k) & 1 == 1
        yield with_plane(k, p[has], row[has])


def with_plane(plane: int, pairs: np.ndarray, rows: np.ndarray) -> tuple:
    pair, block, bits = bitmaps(pairs, rows >> BLOCK_BITS, rows & (BLOCK - 1))
    return pair, block, np.full(len(pair), plane), bits


def bitmaps(*columns: np.ndarray) -> tuple:
    """Rows sorted by their keys and then by place, as one bitmap a key: the keys' columns and the bitmaps."""
    *keys, d = columns
    if not len(d):
        return (*keys, pa.array([], pa.binary()))
    start = np.flatnonzero(np.r_[True, np.logical_or.reduce([k[1:] != k[:-1] for k in keys])])
    size = np.diff(np.r_[start, len(d)])
    raw = d.astype("<u2").tobytes()
    bits = [raw[2 * s : 2 * (s + n)] if 2 * n < FULL else bitmap(d[s : s + n]) for s, n in zip(start.tolist(), size.tolist(), strict=True)]
    return (*[k[start] for k in keys], pa.array(bits, pa.binary()))


def bitmap(places: np.ndarray) -> bytes:
    flags = np.zeros(BLOCK, dtype=np.uint8)
    flags[places] = 1
    return np.packbits(flags, bitorder="little").tobytes()


def places_of(bits: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All places of the bitmaps one after another, and how many each has."""
    whole = [np.flatnonzero(np.unpackbits(np.frombuffer(x, np.uint8), bitorder="little")).astype("<u2").tobytes() if len(x) == FULL else x for x in bits]
    return np.frombuffer(b"".join(whole), dtype="<u2").astype(np.int64), np.fromiter(map(len, whole), np.int64, len(whole)) // 2


def sizes(bits: list[bytes]) -> list[int]:
    return [int.from_bytes(x).bit_count() if len(x) == FULL else len(x) // 2 for x in bits]


def _batch(schema: pa.Schema, rows: int, /, **columns) -> pa.RecordBatch:
    """A batch of so many rows, null in the columns not given."""
    array = lambda v, kind: v if isinstance(v, pa.Array) else pa.array(v, kind)
    return pa.RecordBatch.from_arrays([array(columns[f.name], f.type) if f.name in columns else pa.nulls(rows, f.type) for f in schema], schema=schema)


def _numbers(batch: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    return [batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in names]


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    return pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in ddl.split(", ")])


def _index(path_a: str, path_b: str):
    schema = _arrow(ROWS)

    def postings_of(file: int, held: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for pair, block, plane, bits in packed(*map(np.concatenate, zip(*held, strict=True))):
            yield _batch(schema, len(pair), kind=np.full(len(pair), POSTING), file=np.full(len(pair), file), block=block, pair=pair, plane=plane, bits=bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = aligner_of(path_a, path_b)
        held: dict[int, list] = {}
        n_held = 0
        for batch, raw in chunks(batches):
            links, n_a, n_b, n, digests = known.align([x.decode("utf-8", "replace") for x in raw])
            files, at = _numbers(batch, "file", "at")
            yield _batch(
                schema, len(raw), kind=np.full(len(raw), DOCUMENT), file=files, block=at >> BLOCK_BITS, place=at & (BLOCK - 1), doc_id=batch.column("doc_id"),
                n_a=n_a, n_b=n_b, n_groups=n, n_links=n, groups_sha256=digests,
            )
            of, where = np.repeat(files, n), np.repeat(at, n)
            for file in np.unique(of).tolist():
                held.setdefault(file, []).append((links[of == file], where[of == file]))
            n_held += len(links)
            if n_held > HELD:
                for file, part in held.items():
                    yield from postings_of(file, part)
                held, n_held = {}, 0
        for file, part in held.items():
            yield from postings_of(file, part)

    return run


def indexed(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """One row a document, and one a pair, block and plane for each piece of a block that a task saw; written once."""
    rows = numbered(docs, "row_number_", "doc_id", "text")
    at = F.pmod(F.col("row_number_"), F.lit(PER_FILE).cast("decimal(13,0)"))
    placed = rows.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64((F.col("row_number_") - at).cast("string")).alias("file"), at.cast("long").alias("at"))
    return written(placed.mapInArrow(_index(path_a, path_b), ROWS))


KEYS = ("pair", "file", "block", "plane")


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by their keys: those of one key as one bitmap, by OR; ``n`` is how many bits it has."""
    schema = _arrow(MERGED)

    def out(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        columns, bits = _numbers(rows, *KEYS), rows.column("bits").to_pylist()
        start = np.flatnonzero(np.r_[True, np.logical_or.reduce([c[1:] != c[:-1] for c in columns])])
        several = np.repeat(np.diff(np.r_[start, len(bits)]) > 1, np.diff(np.r_[start, len(bits)]))
        alone, more = np.flatnonzero(~several), np.flatnonzero(several)
        if len(alone):
            one = [bits[i] for i in alone]
            yield _batch(schema, len(one), **{k: c[alone] for k, c in zip(KEYS, columns, strict=True)}, bits=one, n=sizes(one))
        if len(more):
            places, n = places_of([bits[i] for i in more])
            spread = [np.repeat(c[more], n) for c in columns]
            order = np.lexsort((places, *spread[::-1]))
            *found, merged = bitmaps(*[c[order] for c in spread], places[order])
            yield _batch(schema, len(merged), **dict(zip(KEYS, found, strict=True)), bits=merged, n=sizes(merged.to_pylist()))

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows:
            columns = _numbers(batch, *KEYS)
            tail = int(np.logical_and.reduce([c == c[-1] for c in columns]).sum())  # the last key may go on in the next batch
            if tail < batch.num_rows or held and any(held[-1].column(k)[0].as_py() != c[0] for k, c in zip(KEYS, columns, strict=True)):
                yield from out(pa.Table.from_batches([*held, batch.slice(0, batch.num_rows - tail)]))
                held = []
            held.append(batch.slice(batch.num_rows - tail))
    if held:
        yield from out(pa.Table.from_batches(held))


def postings(index: DataFrame) -> DataFrame:
    """The index with one bitmap a pair, block and plane: pair, file, block, plane, bits, n."""
    rows = index.where(F.col("kind") == POSTING).select(*KEYS, "bits")
    return written(rows.repartition("pair", "file", "block").sortWithinPartitions(*KEYS).mapInArrow(_merge, MERGED))


def weight() -> Column:
    """How many links a bit of a row's plane stands for."""
    return F.expr(f"if(plane = {ANY}, 1L, shiftleft(1L, greatest(plane, 0)))")


def pair_counts(merged: DataFrame) -> DataFrame:
    """Per pair: a, b, docs, links, best (whether no other pair of its b has more links), and rows of the index."""
    sums = merged.groupBy("pair").agg(
        F.sum(F.when(F.col("plane") == ANY, F.col("n")).otherwise(0)).alias("docs"), F.sum(F.col("n") * weight()).alias("links"), F.count("*").alias("rows")
    )
    ids = sums.select("pair", F.shiftright("pair", 32).cast("int").alias("a"), F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("b"), "docs", "links", "rows")
    return ids.withColumn("best", F.col("links") == F.max("links").over(W.partitionBy("b")))


def _scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by file, block and kind: the postings of a block are added up, and its documents, which follow, take their sums."""
    schema = _arrow(RESULT)
    at, best, total = None, np.zeros(BLOCK, np.int64), np.zeros(BLOCK, np.int64)
    for batch in batches:
        if not batch.num_rows:
            continue
        files, blocks, kinds = _numbers(batch, "file", "block", "kind")
        cuts = np.flatnonzero(np.r_[True, (files[1:] != files[:-1]) | (blocks[1:] != blocks[:-1]) | (kinds[1:] != kinds[:-1]), True])
        for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if at != (files[s], blocks[s]):
                at = (files[s], blocks[s])
                best[:], total[:] = 0, 0
            part = batch.slice(s, e - s)
            if kinds[s] == POSTING:
                places, n = places_of(part.column("bits").to_pylist())
                for sums, column in ((total, "add_count"), (best, "add_best")):
                    np.add.at(sums, places, np.repeat(_numbers(part, column)[0], n))
            else:
                place = _numbers(part, "place")[0]
                same = {c: part.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")}
                yield _batch(schema, part.num_rows, n_best=best[place], count_sum=total[place], **same)


def align(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    index = indexed(docs, path_a, path_b)
    merged = postings(index)
    counts = written(pair_counts(merged))
    joined = spread_join(merged, counts.select("pair", "links", "best", "rows"), ["pair"], "rows")
    scores = joined.select(F.lit(POSTING).alias("kind"), "file", "block", "bits", (weight() * F.col("links")).alias("add_count"), F.when(F.col("best"), weight()).otherwise(0).alias("add_best"))
    own = index.where(F.col("kind") == DOCUMENT).select("kind", "file", "block", "place", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    rows = scores.unionByName(own, allowMissingColumns=True)
    return rows.repartition("file", "block").sortWithinPartitions("file", "block", "kind").mapInArrow(_scored, RESULT)
