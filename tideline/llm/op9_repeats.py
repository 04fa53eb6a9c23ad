"""Suffix-array dedup of long repeated strings, by external induced sorting.

Every string of ``LENGTH`` bytes holds a k-gram of least hash, its leftmost one; equal strings hold it at the same
offset. These anchors, about one in 185 bytes, are the sampled suffixes, and those whose k-gram comes once are done.
The offsets at which an anchor's strings start are cut into runs. All strings of a run share a core, which a 128-bit
digest names as the reduced string's letter; what they do not share are a few bytes on the right and on the left.
Spark's external sort, which merges spilled runs from disk, brings the suffix tuples (core, right, left) of a core
together in order. A task streams through them, core by core: it takes the common prefixes of neighbours, and induces
from the order at one offset the order at the next by a stable sort on the byte that comes before, carrying the
common-prefix values along (one more than the least between two suffixes with the same byte, else none). A string starts
elsewhere too where a neighbour's common prefix reaches the whole string.

Equal tuples are one, with a count, before they are sorted. A core that still has more than ``MOST`` different tuples
is not sorted in one task: its runs are cut into shorter ones with longer cores, down to single strings, which are equal
or not. Equal whole texts are represented by one of them; each such text of ``LENGTH`` bytes or more is removed whole.

Passages that are shorter in bytes are told beside, not removed: of each document's runs of ``GRAM`` words those of least
hash in each ``RUN`` words are taken, so that any run of ``RUN`` words that two documents share holds one that both take;
``n_shared_runs`` counts a document's runs that another document takes too.

Defined cases: null text is empty; a text below ``LENGTH`` bytes is kept; equal rows repeat each other; an empty table
gives no rows; a null doc_id is kept; other columns are ignored. Rows are told apart by their place in their file; what is no
plain Parquet scan is written once for that.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import ROW, Hashes, chunks, numbered, saved, spread_join, swept, texts

LENGTH = 400
K = 32
RUNS = (25, 5, 1)  #: offsets that share a core, at each level
MOST = 4096
RUN, GRAM = 48, 24  #: words
AT_ONCE = 20_000  #: suffix tuples that a task induces at once (with whole groups, MOST more at the most)
TUPLE = "core binary, left binary, right binary, lo int, hi int"
SURVEY_BYTES = 2 << 20
SIZES, BOUNDS = struct.Struct("<3I"), struct.Struct("<2I")
BYTE_HASH = np.random.default_rng(9).integers(0, 1 << 63, 256, dtype=np.uint64)
ODD = np.uint64(0x9E3779B97F4A7C15)
NO_BYTES = hashlib.sha256(b"").hexdigest()


def anchors(raw: list[bytes], length: int = LENGTH, k: int = K) -> tuple[np.ndarray, ...]:
    """(text, at, lo, hi, key): the string from at - o is anchored at ``at`` for each offset o from lo to hi."""
    sizes = np.array([len(x) for x in raw], dtype=np.int64)
    begin = np.cumsum(sizes) - sizes
    buf = np.frombuffer(b"".join(raw), dtype=np.uint8)
    if not (sizes >= length).any():
        return tuple(np.empty(0, dtype=np.int64) for _ in range(5))
    h = BYTE_HASH[buf]
    step = 1
    while step < k:
        h = (h[:-step] * ODD) ^ (h[step:] + (h[step:] >> np.uint64(29)))
        step *= 2
    h ^= h >> np.uint64(32)
    wide = length - k + 1  # k-grams in a string
    m, step = h, 1
    while 2 * step <= wide:
        m = np.minimum(m[:-step], m[step:])
        step *= 2
    if step < wide:
        m = np.minimum(m[: len(m) - (wide - step)], m[wide - step :])
    owner = np.flatnonzero(sizes >= length)
    first, last = begin[owner], begin[owner] + sizes[owner] - length
    edge = np.zeros(len(m) + 1, dtype=np.int8)
    edge[first] += 1
    edge[last + 1] -= 1
    valid = np.cumsum(edge[:-1], dtype=np.int8) > 0
    fresh = np.zeros(len(m), dtype=bool)
    fresh[1:] = m[1:] < m[:-1]
    turn = fresh.copy()
    turn[1:] |= h[: len(m) - 1] == m[:-1]
    fresh[first] = False
    turn[first] = True
    p = np.flatnonzero(turn & valid)
    at = p + wide - 1
    for i in np.flatnonzero(~fresh[p]):
        at[i] = p[i] + int(h[p[i] : p[i] + wide].argmin())
    mine = np.searchsorted(first, p, side="right") - 1
    stop = np.minimum(np.append(p[1:], len(m)) - 1, last[mine])
    return owner[mine], at - first[mine], at - stop, at - p, h[at].view(np.int64)


def survey(docs: DataFrame, length: int, k: int) -> DataFrame:
    """Per row: row, doc_id, n_bytes, digest, and arrays of its anchors."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw in chunks(batches, most=SURVEY_BYTES):
            text, *values = anchors(raw, length, k)
            ends = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=len(raw)))]).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(v.astype(t))) for v, t in zip(values, (np.int64, np.int32, np.int32, np.int64), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(2), batch.column(0), pa.array([len(x) for x in raw], pa.int64()), pa.array([hashlib.sha256(x).digest() for x in raw], pa.binary()), *lists],
                names=["row", "doc_id", "n_bytes", "digest", "at", "lo", "hi", "key"],
            )

    return docs.mapInArrow(rows, f"row {ROW}, doc_id long, n_bytes long, digest binary, at array<long>, lo array<int>, hi array<int>, key array<long>")


def packed(docs: DataFrame) -> DataFrame:
    """(row, text) with the text compressed, as it is shuffled to where its anchors are."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zip_ = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([zip_.compress(x) for x in texts(batch)], pa.binary())], names=["row", "text"])

    return docs.select("row", "text").mapInArrow(rows, f"row {ROW}, text binary")


def _picked(batch: pa.RecordBatch) -> Iterator[tuple[int, bytes, list[dict]]]:
    unzip = zstandard.ZstdDecompressor()
    for i, (x, found) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
        yield i, unzip.decompress(x), found


def _digest(a: bytes, b: bytes, c: bytes) -> bytes:
    return hashlib.blake2b(SIZES.pack(len(a), len(b), len(c)) + a + b + c, digest_size=16).digest()


def name_of(core: bytes, left: bytes, right: bytes, lo: int, hi: int) -> bytes:
    """The tuple's name. It is worked out where it is asked for, as it would be a third of what a tuple takes on its way."""
    return _digest(core + BOUNDS.pack(lo, hi), left, right)


def _cut(core: bytes, left: bytes, right: bytes, lo: int, hi: int, whole: int, run: int) -> Iterator[tuple[int, tuple]]:
    """(shift, tuple) for each run of offsets: ``left`` backwards from the core, ``right`` from its end on.

    The string at offset o is left[:o] backwards, the core, right[:whole - o]. A last run that reaches beyond ``whole`` has
    as many bytes less on the right; zeros before them, the same for all that share its core, make up for that.
    """
    for first in range(lo - lo % run, hi + 1, run):
        last = first + run - 1
        inner = _digest(core, left[:first], right[: max(0, whole - last)])
        a, b = left[first : min(last, hi)], bytes(max(0, last - whole)) + right[max(0, whole - last) : whole - max(first, lo)]
        yield first, (inner, a, b, max(lo, first) - first, min(hi, last) - first)


def _first_cuts(x: bytes, found: list[dict], length: int, k: int) -> Iterator[tuple[int, tuple]]:
    """(base, tuple) of a text's anchors: the string at offset o starts at base - o."""
    for f in found:
        at, lo, hi = f["at"], f["lo"], f["hi"]
        for first, t in _cut(x[at : at + k], x[at - hi : at][::-1], x[at + k : at + length - lo], lo, hi, length - k, RUNS[0]):
            yield at - first, t


def first_tuples(joined: DataFrame, length: int, k: int) -> DataFrame:
    """The tuples of (row, text, found)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(5)]
            for _, x, found in _picked(batch):
                for _, t in _first_cuts(x, found, length, k):
                    for col, v in zip(out, t, strict=True):
                        col.append(v)
            kinds = [pa.binary()] * 3 + [pa.int32()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=["core", "left", "right", "lo", "hi"])

    return joined.mapInArrow(rows, TUPLE)


def first_members(joined: DataFrame, length: int, k: int) -> DataFrame:
    """(name, row, base) of the tuples of (row, text, found)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, of, bases = [], [], []
            for i, x, found in _picked(batch):
                for base, t in _first_cuts(x, found, length, k):
                    names.append(name_of(*t))
                    of.append(i)
                    bases.append(base)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), batch.column(0).take(pa.array(of, pa.int64())), pa.array(bases, pa.int64())], names=["name", "row", "base"])

    return joined.mapInArrow(rows, "name binary, row long, base long")


def shorter_tuples(tuples: DataFrame, level: int) -> DataFrame:
    """Tuples of the next level, with name, parent (the name of the tuple they come from), shift and n."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(9)]
            for *whole, n in zip(*(batch.column(c).to_pylist() for c in ("core", "left", "right", "lo", "hi", "n")), strict=True):
                name = name_of(*whole)
                for first, t in _cut(*whole, RUNS[level - 1] - 1, RUNS[level]):
                    for col, v in zip(out, (*t, name_of(*t), name, first, n), strict=True):
                        col.append(v)
            kinds = [pa.binary()] * 3 + [pa.int32()] * 2 + [pa.binary(), pa.binary(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=["core", "left", "right", "lo", "hi", "name", "parent", "shift", "n"])

    return tuples.mapInArrow(rows, f"{TUPLE}, name binary, parent binary, shift int, n long")


def _matrix(values: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    size = np.array([len(v) for v in values], dtype=np.int64)
    out = np.frombuffer(b"".join(v.ljust(width, b"\0") for v in values), dtype=np.uint8).reshape(len(values), width)
    return out, size


def induce(key: np.ndarray, right: list[bytes], left: list[bytes], lo: np.ndarray, hi: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(tuple, offset) of the strings that start elsewhere too, for tuples sorted by (key, right)."""
    group = np.cumsum(np.concatenate([[0], key[1:] != key[:-1]]))
    r, size = _matrix(right, length)
    differ = r[1:] != r[:-1]
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), length) if len(key) > 1 else np.empty(0, dtype=np.int64)
    lcp = np.zeros(len(key) + 1, dtype=np.int64)  # of a tuple with the one before; one more at the end
    lcp[1:-1] = np.where(group[1:] == group[:-1], np.minimum(common, np.minimum(size[1:], size[:-1])), 0)
    before, _ = _matrix(left, max(1, int(hi.max(initial=0))))
    del r, differ
    now = np.arange(len(key))
    found: list[tuple[np.ndarray, np.ndarray]] = []
    offset = 0
    while len(now):
        best = np.maximum(lcp[:-1], lcp[1:])
        hit = (best >= length) & (lo[now] <= offset)
        if hit.any():
            found.append((now[hit], np.full(int(hit.sum()), offset)))
        stay = np.flatnonzero((hi[now] > offset) & (best >= length - (hi[now] - offset)))
        if not len(stay):
            break
        lcp = np.append(np.minimum.reduceat(lcp, np.stack([np.concatenate([[0], stay[:-1] + 1]), stay + 1], axis=1).ravel())[::2], 0)
        now = now[stay]
        lcp[0] = 0
        place = group[now] * 256 + before[now, offset]
        order = np.argsort(place, kind="stable")
        a, b = order[:-1], order[1:]
        same = place[a] == place[b]
        grown = np.zeros(len(now) + 1, dtype=np.int64)
        if same.any():
            ends = np.stack([a[same] + 1, b[same] + 1], axis=1).ravel()
            grown[1:-1][same] = 1 + np.minimum.reduceat(lcp, ends)[::2]
        lcp, now, offset = grown, now[order], offset + 1
    if not found:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    return np.concatenate([x for x, _ in found]), np.concatenate([o for _, o in found])


def induced(tuples: DataFrame, length: int) -> DataFrame:
    """(name, first, last): runs of offsets of strings that start elsewhere too, from tuples sorted by core and right."""

    def starts(batch: pa.Table) -> np.ndarray:
        core = np.frombuffer(b"".join(batch.column("core").to_pylist()), dtype="<u8").reshape(-1, 2)
        return np.concatenate([[True], (core[1:] != core[:-1]).any(axis=1)])

    def work(batch: pa.Table) -> pa.RecordBatch:
        lo, hi, n = (batch.column(c).to_numpy().astype(np.int64) for c in ("lo", "hi", "n"))
        who, offset = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        if length:
            who, offset = induce(np.cumsum(starts(batch)), batch.column("right").to_pylist(), batch.column("left").to_pylist(), lo, hi, length)
        single = n[who] == 1
        who, offset = who[single], offset[single]
        order = np.lexsort((offset, who))
        who, offset = who[order], offset[order]
        cut = np.ones(len(who), dtype=bool)
        cut[1:] = (who[1:] != who[:-1]) | (offset[1:] != offset[:-1] + 1)
        first = np.flatnonzero(cut)
        last = np.append(first[1:], len(who))[: len(first)] - 1
        whole = np.flatnonzero(n > 1)  # what is there twice repeats itself
        of = np.concatenate([who[first], whole])
        told, at = np.unique(of, return_inverse=True)
        few = batch.take(pa.array(told))
        names = pa.array([name_of(*t) for t in zip(*(few.column(c).to_pylist() for c in ("core", "left", "right", "lo", "hi")), strict=True)], pa.binary()).take(pa.array(at))
        return pa.RecordBatch.from_arrays([names, pa.array(np.concatenate([offset[first], lo[whole]])), pa.array(np.concatenate([offset[last], hi[whole]]))], names=["name", "first", "last"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            n += batch.num_rows
            if n < AT_ONCE:
                continue
            table = pa.Table.from_batches(held)
            whole = int(np.flatnonzero(starts(table))[-1])  # the last group may go on
            if whole:
                yield work(table.slice(0, whole))
            held = table.slice(whole).to_batches()
            n = table.num_rows - whole
        if n:
            yield work(pa.Table.from_batches(held))

    return tuples.mapInArrow(rows, "name binary, first long, last long")


def without(joined: DataFrame) -> DataFrame:
    """(row, n_removed, n_spans, kept_sha256) of (row, text, runs)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(4)]
            for i, x, runs in _picked(batch):
                kept, at, removed, spans = hashlib.sha256(), 0, 0, 0
                end = None
                for run in sorted((r["start"], r["end"]) for r in runs):
                    if end is not None and run[0] <= end:
                        end = max(end, run[1])
                        continue
                    if end is not None:
                        removed, spans, at = removed + end - start, spans + 1, end
                    start, end = run
                    kept.update(x[at:start])
                if end is not None:
                    removed, spans, at = removed + end - start, spans + 1, end
                kept.update(x[at:])
                for col, v in zip(out, (i, removed, spans, kept.hexdigest()), strict=True):
                    col.append(v)
            of, *counts = [pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(of), *counts], names=["row", "n_removed", "n_spans", "kept_sha256"])

    return joined.mapInArrow(rows, "row long, n_removed long, n_spans long, kept_sha256 string")


def word_runs(text: bytes, hashes: Hashes, run: int = RUN, gram: int = GRAM) -> np.ndarray:
    """The distinct hashes of the runs of ``gram`` words that are least in any ``run`` words."""
    words = text.split()
    if len(words) < run:
        return np.empty(0, dtype=np.uint64)
    part, g = np.fromiter(map(hashes.__getitem__, words), dtype=np.uint64, count=len(words)), None
    step = 1
    while step <= gram:  # runs of 1, 2, 4, ... words; those in the binary form of ``gram`` are joined
        if gram & step:
            g = part if g is None else _joined_runs(part, g, step)
        part = _joined_runs(part, part, step)
        step *= 2
    g = g ^ (g >> np.uint64(32))
    wide, step = run - gram + 1, 1
    while 2 * step <= wide:
        g = np.minimum(g[:-step], g[step:])
        step *= 2
    if step < wide:
        g = np.minimum(g[: len(g) - (wide - step)], g[wide - step :])
    return np.unique(g)


def _joined_runs(left: np.ndarray, right: np.ndarray, step: int) -> np.ndarray:
    """Hashes of the runs of ``left``, each of ``step`` words, with those of ``right`` behind them."""
    n = max(0, len(right) - step)
    return (left[:n] * ODD) ^ (right[step : step + n] + (right[step : step + n] >> np.uint64(29)))


def shared_runs(docs: DataFrame, run: int = RUN, gram: int = GRAM) -> DataFrame:
    """(row, n_shared_runs) of documents that share runs with others.

    Of the documents that have a run in one slice of a batch the first two are passed on by its hash; the others are known to
    share it, so that a run of very many documents is spread.
    """

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for batch, raw in chunks(batches):
            found = [word_runs(x, hashes, run, gram) for x in raw]
            of = np.repeat(np.arange(len(raw)), [len(k) for k in found])
            keys = np.concatenate(found).view(np.int64)
            order = np.argsort(keys, kind="stable")
            keys, of = keys[order], of[order]
            on = np.ones(len(keys), dtype=bool)
            on[2:] = keys[2:] != keys[:-2]
            more = np.bincount(of[~on], minlength=len(raw))
            known = np.flatnonzero(more)
            rows = batch.column(0).take(pa.array(np.concatenate([of[on], known])))
            told = pa.array(np.concatenate([keys[on], np.zeros(len(known), dtype=np.int64)]), mask=np.arange(on.sum() + len(known)) >= on.sum())
            yield pa.RecordBatch.from_arrays([told, rows, pa.array(np.concatenate([np.ones(on.sum(), dtype=np.int64), more[known]]))], names=["key", "row", "n"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, again = None, False  # the last row, and if it repeats its key
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks()
            keys = table.column("key")
            null = keys.is_null().to_numpy()
            k = keys.fill_null(0).to_numpy()
            same = (k[1:] == k[:-1]) & ~null[1:] & ~null[:-1]
            met = null.copy()
            met[0] |= again
            met[1:] |= same
            met[:-1] |= same
            if held is None or len(k) > 1:
                yield from table.slice(0, len(k) - 1).filter(pa.array(met[:-1])).select(["row", "n"]).to_batches()
            held, again = table.slice(len(k) - 1).to_batches()[0], bool(met[-1])
        if held is not None and again:
            yield held.select(["row", "n"])

    told = docs.select("row", "text").mapInArrow(tell, f"key long, row {ROW}, n long")
    dealt = told.repartition(F.coalesce("key", F.xxhash64("row"))).sortWithinPartitions("key")
    return dealt.mapInArrow(meet, f"row {ROW}, n long").groupBy("row").agg(F.sum("n").alias("n_shared_runs"))


def repeated_tuples(tuples: DataFrame, level: int, most: int) -> DataFrame:
    """(name, first, last) of tuples (TUPLE, n): equal ones summed, then sorted by core, or cut shorter."""
    keys = ["core", "left", "right", "lo", "hi"]
    classes = tuples.groupBy(*keys).agg(F.sum("n").alias("n"))
    cores = classes.groupBy("core").agg(F.count("*").alias("tuples"), F.sum("n").alias("strings")).where("strings > 1").select("core", "tuples")
    classes = saved(classes.join(cores, "core"))
    swept(tuples.sparkSession)
    parts = int(tuples.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    few = classes.where(F.col("tuples") <= most).repartition(parts, "core").sortWithinPartitions("core", "right")
    found = induced(few.select(*keys, "n"), RUNS[level] - 1)
    many = classes.where(F.col("tuples") > most).select(*keys, "n")
    if many.isEmpty():
        return found
    shorter = saved(shorter_tuples(many, level + 1))
    below = repeated_tuples(shorter.select(*keys, "n"), level + 1, most)
    back = shorter.select("name", "parent", "shift").join(below, "name")
    return found.unionByName(back.select(F.col("parent").alias("name"), (F.col("shift") + F.col("first")).alias("first"), (F.col("shift") + F.col("last")).alias("last")))


def anchored(docs: DataFrame, known: DataFrame) -> DataFrame:
    """(row, text, found): the texts that hold anchors which come again, compressed, with those anchors; row is ``known``'s id."""
    found = known.where("stands").select("id", F.inline(F.arrays_zip("at", "lo", "hi", "key")))
    shared = saved(found.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    lists = spread_join(found, shared, ["key"], "n").groupBy("id").agg(F.collect_list(F.struct("at", "lo", "hi")).alias("found"))
    lists = lists.join(known.select("id", "row"), "id")
    return packed(docs).join(lists, "row").select(F.col("id").alias("row"), "text", "found")


def repeated_runs(held: DataFrame, length: int = LENGTH, k: int = K, most: int = MOST) -> DataFrame:
    """(row, start, end) of repeated strings in ``held`` (row, text, found); runs of a row may overlap."""
    runs = repeated_tuples(first_tuples(held, length, k).withColumn("n", F.lit(1).cast("long")), 0, most)
    at = first_members(held, length, k).join(runs, "name")
    return at.select("row", (F.col("base") - F.col("last")).alias("start"), (F.col("base") - F.col("first") + length).alias("end"))


def remove_repeats(docs: DataFrame, length: int = LENGTH, k: int = K, most: int = MOST) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_shared_runs."""
    base = numbered(docs, "row", "doc_id", "text")
    # What is saved keeps its partitions and their order, so a short number of its rows holds for all that read it.
    seen = saved(survey(base, length, k)).withColumn("id", F.monotonically_increasing_id())
    same = saved(seen.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("copies")))
    known = spread_join(seen, same, ["digest"], "copies").withColumn("stands", F.col("id") == F.col("first"))
    held = saved(anchored(base, known))
    swept(docs.sparkSession)
    runs = repeated_runs(held, length, k, most).groupBy("row").agg(F.collect_list(F.struct("start", "end")).alias("runs"))
    cut = without(held.select("row", "text").join(runs, "row"))
    whole = (F.col("copies") > 1) & (F.col("n_bytes") >= length)
    at = known.join(shared_runs(base).withColumnRenamed("row", "row_"), F.col("row") == F.col("row_"), "left")
    at = at.select(F.col("id").alias("row"), "doc_id", "n_bytes", "digest", "copies", "n_shared_runs").join(cut, "row", "left")
    return at.select(
        "doc_id",
        "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(whole, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(whole, F.lit(NO_BYTES)).otherwise(F.coalesce("kept_sha256", F.lower(F.hex("digest")))).alias("kept_sha256"),
        F.coalesce("n_shared_runs", F.lit(0)).alias("n_shared_runs"),
    )
