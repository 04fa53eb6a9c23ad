"""Near-duplicate titles within a company."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.functions.shared import stored
from tideline.functions.text import norm_company, norm_title

THRESHOLD = 88.0
FEW = 256  #: titles of a company that are one row
#: Titles of a larger company that a block holds at most, how many characters, and blocks that are made if there are so many titles.
BLOCK, BLOCK_CHARS, BLOCKS = 16384, 1 << 21, 16
#: Counts of a character up to which two titles are compared by it, pairs looked at at once, and characters up to which many pairs are.
COUNTED, CELLS, WIDE = 12, 1 << 23, 512
EPS = 1e-3
FOUND = "company string, a string, b string, ratio double"


def indel_ratio(a: str, b: str) -> float:
    """200 * longest common subsequence / both lengths; the subsequence by bit vectors. Two empty texts are equal."""
    if not a and not b:
        return 100.0
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for c in b:
        u = v & places.get(c, 0)
        v = ((v + u) | (v - u)) & full
    return 200.0 * (len(a) - v.bit_count()) / (len(a) + len(b))


def _counted(texts: list[str], threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Of each text whether it has a character once, twice, ... and what it takes from the bound of ``_may_be_near``."""
    counts = np.zeros((len(texts), 64), np.int32)
    for i, x in enumerate(texts):  # characters beyond 63 kinds are taken together by remainder
        counts[i] = np.bincount(np.frombuffer(x.encode("utf-32-le"), np.uint32) & 63, minlength=64)
    more = np.maximum(counts - COUNTED, 0).sum(1)
    return (counts[:, :, None] > np.arange(COUNTED)).reshape(len(texts), -1), more / 2 - counts.sum(1) * threshold / 200


def _may_be_near(a: list[str], b: list[str], threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of all pairs whose characters allow the threshold, some at a time.

    A common subsequence is no longer than what the two have of each character: the product of what is counted, and half
    of what either has beyond that.
    """
    (x, of_x), (y, of_y) = _counted(a, threshold), _counted(b, threshold)
    both = x.any(0) & y.any(0)
    one = lambda n: np.ones(n, np.float32)
    x = np.column_stack([x[:, both], of_x, one(len(a))]).astype(np.float32)
    y = np.column_stack([y[:, both], one(len(b)), of_y]).astype(np.float32).T.copy()
    step = max(CELLS // max(len(b), 1), 1)
    for low in range(0, len(a), step):
        i, j = np.nonzero(x[low : low + step] @ y >= -EPS)
        yield i + low, j


def _codes(texts: list[str], alphabet: np.ndarray) -> np.ndarray:
    """The characters of texts by their place in the alphabet from 1 on, filled up by 0; texts over ``WIDE`` are left out."""
    sizes = np.array([len(x) if len(x) <= WIDE else 0 for x in texts])
    out = np.zeros((len(texts), max(sizes.max(initial=0), 1)), np.int32)
    out[np.arange(out.shape[1]) < sizes[:, None]] = np.searchsorted(alphabet, _points(x for x in texts if len(x) <= WIDE)) + 1
    return out


def _points(texts: Iterator[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)


def _subsequences(short: np.ndarray, long: np.ndarray, kinds: int) -> np.ndarray:
    """The longest common subsequence of each row of codes with the same row of the other, as ``indel_ratio`` finds it."""
    n, words = len(short), -(-short.shape[1] // 64)
    row, at = np.nonzero(short)
    places = np.zeros((n, kinds + 1, words), np.uint64)
    bit = np.uint64(1) << (at & 63).astype(np.uint64)
    np.bitwise_or.at(places, (row, short[row, at], at >> 6), bit)
    full = np.zeros((n, words), np.uint64)
    np.bitwise_or.at(full, (row, at >> 6), bit)
    v, every = full.copy(), np.arange(n)
    for c in long.T:
        u = v & places[every, c]
        total = v + u
        carry = total[:, 0] < v[:, 0]
        for k in range(1, words):
            plain = total[:, k] < v[:, k]
            total[:, k] += carry
            carry = plain | (carry & (total[:, k] == 0))
        v = (total | (v ^ u)) & full
    return np.bitwise_count(full ^ v).sum(1, dtype=np.int64)


def near_pairs(a: list[str], b: list[str] | None, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place in a, place in b, ratio) of all pairs at or above the threshold; without ``b``, of all pairs in ``a``, i < j."""
    own, b = b is None, a if b is None else b
    alphabet = np.unique(_points(x for t in (a, b) for x in t if len(x) <= WIDE))
    left, right = _codes(a, alphabet), _codes(b, alphabet)
    n, m = np.array([len(x) for x in a], np.int64), np.array([len(x) for x in b], np.int64)
    found = []
    for i, j in _may_be_near(a, b, threshold):
        if own:
            i, j = i[i < j], j[i < j]
        common = np.zeros(len(i), np.int64)
        longer, words = np.maximum(n[i], m[j]), -(-np.minimum(n[i], m[j]) // 64)
        for k in np.flatnonzero(longer > WIDE).tolist():
            common[k] = round(indel_ratio(a[i[k]], b[j[k]]) * (n[i[k]] + m[j[k]]) / 200)
        for w in np.unique(words[(longer <= WIDE) & (words > 0)]).tolist():
            some = np.flatnonzero((longer <= WIDE) & (words == w))
            most = max((1 << 22) // ((len(alphabet) + 1) * w + WIDE), 1)
            for at in range(0, len(some), most):
                s = some[at : at + most]
                first = n[i[s]] <= m[j[s]]
                for turn, (x, y, p, q, long) in ((first, (left, right, i, j, m[j])), (~first, (right, left, j, i, n[i]))):
                    t = s[turn]
                    if len(t):
                        common[t] = _subsequences(x[p[t], : 64 * w], y[q[t], : long[t].max()], len(alphabet))
        both = n[i] + m[j]
        ratio = np.where(both == 0, 100.0, 200.0 * common / np.maximum(both, 1))
        near = ratio >= threshold
        found.append((i[near], j[near], ratio[near]))
    i, j, ratio = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
    return i, j, ratio


def _sorted(titles: list[str]) -> list[str]:
    return [" ".join(sorted(t.split())) for t in titles]


def pairs_within(titles: list[str], threshold: float) -> list[tuple[str, str, float]]:
    """(a, b, ratio) of all pairs of a few titles at or above the threshold, a < b."""
    titles = sorted(titles)
    return [(titles[i], titles[j], r) for i, j, r in zip(*(x.tolist() for x in near_pairs(_sorted(titles), None, threshold)), strict=True)]


def near_titles(postings: DataFrame, threshold: float = THRESHOLD, few: int = FEW) -> DataFrame:
    """(company, a, b, ratio) of distinct titles of a company at or above the threshold, a < b.

    A company of at most ``few`` titles is one row of them, whose pairs are looked through. Those of larger ones are dealt into
    blocks, and a task takes one pair of blocks: all pairs are looked at by a product of what is counted of their characters,
    and the few that may be near by their subsequence. So the work is the square of a company's titles, and a task's is bounded.
    """
    titles = stored(postings.select(norm_company(F.col("company")).alias("company"), norm_title(F.col("title")).alias("title")).distinct(), "titles")
    most = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum(F.length("title")) / BLOCK_CHARS), F.least(F.ceil(F.count("*") / 1024), F.lit(BLOCKS)))
    sizes = titles.groupBy(F.col("company").alias("_company")).agg((F.count("*") <= few).alias("small"), most.cast("int").alias("blocks"))
    own = titles.join(sizes, F.col("company").eqNullSafe(F.col("_company"))).drop("_company")

    def small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for company, some in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found = pairs_within(some, threshold)
                if found:
                    x, y, ratio = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array([company] * len(x), pa.string()), pa.array(x), pa.array(y), pa.array(ratio, pa.float64())], names=["company", "a", "b", "ratio"])

    def of_blocks(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        company, low, high = (k.as_py() for k in key)
        mine = rows["block"].to_numpy() == low
        x = rows["title"].filter(pa.array(mine)).to_pylist()
        y = None if low == high else rows["title"].filter(pa.array(~mine)).to_pylist()
        i, j, ratio = near_pairs(_sorted(x), None if y is None else _sorted(y), threshold) if x and (y is None or y) else ((), (), ())
        pairs = [sorted((x[p], (x if y is None else y)[q])) for p, q in zip(i, j, strict=True)]
        return pa.table({"company": pa.array([company] * len(pairs), pa.string()), "a": pa.array([p for p, _ in pairs], pa.string()), "b": pa.array([q for _, q in pairs], pa.string()), "ratio": pa.array(ratio, pa.float64())})

    groups = own.where("small").groupBy("company").agg(F.collect_list("title").alias("titles"))
    parts = sizes.where("not small").agg(F.sum(F.col("blocks").cast("long") * (F.col("blocks") + 1) / 2)).first()[0] or 1
    dealt = own.where("not small").withColumn("block", F.pmod(F.xxhash64("title"), F.col("blocks").cast("long")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pairs = dealt.select("company", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "title")
    large = pairs.repartition(min(int(parts), 4096), "company", "low", "high").groupBy("company", "low", "high").applyInArrow(of_blocks, FOUND)
    return groups.mapInArrow(small, FOUND).unionByName(large)
