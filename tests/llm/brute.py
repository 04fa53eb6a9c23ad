"""Plain versions of the operators' contracts, over lists of rows."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

BLANK = re.compile(r"[\x20\x09-\x0D]")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def secrets(text):
    text = text or ""
    found = [("assign", m.start(), m.end()) for m in re.finditer(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 8]
    found += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    kinds = ["assign", "access", "hex"]
    n = [sum(k == kind for k, _, _ in found) for kind in kinds]
    found.sort(key=lambda x: (x[1], kinds.index(x[0])))
    return (*n, sha(",".join(f"{k}:{s}:{e}" for k, s, e in found)), found)


def exact(rows):
    """rows of (doc_id, text) -> {(doc_id, text): (keep_id, size, sha)}"""
    groups = defaultdict(list)
    for d, t in rows:
        groups[BLANK.sub("", t or "")].append((-len(t or ""), d is None, d or 0, d))
    return {plain: (min(g)[3], len(g), sha(plain)) for plain, g in groups.items()}


def fingerprint(text):
    import xxhash

    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(fps):
    """[(doc_id, fp)] -> {fp: least doc_id}"""
    distinct = sorted({f for _, f in fps})
    parent = {f: f for f in distinct}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if (a ^ b).bit_count() <= 2:
                parent[root(a)] = root(b)
    least = {}
    for d, f in fps:
        r = root(f)
        if d is not None:
            least[r] = min(d, least.get(r, d))
    return {f: least.get(root(f)) for f in distinct}


def repeats(rows, length):
    """[text] -> [(n_bytes, n_removed, n_spans, sha)]"""
    raw = [(t or "").encode() for t in rows]
    seen = Counter(x[i : i + length] for x in raw for i in range(len(x) - length + 1))
    out = []
    for x in raw:
        gone = bytearray(len(x))
        for i in range(len(x) - length + 1):
            if seen[x[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(gone[i] and not (i and gone[i - 1]) for i in range(len(x)))
        out.append((len(x), sum(gone), spans, sha(bytes(b for b, g in zip(x, gone) if not g))))
    return out


def rules(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n")]
    seen, dup = set(), 0
    for x in lines:
        if WORD.search(x) and x in seen:
            dup += 1
        seen.add(x)
    grams = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    hit = set()
    for i in range(len(words) - 4):
        if grams[tuple(words[i : i + 5])] > 1:
            hit.update(range(i, i + 5))
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(hit), n < 10 or 100 * len(hit) > 20 * n


def ids_of(text, tokenizer):
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [0]


def crc(ids):
    return zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))
