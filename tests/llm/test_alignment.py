"""Alignment of tokenizers against whole texts given to both, link by link."""

from collections import Counter, defaultdict

import numpy as np
import pytest
import brute
from pyspark.sql import functions as F

from tideline.llm import op12_alignment as op12

tokenizers = pytest.importorskip("public_tokenizers")
A, B = tokenizers.path("byte_bpe_50k.json"), tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, file string, block int, pair int, n_a int"
WORDS = " ".join(f"word{i % 977}\n" if i % 31 == 0 else f"word{i % 977}" for i in range(60_000))
TEXTS = [
    None, "", " ", "  ", "a", " a", "a ", "a  ", "a \n", "a\n b", "a\n  b", "a\r b", "x();\r\n y();\r\n", "a  b", "a　 b 　 c", "a\x1c b\x1f c", "a​ b", "\t a \t b", "a\x00 b\x00",
    "low▁mark", "▁", " <|endoftext|> </s><s> <unk>", "ﬁ ﬂ İ ß é é \U0001f600 \U0001f468‍\U0001f469", "1234567 89 0", "don't we'll I'M 'S", "same same same", "same same same", "..... !!!!  ----", "\n\n\n", "a" * 3000, "é" * 500 + " b", WORDS,
]


def plain(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    to_byte = op12.byte_values()
    name = {i: t for t, i in a.get_vocab().items()}
    cut, count = [], Counter()
    for doc_id, text in rows:
        ids_a, ids_b = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        bytes_a = [bytes(to_byte[c] for c in name[i]) for i in ids_a]
        bytes_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i in ids_b for p in [b.id_to_piece(i)]]
        if not text or b"".join(bytes_a) != (" " + text).encode() or b"".join(bytes_b) != (" " + text).encode():
            cut.append((doc_id, [], [], [], []))
            continue
        end_a, end_b = np.cumsum([len(x) for x in bytes_a]).tolist(), np.cumsum([len(x) for x in bytes_b]).tolist()
        both = sorted(set(end_a) & set(end_b))
        of_a, of_b = dict(zip(end_a, ids_a, strict=True)), dict(zip(end_b, ids_b, strict=True))
        links = [(of_a[e], of_b[e]) for e in both]
        groups, at_a, at_b = [], 0, 0
        for e in both:
            i, j = at_a, at_b
            while at_a < len(end_a) and end_a[at_a] <= e:
                at_a += 1
            while at_b < len(end_b) and end_b[at_b] <= e:
                at_b += 1
            groups.append(",".join(map(str, ids_a[i:at_a])) + "|" + ",".join(map(str, ids_b[j:at_b])))
        cut.append((doc_id, ids_a, ids_b, groups, links))
        count.update(links)
    top = defaultdict(int)
    for (_, y), n in count.items():
        top[y] = max(top[y], n)
    return sorted(
        ((d, len(x), len(y), len(g), len(ls), sum(count[p] == top[p[1]] for p in ls), sum(count[p] for p in ls), brute.sha(";".join(g)) if x else "") for d, x, y, g, ls in cut), key=str
    )


def got(df):
    return sorted((tuple(r) for r in op12.align(df, A, B).collect()), key=str)


@pytest.fixture(scope="module")
def rows(spark, sf):
    given = [(r.doc_id + 100, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    return [(i, t) for i, t in enumerate(TEXTS)] + [(None, "no id"), (3, "again"), (3, "again")] + given


def test_equals_whole_texts_tokenized(spark, rows, tmp_path):
    df = spark.createDataFrame([(d, t, "f", 1, 2, 3) for d, t in rows], SCHEMA)
    df.repartition(3).write.parquet(str(tmp_path / "d"))
    want = plain(rows)
    assert got(spark.read.parquet(str(tmp_path / "d"))) == want
    assert got(df.repartition(7)) == want


def test_empty(spark):
    assert got(spark.createDataFrame([], SCHEMA)) == []
    assert got(spark.createDataFrame([(1, None, "", 0, 0, 0)], SCHEMA)) == [(1, 0, 0, 0, 0, 0, 0, "")]


def test_bitmaps_and_planes(spark):
    rng = np.random.default_rng(3)
    pairs, at = rng.integers(0, 4, 40_000) << 32, rng.integers(5000, 5000 + 2 * op12.BLOCK, 40_000)
    count = Counter(zip(pairs.tolist(), at.tolist()))
    seen = Counter()
    for pair, block, plane, bits in op12.packed(pairs, at):
        for p, b, k, x in zip(pair.tolist(), block.tolist(), plane.tolist(), bits.to_pylist(), strict=True):
            assert len(x) <= op12.FULL
            places, n = op12.places_of([x])
            assert n[0] == op12.sizes([x])[0]
            for d in places.tolist():
                seen[p, (b << op12.BLOCK_BITS) + d] += 1 if k == op12.ANY else 1 << k
    assert seen == count


def test_counts_of_documents_and_links(spark):
    df = spark.createDataFrame([(i, "the the" if i % 2 else "the", "", 0, 0, 0) for i in range(9000)], SCHEMA).repartition(6)
    counts = op12.pair_counts(op12.postings(op12.indexed(df, A, B))).collect()
    assert [(r.docs, r.links, r.best) for r in counts] == [(9000, 13500, True)]
    assert {tuple(r)[1:] for r in op12.align(df, A, B).drop("groups_sha256").distinct().collect()} == {(1, 1, 1, 1, 1, 13500), (2, 2, 2, 2, 2, 27000)}
    assert op12.indexed(df, A, B).where(F.col("kind") == op12.DOCUMENT).count() == 9000


def test_texts_cut_in_pieces_have_the_same_tokens():
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    known = op12.Aligner(A, B)
    for text in [t for t in TEXTS if t and op12.LOW_MARK not in t]:
        want = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        for least in (1, 7, 100) if len(text) < 9000 else (5000,):
            parts = op12.pieces(text, least)
            assert "".join(parts) == " " + text and all(p[0] == " " for p in parts)
            assert [i for p in parts for i in known.a.encode_ordinary(p)] == want[0]
            assert [i for p in parts for i in known.b.encode(p[1:]) or known.low_mark] == want[1]
    assert len(op12.pieces(WORDS, 1000)) > 100
