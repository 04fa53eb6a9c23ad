"""The pipeline's whole output against plain versions of its stages, on an empty table and on a text of megabytes."""

import random
from collections import Counter, defaultdict

import brute
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tideline.llm import op2_mixing, op8_quality

TOKENIZER = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


def plain_exact(rows):
    """(doc_id, text, source) of the longest, then least, of texts that are equal but for blanks."""
    best = {}
    for d, t, s in rows:
        k = brute.BLANK.sub("", t or "")
        best[k] = min(best.get(k, (1, 0, None, None)), (-len(t or ""), d, t, s), key=lambda x: x[:2])
    return [(d, t, s) for _, d, t, s in best.values()]


def plain_near(rows, width=5, similar=0.8):
    def grams(text):
        words = brute.WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} or {tuple(words)}

    sets = [grams(t) for _, t, _ in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= similar * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    groups = defaultdict(list)
    for i, r in enumerate(rows):
        groups[find(i)].append(r)
    return [min(g, key=lambda r: r[0]) for g in groups.values()]


def test_run_equals_plain_stages(spark, sf):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(TOKENIZER)
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    good = {r.doc_id for r in op8_quality.classify(docs, labels).where("predicted = 1").collect()}
    rows = plain_near(plain_exact([(r.doc_id, r.text, r.source) for r in docs.collect() if r.doc_id in good]))
    kept = spark.createDataFrame(rows, "doc_id long, text string, source string")
    copies = {r.doc_id: r.copies for r in op2_mixing.plan_mixture(kept).collect()}
    want = Counter()
    for d, t, _ in rows:
        ids = brute.ids_of(t, tokenizer)
        for k, s in enumerate(range(0, len(ids), 2048)):
            want[d, k, s, len(ids[s : s + 2048]), brute.crc(ids[s : s + 2048])] += copies[d]
    out = corpus_pipeline.run(spark, sf).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == +want
    held = defaultdict(int)
    for r in out:
        held[r.sequence_id] += r.length
    assert max(held.values()) <= 2048 and len(held) <= sum(held.values()) / 2048 * 1.05 + 2


def test_run_on_an_empty_table(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{sf}/labels.parquet").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_take_a_text_of_megabytes(spark, sf, tmp_path):
    draw = random.Random(2)
    words = ["".join(draw.choices("abcdefghijklmnop", k=draw.randint(2, 9))) for _ in range(5000)]
    long = " ".join(draw.choice(words) for _ in range(400_000))
    texts = [long, long + "  ", long[: len(long) // 20 * 19], "short and unlike it", None]
    path = str(tmp_path / "d")
    spark.createDataFrame([(i, t, "en", "s", 0, 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long, row_ int").coalesce(1).write.parquet(path)
    docs = spark.read.parquet(path)
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    assert ids(corpus_pipeline.exact_dedup(spark, docs, sf)) == [1, 2, 3, 4]
    assert ids(corpus_pipeline.near_dedup(spark, docs, sf)) == [0, 3, 4]
    assert set(ids(corpus_pipeline.quality(spark, docs, sf))) <= {0, 1, 2, 3, 4}
    assert set(ids(corpus_pipeline.mixing(spark, docs, sf))) <= {0, 1, 2, 3, 4}
    packed = corpus_pipeline.packing(spark, docs, sf).groupBy("doc_id").agg(F.max("piece").alias("last"), F.count("*").alias("n")).collect()
    assert len(packed) == 5 and all(r.n == r["last"] + 1 for r in packed) and max(r.n for r in packed) > 100
