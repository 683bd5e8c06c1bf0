"""Collocations against plain counting, and the shards against each other."""

import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cartloom.llm import collocations
from cartloom.llm.tables import table

FOLDER = "/root/testdata/sf0.001"


def _plain(rows, support, longest, k):
    counts, totals = {}, Counter()
    for lang, text in rows:
        own = counts.setdefault(lang or "und", Counter())
        lowered = re.sub("[A-Z]+", lambda m: m.group().lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            found = re.findall(r"[^\x20\x09]+", piece)
            totals[lang or "und"] += len(found)
            own.update(tuple(found[i : i + m]) for m in range(1, longest + 1) for i in range(len(found) - m + 1))
    out = []
    for lang, own in counts.items():
        often = {p: a for p, a in own.items() if a >= support}
        best = []
        for p, a in often.items():
            if len(p) == 1 or any(
                len(q) > len(p) and b >= a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in often.items()
            ):
                continue
            n = totals[lang]
            score, _, left, right = min((1000 * a * n // (own[p[:i]] * own[p[i:]]), i, own[p[:i]], own[p[i:]]) for i in range(1, len(p)))
            best.append((-score, -a, " ".join(p).encode(), left, right, n))
        for rank, (score, a, p, left, right, n) in enumerate(sorted(best)[:k], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n, -score))
    return sorted(out)


def _rows(found):
    return sorted(tuple(r) for r in found.collect())


@pytest.mark.parametrize("block_bytes", [200, 5_000, 1 << 20])
def test_any_blocks_give_the_plain_counts(spark, block_bytes):
    draw = random.Random(3)
    vocabulary = ["the", "The", "of", "new", "york", "é", "日本", "don't", "a,b", "x.\n", "\t"]
    rows = [
        (draw.choice(["en", "de", None, "und"]), " ".join(draw.choice(vocabulary) for _ in range(draw.randrange(60))))
        for _ in range(300)
    ]
    documents = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    found = collocations.collocations(documents, k=40, support=7, block_bytes=block_bytes)
    assert _rows(found) == _plain(rows, 7, 5, 40)


def test_bits_that_many_phrases_share_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(collocations, "WORD_BITS", 64)
    monkeypatch.setattr(collocations, "PHRASE_BITS", 64)
    rows = [("en", f"one two three four five six {i % 7} seven") for i in range(60)]
    documents = spark.createDataFrame(rows, "lang string, text string")
    assert _rows(collocations.collocations(documents, support=5)) == _plain(rows, 5, 5, 2000)


@pytest.mark.parametrize("shards", [1, 2, 8])
def test_the_union_of_locally_frequent_pairs_loses_none(spark, monkeypatch, shards):
    monkeypatch.setattr(collocations, "SHARDS", shards)
    texts = table(spark, FOLDER, "documents").select("lang", "text").repartition(16)
    bits = np.full(collocations.WORD_BITS // 8, 255, np.uint8)
    mined = {r.hash for r in collocations.mine(texts, 50, 2, 20_000, bits).collect()}
    often = collocations.frequent_phrases(texts, 50, 2)[0].where("phrase LIKE '% %'").toArrow()
    wanted = collocations._phrase_hashes(often.column("lang").combine_chunks(), often.column("phrase").combine_chunks())
    assert set(wanted.view(np.int64).tolist()) <= mined and 0 < len(wanted) <= len(mined)
    # one shard has the full support
    assert shards > 1 or len(mined) == len(wanted)


def test_hashes_of_a_block_are_those_of_a_table():
    block = collocations.Block(pa.array(["a bb. Ccc  a\tbb", None, "é a bb"]), pa.array(["en", "en", None]))
    bits = np.full(collocations.WORD_BITS // 8, 255, np.uint8)
    seen = {}

    def keep(n, counts, hashes):
        seen[n] = hashes
        return counts > 0

    for n, at, _ in collocations._levels(block, bits, 3, keep):
        langs = block.langs.take(pa.array(block.lang[at]))
        assert (collocations._phrase_hashes(langs, block.texts(at, n)) == seen[n]).all()
    assert sorted(zip(block.texts(block.first, 1).to_pylist(), block.count.tolist(), strict=True)) == [
        ("a", 1), ("a", 2), ("bb", 1), ("bb", 2), ("ccc", 1), ("é", 1)
    ]


def test_a_block_of_the_default_size_needs_little_memory():
    drawn = [f"w{i}" for i in np.random.default_rng(1).integers(0, 3000, 200_000)]
    texts = [" ".join(drawn[i : i + 1000]) for i in range(0, len(drawn), 1000)]
    texts *= collocations.BLOCK_BYTES // sum(map(len, texts)) + 1
    batch = pa.RecordBatch.from_arrays([pa.array(["en"] * len(texts)), pa.array(texts)], names=["lang", "text"])
    bits = np.full(collocations.WORD_BITS // 8, 255, np.uint8)
    tracemalloc.start()
    try:
        block = next(collocations._blocks(iter([batch]), collocations.BLOCK_BYTES))
        sizes = [n for n, _, _ in collocations._levels(block, bits, 5, lambda n, counts, hashes: counts > 0)]
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert sizes == [2, 3, 4, 5] and peak < 90 << 20


def test_large_counts_are_exact(spark):
    big = 3_000_000_000_007
    frequent = spark.createDataFrame([("en", "a", big), ("en", "b", big + 2), ("en", "a b", big - 4)], "lang string, phrase string, n long")
    totals = spark.createDataFrame([("en", 3 * big)], "lang string, total long")
    row = collocations.scored(frequent, totals).first()
    assert row.score == 1000 * (big - 4) * 3 * big // (big * (big + 2))


def test_odd_rows(spark):
    rows = [("en", None), (None, ""), ("en", " \t\n.,"), ("en", "word " * 200_000), (None, "w" * 100_000), ("de", "tie break"), ("de", "tie break")]
    odd = spark.createDataFrame(rows, "lang string, text string").select(
        "*", *[F.lit(1).alias(c) for c in ("phrase", "n", "words", "rank", "total", "first", "longer")]
    )
    assert _rows(collocations.collocations(odd, support=2)) == _plain(rows, 2, 5, 2000)
    assert collocations.collocations(odd.limit(0)).count() == 0
