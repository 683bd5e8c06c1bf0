"""Fingerprints and groups against brute force over all pairs."""

import random
import re

import numpy as np
import xxhash

from cartloom.llm import simhash
from cartloom.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.01"


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def brute_components(fps, radius=2):
    """Smallest id of each component of ``{id: fp}``."""
    ids = sorted(fps)
    a = np.array([fps[i] for i in ids], np.uint64)
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(ids)):
        near = np.flatnonzero(np.bitwise_count(a ^ a[i]) <= radius)
        for j in near.tolist():
            x, y = find(i), find(j)
            root[max(x, y)] = min(x, y)
    return {ids[i]: ids[find(i)] for i in range(len(ids))}


def test_query_against_brute_force(spark):
    rows = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    want = {r.doc_id: brute_fingerprint(r.text) for r in rows}
    roots = brute_components(want)
    got = QUERIES["op9_simhash_near_dedup"](spark, FOLDER).collect()
    assert len(got) == len(rows)
    for r in got:
        assert int(r.fingerprint, 16) == want[r.doc_id] and len(r.fingerprint) == 16
        assert r.component_id == roots[r.doc_id]


def test_near_fingerprints_and_hot_buckets(spark):
    rng = random.Random(5)
    fps = {i: rng.getrandbits(64) for i in range(300)}
    base = rng.getrandbits(64)
    for i in range(300, 700):  # a dense cloud: pairs within two bits, and chains beyond
        fps[i] = base
        for b in rng.sample(range(64), rng.randint(0, 4)):
            fps[i] ^= 1 << b
    for i in range(700, 760):
        fps[i] = fps[i - 700] ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64))
    marked = spark.createDataFrame([(i, x - (1 << 64) if x >> 63 else x) for i, x in fps.items()], "doc_id long, fp long")
    got = marked.join(simhash.grouped(marked), "fp").collect()
    want = brute_components(fps)
    assert {r.doc_id: r.component_id for r in got} == want


def test_odd_rows(spark):
    docs = spark.createDataFrame(
        [(1, None), (2, ""), (3, " \t"), (4, "A b"), (5, "a\nB"), (5, "a b"), (None, "a b"), (7, "x " * 300_000)],
        "doc_id long, text string",
    )
    got = {(r.doc_id, r.component_id) for r in simhash.near_copies(docs).collect()}
    assert {(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (None, 4)} <= got
    assert simhash.near_copies(docs.limit(0)).count() == 0


def test_plans_cover_the_radius():
    sample = np.random.default_rng(1).integers(-(1 << 63), 1 << 63, 500)
    for radius in (2, 4, 6):
        for total in (10, 10**6, 10**10):
            plan = simhash.choose_plan(sample, total, radius)
            assert sum(t + 1 for t in plan.thresholds) == radius + 1
            assert sorted(b for g in plan.groups for b in g) == list(range(64))
