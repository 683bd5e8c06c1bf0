"""Removed bytes against a table of all 50-byte windows."""

import hashlib
import random

import numpy as np
import pyarrow as pa

from cartloom.llm import suffixes, words
from cartloom.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.01"


def brute(rows):
    """(doc_id, n_bytes, n_removed, n_spans, sha256) of every row."""
    least = {}
    raws = [(i, (t or "").encode()) for i, t in rows]
    for i, raw in raws:
        if i is not None:
            for s in range(len(raw) - 49):
                w = raw[s : s + 50]
                least[w] = min(least.get(w, i), i)
    out = []
    for i, raw in raws:
        gone = np.zeros(len(raw) + 1, bool)
        for s in range(len(raw) - 49):
            if i is not None and least[raw[s : s + 50]] < i:
                gone[s : s + 50] = True
        rest = bytes(np.frombuffer(raw, np.uint8)[~gone[:-1]])
        spans = int((gone[:-1] & ~np.concatenate([[False], gone[:-2]])[: len(raw)]).sum()) if len(raw) else 0
        out.append((i, len(raw), int(gone.sum()), spans, hashlib.sha256(rest).hexdigest()))
    return sorted(out, key=repr)


def digest(df):
    return sorted(
        ((r.doc_id, r.n_bytes, r.n_bytes - len(r.rest), len(r.spans), hashlib.sha256(r.rest).hexdigest()) for r in df.collect()),
        key=repr,
    )


def test_query_against_all_windows(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    got = [tuple(r) for r in QUERIES["op5_suffix_array_dedup"](spark, FOLDER).collect()]
    assert sorted(got, key=repr) == brute(rows)


def test_odd_rows_and_overlaps(spark):
    rng = random.Random(3)
    base = "".join(rng.choice("abcdé ") for _ in range(400))
    rows = [(1, base), (2, "x" + base[10:90] + "y" + base[60:130]), (2, base[:70]), (None, base), (3, None), (4, ""), (5, "aaa" * 60),
            (6, "a" * 120), (7, base[:49]), (8, base[100:150]), (0, base[300:360]), (9, base), (9, base)]
    rows += [(20 + k, base[k * 7 : k * 7 + 60 + k] + rng.choice("pq")) for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert digest(suffixes.deduplicated(docs)) == brute(rows)
    assert suffixes.deduplicated(docs.limit(0)).count() == 0


def test_suffix_sort_and_collisions(monkeypatch):
    rng = random.Random(8)
    text = "".join(rng.choice("ab") for _ in range(600)) + "ab" * 200
    data = np.frombuffer(text.encode(), np.uint8)
    at = np.array(rng.sample(range(len(data) - 50), 500))
    group = np.array([int(p) % 7 for p in at], np.uint64)
    expected = {}
    for p, g in zip(at.tolist(), group.tolist(), strict=True):
        expected.setdefault((g, text[p : p + 50]), set()).add(p)

    def sets():
        order, new = suffixes.equal_windows(data, words.PrefixHashes(data), at, group)
        found, current = [], None
        for k, fresh in zip(order.tolist(), new.tolist(), strict=True):
            if fresh:
                current = set()
                found.append(current)
            current.add(int(at[k]))
        return sorted(map(sorted, found))

    assert sets() == sorted(map(sorted, expected.values()))
    order = suffixes.suffix_sort(data, words.PrefixHashes(data), at, group)
    ranked = [(int(group[k]), text[at[k] : at[k] + 50]) for k in order]
    assert ranked == sorted(ranked)
    # hashes that collide all the time still give the same sets
    real = words.PrefixHashes.of
    monkeypatch.setattr(words.PrefixHashes, "of", lambda self, a, b: real(self, a, b) & np.uint64(3))
    assert sets() == sorted(map(sorted, expected.values()))


def test_only_windows_of_several_documents_are_sorted(monkeypatch):
    """Runs that differ at one end: windows that one document alone has are not sorted, the result is brute force's."""
    rng = np.random.default_rng(8)
    common = rng.integers(97, 123, 70, dtype=np.uint8).tobytes()
    runs = [(i, common[: 52 + i % 9] + rng.integers(97, 123, 12, dtype=np.uint8).tobytes()) for i in range(12)]
    runs += [(12, runs[3][1]), (13, bytes(reversed(common)))]
    n = [len(raw) - suffixes.SPAN + 1 for _, raw in runs]
    blob = suffixes.pack(
        np.array([i for i, _ in runs], np.int64), np.zeros(len(runs), np.int32), np.zeros(len(runs), np.uint32),
        np.array(n, np.uint8), np.zeros(len(runs), np.uint8), np.frombuffer(b"".join(raw for _, raw in runs), np.uint8),
    )
    sorted_rows, own = [], suffixes.equal_windows
    monkeypatch.setattr(suffixes, "equal_windows", lambda d, p, at, g: sorted_rows.append(len(at)) or own(d, p, at, g))
    found = suffixes._compare(pa.table({"bucket": [0], "blob": [blob]})).to_pylist()
    got = {(r["doc_id"], r["start"] + k) for r in found for k in range(r["n"])}
    windows = {(i, k): raw[k : k + suffixes.SPAN] for (i, raw), m in zip(runs, n) for k in range(m)}
    first = {}
    for (i, k), window in windows.items():
        first[k, window] = min(i, first.get((k, window), i))  # a run's windows are compared at their place after the anchor
    assert got == {(i, k) for (i, k), window in windows.items() if first[k, window] < i}
    assert sum(sorted_rows) < sum(n) / 2


def test_bytes_are_fetched_without_hashing_whole_texts(monkeypatch):
    """Anchors of fetched runs are those by which the runs were dealt, and only the bytes of runs are hashed."""
    rng = np.random.default_rng(4)
    raws = [b"ab" * 50 + rng.integers(97, 100, 4000, dtype=np.uint8).tobytes() for _ in range(6)]
    asked, want = [], {}
    for i, raw in enumerate(raws):
        data = np.frombuffer(raw, np.uint8)
        prefix = words.PrefixHashes(data)
        begin, count, anchor, _ = suffixes.anchored_runs(data, np.array([0, len(raw)]), prefix)
        value = prefix.every(suffixes.GRAM)
        for b, c, a in list(zip(begin.tolist(), count.tolist(), anchor.tolist()))[::40]:
            for w in range(b, b + c):  # every window of a run has its anchor: the first string of the least rank
                ranks = suffixes._ranked(value[w : w + suffixes.SPAN - suffixes.GRAM + 1])
                assert w + int(ranks.argmin()) == a
            want[i, b] = (a - b, int(value[a] >> np.uint64(32)) % 3, raw[b : b + c + suffixes.SPAN - 1])
        mine = [k for k in want if k[0] == i]
        counts = dict(zip(begin.tolist(), count.tolist()))
        asked.append((i, 0, suffixes.zstandard.compress(raw), [b for _, b in mine], [counts[b] for _, b in mine]))
    hashed, own = [], words.PrefixHashes.__init__
    monkeypatch.setattr(words.PrefixHashes, "__init__", lambda self, data: hashed.append(len(data)) or own(self, data))
    batch = pa.RecordBatch.from_pylist([dict(zip(("doc_id", "mark", "blob", "starts", "counts"), row)) for row in asked])
    got = {}
    for found in suffixes._fetch([batch], 3):
        for bucket, blob in zip(*(c.to_pylist() for c in found.columns)):
            ids, marks, start, count, offset, data = suffixes.unpack(blob, *suffixes.PARTS)
            at = 0
            for i, s, c, o in zip(ids.tolist(), start.tolist(), count.tolist(), offset.tolist()):
                got[i, s] = (o, bucket, data[at : at + c + suffixes.SPAN - 1].tobytes())
                at += c + suffixes.SPAN - 1
    assert got == want
    assert sum(hashed) == sum(len(content) for _, _, content in want.values()) < sum(map(len, raws)) / 3


def test_pairs_are_grouped_by_all_of_their_bits():
    anchor = np.array([5, 5 + (1 << 32), 5, 5, 5 + (1 << 32), 9], np.uint64)
    code = np.array([7, 7, 7 + (1 << 32), 7, 7, 7], np.uint64)
    order, new = suffixes._grouped(anchor, code)
    pairs = list(zip(anchor[order].tolist(), code[order].tolist()))
    assert [p for p, first in zip(pairs, new) if first] == sorted(set(pairs)) and new.sum() == 4
    rng = np.random.default_rng(2)
    anchor, code = rng.integers(0, 50, 1000).astype(np.uint64), rng.integers(0, 9, 1000).astype(np.uint64)
    order, new = suffixes._grouped(anchor, code)
    assert sorted(order.tolist()) == list(range(1000)) and new.sum() == len(set(zip(anchor.tolist(), code.tolist())))


def test_a_large_bucket_is_settled_in_ranges_of_anchors(spark, monkeypatch):
    rng = np.random.default_rng(6)
    words_ = [bytes(rng.integers(97, 123, 60, dtype=np.uint8)) for _ in range(30)]
    texts = [b"".join(words_[k] for k in rng.integers(0, 30, 12)) + bytes(rng.integers(97, 123, 200, dtype=np.uint8)) for _ in range(40)]
    batch = pa.RecordBatch.from_arrays(
        [pa.array(range(40), pa.int64()), pa.array(np.zeros(40, np.int32)), pa.array([t.decode() for t in texts])], ["doc_id", "mark", "text"]
    )
    table = pa.Table.from_batches(suffixes._collapse([batch], 1))
    ordered = lambda t: sorted(map(repr, t.to_pylist()))
    want, own, sizes = ordered(suffixes._settle(table)), suffixes._settled, []
    monkeypatch.setattr(suffixes, "SETTLED_RUNS", 100)
    monkeypatch.setattr(suffixes, "_settled", lambda anchor, *rest: sizes.append(len(anchor)) or own(anchor, *rest))
    assert ordered(suffixes._settle(table)) == want and len(want) > 100
    assert len(sizes) > 5 and max(sizes) < 300
