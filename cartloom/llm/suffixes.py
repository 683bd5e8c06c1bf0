"""Suffix-array dedup: bytes in long strings that an earlier document has are removed.

A window is a string of ``SPAN`` bytes inside one document. Windows are removed that also occur
in a document with a smaller id, and with them every byte they cover.

Sorting all suffixes of a corpus would move every text many times over. Equal windows have
equal content, so each is dealt out by its anchor: the smallest hash of the ``GRAM``-byte
strings in it, the first among equal ones. Neighbouring windows share their anchor; such a run
of windows, about fifteen on average, is one entry.

1. Entries are collapsed before their shuffle: of equal runs in a block of texts only those of
   the smallest document go on, and the others are removed on the spot. A passage in a third
   of all documents so sends one entry per block.
2. Entries meet by anchor. Equal runs are settled at once by their smallest document. What is
   left are anchors with different runs, mostly at the ends of copied passages.
3. For these the bytes of the runs are fetched. Windows whose hash is in one document alone have
   no equal elsewhere and stay; the suffixes that begin at the others are sorted by mergesort: two suffixes are compared by finding the length of their common
   extension by binary search over prefix polynomial hashes, then one byte. Neighbours that
   agree on ``SPAN`` bytes are verified byte by byte; where a hash collided, the group is
   sorted by its bytes. Each set of equal windows is settled by its smallest document.
4. Removed windows are gathered per document and cut out of its text.

Runs are told apart by at least 80 bits of hash beside the bucket. Texts travel compressed.
Defined results: null text is empty; documents without id keep everything and remove nothing
elsewhere; rows with one id do not remove from each other; texts shorter than ``SPAN`` bytes
stay; repeated rows each get their row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartloom.llm import words
from cartloom.session import materialize

SPAN, GRAM = 50, 20
#: Bytes of text per bucket of anchors, which bounds what one task holds.
BUCKET_BYTES = 6 << 20
#: More buckets than these are settled eight at a time, as many runs at once as a bucket has.
FEW_BUCKETS, SETTLED_RUNS = 256, 600_000
#: Bytes of text whose windows are looked at together, so few that their arrays stay in a cache.
TEXT_BYTES = 1 << 17
#: Bytes of text whose runs are collapsed together before they are sent.
FLUSH_BYTES = 8 << 20
#: Open runs whose bytes are packed together.
FETCH_RUNS = 200_000
_CHUNK = 1 << 16


def mark(text: Column) -> Column:
    """Tells apart rows of one id that have different texts."""
    return F.hash(F.coalesce(text, F.lit("")))


# ---- packed arrays ---------------------------------------------------------------------


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed value."""
    head = np.array([len(a) for a in arrays], np.int64).tobytes()
    return zstandard.compress(head + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays), 1)


def unpack(blob: bytes, *dtypes: str) -> list[np.ndarray]:
    raw, at, out = zstandard.decompress(blob), 8 * len(dtypes), []
    for size, kind in zip(np.frombuffer(raw, np.int64, len(dtypes)), dtypes, strict=True):
        out.append(np.frombuffer(raw, kind, size, at))
        at += out[-1].nbytes
    return out


RUNS = ("<i8", "<i4", "<u4", "<u4", "<u2", "<u4", "<u4", "u1")  # ids, marks, anchor steps, code low, high, doc, start, n
DROPS = ("<i8", "<i4", "<u4", "<u4", "u1")  # ids, marks, doc, start, n
PARTS = ("<i8", "<i4", "<u4", "u1", "u1", "u1")  # ids, marks, start, n, anchor offset, bytes


def _docs(which: np.ndarray, ids: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Only the documents that are referred to, and the references to them."""
    used, new = np.unique(which, return_inverse=True)
    return ids[used], marks[used], new.astype(np.uint32)


# ---- windows, anchors, runs ------------------------------------------------------------

#: The bits of a rank that hold the place of a string in its window.
_PLACE = np.uint64((1 << (SPAN - GRAM).bit_length()) - 1)


def _ranked(hashes: np.ndarray) -> np.ndarray:
    """What strings are compared by to find the smallest of a window; of equal ones the first is it."""
    return hashes & ~_PLACE


def anchored_runs(data: np.ndarray, starts: np.ndarray, prefix: words.PrefixHashes):
    """First window, number of windows, anchor and text number of every run of windows."""
    n = len(data) - SPAN + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 4
    least, width, reach = _ranked(prefix.every(GRAM)), SPAN - GRAM + 1, 1
    while reach < width:  # least of the first ``reach`` strings of a window, doubling; its low bits are its place there
        shift = min(reach, width - reach)
        later = least[shift:] + np.uint64(shift)
        least = np.minimum(least[:-shift], later, out=later)
        reach += shift
    at = np.arange(len(least), dtype=np.int32) + (least & _PLACE).astype(np.int32)
    ends = np.repeat(starts[1:], np.diff(starts))[:n]
    inside = np.arange(n) + SPAN <= ends
    changed = at[1:n] != at[: n - 1]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | changed
    last[:-1] &= ~inside[1:] | changed
    begin = np.flatnonzero(first)
    count = np.flatnonzero(last) - begin + 1
    return begin, count, at[begin].astype(np.int64), np.searchsorted(starts, begin, "right") - 1


def _grouped(anchor: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order in which equal pairs, and anchors that are equal in 32 bits, are together, and where new pairs begin."""
    # one sort of a number with 32 bits of each; only where it does not tell pairs apart they are sorted in full
    key = (anchor << np.uint64(32)) | (code & np.uint64(0xFFFFFFFF))
    for sort in (lambda: np.argsort(key), lambda: np.lexsort((code, anchor))):
        order = sort()
        a, c = anchor[order], code[order]
        new = np.concatenate([[True], (a[1:] != a[:-1]) | (c[1:] != c[:-1])])
        if not (new[1:] & (key[order[1:]] == key[order[:-1]])).any():
            break
    return order, new


def _collapse(batches, buckets: int):
    """Runs of each block of texts by bucket (kind 0), and what the block itself removes (kind 1)."""

    def flush(parts, ids, marks):
        anchor, code, doc, start, count = (np.concatenate(x) for x in zip(*parts, strict=True))
        ids, marks = np.concatenate(ids), np.concatenate(marks)
        own = ids[doc]
        order, new = _grouped(anchor, code)
        anchor, code, doc, start, count, own = (x[order] for x in (anchor, code, doc, start, count, own))
        gone = own > np.minimum.reduceat(own, np.flatnonzero(new))[np.cumsum(new) - 1]
        rows = []
        if gone.any():
            used_ids, used_marks, which = _docs(doc[gone], ids, marks)
            blob = pack(used_ids, used_marks, which, start[gone].astype(np.uint32), count[gone].astype(np.uint8))
            rows.append((int(order[0]) % buckets, 1, blob))
        left = np.flatnonzero(~gone)
        bucket = (anchor[left] >> np.uint64(32)).astype(np.int64) % buckets
        by = np.argsort(bucket, kind="stable")
        cuts = np.searchsorted(bucket[by], np.arange(buckets + 1))
        for b in np.flatnonzero(np.diff(cuts)).tolist():
            k = left[by[cuts[b] : cuts[b + 1]]]
            low = (anchor[k] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            sort = np.argsort(low, kind="stable")
            k, low = k[sort], low[sort]
            used_ids, used_marks, which = _docs(doc[k], ids, marks)
            rows.append((b, 0, pack(
                used_ids, used_marks, np.diff(low, prepend=np.uint32(0)), (code[k] & np.uint64(0xFFFFFFFF)).astype(np.uint32),
                (code[k] >> np.uint64(48)).astype(np.uint16), which, start[k].astype(np.uint32), count[k].astype(np.uint8),
            )))
        columns = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.binary()), strict=True)]
        return pa.RecordBatch.from_arrays(columns, ["bucket", "kind", "blob"])

    parts, ids, marks, size, n = [], [], [], 0, 0
    for batch in batches:
        texts = batch.column(2)
        for first, last in words.blocks(texts, TEXT_BYTES):
            data, starts = words.flat(texts.slice(first, last - first))
            prefix = words.PrefixHashes(data)
            begin, count, anchor, doc = anchored_runs(data, starts, prefix)
            if len(begin):
                code = prefix.of(begin, begin + count + SPAN - 1) ^ words.mixed((anchor - begin).astype(np.uint64))
                parts.append((prefix.of(anchor, anchor + GRAM), words.mixed(code), doc + n, begin - starts[doc], count))
            ids.append(batch.column(0).slice(first, last - first).to_numpy())
            marks.append(batch.column(1).slice(first, last - first).to_numpy())
            size, n = size + len(data), n + last - first
            if size >= FLUSH_BYTES and parts:
                yield flush(parts, ids, marks)
                parts, ids, marks, size, n = [], [], [], 0, 0
    if parts:
        yield flush(parts, ids, marks)


SETTLED = "doc_id long, mark int, open boolean, start int, n int"


def _rows(ids, marks, is_open, start, count) -> pa.Table:
    return pa.table({
        "doc_id": pa.array(ids, pa.int64()), "mark": pa.array(marks, pa.int32()), "open": pa.array(is_open, pa.bool_()),
        "start": pa.array(start.astype(np.int32)), "n": pa.array(count.astype(np.int32)),
    })


def _settle(table: pa.Table) -> pa.Table:
    """Of one bucket: runs to remove, and runs whose windows have to be compared one by one (open)."""
    out, blobs, total = [], [], 0
    for kind, blob in zip(table["kind"].to_pylist(), table["blob"].to_pylist(), strict=True):
        if kind:
            ids, marks, doc, start, count = unpack(blob, *DROPS)
            out.append(_rows(ids[doc], marks[doc], np.zeros(len(doc), bool), start, count))
        else:
            ids, marks, step, *rest = unpack(blob, *RUNS)
            blobs.append((ids, marks, np.cumsum(step, dtype=np.uint32), *rest))
            total += len(step)
    # runs lie in the order of their anchors, so a range of anchors is a slice of every blob
    ranges = -(-total // SETTLED_RUNS)
    edges = np.linspace(0, 1 << 32, ranges + 1).astype(np.uint64)
    for first, last in zip(edges[:-1], edges[1:], strict=True):
        runs = []
        for ids, marks, anchor, low, high, doc, start, count in blobs:
            k = slice(*np.searchsorted(anchor, (first, last)).tolist())
            code = low[k].astype(np.uint64) | high[k].astype(np.uint64) << np.uint64(32)
            runs.append((anchor[k].astype(np.uint64), code, ids[doc[k]], marks[doc[k]], start[k], count[k]))
        runs = [np.concatenate(x) for x in zip(*runs, strict=True)]
        if len(runs[0]):
            out += _settled(*runs)
    return pa.concat_tables(out)


def _settled(anchor, code, ids, marks, start, count) -> list[pa.Table]:
    order, new = _grouped(anchor, code)
    anchor, code, ids, marks, start, count = (x[order] for x in (anchor, code, ids, marks, start, count))
    new_anchor = np.concatenate([[True], anchor[1:] != anchor[:-1]])
    gone = ids > np.minimum.reduceat(ids, np.flatnonzero(new))[np.cumsum(new) - 1]
    of = np.cumsum(new_anchor) - 1
    several = (np.bincount(of[new]) > 1)[of]
    # runs of one document alone cannot remove anything from each other
    firsts = np.flatnonzero(new_anchor)
    mixed_ids = (np.minimum.reduceat(ids, firsts) < np.maximum.reduceat(ids, firsts))[of]
    return [
        _rows(ids[chosen], marks[chosen], np.full(int(chosen.sum()), is_open), start[chosen], count[chosen])
        for is_open, chosen in ((False, gone), (True, ~gone & several & mixed_ids))
    ]


# ---- suffix sort -----------------------------------------------------------------------


def common_extension(prefix: words.PrefixHashes, a: np.ndarray, b: np.ndarray, most: int = SPAN) -> np.ndarray:
    """Length, up to ``most``, on which the suffixes at ``a`` and ``b`` agree, by binary search on hashes."""
    low, high = np.zeros(len(a), np.int64), np.full(len(a), most)
    whole = prefix.of(a, a + most) == prefix.of(b, b + most)
    low[whole] = most
    while (active := np.flatnonzero(low < high)).size:
        middle = (low[active] + high[active] + 1) // 2
        x, y = a[active], b[active]
        same = prefix.of(x, x + middle) == prefix.of(y, y + middle)
        low[active[same]] = middle[same]
        high[active[~same]] = middle[~same] - 1
    return low


def _before(data, prefix, a: np.ndarray, b: np.ndarray, ties: np.ndarray) -> np.ndarray:
    """Whether the suffix at ``a`` sorts before that at ``b``; equal ones as ``ties`` says."""
    common = common_extension(prefix, a, b)
    end = len(data) - 1
    less = data[np.minimum(a + common, end)] < data[np.minimum(b + common, end)]
    return np.where(common >= SPAN, ties, less)


def suffix_sort(data: np.ndarray, prefix: words.PrefixHashes, at: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Order of the suffixes ``at`` inside their groups, by merging sorted pieces of doubling length.

    All pieces of one length are merged at once: the place of a suffix is its place in its own
    piece plus its rank in the other piece, found by binary search with hash comparisons.
    """
    order = np.argsort(group, kind="stable")
    sizes = np.diff(np.flatnonzero(np.concatenate([[True], group[order][1:] != group[order][:-1], [True]])))
    begin = np.repeat(np.cumsum(sizes) - sizes, sizes)
    size = np.repeat(sizes, sizes)
    local = np.arange(len(order)) - begin
    width = 1
    while (rows := np.flatnonzero(size > width)).size:
        piece = local[rows] // width
        other = piece ^ 1
        low = np.minimum(other * width, size[rows])
        high = np.minimum(low + width, size[rows])
        first, base = low.copy(), begin[rows]
        own, ties = at[order[rows]], piece % 2 == 1  # an equal suffix of the left piece comes first
        while (active := np.flatnonzero(low < high)).size:
            middle = (low[active] + high[active]) // 2
            theirs = at[order[base[active] + middle]]
            ahead = _before(data, prefix, theirs, own[active], ties[active])
            low[active[ahead]] = middle[ahead] + 1
            high[active[~ahead]] = middle[~ahead]
        place = base + (piece // 2) * 2 * width + local[rows] % width + (low - first)
        moved = order.copy()
        moved[place] = order[rows]
        order = moved
        width *= 2
    return order


def equal_windows(data: np.ndarray, prefix: words.PrefixHashes, at: np.ndarray, group: np.ndarray):
    """Order of the windows ``at``, and which of them begin a set of equal ones in it."""
    order = suffix_sort(data, prefix, at, group)
    collided = set()
    if (lost := np.bincount(order, minlength=len(order)) != 1).any():  # comparisons contradicted each other
        collided = set(group[lost].tolist())
        order = np.argsort(group, kind="stable")
    place, key = at[order], group[order]
    new = np.ones(len(order), bool)
    agree = np.flatnonzero(key[1:] == key[:-1])
    same = prefix.of(place[agree], place[agree] + SPAN) == prefix.of(place[agree + 1], place[agree + 1] + SPAN)
    agree = agree[same]
    for k in range(0, len(agree), _CHUNK):
        part = agree[k : k + _CHUNK]
        offsets = np.arange(SPAN)
        differ = (data[place[part][:, None] + offsets] != data[place[part + 1][:, None] + offsets]).any(axis=1)
        collided |= set(key[part[differ]].tolist())
    new[agree + 1] = False
    for g in collided if not lost.any() else set(group.tolist()):
        rows = np.flatnonzero(key == np.uint64(g))
        content = [data[p : p + SPAN].tobytes() for p in place[rows].tolist()]
        sort = sorted(range(len(rows)), key=content.__getitem__)
        order[rows] = order[rows][sort]
        ranked = [content[k] for k in sort]
        new[rows] = [True] + [x != y for x, y in zip(ranked[1:], ranked, strict=False)]
    return order, new


def _anchors(runs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Place and hash of the anchor of each run: the first smallest string of its first window."""
    lengths = np.array([len(run) for run in runs], np.int64)
    begin = np.cumsum(lengths) - lengths
    prefix = words.PrefixHashes(np.frombuffer(b"".join(runs), np.uint8))
    place, hashes = np.zeros(len(runs), np.int64), prefix.of(begin, begin + GRAM)
    for k in range(1, SPAN - GRAM + 1):
        other = prefix.of(begin + k, begin + k + GRAM)
        less = _ranked(other) < _ranked(hashes)
        place[less], hashes[less] = k, other[less]
    return place, hashes


def _fetch(batches, buckets: int):
    """Bytes of the open runs of every text, packed by bucket of their anchor."""

    step = words.BLOCK_BYTES // (2 * SPAN)

    def batch_of(parts):
        ids, marks, start, count = (np.concatenate([part[k] for part in parts]) for k in range(4))
        content = [x for part in parts for x in part[4]]
        offset, hashes = (np.concatenate(x) for x in zip(*(_anchors(content[at : at + step]) for at in range(0, len(content), step)), strict=True))
        bucket = (hashes >> np.uint64(32)).astype(np.int64) % buckets
        order = np.argsort(bucket, kind="stable")
        cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
        rows = []
        for b in np.flatnonzero(np.diff(cuts)).tolist():
            k = order[cuts[b] : cuts[b + 1]]
            own = np.frombuffer(b"".join([content[i] for i in k.tolist()]), np.uint8)
            rows.append((b, pack(ids[k], marks[k], start[k].astype(np.uint32), count[k].astype(np.uint8), offset[k].astype(np.uint8), own)))
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["bucket", "blob"])

    parts, n = [], 0
    for batch in batches:
        for doc_id, own_mark, blob, starts, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            raw = zstandard.decompress(blob)
            start, count = np.array(starts, np.int64), np.array(counts, np.int64)
            # only the bytes of the runs are hashed, many texts at once
            content = [raw[s : s + c + SPAN - 1] for s, c in zip(starts, counts, strict=True)]
            parts.append((np.full(len(start), doc_id), np.full(len(start), own_mark, np.int32), start, count, content))
            n += len(start)
            if n >= FETCH_RUNS:
                yield batch_of(parts)
                parts, n = [], 0
    if parts:
        yield batch_of(parts)


def _of_several(keys: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The numbers of the rows whose key has several ids."""
    if not len(keys):
        return np.zeros(0, np.int64)
    order = np.argsort(keys)
    firsts = np.flatnonzero(np.concatenate([[True], keys[order][1:] != keys[order][:-1]]))
    several = np.minimum.reduceat(ids[order], firsts) < np.maximum.reduceat(ids[order], firsts)
    return np.sort(order[np.repeat(several, np.diff(np.append(firsts, len(keys))))])


def _compare(table: pa.Table) -> pa.Table:
    """Of one bucket of open runs: the windows that a smaller document has."""
    rows = [unpack(blob, *PARTS) for blob in table["blob"].to_pylist()]
    ids, marks, start, count, offset, data = (np.concatenate(x) for x in zip(*rows, strict=True))
    count = count.astype(np.int64)
    lengths = count + SPAN - 1
    begin = np.cumsum(lengths) - lengths
    prefix = words.PrefixHashes(data)
    anchor = prefix.of(begin + offset, begin + offset + GRAM)
    run = np.repeat(np.arange(len(count)), count)
    step = np.arange(len(run)) - np.repeat(np.cumsum(count) - count, count)
    group = words.mixed(anchor[run] + (offset[run].astype(np.int64) - step).astype(np.uint64))
    at, own = begin[run] + step, ids[run]
    # windows whose hash no other document has are equal to none of another document
    held = _of_several(words.mixed(prefix.of(at, at + SPAN) ^ group), own)
    gone = np.zeros(len(run), bool)
    if len(held):
        order, new = equal_windows(data, prefix, at[held], group[held])
        own = own[held][order]
        least = np.minimum.reduceat(own, np.flatnonzero(new))[np.cumsum(new) - 1]
        gone[held[order[own > least]]] = True
    # neighbouring windows of a run become one row
    head = gone.copy()
    head[1:] &= ~(gone[:-1] & (run[1:] == run[:-1]))
    tail = gone.copy()
    tail[:-1] &= ~(gone[1:] & (run[1:] == run[:-1]))
    first, last = np.flatnonzero(head), np.flatnonzero(tail)
    r = run[first]
    return _rows(ids[r], marks[r], np.zeros(len(first), bool), start[r] + step[first], last - first + 1)


# ---- the operator ----------------------------------------------------------------------


def cut(raw: bytes, starts: list[int], counts: list[int]) -> tuple[list[tuple[int, int]], bytes]:
    """The removed byte ranges of a text, joined where they meet, and the bytes that are left."""
    spans: list[list[int]] = []
    for s, e in sorted((s, s + n + SPAN - 1) for s, n in zip(starts, counts, strict=True)):
        if spans and s <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], e)
        else:
            spans.append([s, e])
    edges = [0, *(x for span in spans for x in span), len(raw)]
    return [tuple(x) for x in spans], b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


def _compressed(text: Column) -> Column:
    @F.arrow_udf("binary")
    def compress(texts: pa.Array) -> pa.Array:
        packer = zstandard.ZstdCompressor(level=1)
        return pa.array([packer.compress(t.encode()) for t in texts.to_pylist()], pa.binary())

    return compress(F.coalesce(text, F.lit("")))


def removed_windows(documents: DataFrame) -> DataFrame:
    """(doc_id, mark, starts, counts): runs of windows to remove from each document that loses any."""
    texts = documents.where("doc_id IS NOT NULL").select(
        F.col("doc_id").cast("long").alias("doc_id"), mark(F.col("text")).alias("mark"), F.coalesce("text", F.lit("")).alias("text")
    )
    total = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = max(8, -(-total // BUCKET_BYTES))
    # every block of texts sends a value to every bucket: their number grows with the square of the buckets
    settling = min(buckets, max(FEW_BUCKETS, -(-buckets // 8)))
    runs = texts.mapInArrow(lambda b: _collapse(b, settling), "bucket int, kind int, blob binary")
    settled = materialize(runs.groupBy("bucket").applyInArrow(_settle, SETTLED), "suffix-settled")
    per_doc = [F.collect_list("start").alias("starts"), F.collect_list("n").alias("counts")]
    wanted = settled.where("open").distinct().groupBy("doc_id", "mark").agg(*per_doc)
    held = texts.select("doc_id", "mark", _compressed(F.col("text")).alias("blob"))
    # equal rows hold equal runs, so one of them is enough
    asked = held.join(wanted, ["doc_id", "mark"]).dropDuplicates(["doc_id", "mark"]).select(
        "doc_id", "mark", "blob", "starts", "counts"
    )
    parts = asked.mapInArrow(lambda b: _fetch(b, buckets), "bucket int, blob binary")
    compared = parts.groupBy("bucket").applyInArrow(_compare, SETTLED)
    both = settled.where("NOT open").unionAll(compared).select("doc_id", "mark", "start", "n")
    return both.groupBy("doc_id", "mark").agg(*per_doc)


def deduplicated(documents: DataFrame) -> DataFrame:
    """doc_id, n_bytes, the removed byte ranges ``spans`` and the remaining bytes ``rest`` of every document."""
    gone = materialize(removed_windows(documents), "suffix-removed").select(
        F.col("doc_id").alias("gone_id"), F.col("mark").alias("gone_mark"), "starts", "counts"
    )
    held = documents.select("doc_id", mark(F.col("text")).alias("mark"), _compressed(F.col("text")).alias("blob"))

    @F.arrow_udf("n_bytes long, spans array<struct<begin: long, end: long>>, rest binary")
    def cut_out(blobs: pa.Array, starts: pa.Array, counts: pa.Array) -> pa.Array:
        sizes, spans, rests = [], [], []
        for blob, s, n in zip(blobs.to_pylist(), starts.to_pylist(), counts.to_pylist(), strict=True):
            raw = zstandard.decompress(blob)
            found, rest = cut(raw, s or [], n or [])
            sizes.append(len(raw))
            spans.append([{"begin": a, "end": b} for a, b in found])
            rests.append(rest)
        kind = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
        return pa.StructArray.from_arrays([pa.array(sizes, pa.int64()), pa.array(spans, kind), pa.array(rests, pa.binary())], ["n_bytes", "spans", "rest"])

    same = (F.col("doc_id") == F.col("gone_id")) & (F.col("mark") == F.col("gone_mark"))
    out = held.join(gone, same, "left").select("doc_id", cut_out("blob", "starts", "counts").alias("out"))
    return out.select("doc_id", "out.*")
