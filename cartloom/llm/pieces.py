"""SentencePiece encoding and decoding through a table of distinct chunks.

Where no piece of a model has a white-space marker behind another character, no merge crosses
the place before a marker, so a text's ids are those of its chunks, one after another. A chunk
is a run of markers and the characters up to the next marker.

Texts become blocks of about ``BLOCK_BYTES``, more only where one text alone is longer, and each
block finds its distinct chunks. These are dealt by hash, so that all requests for a chunk meet
in one task, where it is segmented once. The ids go back to the blocks by chunk, and to the
texts by position. A chunk is sent once per block however often it occurs, in lists of a block
and a bucket, and a task keeps at most ``KEPT`` chunks in memory: a chunk that it meets again after
that many others is segmented again.

The documents are read twice, once for the chunks and once for their positions, which costs less
than to store the positions. Both reads must deal the rows alike, as reads of a written table do;
a checksum of each block stops the job where they do not.

Defined results: null and empty texts have no ids and decode to an empty text; rows are kept
as they come, repeated ones and those without an id too, with all their columns in ``row``; an
empty table gives an empty result. A literal marker in a text is a marker, as for the library.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartloom.llm import words

MARK = "▁"
BLOCK_BYTES = 8 << 20
#: Chunks are dealt to as many tasks as the documents are read by, but to no fewer and no more than these.
BUCKETS, MOST_BUCKETS = 64, 4096
KEPT = 1_000_000
#: Characters of a text that are cut into chunks at once, up to the next marker.
SLICE = 1 << 20
CHUNK = re.compile(f"{MARK}+[^{MARK}]*")
_PROBES = (" a  b ", "ﬁ ① Å\tx\n y", f"{MARK}a{MARK}")


@lru_cache(maxsize=2)
def processor(model: bytes) -> sentencepiece.SentencePieceProcessor:
    return sentencepiece.SentencePieceProcessor(model_proto=model)


def read_model(path: str) -> bytes:
    """The model at ``path``, if chunks can be segmented on their own."""
    with open(path, "rb") as file:
        model = file.read()
    held = processor(model)
    pieces = [held.id_to_piece(i) for i in range(held.vocab_size())]
    if any(MARK in piece.lstrip(MARK) for piece in pieces):
        raise ValueError("pieces of this model go across white-space markers")
    if held.piece_to_id(MARK) == held.unk_id():
        raise ValueError("this model has no piece for a single marker")
    for text in _PROBES:
        if held.normalize(text) != MARK + text.replace(" ", MARK):
            raise ValueError("this model changes texts before it segments them")
    return model


def chunks_of(text: str) -> Iterator[str]:
    """The chunks of a text in order."""
    first = 0
    while first < len(text):
        last = first + SLICE
        while last < len(text) and (text[last] not in (" ", MARK) or text[last - 1] in (" ", MARK)):
            last += 1
        part = text[first:last].replace(" ", MARK)
        yield from CHUNK.findall(part if first else MARK + part)
        first = last


def ids_of(model: bytes, chunks: list[str]) -> list[list[int]]:
    """The ids of every chunk; the library itself puts a marker before what it is given."""
    held = processor(model)
    alone = [held.piece_to_id(MARK)]
    found = held.encode([chunk[1:] for chunk in chunks], num_threads=1)
    return [alone if chunk == MARK else ids for chunk, ids in zip(chunks, found, strict=True)]


def _packed(numbers: np.ndarray) -> bytes:
    return pa.compress(numbers.astype(np.int32).tobytes(), codec="zstd", asbytes=True)


def _unpacked(blob: bytes, size: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(blob, 4 * size, codec="zstd", asbytes=True), np.int32)


class Block:
    """The distinct chunks of some texts by bucket, and the texts as numbers of chunks."""

    def __init__(self, texts: list[str | None], buckets: int) -> None:
        found: dict[str, int] = {}
        parts = [
            np.fromiter((found.setdefault(chunk, len(found)) for chunk in chunks_of(text or "")), np.int32) for text in texts
        ]
        bucket = np.fromiter((crc32(chunk.encode()) % buckets for chunk in found), np.int64)
        order = np.argsort(bucket, kind="stable")
        number = np.empty(len(order), np.int32)
        number[order] = np.arange(len(order), dtype=np.int32)
        held = list(found)
        self.chunks = [held[i] for i in order.tolist()]
        self.bounds = np.searchsorted(bucket[order], np.arange(buckets + 1))
        self.codes = number[np.concatenate(parts)]
        self.sizes = np.array([len(part) for part in parts])
        digest = hashlib.blake2b("".join(self.chunks).encode(), digest_size=8).digest()
        self.check = int.from_bytes(digest, "little", signed=True)


def _blocks(batches: Iterator[pa.RecordBatch], text: int, buckets: int) -> Iterator[tuple[int, pa.RecordBatch, Block]]:
    """Number, rows and content of every block of a partition."""
    number = TaskContext.get().partitionId() << 33
    for batch in batches:
        for first, last in words.blocks(batch.column(text), BLOCK_BYTES):
            rows = batch.slice(first, last - first)
            yield number, rows, Block(rows.column(text).to_pylist(), buckets)
            number += 1


def _requests(documents: DataFrame, text: str, buckets: int) -> DataFrame:
    """(block, bucket, chunks): the distinct chunks of every block, a list per bucket."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, _, block in _blocks(batches, 0, buckets):
            wanted = np.flatnonzero(np.diff(block.bounds))
            if len(wanted):
                bounds = pa.array(np.append(block.bounds[wanted], len(block.chunks)), pa.int32())
                lists = pa.ListArray.from_arrays(bounds, pa.array(block.chunks, pa.string()))
                packed = [_packed_strings(lists[i].values) for i in range(len(wanted))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number] * len(wanted), pa.int64()), pa.array([block.check] * len(wanted), pa.int64()),
                     pa.array(wanted, pa.int32()), pa.array(packed, pa.binary())],
                    names=["block", "check", "bucket", "chunks"],
                )

    return documents.select(text).mapInArrow(ask, "block long, check long, bucket int, chunks binary")


def _packed_strings(chunks: pa.Array) -> bytes:
    """Texts without a zero byte between them would run together, so each is written with its size."""
    sizes = pc.binary_length(chunks).to_numpy().astype(np.int32)
    joined = "".join(chunks.to_pylist()).encode()
    head = np.array([len(sizes), len(joined)], np.int32).tobytes()
    return head + pa.compress(sizes.tobytes() + joined, codec="zstd", asbytes=True)


def _unpacked_strings(blob: bytes) -> list[str]:
    n, size = np.frombuffer(blob[:8], np.int32).tolist()
    raw = pa.decompress(blob[8:], 4 * n + size, codec="zstd", asbytes=True)
    ends = np.cumsum(np.frombuffer(raw[: 4 * n], np.int32)).tolist()
    joined = raw[4 * n :]
    return [joined[a:b].decode() for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def _segmented(requests: DataFrame, model: bytes, buckets: int) -> DataFrame:
    """(block, check, bucket, n, counts, total, ids): the ids of the chunks of every request."""

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, np.ndarray] = {}
        for batch in batches:
            for at in range(batch.num_rows):
                chunks = _unpacked_strings(batch.column(3)[at].as_py())
                if len(known) > KEPT:
                    known = {}
                new = [chunk for chunk in chunks if chunk not in known]
                known.update(zip(new, [np.array(ids, np.int32) for ids in ids_of(model, new)], strict=True))
                ids = [known[chunk] for chunk in chunks]
                counts, flat = np.array([len(own) for own in ids]), np.concatenate(ids)
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(i).slice(at, 1) for i in range(3)],
                     pa.array([len(counts)], pa.int32()), pa.array([_packed(counts)], pa.binary()),
                     pa.array([len(flat)], pa.int32()), pa.array([_packed(flat)], pa.binary())],
                    names=["block", "check", "bucket", "n", "counts", "total", "ids"],
                )

    schema = "block long, check long, bucket int, n int, counts binary, total int, ids binary"
    return requests.repartition(buckets, "bucket").mapInArrow(answer, schema)


def _positions(documents: DataFrame, text: str, buckets: int) -> DataFrame:
    """(block, check, rows, n, sizes, codes): the rows of every block, with their texts as chunk numbers."""
    others = [F.col(c) for c in documents.columns if c != text] or [F.lit(True).alias("is_row")]
    own = documents.select(F.struct(*others).alias("row"), F.col(text).alias("text"))
    schema = T.StructType([
        T.StructField("block", T.LongType()),
        T.StructField("check", T.LongType()),
        T.StructField("rows", T.ArrayType(own.schema["row"].dataType)),
        T.StructField("n", T.IntegerType()),
        T.StructField("sizes", T.BinaryType()),
        T.StructField("codes", T.BinaryType()),
    ])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, rows, block in _blocks(batches, 1, buckets):
            held = pa.ListArray.from_arrays(pa.array([0, rows.num_rows], pa.int32()), rows.column(0))
            yield pa.RecordBatch.from_arrays(
                [pa.array([number], pa.int64()), pa.array([block.check], pa.int64()), held,
                 pa.array([len(block.codes)], pa.int32()), pa.array([_packed(block.sizes)], pa.binary()),
                 pa.array([_packed(block.codes)], pa.binary())],
                names=schema.names,
            )

    return own.mapInArrow(cut, schema)


def _joined(block: pa.Table, answers: pa.Table, model: bytes | None, names: list[str]) -> pa.Table:
    """The rows of one block with their ids, and the decoded texts if there is a model."""
    if block.num_rows != 1 or set(answers.column("check").to_pylist()) - set(block.column("check").to_pylist()):
        raise RuntimeError("the documents were dealt differently when they were read again; write them as a table first")
    rows = block.column("rows").combine_chunks().flatten()
    sizes = _unpacked(block.column("sizes")[0].as_py(), len(rows))
    codes = _unpacked(block.column("codes")[0].as_py(), block.column("n")[0].as_py())
    own = answers.sort_by("bucket").to_pylist()
    lengths = np.concatenate([np.zeros(0, np.int32)] + [_unpacked(a["counts"], a["n"]) for a in own]).astype(np.int64)
    ids = np.concatenate([np.zeros(0, np.int32)] + [_unpacked(a["ids"], a["total"]) for a in own])
    starts = np.cumsum(lengths) - lengths
    counts = lengths[codes]
    ends = np.cumsum(counts)
    at = np.repeat(starts[codes] - (ends - counts), counts) + np.arange(counts.sum())
    found = ids[at]
    bounds = np.append(0, ends)[np.append(0, np.cumsum(sizes))]
    columns = [rows, pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(found, pa.int32()))]
    if model is not None:
        held = processor(model)
        texts = (held.decode(found[a:b].tolist()) if b > a else "" for a, b in zip(bounds[:-1], bounds[1:], strict=True))
        columns.append(pa.array(texts, pa.string()))
    return pa.Table.from_arrays(columns, names=names)


def encoded(documents: DataFrame, model_path: str, text: str = "text", decode: bool = True) -> DataFrame:
    """``row`` (all other columns of ``documents``; one column ``is_row`` if there are none), ``ids``, ``decoded`` if asked for."""
    model = read_model(model_path)
    buckets = min(MOST_BUCKETS, max(BUCKETS, 2 * documents.select(text).rdd.getNumPartitions()))
    answers = _segmented(_requests(documents, text, buckets), model, buckets)
    held = _positions(documents, text, buckets)
    fields = [T.StructField("row", held.schema["rows"].dataType.elementType), T.StructField("ids", T.ArrayType(T.IntegerType()))]
    schema = T.StructType(fields + [T.StructField("decoded", T.StringType())] * decode)

    def join_back(left: pa.Table, right: pa.Table) -> pa.Table:
        return _joined(left, right, model if decode else None, schema.names)

    return held.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(join_back, schema)
