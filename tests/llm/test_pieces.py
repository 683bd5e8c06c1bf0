"""SentencePiece through chunks against the library itself."""

import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from cartloom.llm import pieces
from cartloom.llm.tables import table

FOLDER = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def model():
    return pieces.read_model(PATH)


@pytest.mark.parametrize("size", [1 << 20, 1, 7])
def test_ids_of_chunks_are_those_of_the_text(model, monkeypatch, size):
    monkeypatch.setattr(pieces, "SLICE", size)
    held, draw = pieces.processor(model), random.Random(size)
    for _ in range(5000):
        text = "".join(draw.choice(" ▁ aé\t\n日🙂\x00thein.,12 　ﬁ") for _ in range(draw.randrange(40)))
        chunks = list(pieces.chunks_of(text))
        assert [i for ids in pieces.ids_of(model, chunks) for i in ids] == held.encode(text)


def test_requests_keep_their_chunks():
    import pyarrow as pa

    chunks = ["", "▁a", "▁\x00b", "▁日本", "▁" * 20]
    assert pieces._unpacked_strings(pieces._packed_strings(pa.array(chunks))) == chunks


def _expected(model, rows):
    held = pieces.processor(model)
    return sorted((d or -1, held.encode(t or ""), held.decode(held.encode(t or ""))) for d, t in rows)


def _got(found):
    return sorted((r.row.doc_id or -1, r.ids, r.decoded) for r in found.collect())


@pytest.mark.parametrize("block", [pieces.BLOCK_BYTES, 20_000])
def test_whole_documents(spark, model, monkeypatch, block):
    monkeypatch.setattr(pieces, "BLOCK_BYTES", block)
    documents = table(spark, FOLDER, "documents").select("doc_id", "text")
    assert _got(pieces.encoded(documents, PATH)) == _expected(model, documents.collect())


def test_chunks_beyond_the_kept_ones_are_segmented_again(spark, model, monkeypatch):
    monkeypatch.setattr(pieces, "KEPT", 3)
    documents = spark.createDataFrame([(i, f"one two three {i} four five {i % 3}") for i in range(50)], "doc_id long, text string")
    assert _got(pieces.encoded(documents, PATH)) == _expected(model, documents.collect())


def test_odd_rows(spark, model):
    rows = [(1, None), (2, ""), (3, " "), (None, "null id"), (4, "word " * 300_000), (5, "tie"), (5, "tie"), (6, "x" * 200_000)]
    odd = spark.createDataFrame(rows, "doc_id long, text string").select(
        "*", *[F.lit(1).alias(c) for c in ("row", "rows", "block", "check", "codes", "ids", "decoded", "bucket", "n", "is_row")]
    )
    found = pieces.encoded(odd, PATH)
    assert found.columns == ["row", "ids", "decoded"] and _got(found) == _expected(model, rows)
    assert set(found.schema["row"].dataType.names) >= set(odd.columns) - {"text"}
    assert pieces.encoded(odd.limit(0), PATH).count() == 0
    assert pieces.encoded(odd, PATH, decode=False).columns == ["row", "ids"]


def test_a_second_read_that_differs_stops_the_job():
    import numpy as np
    import pyarrow as pa

    block = pieces.Block(["a b", "c"], 4)
    left = pa.table({"block": [0], "check": [block.check], "rows": [[{"x": 1}, {"x": 2}]], "n": [3],
                     "sizes": [pieces._packed(block.sizes)], "codes": [pieces._packed(block.codes)]})
    empty = pieces._packed(np.zeros(0))
    right = pa.table({"check": [block.check + 1], "bucket": [0], "n": [0], "counts": [empty], "total": [0], "ids": [empty]})
    with pytest.raises(RuntimeError):
        pieces._joined(left, right, None, ["row", "ids"])


def test_models_whose_pieces_cross_markers_are_refused(monkeypatch):
    class Crossing:
        def vocab_size(self):
            return 2

        def id_to_piece(self, i):
            return ["▁a", "a▁b"][i]

    monkeypatch.setattr(pieces, "processor", lambda model: Crossing())
    with pytest.raises(ValueError):
        pieces.read_model(PATH)
