import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cartloom.operators import corpus, gram_index
from cartloom.operators.matching import grams, term_hits
from test_matching import TERMS, TEXTS

ROWS = "id int, body string, note string"


def terms_of(spark, terms):
    return spark.createDataFrame([(t,) for t in terms], "term string")


def rows_of(hits):
    return sorted((r.term, r.id is not None, r.id or 0, tuple(r.found)) for r in hits.collect())


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(1)
    bodies = TEXTS + ["".join(rng.choices("abn %_é", k=rng.randrange(14))) for _ in range(80)] + [None, "long " * 20_000]
    rows = [(i, body, rng.choice([None, "Note", body])) for i, body in enumerate(bodies)]
    rows += [(None, "Banana", None), (None, "Banana", None), (3, "a_b", "again")]
    return spark.createDataFrame(rows, ROWS)


@pytest.mark.parametrize("part_rows", [1, 8, 1 << 14])
@pytest.mark.parametrize("wildcards", [False, True])
def test_rows_are_those_of_the_scan(spark, tmp_path, texts, part_rows, wildcards):
    rng = random.Random(2)
    terms = terms_of(spark, sorted({*TERMS, *("".join(rng.choices("abn%_", k=rng.randrange(1, 6))) for _ in range(40))}) + [None, "note"])
    index = gram_index.build_gram_index(texts, ["id"], ["body", "note"], f"{tmp_path}/index", part_rows)
    want = rows_of(term_hits(terms, texts, ["id"], ["body", "note"], wildcards))
    assert len(want) > 300
    assert rows_of(index.hits(terms, wildcards)) == want
    assert rows_of(index.hits(terms, wildcards, rarest=1)) == want


def test_lists_hold_the_grams_of_every_row(spark, tmp_path, texts):
    rng = random.Random(4)
    odd = [(1000 + i, "".join(rng.choices("aB?é日😀𝒳İ\n\r\u2028\x00", k=rng.randrange(9))), rng.choice([None, "", "😀a"])) for i in range(60)]
    rows = texts.where("id IS NULL OR length(body) < 1000 OR body IS NULL").unionAll(spark.createDataFrame(odd, ROWS))
    index = gram_index.build_gram_index(rows, ["id"], ["body", "note"], f"{tmp_path}/index", 16)
    own = F.array_distinct(F.flatten(F.array(*[F.coalesce(grams(F.lower(c)), F.array().cast("array<string>")) for c in ("body", "note")])))
    want = index.texts().select("part", F.explode(own).alias("gram"), "place").collect()
    lists = index.postings().collect()
    assert sorted((r.part, r.gram, place) for r in lists for place in r.places) == sorted(map(tuple, want))
    assert all(r.n == len(r.places) and r.places == sorted(r.places) for r in lists)


@pytest.mark.parametrize("block_chars", [1, 30, 1 << 20])
def test_a_block_gives_a_row_per_gram_and_not_per_text(monkeypatch, block_chars):
    monkeypatch.setattr(gram_index, "BLOCK_CHARS", block_chars)
    columns = [pa.array([7] * 1000), pa.array(range(1000), pa.int32()), pa.array(["abc"] * 1000)]
    batch = pa.RecordBatch.from_arrays(columns, names=["part", "place", "lowered"])
    rows = [row for found in gram_index._listed(iter([batch])) for row in found.to_pylist()]
    held = {}
    for r in rows:
        held.setdefault((r["part"], r["gram"]), []).extend(r["places"])
    assert held == {(7, gram): [*range(1000)] for gram in ("", "a", "ab", "abc", "b", "bc", "c")}
    assert len(rows) == 7 * -(-1000 // max(1, block_chars // 3))


def test_many_terms_go_without_literals(spark, tmp_path, texts, monkeypatch):
    monkeypatch.setattr(gram_index, "LITERALS", 2)
    index = gram_index.build_gram_index(texts, ["id"], ["body"], f"{tmp_path}/index", 8)
    terms = terms_of(spark, [*TERMS, "bab", "ana", "nab"])
    assert rows_of(index.hits(terms)) == rows_of(term_hits(terms, texts, ["id"], ["body"]))


def test_a_search_opens_lists_of_its_grams_and_parts_with_hits(spark, tmp_path):
    rows = [(i, f"common text number {i}", None) for i in range(4000)] + [(9999, "a zebra", None)]
    index = gram_index.build_gram_index(spark.createDataFrame(rows, ROWS).coalesce(1), ["id"], ["body"], f"{tmp_path}/index", 256)
    hits = index.hits(terms_of(spark, ["zebra"]))
    plan = hits._jdf.queryExecution().executedPlan().toString()
    filters = plan[plan.index("PartitionFilters") :].split("\n")[0]
    assert "part#" in filters and [r.id for r in hits.collect()] == [9999]
    assert index.texts().select("part").distinct().count() == 16
    # what is left after the lists is the row itself, not the part
    assert rows_of(index.hits(terms_of(spark, ["number 3999"])))[0][2] == 3999


def test_a_second_search_reads_no_source(spark, tmp_path):
    rows = [("a.md", f"a.md:{i}", "file", i, i, f"line {i} of words") for i in range(1, 300)]
    schema = "path string, symbol string, kind string, start_line int, end_line int, text string"
    source = str(tmp_path / "chunks")
    spark.createDataFrame(rows, schema).write.parquet(source)
    chunks = spark.read.parquet(source)
    index = gram_index.build_gram_index(chunks, corpus.FILE_ORDER, ["text", "symbol"], f"{tmp_path}/index", 64)
    rule = ((("a.",), 60),)
    for terms in (["line 7"], ["29", "words"], ["nothing of this"], [""]):
        asked = terms_of(spark, terms)
        for got, want in (
            (corpus.grep(asked, index), corpus.grep(asked, chunks)),
            (corpus.rank_chunks(asked, index, prefix_rules=rule), corpus.rank_chunks(asked, chunks, prefix_rules=rule)),
        ):
            assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
            assert source not in got._jdf.queryExecution().analyzed().toString()
            assert not any(source in file for file in got.inputFiles())


def test_empty_tables(spark, tmp_path, texts):
    index = gram_index.build_gram_index(texts.limit(0), ["id"], ["body"], f"{tmp_path}/none")
    assert index.hits(terms_of(spark, ["a"])).count() == 0
    index = gram_index.build_gram_index(texts, ["id"], ["body"], f"{tmp_path}/some")
    assert index.hits(terms_of(spark, [])).count() == 0
    with pytest.raises(ValueError):
        gram_index.build_gram_index(texts, ["id"], ["body"], f"{tmp_path}/bad", 100)
