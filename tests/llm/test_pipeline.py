"""Every stage of the pipeline against SQL or brute force on what the stage before kept."""

import re
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cartloom.llm import simhash
from cartloom.llm.oracles import OP1, OP10
from cartloom.session import materialize

FOLDER = "/root/testdata/sf0.01"
SPACE = " \t\n\x0b\x0c\r"


@pytest.fixture(scope="module")
def kept(spark):
    """Rows of documents and of each stage's result."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    out = [docs.collect()]
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, FOLDER), "test-stage")
        out.append(docs.collect())
    return out


def sql(rows, text):
    """DuckDB SQL over ``rows`` as the documents."""
    con = duckdb.connect()
    con.execute(f"CREATE VIEW labels AS SELECT * FROM '{FOLDER}/labels.parquet'")
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", [(r.doc_id, r.text, r.source) for r in rows])
    found = con.execute(text)
    names = [c[0] for c in found.description]
    return [dict(zip(names, row, strict=True)) for row in found.fetchall()]


def survivors(rows):
    """Ids that stay when the fingerprints of all pairs are compared, by union and find."""
    prints = np.array([simhash._fingerprint((r.text or "").encode(), 3, 42) for r in rows], np.int64)
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in np.flatnonzero(np.bitwise_count((prints[i] ^ prints[:i]).view(np.uint64)) <= 2):
            a, b = sorted((find(i), find(int(j))))
            parent[b] = a
    least = {}
    for i, r in enumerate(rows):
        least[find(i)] = min(r.doc_id, least.get(find(i), r.doc_id))
    return sorted(least.values())


def test_names_and_columns(spark, kept):
    assert [len(s) for s in corpus_pipeline.STAGES] == [2] * 5 and corpus_pipeline.ORACLE_SQL is None
    columns = spark.read.parquet(f"{FOLDER}/documents.parquet").columns
    assert all(list(rows[0].asDict()) == columns for rows in kept[:5])
    assert list(kept[5][0].asDict()) == [*columns, "copy"]


def test_quality_keeps_what_the_sql_keeps(kept):
    want = {r["doc_id"] for r in sql(kept[0], OP1) if r["kept"]}
    assert {r.doc_id for r in kept[1]} == want and len(want) > 800


def test_line_dedup_against_plain_python(kept):
    docs = defaultdict(set)
    key = lambda line: re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(SPACE))
    for r in kept[1]:
        for line in r.text.split("\n"):
            docs[key(line)].add(r.doc_id)
    gone = {k: max(ids) for k, ids in docs.items() if len(k) >= 40 and len(ids) >= 5}
    got = {r.doc_id: r for r in kept[2]}
    assert len(got) == len(kept[1]) and gone
    for r in kept[1]:
        rest = "\n".join(x for x in r.text.split("\n") if gone.get(key(x), r.doc_id) == r.doc_id)
        assert got[r.doc_id].text == rest and got[r.doc_id].n_chars == len(rest)


def test_near_dedup_against_all_pairs(kept):
    want = survivors(kept[2])
    assert sorted(r.doc_id for r in kept[3]) == want and len(want) < len(kept[2])
    before = {r.doc_id: r for r in kept[2]}
    assert all(r == before[r.doc_id] for r in kept[3])
    assert len({r.text for r in kept[3]}) == len(kept[3])


def test_decontamination_drops_documents_with_items(spark, kept):
    items = [r.text for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    flat = lambda t: " ".join((t or "").split())
    holds = {r.doc_id for r in kept[3] if any(flat(x) in flat(r.text) for x in items)}
    gone = {r.doc_id for r in kept[3]} - {r.doc_id for r in kept[4]}
    assert holds and holds <= gone and len(gone) <= 1.1 * len(holds)


def test_mixing_takes_what_the_sql_takes(kept):
    want = {r["doc_id"]: r["taken"] for r in sql(kept[4], OP10) if r["taken"]}
    got = defaultdict(int)
    for r in kept[5]:
        got[r.doc_id] += len(r.text.strip(SPACE).split())
        assert 1 <= r.copy <= 2
    assert {i: n for i, n in got.items() if n} == want  # an emptied document takes no words


def test_near_dedup_of_odd_rows(spark):
    base = " ".join(f"word{i}" for i in range(60))
    rows = [(1, base), (2, base + "\n"), (3, base), (3, base), (None, base), (4, None), (5, ""), (6, "short text"),
            (6, "another one"), (7, "only here " * 4), (7, "only here " * 4), (None, None), (None, "no id"), (None, "no id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs = docs.select("*", *[F.lit(1).alias(c) for c in ("row", "id", "h1", "h2", "action", "root", "fp", "n", "who", "first")])
    out = simhash.one_of_each(docs)
    assert out.columns == docs.columns
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=repr)
    want = [(1, base), (4, None), (6, "short text"), (6, "another one"), (7, "only here " * 4), (None, "no id")]
    assert got == sorted(want, key=repr)
    assert simhash.one_of_each(docs.limit(0)).count() == 0


def test_stages_take_odd_and_empty_tables(spark):
    rows = [(1, None, None, None, None), (None, "", "en", "a", 0), (2, "a few words " * 3, "en", "a", 1), (2, "a few words " * 3, "en", "a", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumn("copy", F.lit("x")).withColumn("rest", F.lit(1))
    for name, stage in corpus_pipeline.STAGES[:4]:
        assert stage(spark, docs, FOLDER).columns == docs.columns
        stage(spark, docs, FOLDER).count()
        assert stage(spark, docs.limit(0), FOLDER).count() == 0
    mixed = corpus_pipeline.mixing_sources(spark, docs.drop("copy"), FOLDER)
    assert mixed.columns[-1] == "copy" and mixed.count() >= 2
    taken = docs.withColumn("Mix_Copy", F.lit(0))
    mixed = materialize(corpus_pipeline.mixing_sources(spark, taken, FOLDER), "mixed")
    assert mixed.columns == [*taken.columns, "mix_mix_copy"] and mixed.where("copy = 'x'").count() == mixed.count() >= 2


def test_near_dedup_keeps_one_of_a_chain(spark, monkeypatch):
    """Texts that are linked through others are one group, and equal rows of the first are one row."""
    values = {"a": 0b0, "b": 0b11, "c": 0b1111, "d": 0b1111111, "e": -1}
    column = F.create_map(*[F.lit(x) for pair in values.items() for x in pair])
    monkeypatch.setattr(simhash, "fingerprint", lambda text, shingle, seed: column[text].cast("long"))
    rows = [(9, "a"), (2, "c"), (2, "c"), (5, "b"), (7, "d"), (8, "e"), (8, "e")]
    out = simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r.doc_id, r.text) for r in out.collect()) == [(2, "c"), (7, "d"), (8, "e")]
