import random
import re

import pytest
from pyspark.sql import functions as F

from cartloom.operators import corpus
from cartloom.operators.lookup import search_by_name
from cartloom.operators.matching import term_matches

TEXTS = ["Banana", "banana chips", "100% juice", "a_b", "ab", "", "Crème", "x" * 50, "back\\slash"]
TERMS = ["banana", "AN", "a", "%", "_", "a_b", "100%", "\\%", "b\\a", "", "zzz", "è", "n%c", "xxx"]


def like(term):
    """The regular expression for ``%term%`` with LIKE's escapes."""
    pattern, out, i = f"%{term}%", "", 0
    while i < len(pattern):
        char = pattern[i]
        if char == "\\" and i + 1 < len(pattern):
            i += 1
            out += re.escape(pattern[i])
        else:
            out += {"%": ".*", "_": "."}.get(char, re.escape(char))
        i += 1
    return re.compile(out, re.I | re.S)


@pytest.mark.parametrize("literal_terms", [0, 64])
@pytest.mark.parametrize("wildcards", [False, True])
def test_both_ways_match_brute_force(spark, literal_terms, wildcards):
    rng = random.Random(1)
    texts = TEXTS + ["".join(rng.choices("abn %_", k=rng.randrange(12))) for _ in range(60)]
    terms = TERMS + ["".join(rng.choices("abn%_", k=rng.randrange(1, 5))) for _ in range(40)]
    texts, terms = sorted(set(texts)), sorted(set(terms))
    got = term_matches(
        spark.createDataFrame([(t,) for t in terms], "term string"),
        spark.createDataFrame(list(enumerate(texts)), "id int, body string"),
        ["id"],
        "body",
        wildcards=wildcards,
        literal_terms=literal_terms and 500,
    ).collect()
    pairs = [(r.term, texts[r.id]) for r in got]
    want = {
        (term, body)
        for term in terms
        for body in texts
        if (like(term).fullmatch(body) if wildcards else term.lower() in body.lower())
    }
    assert len(pairs) == len(set(pairs))
    assert set(pairs) == want


def test_hot_gram_goes_to_a_rarer_one(spark):
    """A third of the texts share a word; a term with a rarer part is keyed by that part."""
    texts = [(i, f"common word {i % 7}") for i in range(300)] + [(1000, "common zebra")]
    texts = spark.createDataFrame(texts, "id int, body string")
    terms = spark.createDataFrame([("common zebra",)], "term string")
    got = term_matches(terms, texts, ["id"], "body", literal_terms=0)
    assert [tuple(r) for r in got.collect()] == [("common zebra", 1000)]


def test_search_by_name(spark, catalogue):
    products, velocity, _ = catalogue
    queries = spark.createDataFrame(
        [("q1", " BANANA "), ("q2", ""), ("q3", "   "), ("q4", "%"), ("q5", "none"), ("q6", None)],
        "query_id string, user_query string",
    )
    got = search_by_name(queries, products, velocity).orderBy("query_id", "rank").collect()
    found = {}
    for row in got:
        found.setdefault(row.query_id, []).append(row.product_id)
    assert found == {"q1": [4, 3], "q4": [1, 4, 2, 3, 5, 6]}
    literal = search_by_name(queries, products, velocity, escape=True)
    assert {r.query_id for r in literal.collect()} == {"q1"}
    top = search_by_name(queries, products, velocity, k=1).where(F.col("query_id") == "q4")
    assert [r.product_id for r in top.collect()] == [1]


def _chunks(spark):
    rows = [
        ("a.py", 1, "run", "call zebra here"), ("a.py", 1, "run", "call zebra here"), ("a.py", 1, "run", "no such word"),
        ("b.py", 5, None, "zebra"), (None, None, None, "zebra zz"), ("c.py", 2, "zebra", None),
    ]
    return spark.createDataFrame(rows, "path string, start_line int, symbol string, text string")


@pytest.mark.parametrize("more", [0, 60])
def test_null_and_repeated_keys_are_found_with_few_and_many_terms(spark, more):
    terms = spark.createDataFrame([("zebra",), ("zz",), ("z",)] + [(f"other{i}",) for i in range(more)], "term string")
    hits = corpus.grep(terms, _chunks(spark)).collect()
    assert sum(r.term == "zebra" for r in hits) == 4
    assert [r.path for r in hits if r.term == "zz"] == [None]
    assert sum(r.term == "z" for r in hits) == 4
    ranked = corpus.rank_chunks(terms, _chunks(spark)).collect()
    best = sorted((r.path or "", r.score) for r in ranked if r.term == "zebra")
    assert [path for path, _ in best] == ["", "a.py", "a.py", "b.py", "c.py"]
    assert len({score for path, score in best if path == "a.py"}) == 1


def test_texts_are_not_shuffled(spark):
    terms = spark.range(50).select(F.concat(F.lit("term"), F.col("id").cast("string")).alias("term"))
    plan = corpus.grep(terms, _chunks(spark))._jdf.queryExecution().executedPlan().toString()
    for line in plan.splitlines():
        if "Exchange hash" in line or "Exchange range" in line:
            assert "text" not in line and "lowered" not in line
    # what is exchanged comes out of a stage that ends in the hits
    assert "SortMergeJoin" not in plan
