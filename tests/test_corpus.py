import random

import pytest

from cartloom.functions import fixed_values as fixed
from cartloom.operators import corpus, graph, incremental

DOC = "path string, text string"

CODE = '''import x


def outer(a):
    y = 1

    def inner(b):
        return b
    z = 2
class Thing:
    def method(self):
        pass
def last(
'''


def chunk_rows(df):
    return sorted((r.path, r.symbol, r.kind, r.start_line, r.end_line, r.text) for r in df.collect())


def test_chunks_tile_every_text(spark):
    rng = random.Random(4)
    texts = {f"d/{i}.md": "".join(rng.choices("ab\n", k=rng.randrange(80))) for i in range(40)}
    texts |= {"crlf.md": "a\r\nb\r\n", "one.md": "x", "empty.md": "", "break.md": "\n"}
    df = spark.createDataFrame(list(texts.items()), DOC)
    by_path = {}
    for row in corpus.chunk_lines(df, 3).collect():
        by_path.setdefault(row.path, []).append(row)
    for path, text in texts.items():
        lines = text.splitlines()
        chunks = sorted(by_path.get(path, []), key=lambda r: r.start_line)
        assert [line for c in chunks for line in c.text.split("\n")] == lines
        starts = list(range(1, len(lines) + 1, 3))
        assert [c.start_line for c in chunks] == starts
        assert [c.end_line for c in chunks] == [min(s + 2, len(lines)) for s in starts]
        assert [c.symbol for c in chunks] == [f"{path.split('/')[-1]}:{s}" for s in starts]


def test_index_of_code_and_text(spark):
    docs = spark.createDataFrame(
        [("a/code.py", CODE), ("a/plain.py", "x = 1\n"), ("a/empty.py", ""), ("note.md", "hi")], DOC
    )
    got = {(r[0], r[1]): r[2:5] for r in chunk_rows(corpus.index_files(docs))}
    assert got == {
        ("a/code.py", "outer"): ("function", 4, 9),
        ("a/code.py", "outer.inner"): ("function", 7, 9),
        ("a/code.py", "Thing"): ("class", 10, 12),
        ("a/code.py", "Thing.method"): ("function", 11, 12),
        ("a/code.py", "last"): ("function", 13, 13),
        ("a/plain.py", "plain.py"): ("file", 1, 1),
        ("a/empty.py", "empty.py"): ("file", 1, 0),
        ("note.md", "note.md:1"): ("file", 1, 1),
    }


def stack_blocks(headings, last):
    """Blocks of one document by walking it with a stack."""
    out, stack = [], []
    for i, (pos, level, name) in enumerate(headings):
        while stack and stack[-1][0] >= level:
            stack.pop()
        end = next((p - 1 for p, lvl, _ in headings[i + 1 :] if lvl <= level), last)
        out.append((pos, end, ".".join([n for _, n in stack] + [name])))
        stack.append((level, name))
    return out


@pytest.mark.parametrize("piece", [3, 4096])
def test_blocks_match_a_stack(spark, piece):
    rng = random.Random(9)
    docs = {}
    for doc in range(40):
        last = rng.randrange(1, 30) if doc else 400  # document 0 holds most lines
        spots = sorted(rng.sample(range(1, last + 1), rng.randrange(0, last)))
        docs[doc] = ([(p, rng.randrange(4), f"n{p}") for p in spots], last)
    rows = [(d, *h) for d, (headings, _) in docs.items() for h in headings]
    got = corpus.segment_blocks(
        spark.createDataFrame(rows, "doc int, pos int, level int, name string"),
        spark.createDataFrame([(d, last) for d, (_, last) in docs.items()], "doc int, last int"),
        piece=piece,
    ).collect()
    for doc, (headings, last) in docs.items():
        mine = sorted((r.pos, r.end, r.symbol) for r in got if r.doc == doc)
        assert mine == stack_blocks(headings, last)


@pytest.fixture(scope="module")
def chunks(spark):
    rows = [
        ("app/tools.py", "Search", "function", 1, 3, "def search price"),
        ("app/bot/x.py", "search_all", "function", 1, 3, "price"),
        ("docs/a.md", "a.md:1", "file", 1, 9, "The PRICE list"),
        ("docs/b.md", "b.md:1", "file", 1, 9, "nothing"),
        ("sql/q.sql", "q.sql:1", "file", 1, 9, "nothing"),
    ]
    return spark.createDataFrame(
        rows, "path string, symbol string, kind string, start_line int, end_line int, text string"
    )


def by_term(df, *columns):
    out = {}
    for row in df.orderBy("term", "rank").collect():
        out.setdefault(row.term, []).append(tuple(row[c] for c in columns))
    return out


def test_grep_and_symbols(spark, chunks):
    terms = spark.createDataFrame([("Price",), ("SEARCH ",), ("search_",), (" ",), ("zz",)], "term string")
    assert by_term(corpus.grep(terms, chunks), "path")["Price"] == [
        ("app/bot/x.py",), ("app/tools.py",), ("docs/a.md",),
    ]
    assert len(by_term(corpus.grep(terms, chunks, 2), "path")["Price"]) == 2
    assert by_term(corpus.find_symbol(terms, chunks), "match", "symbol") == {
        "SEARCH ": [("exact", "Search")],
        "search_": [("partial", "search_all")],
    }


def test_ranking_offers_favoured_paths_to_every_term(spark, chunks):
    terms = spark.createDataFrame([("price",), ("zz",), ("search",)], "term string")
    rule = ((("app/bot/",), -500), (("app/tools.py", "sql/"), 600))
    got = by_term(corpus.rank_chunks(terms, chunks, prefix_rules=rule), "path", "score")
    favoured = [("app/tools.py", 600), ("sql/q.sql", 600)]
    assert got == {
        "price": [("app/tools.py", 650), ("sql/q.sql", 600), ("docs/a.md", 50)],
        "search": [("app/tools.py", 730), ("sql/q.sql", 600)],
        "zz": favoured,
    }
    with pytest.raises(ValueError):
        corpus.rank_chunks(terms, chunks, text_points=-1)


def test_selection_counts_and_modules(spark, chunks):
    got = corpus.select_chunks(chunks, ("app/", "api/"), ".py", ("function", "class"))
    assert sorted(r.module for r in corpus.module_names(got).collect()) == ["tools", "x"]
    row = corpus.counts(chunks, "path").first()
    assert (row.rows, row.distinct_path) == (5, 5)


def test_ordered_text_comes_in_bounded_parts(spark):
    rows = [("a", i, f"line {i}") for i in range(25)] + [("b", 3, "only")]
    df = spark.createDataFrame(rows, "k string, i int, t string").repartition(4)
    got = sorted(tuple(r) for r in corpus.concat_ordered(df, "k", "i", "t", part_rows=10).collect())
    assert [(k, part) for k, part, _ in got] == [("a", 0), ("a", 1), ("a", 2), ("b", 0)]
    assert "\n".join(t for k, _, t in got if k == "a") == "\n".join(f"line {i}" for i in range(25))


def test_parts_are_cut_by_row_number(spark):
    rows = [("a", 3, "x"), ("a", 10003, "y"), ("b", -5, "p"), ("b", 0, "q"), ("b", 7, "r")]
    df = spark.createDataFrame(rows, "k string, i int, t string").repartition(3)
    assert sorted(map(tuple, corpus.concat_ordered(df, "k", "i", "t").collect())) == [("a", 0, "x\ny"), ("b", 0, "p\nq\nr")]
    halves = df.withColumn("i", df.i / 2)
    got = sorted(map(tuple, corpus.concat_ordered(halves, "k", "i", "t", part_rows=2).collect()))
    assert got == [("a", 0, "x\ny"), ("b", 0, "p\nq"), ("b", 1, "r")]


def test_null_hashes_are_not_computed_again(spark):
    current = spark.createDataFrame([(1, None, "t"), (2, "h", "u")], "k int, h string, body string")
    state = spark.createDataFrame([(1, None, "old"), (2, "g", "old")], "k int, h string, payload string")
    assert [r.k for r in incremental.changed_rows(current, state, "k", "h").collect()] == [2]
    new = incremental.refresh(current, state, "k", "h", lambda df: df.selectExpr("k", "h", "body AS payload"))
    assert sorted((r.k, r.payload) for r in new.collect()) == [(1, "old"), (2, "u")]


def test_graph(spark):
    edges = spark.createDataFrame(
        [("f", "g"), ("f", "g"), ("m.f", "h"), ("g", "print"), ("g", "k")], "src string, dst string"
    )
    assert graph.filter_edges(edges).where("dst = 'print'").count() == 0
    stop = spark.createDataFrame([("g",), ("g",)], "dst string")
    assert sorted(tuple(r) for r in graph.filter_edges(edges, stop).collect()) == [
        ("g", "k"), ("g", "print"), ("m.f", "h"),
    ]
    terms = spark.createDataFrame([(" g ",), ("m.f",), ("a.b.g",), ("zz",), ("x.zz",)], "term string")
    got = sorted(tuple(r) for r in graph.trace(terms, edges).collect())
    around_g = [("callees", "k"), ("callees", "print"), ("callers", "f")]
    assert got == sorted(
        [(term, "g", *link) for term in (" g ", "a.b.g") for link in around_g]
        + [("m.f", "m.f", "callees", "h")]
    )


def test_refresh_recomputes_only_changes(spark):
    current = spark.createDataFrame(
        [(1, "h1", "one"), (2, "h2new", "two"), (3, "h3", "three")], "k int, h string, body string"
    )
    state = spark.createDataFrame(
        [(1, "h1", "old one"), (2, "h2", "old two"), (9, "h9", "gone")], "k int, h string, payload string"
    )

    def compute(df):
        return df.selectExpr("k", "h", "upper(body) AS payload")

    first = incremental.refresh(current, state, "k", "h", compute)
    assert sorted(tuple(r) for r in first.collect()) == [
        (1, "h1", "old one"), (2, "h2new", "TWO"), (3, "h3", "THREE"),
    ]
    assert incremental.changed_rows(current, first, "k", "h").count() == 0
    kept = incremental.refresh(current, state, "k", "h", compute, keep_missing=True)
    assert {r.k for r in kept.collect()} == {1, 2, 3, 9}


def test_default_words_stop_edges(spark):
    edges = spark.createDataFrame([("f", word) for word in fixed.EDGE_STOP_LIST], "src string, dst string")
    assert graph.filter_edges(edges).count() == 0


@pytest.mark.parametrize("part_rows", [1, 2, 100])
def test_rows_of_equal_positions_are_ordered_by_text(spark, part_rows):
    rows = [(k, at, text) for k in (1, None) for at, text in [(2, "z"), (1, "b"), (1, "a"), (None, "n"), (1, "c"), (2, "y"), (1, None)]]
    for order in (1, -1):
        df = spark.createDataFrame(rows[::order], "k int, at int, body string").repartition(3)
        parts = corpus.concat_ordered(df, "k", "at", "body", sep="|", part_rows=part_rows).collect()
        for key in (1, None):
            own = sorted((r.part, r.text) for r in parts if r.k == key)
            assert "|".join(text for _, text in own if text) == "n|a|b|c|y|z"


def test_many_headings_take_time_by_their_number(spark):
    text = "\n".join(f"{'    ' * (i % 5)}def f{i}(a):\n{'    ' * (i % 5)}    pass" for i in range(100_000))
    df = spark.createDataFrame([("a.py", text)], DOC)
    last = corpus.chunk_blocks(df).where("start_line >= 199990").orderBy("start_line").collect()
    assert [(r.symbol, r.start_line, r.end_line) for r in last] == [
        ("f99995", 199991, 200000), ("f99995.f99996", 199993, 200000), ("f99995.f99996.f99997", 199995, 200000),
        ("f99995.f99996.f99997.f99998", 199997, 200000), ("f99995.f99996.f99997.f99998.f99999", 199999, 200000),
    ]


def test_trace_removes_duplicates_of_neighbours_once(spark):
    """Heads and tails share one pass over the neighbours, so that no task holds them twice."""
    edges = spark.createDataFrame([("a.b", "x"), ("c", "y"), ("c", "y"), (None, "z")], "src string, dst string")
    terms = spark.createDataFrame([("a.b",), (" a.b",), ("q.c",), ("q.x",), ("y",), (None,), ("none.",)], "term string")
    found = graph.trace(terms, edges)
    assert sorted(tuple(r) for r in found.collect()) == [
        (" a.b", "a.b", "callees", "x"), ("a.b", "a.b", "callees", "x"), ("q.c", "c", "callees", "y"),
        ("q.x", "x", "callers", "a.b"), ("y", "y", "callers", "c"),
    ]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan and plan.count("Aggregate [node") == 2
