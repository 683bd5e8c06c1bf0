import numpy as np
import pytest

from cartloom.operators import vector_index, vectors

VEC = "vec_id long, embedding array<float>"


def collect(df):
    out = {}
    for row in df.orderBy("query_id", "rank").collect():
        out.setdefault(row.query_id, []).append((row.vec_id, round(row.score, 9)))
    return out


def clustered(n, dim, kinds, seed=6):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(kinds, dim))
    return (centres[np.arange(n) % kinds] + rng.normal(scale=0.15, size=(n, dim))).astype(np.float32)


def asked_of(table):
    return table.withColumnRenamed("vec_id", "query_id")


@pytest.mark.parametrize("metric", ["cosine", "l2"])
def test_all_lists_give_the_exact_hits(spark, tmp_path, metric, monkeypatch):
    monkeypatch.setattr(vector_index, "QUERY_ROWS", 20)
    monkeypatch.setattr(vector_index, "CODE_ROWS", 30)
    data = clustered(240, 7, 12)
    data[200:] = data[200]  # a sixth of the vectors are copies of one
    data[150] = 0
    table = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(data)] + [(999, None)], VEC).repartition(5)
    index = vector_index.build_index(table, f"{tmp_path}/index", lists=6, metric=metric)
    want = collect(vectors.vector_search(asked_of(table), table, 4, metric))
    assert collect(vector_index.search_index(asked_of(table), index, 4, probes=6, rerank=300)) == want
    assert index.read(spark).count() == (239 if metric == "cosine" else 240)


def test_few_lists_hold_most_neighbours_of_clustered_vectors(spark, tmp_path):
    data = clustered(1500, 16, 40)
    table = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(data)], VEC).repartition(4)
    index = vector_index.build_index(table, f"{tmp_path}/index")
    exact = collect(vectors.vector_search(asked_of(table), table, 5))
    near = collect(vector_index.search_index(asked_of(table), index))
    found = sum(len({v for v, _ in exact[q]} & {v for v, _ in near.get(q, [])}) for q in exact)
    read = vector_index.share_read(asked_of(table), index, 20).first()
    assert found / (5 * len(exact)) >= 0.9 and index.probes <= 4
    assert read.codes_read <= 0.2 and read.vectors_read <= 0.02
    for query, hits in near.items():
        for vec, score in hits:
            a, b = data[query].astype(float), data[vec].astype(float)
            assert score == pytest.approx(a @ b / np.linalg.norm(a) / np.linalg.norm(b), abs=1e-8)


def test_only_the_folders_of_probed_lists_are_opened(spark, tmp_path):
    data = clustered(600, 16, 20)
    table = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(data)], VEC).repartition(4)
    vector_index.build_index(table, f"{tmp_path}/index", lists=20)
    index = vector_index.open_index(spark, f"{tmp_path}/index")
    asked = asked_of(table).where("query_id < 2")
    found = vector_index.candidates(asked, index, 10, probes=2)
    lists = {row.list for row in found.collect()}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert 0 < len(lists) <= 4 and "PartitionFilters: [list" in plan
    scan = plan[plan.index("PartitionFilters") :]
    assert "embedding" not in scan[scan.index("ReadSchema") :].split("\n")[0]


def test_a_written_index_is_opened_as_it_was(spark, tmp_path):
    table = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(clustered(90, 5, 4))], VEC)
    built = vector_index.build_index(table, f"{tmp_path}/index", metric="l2")
    opened = vector_index.open_index(spark, f"{tmp_path}/index")
    assert (opened.metric, opened.probes) == (built.metric, built.probes)
    assert np.array_equal(opened.centroids, built.centroids) and np.array_equal(opened.high, built.high)
    rows = np.random.default_rng(0).normal(size=(50, 5)) * 3
    inside = np.clip(rows, built.low, built.high)
    assert np.abs(built.decode(built.encode(rows)) - inside).max() <= (built.high - built.low).max() / 30 + 1e-12


def test_odd_tables(spark, tmp_path):
    empty = spark.createDataFrame([], VEC)
    index = vector_index.build_index(empty, f"{tmp_path}/empty")
    assert vector_index.search_index(asked_of(empty), index).count() == 0
    one = spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0])], VEC)
    index = vector_index.build_index(one, f"{tmp_path}/one")
    asked = spark.createDataFrame([(7, [2.0, 0.0]), (8, [0.0, 0.0])], "query_id long, embedding array<float>")
    assert collect(vector_index.search_index(asked, index)) == {7: [(1, 1.0), (1, 1.0)]}
    with pytest.raises(ValueError):
        vector_index.build_index(one, f"{tmp_path}/bad", metric="dot")


def test_an_index_asked_for_everything_forms_no_pairs(spark, tmp_path, monkeypatch):
    """All lists and all vectors: the exact search, without a row for each query and vector."""
    data = np.random.default_rng(5).normal(size=(200, 6)).astype(np.float32)
    table = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(data)], "vec_id long, embedding array<float>")
    index = vector_index.build_index(table, str(tmp_path / "index"), lists=7)
    asked = table.withColumnRenamed("vec_id", "query_id")
    want = sorted(map(tuple, vectors.vector_search(asked, table, 4).collect()))
    monkeypatch.setattr(vector_index, "candidates", None)
    assert sorted(map(tuple, vector_index.search_index(asked, index, 4, probes=7, rerank=200).collect())) == want


def test_lists_of_many_rows_are_found_in_slices(monkeypatch):
    rng = np.random.default_rng(3)
    index = vector_index.VectorIndex("", "l2", rng.normal(size=(50, 4)), np.zeros(4), np.ones(4), 5, "")
    rows = rng.normal(size=(333, 4))
    want = np.argsort(-vector_index._closeness(rows, index.centroids), axis=1, kind="stable")
    monkeypatch.setattr(vector_index, "SLICE", 1000)
    whole, seen = vector_index._closeness, []
    monkeypatch.setattr(vector_index, "_closeness", lambda a, b: seen.append(len(a)) or whole(a, b))
    for n in (1, 5, 50):
        assert (index.nearest(rows, n) == want[:, :n]).all()
    assert max(seen) <= 20


def test_a_query_is_one_row_however_many_lists_it_looks_at(spark, tmp_path, monkeypatch):
    """And the candidates in a grid of several blocks are the best by code of the lists that are looked at."""
    data = np.random.default_rng(8).normal(size=(300, 5)).astype(np.float32)
    data[250:260] = data[250]
    table = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(data)], VEC).repartition(3)
    index = vector_index.build_index(table, f"{tmp_path}/index", lists=9)
    asked = asked_of(table)
    assert vector_index.with_probes(asked, index, 6).count() == 300
    monkeypatch.setattr(vector_index, "QUERY_ROWS", 70)
    monkeypatch.setattr(vector_index, "CODE_ROWS", 60)
    monkeypatch.setattr(vectors, "QUERY_SLICE", 32)
    found = {(r.query_id, r.vec_id): r.list for r in vector_index.candidates(asked, index, 7, probes=6).collect()}
    raw = data.astype(float)
    unit = raw / np.linalg.norm(raw, axis=1, keepdims=True)
    own = index.nearest(unit, 1)[:, 0]
    rows = index.decode(index.encode(unit))
    scores = np.round(unit @ (rows / np.linalg.norm(rows, axis=1, keepdims=True)).T, 9)
    for q, lists in enumerate(index.nearest(unit, 6)):
        held = np.flatnonzero(np.isin(own, lists))
        want = sorted(held.tolist(), key=lambda v: (-scores[q, v], v))[:7]
        assert sorted(v for a, v in found if a == q) == sorted(want)
    assert all(own[v] == number for (_, v), number in found.items())
    counts = {r.list: r.asked for r in vector_index.lists_asked(asked, index, 6).collect()}
    assert counts == dict(enumerate(np.bincount(index.nearest(unit, 6).ravel()).tolist()))
    # every query is a row of a grid of ceil(300 / 70) by ceil(300 / 60) blocks, a list is no row
    sent, whole = [], vectors.grid_hits
    monkeypatch.setattr(vectors, "grid_hits", lambda q, v, *rest: sent.append(q.count() * q.first().vector_blocks) or whole(q, v, *rest))
    vector_index.candidates(asked, index, 7, probes=6)
    assert sent == [300 * 5]
