import numpy as np
import pyarrow as pa
import pytest

from cartloom.operators import vectors

VEC = "vec_id long, embedding array<float>"


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(2)
    data = rng.normal(size=(300, 8)).astype(np.float32)
    data[200:] = data[200]  # a third of the vectors are copies of one
    data[150] = 0
    table = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(data)], VEC)
    return data.astype(np.float64), table.repartition(5)


def brute(data, k, metric):
    out = {}
    for q, query in enumerate(data):
        if metric == "cosine":
            norms = np.linalg.norm(data, axis=1) * np.linalg.norm(query)
            with np.errstate(invalid="ignore"):
                scores = np.where(norms > 0, data @ query / norms, -np.inf)
        else:
            scores = -np.square(data - query).sum(1)
        order = sorted(range(len(data)), key=lambda i: (-round(scores[i], 9), i))
        out[q] = [(i, scores[i]) for i in order if scores[i] > -np.inf][:k]
    return {q: hits for q, hits in out.items() if hits}


def collect(df):
    out = {}
    for row in df.orderBy("query_id", "rank").collect():
        out.setdefault(row.query_id, []).append((row.vec_id, row.score))
    return out


@pytest.mark.parametrize("metric", ["cosine", "l2"])
@pytest.mark.parametrize("sent", [1000, 70])
def test_exact_search(spark, points, metric, sent, monkeypatch):
    data, table = points
    monkeypatch.setattr(vectors, "BROADCAST_BYTES", 8 * 8 * 150)
    monkeypatch.setattr(vectors, "SLICE", 2000)
    asked = table.withColumnRenamed("vec_id", "query_id")
    got = collect(vectors.vector_search(asked, table, 7, metric, broadcast_queries=sent))
    want = brute(data, 7, metric)
    assert set(got) == set(want)
    for query, hits in want.items():
        assert [s for _, s in got[query]] == pytest.approx([s for _, s in hits], abs=1e-9)


@pytest.mark.parametrize("rows", [(1, 1000), (1000, 1), (40, 70)])
def test_blocks_of_any_size_give_the_same_hits(spark, points, rows):
    data, table = points
    table = table.where("vec_id < 120 OR vec_id > 260")
    asked = table.withColumnRenamed("vec_id", "query_id")
    want = collect(vectors.vector_search(asked, table, 3))
    got = vectors.vector_search(asked, table, 3, broadcast_queries=0, query_rows=rows[0], vector_rows=rows[1])
    got = collect(got)
    assert {q: [v for v, _ in hits] for q, hits in got.items()} == {q: [v for v, _ in hits] for q, hits in want.items()}


def test_many_queries_do_not_pass_the_driver(spark, points, monkeypatch):
    _, table = points
    monkeypatch.setattr(type(table), "toArrow", None)
    monkeypatch.setattr(spark.sparkContext, "broadcast", None)
    found = vectors.vector_search(table.withColumnRenamed("vec_id", "query_id"), table, 3, broadcast_queries=10)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "Broadcast" not in plan


@pytest.mark.parametrize("sent", [1000, 0])
def test_vectors_of_unequal_length_are_an_error(spark, sent):
    table = spark.createDataFrame([(1, [1.0, 2.0, 3.0]), (2, [1.0] * 5)], VEC).coalesce(1)
    with pytest.raises(Exception, match="unequal lengths"):
        vectors.vector_search(table.withColumnRenamed("vec_id", "query_id"), table, broadcast_queries=sent).collect()


def test_no_queries_and_no_vectors(spark, points):
    _, table = points
    asked = table.withColumnRenamed("vec_id", "query_id")
    assert vectors.vector_search(asked.limit(0), table).count() == 0
    assert vectors.vector_search(asked, table.limit(0)).count() == 0
    with pytest.raises(ValueError):
        vectors.vector_search(asked, table, metric="dot")


def test_hashed_search_prunes_and_finds_most_neighbours(spark):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(30, 16))
    data = (centres[np.arange(600) % 30] + rng.normal(scale=0.15, size=(600, 16))).astype(np.float32)
    table = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(data)], VEC).repartition(4)
    asked = table.withColumnRenamed("vec_id", "query_id")
    exact = collect(vectors.vector_search(asked, table, 5))
    near = collect(vectors.vector_search_lsh(asked, table, 5, tables=4, bits=8))
    found = sum(len({v for v, _ in exact[q]} & {v for v, _ in near.get(q, [])}) for q in exact)
    assert found / (5 * len(exact)) >= 0.9
    pairs = vectors.lsh_candidates(asked, table, tables=4, bits=8)
    assert pairs.count() <= 0.2 * 600 * 600
    candidates = {(r.query_id, r.vec_id) for r in pairs.collect()}
    for query, hits in near.items():
        for vec, score in hits:
            assert (query, vec) in candidates
            a, b = data[query].astype(float), data[vec].astype(float)
            assert score == pytest.approx(a @ b / np.linalg.norm(a) / np.linalg.norm(b), abs=1e-9)


def test_equal_vectors_rank_by_id(spark):
    row = np.random.default_rng(1).normal(size=7).tolist()
    table = spark.createDataFrame([(i, row) for i in range(200)], VEC).repartition(7)
    asked = table.where("vec_id < 3").withColumnRenamed("vec_id", "query_id")
    got = collect(vectors.vector_search(asked, table, 4))
    assert {q: [v for v, _ in hits] for q, hits in got.items()} == dict.fromkeys(range(3), [0, 1, 2, 3])


def test_pairs_of_codes_are_not_shuffled(spark, points, monkeypatch):
    """Pairs come out of the cells of a grid once, and are counted without being formed."""
    data, table = points
    table = table.where("vec_id < 150").union(spark.createDataFrame([(999, None)], VEC))
    monkeypatch.setattr(vectors, "CODED_ROWS", 40)
    monkeypatch.setattr(vectors, "SLICE", 90)
    asked = table.withColumnRenamed("vec_id", "query_id")
    pairs = vectors.lsh_candidates(asked, table, tables=4, bits=3)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" not in plan
    own = vectors.SignCodes(8, 4, 3, 7).of(data[:150])
    want = {(q, v) for q in range(150) for v in range(150) if (own[q] == own[v]).any()}
    got = [tuple(r) for r in pairs.collect()]
    assert sorted(got) == sorted(want)
    counts = {r.query_id: r.scored for r in vectors.lsh_counts(asked, table, tables=4, bits=3).collect()}
    assert counts == {q: sum(a == q for a, _ in want) for q in range(150)}
    twice = vectors.lsh_candidates(asked, table.union(table), tables=4, bits=3)
    assert sorted(tuple(r) for r in twice.collect()) == sorted(want)


@pytest.mark.parametrize("metric", ["cosine", "l2"])
def test_slices_give_the_hits_of_all_scores(metric, monkeypatch):
    """Only pairs that may be among the best are scored in full; copies and close scores included."""
    rng = np.random.default_rng(4)
    data = np.concatenate([rng.normal(size=(150, 5)), np.repeat(rng.normal(size=(3, 5)), 40, axis=0), np.zeros((2, 5))])
    data[:60] = data[0] + rng.normal(scale=1e-7, size=(60, 5))
    monkeypatch.setattr(vectors, "SLICE", 300)
    monkeypatch.setattr(vectors, "QUERY_SLICE", 16)
    scored, own = [], vectors._pair_scores
    monkeypatch.setattr(vectors, "_pair_scores", lambda a, b, m: scored.append(len(a)) or own(a, b, m))
    ids = pa.array(range(len(data)))
    hits = vectors._hits(data, data, ids, 4, metric)
    got = {}
    for q, v, score in zip(*(c.to_pylist() for c in hits.columns)):
        got.setdefault(q, []).append((v, score))
    with np.errstate(invalid="ignore", divide="ignore"):
        norms = np.linalg.norm(data, axis=1)
        full = data @ data.T / np.outer(norms, norms) if metric == "cosine" else -np.square(data[:, None] - data[None]).sum(2)
    full = np.where(np.isnan(full), -np.inf, full)
    for q in range(len(data)):
        best = np.sort(full[q])[::-1][:4]
        best = best[best > -np.inf]
        assert [s for _, s in got.get(q, [])] == pytest.approx(best.tolist(), abs=1e-11)
        assert all(full[q, v] == pytest.approx(s, abs=1e-11) for v, s in got.get(q, []))
    assert sum(scored) < 0.6 * len(data) ** 2
    assert vectors._blocks(720_000, 300, 65_536) == 16 and vectors._blocks(9_000_000, 300, 65_536) == 138
    assert vectors._blocks(500, 300, 65_536) == 2 and vectors._blocks(0, 300, 65_536) == 1
