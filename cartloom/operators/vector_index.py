"""An inverted file of vectors for approximate search.

Vectors are stored in partitions by their nearest centroid. Beside each vector lies a code of
four bits a dimension. A query looks at the codes of the lists of its nearest centroids only,
and reads in full the few vectors that score best by code. Lists are folders, so those that no
query asks for are not opened, and codes are a column, so vectors are not read for a first score.

Centroids, the range of the codes and the number of lists to probe are fitted once, on at most
``SAMPLE_ROWS`` vectors; the number of lists is the least that holds ``target`` of the nearest
neighbours of sampled vectors. Every vector is stored. Null vectors and, for the cosine, zero
vectors are in no result and are not stored; vectors of unequal length are an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cartloom.operators import vectors as exact
from cartloom.operators.ranking import top_k

SAMPLE_ROWS = 20_000
MOST_LISTS = 4096
ROUNDS = 20
#: Rows of a block of queries and of codes, as long as no more than ``vectors.MOST_BLOCKS`` blocks are needed.
QUERY_ROWS, CODE_ROWS = 4096, 1 << 18
LEVELS = 15
#: Numbers of a matrix of distances to centroids.
SLICE = 1 << 20


@dataclass(frozen=True)
class VectorIndex:
    """A written index: where it is, and what was fitted."""

    path: str
    metric: str
    centroids: np.ndarray
    low: np.ndarray
    high: np.ndarray
    probes: int
    schema: str

    @property
    def lists(self) -> int:
        return len(self.centroids)

    def read(self, spark: SparkSession) -> DataFrame:
        """``(list, vec_id, code, embedding)`` of all stored vectors."""
        return spark.read.schema(self.schema).parquet(f"{self.path}/lists")

    def nearest(self, rows: np.ndarray, n: int) -> np.ndarray:
        """The lists of the ``n`` nearest centroids of every row, nearest first."""
        out = np.empty((len(rows), min(n, self.lists)), np.int64)
        # a few rows at a time: there may be thousands of lists
        step = max(1, SLICE // self.lists)
        for at in range(0, len(rows), step):
            out[at : at + step] = _nearest_lists(-_closeness(rows[at : at + step], self.centroids), out.shape[1])
        return out

    def encode(self, rows: np.ndarray) -> np.ndarray:
        """Two dimensions a byte."""
        span = np.where(self.high > self.low, self.high - self.low, 1)
        steps = np.clip(np.rint((rows - self.low) / span * LEVELS), 0, LEVELS).astype(np.uint8)
        steps = np.pad(steps, ((0, 0), (0, steps.shape[1] % 2)))
        return steps[:, ::2] << 4 | steps[:, 1::2]

    def decode(self, codes: np.ndarray) -> np.ndarray:
        steps = np.stack([codes >> 4, codes & 15], axis=2).reshape(len(codes), -1)[:, : len(self.low)]
        return self.low + steps * (np.where(self.high > self.low, self.high - self.low, 1) / LEVELS)


def _nearest_lists(far: np.ndarray, n: int) -> np.ndarray:
    """The numbers of the ``n`` least of each row, in order, of equal ones the first."""
    if n == 1:
        return far.argmin(axis=1)[:, None]
    return np.argsort(far, axis=1, kind="stable")[:, :n]


def _closeness(rows: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return 2 * rows @ centroids.T - np.square(centroids).sum(1)[None, :]


def _prepared(rows: np.ndarray, metric: str) -> np.ndarray:
    """Rows whose inner products or distances are those of the metric."""
    if metric == "l2":
        return rows
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, norms, out=np.zeros_like(rows), where=norms > 0)


def _fitted(sample: np.ndarray, lists: int, seed: int) -> np.ndarray:
    """Centroids by Lloyd's rounds; a centroid without vectors moves to the vector worst served."""
    rng = np.random.default_rng(seed)
    centroids = sample[np.sort(rng.choice(len(sample), min(lists, len(sample)), replace=False))].copy()
    for _ in range(ROUNDS):
        scores = _closeness(sample, centroids)
        own = scores.argmax(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, sample)
        counts = np.bincount(own, minlength=len(centroids))
        moved = np.divide(sums, counts[:, None], out=centroids.copy(), where=counts[:, None] > 0)
        empty = np.flatnonzero(counts == 0)
        moved[empty] = sample[np.argsort(scores.max(axis=1) - np.square(sample).sum(1))[: len(empty)]]
        if np.allclose(moved, centroids):
            break
        centroids = moved
    return centroids


def _probes(sample: np.ndarray, centroids: np.ndarray, k: int, target: float, seed: int) -> int:
    """How many lists hold ``target`` of the ``k`` nearest sampled neighbours of sampled vectors."""
    asked = np.random.default_rng(seed + 1).choice(len(sample), min(500, len(sample)), replace=False)
    scores = _closeness(sample[asked], sample)
    scores[np.arange(len(asked)), asked] = -np.inf
    near = np.argsort(-scores, axis=1)[:, : min(k, len(sample) - 1)]
    own = _closeness(sample, centroids).argmax(axis=1)
    order = np.argsort(-_closeness(sample[asked], centroids), axis=1, kind="stable")
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(len(centroids))[None, :].repeat(len(asked), 0), axis=1)
    found = np.sort(np.take_along_axis(place, own[near], axis=1).ravel())
    return int(found[min(len(found) - 1, int(np.ceil(target * len(found))))]) + 1 if len(found) else 1


def build_index(
    vectors: DataFrame,
    path: str,
    lists: int | None = None,
    metric: str = "cosine",
    k: int = 5,
    target: float = 0.95,
    seed: int = 7,
) -> VectorIndex:
    """Fit and write an index of ``(vec_id, embedding)`` at a new folder ``path``.

    ``lists`` is about the square root of the number of vectors unless given.
    """
    if metric not in ("cosine", "l2"):
        raise ValueError(f"metric must be 'cosine' or 'l2', not {metric!r}")
    held = vectors.select("vec_id", "embedding").dropna()
    rows = held.count()
    share = F.pmod(F.xxhash64(F.lit(seed), "vec_id", "embedding"), F.lit(1 << 30)) < int(min(1, SAMPLE_ROWS / max(1, rows)) * (1 << 30))
    sample = exact._matrix(exact._one(held.where(share).orderBy("vec_id").limit(SAMPLE_ROWS).select("embedding").toArrow().column(0)))
    sample = _prepared(sample, metric)
    if metric == "cosine":
        sample = sample[np.square(sample).sum(1) > 0]
    if not len(sample):
        sample = np.zeros((1, sample.shape[1]))
    centroids = _fitted(sample, lists or max(1, min(MOST_LISTS, int(rows**0.5))), seed)
    types = [held.schema[c].dataType.simpleString() for c in ("vec_id", "embedding")]
    stored = "list int, vec_id {}, code binary, embedding {}".format(*types)
    near = _probes(sample, centroids, k, target, seed)
    index = VectorIndex(path, metric, centroids, sample.min(0), sample.max(0), near, stored)
    _write(held, index)
    spark = vectors.sparkSession
    fitted = [(metric, near, stored, centroids.tolist(), index.low.tolist(), index.high.tolist())]
    schema = "metric string, probes int, stored string, centroids array<array<double>>, low array<double>, high array<double>"
    spark.createDataFrame(fitted, schema).coalesce(1).write.parquet(f"{path}/fitted")
    return index


def open_index(spark: SparkSession, path: str) -> VectorIndex:
    """The index that was written at ``path``."""
    row = spark.read.parquet(f"{path}/fitted").first()
    return VectorIndex(path, row.metric, np.array(row.centroids), np.array(row.low), np.array(row.high), row.probes, row.stored)


def _write(held: DataFrame, index: VectorIndex) -> None:
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = exact._matrix(batch.column("embedding"))
            if not len(raw):
                continue
            rows = _prepared(raw, index.metric)
            keep = np.square(rows).sum(1) > 0 if index.metric == "cosine" else np.ones(len(rows), bool)
            codes = [row.tobytes() for row in index.encode(rows)]
            out = pa.RecordBatch.from_arrays(
                [pa.array(index.nearest(rows, 1)[:, 0], pa.int32()), batch.column("vec_id"), pa.array(codes, pa.binary()),
                 batch.column("embedding")],
                names=["list", "vec_id", "code", "embedding"],
            )
            yield out.filter(pa.array(keep))

    # a list with a large share of the vectors is several ranges, each a file of the list
    held.mapInArrow(assign, index.schema).repartitionByRange(
        "list", "vec_id"
    ).sortWithinPartitions("list", "vec_id").write.partitionBy("list").parquet(f"{index.path}/lists")


def with_probes(queries: DataFrame, index: VectorIndex, probes: int | None = None) -> DataFrame:
    """``(query_id, embedding, home, probed)``: the queries that look at any list.

    ``home`` is the list of the nearest centroid, ``probed`` has a bit for every list, set where
    the query looks at it: a query stays one row, however many lists it looks at.
    """
    n = min(probes or index.probes, index.lists)
    asked = queries.select("query_id", "embedding").dropna()
    query_type, kind = (asked.schema[c].dataType.simpleString() for c in ("query_id", "embedding"))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = exact._matrix(batch.column("embedding"))
            if not len(raw):
                continue
            rows = _prepared(raw, index.metric)
            keep = np.flatnonzero(np.square(rows).sum(1) > 0) if index.metric == "cosine" else np.arange(len(rows))
            homes, bits, step = [np.zeros(0, np.int64)], [], max(1, SLICE // index.lists)
            for first in range(0, len(keep), step):
                near = index.nearest(rows[keep[first : first + step]], n)
                marks = np.zeros((len(near), index.lists), bool)
                np.put_along_axis(marks, near, True, axis=1)
                homes.append(near[:, 0])
                bits += [row.tobytes() for row in np.packbits(marks, axis=1)]
            at = pa.array(keep)
            yield pa.RecordBatch.from_arrays(
                [batch.column("query_id").take(at), batch.column("embedding").take(at),
                 pa.array(np.concatenate(homes), pa.int32()), pa.array(bits, pa.binary())],
                names=["query_id", "embedding", "home", "probed"],
            )

    return asked.mapInArrow(assign, f"query_id {query_type}, embedding {kind}, home int, probed binary")


def _marks(bits: pa.Array, lists: int) -> np.ndarray:
    """Of each row of ``probed``, which lists it looks at."""
    packed = np.frombuffer(b"".join(bits.to_pylist()), np.uint8).reshape(len(bits), -1)
    return np.unpackbits(packed, axis=1, count=lists).view(bool)


def lists_asked(queries: DataFrame, index: VectorIndex, probes: int | None = None) -> DataFrame:
    """``(list, asked)``: how many queries look at each list that any looks at; counted where queries are read."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, step = np.zeros(index.lists, np.int64), max(1, SLICE // index.lists)
        for batch in batches:
            for first in range(0, batch.num_rows, step):
                total += _marks(batch.column(0).slice(first, step), index.lists).sum(0)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(total[found])], names=["list", "asked"])

    counted = with_probes(queries, index, probes).select("probed").mapInArrow(count, "list int, asked long")
    return counted.groupBy("list").agg(F.sum("asked").alias("asked"))


def candidates(
    queries: DataFrame, index: VectorIndex, rerank: int, probes: int | None = None
) -> DataFrame:
    """``(query_id, list, vec_id)``: the ``rerank`` vectors of each query that score best by code.

    Of the index, only the codes of the lists that are asked for are read. Queries and codes are dealt in
    a grid of a few large blocks, so a query is sent once per block of codes and not once per list that it
    looks at, and has ``rerank`` hits per block. Inside a block queries are taken in the order of
    their homes, and meet the lists that any of those at hand looks at.
    """
    spark = queries.sparkSession
    # at most one row per list
    wanted = {row.list: row.asked for row in lists_asked(queries, index, probes).collect()}
    codes = index.read(spark).where(F.col("list").isin(*sorted(wanted))).select("list", "vec_id", "code")
    rows = codes.count() if wanted else 0
    query_type, vec_type = (df.schema[c].dataType.simpleString() for df, c in ((queries, "query_id"), (codes, "vec_id")))
    schema = f"query_id {query_type}, vec_id {vec_type}, score double, list int"
    if not rows:
        return spark.createDataFrame([], schema).select("query_id", "list", "vec_id")
    fitting = max(1, exact.BROADCAST_BYTES // (8 * max(1, len(index.low))))
    asking = sum(wanted.values()) // min(probes or index.probes, index.lists)
    blocks = {
        "query_blocks": F.lit(exact._blocks(asking, QUERY_ROWS, fitting)),
        "vector_blocks": F.lit(exact._blocks(rows, CODE_ROWS, fitting)),
    }

    def near(asked: pa.Table, held: pa.Table) -> pa.Table:
        asked = asked.take(pc.sort_indices(asked, [("home", "ascending")]))
        # places are in the order of ids, so that equal scores are in it as well
        held = held.take(pc.sort_indices(held, [("vec_id", "ascending")]))
        ids, vec_ids, own = (exact._one(x) for x in (asked.column("query_id"), held.column("vec_id"), held.column("own_list")))
        found, lists = [pa.table({"query_id": ids[:0], "vec_id": vec_ids[:0], "score": pa.array([], pa.float64()), "list": own[:0]})], own.to_numpy()
        if len(ids) and len(vec_ids):
            packed = b"".join(held.column("code").to_pylist())
            decoded = index.decode(np.frombuffer(packed, np.uint8).reshape(len(vec_ids), -1))
        for at in range(0, len(ids) if len(vec_ids) else 0, exact.QUERY_SLICE):
            part = asked.slice(at, exact.QUERY_SLICE)
            rows, marks = exact._matrix(exact._one(part.column("embedding"))), _marks(exact._one(part.column("probed")), index.lists)
            exact._same_length(rows, decoded)
            places = np.flatnonzero(marks.any(axis=0)[lists])
            allowed = lambda q, v, marks=marks, at=lists[places]: marks[q, at[v]]
            seen = lambda q, v, marks=marks, at=lists[places]: marks[q][:, at[v]]
            hits = exact._hits(rows, decoded[places], pa.array(places), rerank, index.metric, allowed, None, seen)
            place = exact._one(hits.column("vec_id"))
            named = exact._named(hits, ids.slice(at, exact.QUERY_SLICE))
            found.append(named.set_column(1, "vec_id", vec_ids.take(place)).append_column("list", own.take(place)))
        return pa.concat_tables(found)

    first = exact.grid_hits(
        with_probes(queries, index, probes).withColumns({"list": F.lit(0), **blocks}),
        codes.withColumnRenamed("list", "own_list").withColumns({"list": F.lit(0), **blocks}),
        near, schema,
    )
    return top_k(first, ["query_id"], [F.desc("score"), F.asc("vec_id")], rerank).select("query_id", "list", "vec_id")


def _score(metric: str) -> Column:
    """The exact score of ``asked`` and ``embedding``, rounded as :func:`vector_search` does."""

    @F.arrow_udf("double")
    def score(left: pa.Array, right: pa.Array) -> pa.Array:
        a, b = exact._matrix(left), exact._matrix(right)
        if metric == "l2":
            out = 2 * (a * b).sum(1) - np.square(a).sum(1) - np.square(b).sum(1)
        else:
            out = (a * b).sum(1) / (np.linalg.norm(a, axis=1) * np.linalg.norm(b, axis=1))
        return pa.array(np.round(out, exact.DECIMALS))

    return score(F.col("asked"), F.col("embedding"))


def search_index(
    queries: DataFrame, index: VectorIndex, k: int = 5, probes: int | None = None, rerank: int | None = None,
    best: DataFrame | None = None,
) -> DataFrame:
    """The ``k`` nearest vectors found for every query: ``(query_id, rank, vec_id, score)``.

    ``probes`` lists are looked at and ``rerank`` vectors, 4 times ``k`` unless given, are read in
    full for each query; scores are exact. With all lists and enough vectors the result is that
    of the exact search. Query ids are unique. ``best`` are the :func:`candidates`, if they are there already.
    """
    spark = queries.sparkSession
    if min(probes or index.probes, index.lists) == index.lists and (rerank or 4 * k) >= index.read(spark).count():
        # every vector would be read in full for every query: no first score and no pair of ids is needed
        return exact.vector_search(queries, index.read(spark).select("vec_id", "embedding"), k, index.metric)
    best = candidates(queries, index, rerank or 4 * k, probes) if best is None else best
    stored = index.read(spark).select("list", "vec_id", "embedding")
    pairs = best.distinct().join(stored, ["list", "vec_id"]).join(
        queries.select("query_id", F.col("embedding").alias("asked")), "query_id"
    )
    scored = pairs.select("query_id", "vec_id", _score(index.metric).alias("score"))
    return top_k(scored, ["query_id"], [F.desc("score"), F.asc("vec_id")], k).select("query_id", "rank", "vec_id", "score")


def share_read(
    queries: DataFrame, index: VectorIndex, rerank: int, probes: int | None = None, best: DataFrame | None = None
) -> DataFrame:
    """One row: the mean share of the codes that a query looks at, and of the vectors that it reads in full.

    ``best`` are the :func:`candidates`, if they are there already.
    """
    stored = index.read(queries.sparkSession)
    sizes = stored.groupBy("list").agg(F.count(F.lit(1)).alias("held"))
    asked = queries.select("query_id").agg(F.count(F.lit(1)).alias("asked"))
    seen = lists_asked(queries, index, probes).join(sizes, "list").agg(F.sum(F.col("asked") * F.col("held")).alias("codes"))
    best = candidates(queries, index, rerank, probes) if best is None else best
    full = best.agg(F.count(F.lit(1)).alias("vectors"))
    pairs = stored.agg(F.count(F.lit(1)).alias("rows")).select((F.col("rows") * asked.scalar()).alias("pairs"))
    return pairs.select(
        (seen.scalar() / F.col("pairs")).alias("codes_read"), (full.scalar() / F.col("pairs")).alias("vectors_read")
    )
