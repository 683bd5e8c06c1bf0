"""Nearest vectors per query, exact and approximate.

A few queries, of checked size, travel to the scan of the vectors, which are not shuffled then.
More queries are dealt with the vectors in a grid: every block of queries meets every block of
vectors in one task, and none passes the driver. Scores are computed with a matrix product
inside Spark tasks; a task keeps the best ``k`` per query and sends only those. The last cut to
``k`` per query is an ordinary top-k. Vectors that are null, or have no defined cosine, are no
hits, and such queries have none; vectors of unequal length are an error.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from cartloom.operators.ranking import top_k

BROADCAST_QUERIES = 4096
#: Bytes of queries that are sent at once.
BROADCAST_BYTES = 32 << 20
#: Numbers of a matrix of scores, and the queries that are its rows.
SLICE, QUERY_SLICE = 4_000_000, 1024
#: Rows of a block of a grid, so that a few blocks are enough to spread the work.
BLOCK_ROWS = 1 << 14
#: Blocks of either side of a grid, unless more are needed to hold the rows.
MOST_BLOCKS = 16
#: Pairs that are scored at once.
PAIRS = 1 << 16
#: Rows of each side of a cell in which codes are compared.
CODED_ROWS = 1 << 14
#: Decimals that scores are compared by; the last bits depend on a vector's place in its batch.
DECIMALS = 12
HITS = "query_id {query}, vec_id {vec}, score double"


def _matrix(column: pa.Array) -> np.ndarray:
    """A list column without nulls as a two-dimensional array."""
    rows = len(column)
    if len(sizes := pc.unique(pc.list_value_length(column))) > 1:
        raise ValueError(f"vectors have unequal lengths: {sorted(sizes.to_pylist())[:5]}")
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(rows, -1) if rows else flat.reshape(0, 0)


def _scores(queries: np.ndarray, vectors: np.ndarray, metric: str) -> np.ndarray:
    """Similarity, larger is closer: cosine, or the negated squared Euclidean distance."""
    dots = queries @ vectors.T
    if metric == "cosine":
        norms = np.outer(np.linalg.norm(queries, axis=1), np.linalg.norm(vectors, axis=1))
        return np.divide(dots, norms, out=np.full_like(dots, np.nan), where=norms > 0)
    return 2 * dots - np.square(queries).sum(1)[:, None] - np.square(vectors).sum(1)[None, :]


def _best(hits: pa.Table, k: int) -> pa.Table:
    """The best ``k`` rows ``(at, vec_id, score)`` per query number ``at``, equal scores by id."""
    hits = hits.take(pc.sort_indices(hits, [("at", "ascending"), ("score", "descending"), ("vec_id", "ascending")]))
    at = hits.column("at").to_numpy()
    first = np.searchsorted(at, at)
    return hits.filter(pa.array(np.arange(len(at)) - first < k))


Allowed = Callable[[np.ndarray, np.ndarray], np.ndarray]
Seen = Callable[[np.ndarray, slice], np.ndarray]


def _unit(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of length one in single precision, and their lengths; rows without a direction are NaN."""
    norms = np.linalg.norm(rows, axis=1)
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(norms > 0, 1, np.nan).astype(np.float32)[:, None] * (rows / norms[:, None]).astype(np.float32), norms


def _pair_scores(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """The rounded score of each row of ``a`` with the same row of ``b``."""
    dots = np.einsum("ij,ij->i", a, b)
    if metric == "cosine":
        scores = dots / (np.linalg.norm(a, axis=1) * np.linalg.norm(b, axis=1))
    else:
        scores = 2 * dots - np.square(a).sum(1) - np.square(b).sum(1)
    return np.round(np.where(np.isnan(scores), -np.inf, scores), DECIMALS)


def _hits(
    queries: np.ndarray, vectors: np.ndarray, ids: pa.Array, k: int, metric: str,
    allowed: Allowed | None = None, least: np.ndarray | None = None, seen: Seen | None = None,
) -> pa.Table:
    """The best ``k`` of ``vectors``, known by ``ids``, for each query, and none below its ``least`` score.

    Vectors are taken in slices. A matrix product, for the cosine in single precision, tells which of
    a slice may be among the best so far, by a margin over its own error; only these are scored.
    ``allowed`` says which pairs of numbers of queries and vectors may be hits. ``seen`` says the same of some
    queries by a slice of vectors; with it, a query without a bound gets one from its rough scores.
    """
    least = np.full(len(queries), -np.inf) if least is None else least
    dim = vectors.shape[1] if len(vectors) else 0
    found: list[pa.Table] = []
    if metric == "cosine":
        left, right, margin = _unit(queries)[0], _unit(vectors)[0], (dim + 8) * 1.2e-7
    for start in range(0, len(queries), QUERY_SLICE):
        part = slice(start, min(start + QUERY_SLICE, len(queries)))
        low, best = least[part].copy(), None
        step = max(1, SLICE // (part.stop - start))
        bounds = _growing(len(vectors), step, k)
        for first, stop in zip(bounds, bounds[1:]):
            held = slice(first, stop)
            with np.errstate(invalid="ignore"):
                if metric == "cosine":
                    rough, off = left[part] @ right[held].T, margin
                else:
                    rough = _scores(queries[part], vectors[held], metric)
                    off = 2e-12 + (dim + 8) * 1e-15 * (np.square(queries[part]).sum(1)[:, None] + np.square(vectors[held]).sum(1).max())
                open_rows = np.flatnonzero(low == -np.inf)
                bound = (low[:, None] - off).astype(rough.dtype) if metric != "cosine" else (low[:, None] - 2 * off).astype(np.float32)
                if (allowed is None or seen is not None) and len(open_rows) and rough.shape[1] > k:
                    known = np.where(np.isnan(rough[open_rows]), -np.inf, rough[open_rows])
                    if seen is not None:
                        known[~seen(open_rows + start, held)] = -np.inf
                    kth = np.partition(known, -k, axis=1)[:, [-k]]
                    bound[open_rows] = kth - 2 * (off if metric == "cosine" else off[open_rows])
                # a bound above minus infinity leaves out what is no hit
                near = rough >= np.maximum(bound, np.finfo(rough.dtype).min)
                q, v = np.divmod(np.flatnonzero(near), rough.shape[1])
            if allowed is not None and len(q):
                keep = allowed(q + start, v + first)
                q, v = q[keep], v[keep]
            if not len(q):
                continue
            scores = np.concatenate([
                _pair_scores(queries[part][q[at : at + PAIRS]], vectors[held][v[at : at + PAIRS]], metric)
                for at in range(0, len(q), PAIRS)
            ])
            keep = (scores > -np.inf) & (scores >= low[q])
            q, v, scores = q[keep], v[keep], scores[keep]
            hits = pa.table({"at": pa.array(q + start, pa.int64()), "vec_id": ids.take(pa.array(v + first)), "score": pa.array(scores)})
            best = _best(hits if best is None else pa.concat_tables([best, hits]), k)
            low = np.maximum(low, _kth(best, part, k))
        if best is not None:
            found.append(best)
    if not found:
        return pa.table({"at": pa.array([], pa.int64()), "vec_id": ids[:0], "score": pa.array([], pa.float64())})
    return pa.concat_tables(found)


def _growing(rows: int, most: int, k: int) -> list[int]:
    """Bounds of slices that double up to ``most`` rows: a few rows give a first bound on the best ``k``."""
    bounds, step = [0], min(most, 64 * k)
    while bounds[-1] < rows:
        bounds.append(min(rows, bounds[-1] + step))
        step = min(most, 2 * step)
    return bounds


def _kth(best: pa.Table, part: slice, k: int) -> np.ndarray:
    """The score of the ``k``-th hit of each query of a slice; minus infinity with fewer hits."""
    at, scores = best.column("at").to_numpy(), best.column("score").to_numpy()
    out = np.full(part.stop - part.start, -np.inf)
    last = np.flatnonzero(np.arange(len(at)) - np.searchsorted(at, at) == k - 1)
    out[at[last] - part.start] = scores[last]
    return out


def _one(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def _checked(queries: DataFrame, vectors: DataFrame, metric: str) -> tuple[DataFrame, DataFrame, str]:
    if metric not in ("cosine", "l2"):
        raise ValueError(f"metric must be 'cosine' or 'l2', not {metric!r}")
    schema = HITS.format(
        query=queries.schema["query_id"].dataType.simpleString(),
        vec=vectors.schema["vec_id"].dataType.simpleString(),
    )
    return (
        queries.select("query_id", "embedding").dropna(),
        vectors.select("vec_id", "embedding").dropna(),
        schema,
    )


def _ranked(hits: DataFrame, k: int) -> DataFrame:
    return top_k(hits, ["query_id"], [F.desc("score"), F.asc("vec_id")], k).select(
        "query_id", "rank", "vec_id", "score"
    )


def vector_search(
    queries: DataFrame,
    vectors: DataFrame,
    k: int = 5,
    metric: str = "cosine",
    broadcast_queries: int = BROADCAST_QUERIES,
    query_rows: int | None = None,
    vector_rows: int | None = None,
) -> DataFrame:
    """The ``k`` nearest vectors of every query: ``(query_id, rank, vec_id, score)``.

    ``queries`` holds ``(query_id, embedding)``, ``vectors`` ``(vec_id, embedding)``. At most
    ``broadcast_queries`` queries, and BROADCAST_BYTES, are sent to a scan; more are dealt in a
    grid of blocks of about ``query_rows`` by ``vector_rows``, by default BLOCK_ROWS each. On
    either side MOST_BLOCKS blocks, or as many as have BROADCAST_BYTES, are the most: a row goes
    to every block of the other side, so small blocks of many rows would be copies without end.
    """
    return _searched(queries, vectors, k, metric, broadcast_queries, None, query_rows, vector_rows)


def _searched(
    queries: DataFrame,
    vectors: DataFrame,
    k: int,
    metric: str,
    at_once: int,
    codes: SignCodes | None,
    query_rows: int | None = None,
    vector_rows: int | None = None,
) -> DataFrame:
    queries, vectors, schema = _checked(queries, vectors, metric)
    size = queries.agg(F.count(F.lit(1)).alias("rows"), F.max(F.size("embedding")).alias("dim")).first()
    if not size.rows:
        return _ranked(vectors.sparkSession.createDataFrame([], schema), k)
    fitting = max(1, BROADCAST_BYTES // (8 * max(1, size.dim)))
    if size.rows <= min(at_once, fitting):
        return _ranked(_scan(queries.toArrow(), vectors, k, metric, schema, codes), k)
    query_blocks = _blocks(size.rows, query_rows or BLOCK_ROWS, fitting)
    vector_blocks = _blocks(vectors.count(), vector_rows or BLOCK_ROWS, fitting)
    return _ranked(
        grid_hits(
            queries.withColumns({"list": F.lit(0), "query_blocks": F.lit(query_blocks), "vector_blocks": F.lit(vector_blocks)}),
            vectors.withColumns({"list": F.lit(0), "query_blocks": F.lit(query_blocks), "vector_blocks": F.lit(vector_blocks)}),
            lambda wanted, held: _near(wanted, held, k, metric, codes),
            schema,
        ),
        k,
    )


def _blocks(rows: int, wanted: int, fitting: int) -> int:
    """How many blocks of about ``wanted`` rows there are, or of ``fitting`` ones where those were too many."""
    fewest = max(1, -(-rows // fitting))
    return max(1, min(max(-(-rows // wanted), fewest), max(MOST_BLOCKS, fewest)))


def _block(blocks: str, *columns: str) -> Column:
    """The block of a row: by its values and its input partition, so that copies spread as well."""
    return F.pmod(F.xxhash64(*columns, F.spark_partition_id()), F.col(blocks)).cast("int")


def _every(blocks: str) -> Column:
    return F.explode(F.sequence(F.lit(0), F.col(blocks) - 1))


def grid_hits(
    queries: DataFrame, vectors: DataFrame, near: Callable[[pa.Table, pa.Table], pa.Table], schema: str
) -> DataFrame:
    """What ``near`` finds in each cell of a grid: one block of queries with one block of vectors.

    Both sides carry ``list`` and, equal for all rows of a list, ``query_blocks`` and
    ``vector_blocks``. A query goes to every block of vectors of its list once, a vector to every
    block of queries. ``near`` gets the other columns of a cell's queries and vectors.
    """
    cell = ["list", "query_block", "vector_block"]
    sizes = ("list", "query_blocks", "vector_blocks")
    query_columns = [c for c in queries.columns if c not in sizes]
    vector_columns = [c for c in vectors.columns if c not in sizes]
    asked = queries.withColumn("query_block", _block("query_blocks", *query_columns))
    asked = asked.select("list", "query_block", _every("vector_blocks").alias("vector_block"), *query_columns)
    held = vectors.withColumn("vector_block", _block("vector_blocks", *vector_columns))
    held = held.select("list", _every("query_blocks").alias("query_block"), "vector_block", *vector_columns)

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        return near(left.select(query_columns), right.select(vector_columns))

    return asked.groupBy(*cell).cogroup(held.groupBy(*cell)).applyInArrow(meet, schema)


def _allowed(asked: np.ndarray, held: np.ndarray) -> Allowed:
    """Which pairs of rows of the codes of queries and of vectors agree in any table."""

    def allowed(q: np.ndarray, v: np.ndarray) -> np.ndarray:
        same = np.zeros(len(q), bool)
        for table in range(held.shape[1]):
            same |= asked[q, table] == held[v, table]
        return same

    return allowed


def _share_a_code(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Whether each row of codes agrees with each of the other ones in any table."""
    mask = np.zeros((len(left), len(right)), bool)
    for table in range(right.shape[1]):
        mask |= left[:, table][:, None] == right[:, table][None, :]
    return mask


def _near(wanted: pa.Table, held: pa.Table, k: int, metric: str, codes: SignCodes | None) -> pa.Table:
    """The best ``k`` vectors of a table for each query of a table."""
    ids, asked = _one(wanted.column("query_id")), _matrix(_one(wanted.column("embedding")))
    vec_ids = _one(held.column("vec_id"))
    if not len(ids) or not held.num_rows:
        return pa.table({"query_id": ids[:0], "vec_id": vec_ids[:0], "score": pa.array([], pa.float64())})
    vectors = _matrix(_one(held.column("embedding")))
    _same_length(asked, vectors)
    hits = _hits(asked, vectors, vec_ids, k, metric, _allowed(codes.of(asked), codes.of(vectors)) if codes else None)
    return _named(hits, ids)


def _same_length(queries: np.ndarray, vectors: np.ndarray) -> None:
    if queries.shape[1] != vectors.shape[1]:
        raise ValueError(f"vectors have unequal lengths: {sorted((queries.shape[1], vectors.shape[1]))}")


def _named(hits: pa.Table, ids: pa.Array) -> pa.Table:
    return pa.table({"query_id": ids.take(_one(hits.column("at"))), "vec_id": hits.column("vec_id"), "score": hits.column("score")})


def _scan(
    sent: pa.Table, vectors: DataFrame, k: int, metric: str, schema: str, codes: SignCodes | None
) -> DataFrame:
    query_ids = _one(sent.column("query_id"))
    shared = vectors.sparkSession.sparkContext.broadcast((query_ids, _matrix(_one(sent.column("embedding")))))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, wanted = shared.value
        if not len(ids):
            return
        own = codes.of(wanted) if codes else None
        best, least = None, np.full(len(ids), -np.inf)
        for batch in batches:
            if batch.num_rows:
                rows = _matrix(_one(batch.column("embedding")))
                _same_length(wanted, rows)
                allowed = _allowed(own, codes.of(rows)) if codes else None
                hits = _hits(wanted, rows, _one(batch.column("vec_id")), k, metric, allowed, least)
                best = _best(hits if best is None else pa.concat_tables([best, hits]), k)
                least = _kth(best, slice(0, len(ids)), k)
        if best is not None:
            yield from _named(best, ids).combine_chunks().to_batches()

    return vectors.mapInArrow(scan, schema)


def _narrow(codes: np.ndarray, bits: int) -> np.ndarray:
    """Codes in as few bytes as hold them; the fewer, the faster they are compared."""
    return codes.astype(np.uint8 if bits <= 8 else np.uint16 if bits <= 16 else np.int64)


class SignCodes:
    """Hash codes of vectors: in each of several tables, the signs of a few random projections."""

    def __init__(self, dim: int, tables: int, bits: int, seed: int) -> None:
        self.tables, self.bits = tables, bits
        self.planes = np.random.default_rng(seed).normal(size=(dim, tables * bits))

    def of(self, vectors: np.ndarray) -> np.ndarray:
        signs = (vectors @ self.planes > 0).reshape(len(vectors), self.tables, self.bits)
        return _narrow(signs @ (1 << np.arange(self.bits)), self.bits)


def _sign_codes(queries: DataFrame, tables: int, bits: int, seed: int) -> SignCodes:
    dim = queries.agg(F.max(F.size("embedding"))).first()[0] or 1
    return SignCodes(dim, tables, bits, seed)


def vector_search_lsh(
    queries: DataFrame,
    vectors: DataFrame,
    k: int = 5,
    metric: str = "cosine",
    tables: int = 8,
    bits: int = 4,
    seed: int = 7,
    broadcast_queries: int = BROADCAST_QUERIES,
) -> DataFrame:
    """Approximate :func:`vector_search`: only vectors that share a hash code are scored.

    Two vectors are candidates if in one of ``tables`` tables the signs of all ``bits`` random
    projections agree. Codes are compared where the vectors are scanned, so a pair that agrees
    in several tables is scored once and a code that many vectors share is no large group. More
    bits prune more, more tables find more.
    """
    return _searched(queries, vectors, k, metric, broadcast_queries, _sign_codes(queries, tables, bits, seed))


def lsh_candidates(
    queries: DataFrame, vectors: DataFrame, tables: int = 8, bits: int = 4, seed: int = 7
) -> DataFrame:
    """The distinct pairs ``(query_id, vec_id)`` that :func:`vector_search_lsh` scores.

    A pair meets in one cell of the grid of queries and vectors, so pairs are neither shuffled nor
    made distinct. To measure their share, :func:`lsh_counts` does not form them.
    """

    def near(ids: pa.Array, own: np.ndarray, vec_ids: pa.Array, held: np.ndarray) -> pa.Table:
        rows = max(1, SLICE // max(1, len(held)))
        found = [np.nonzero(_share_a_code(own[at : at + rows], held)) for at in range(0, len(own), rows)]
        q = np.concatenate([np.zeros(0, np.int64), *[part[0] + k * rows for k, part in enumerate(found)]])
        v = np.concatenate([np.zeros(0, np.int64), *[part[1] for part in found]])
        return pa.table({"query_id": ids.take(pa.array(q)), "vec_id": vec_ids.take(pa.array(v))})

    schema = "query_id {}, vec_id {}".format(*(df.schema[c].dataType.simpleString() for df, c in ((queries, "query_id"), (vectors, "vec_id"))))
    pairs = _coded_cells(queries, vectors, tables, bits, seed, near, schema)
    # cells hold rows, and a repeated id is one pair
    both = [df.select(c).dropna(subset=[c]) for df, c in ((queries, "query_id"), (vectors, "vec_id"))]
    repeated = any(not df.groupBy(df.columns[0]).count().where("count > 1").isEmpty() for df in both)
    return pairs.distinct() if repeated else pairs


def lsh_counts(
    queries: DataFrame, vectors: DataFrame, tables: int = 8, bits: int = 4, seed: int = 7
) -> DataFrame:
    """``(query_id, scored)``: how many ``vectors`` :func:`vector_search_lsh` scores for every query, equal rows once."""

    def near(ids: pa.Array, own: np.ndarray, vec_ids: pa.Array, held: np.ndarray) -> pa.Table:
        rows = max(1, SLICE // max(1, len(held)))
        found = [_share_a_code(own[at : at + rows], held).sum(axis=1) for at in range(0, len(own), rows)]
        counts = np.concatenate([np.zeros(0, np.int64), *found]).astype(np.int64)
        return pa.table({"query_id": ids, "scored": pa.array(counts)})

    schema = f"query_id {queries.schema['query_id'].dataType.simpleString()}, scored long"
    return _coded_cells(queries, vectors, tables, bits, seed, near, schema).groupBy("query_id").agg(F.sum("scored").alias("scored"))


def _coded_cells(
    queries: DataFrame, vectors: DataFrame, tables: int, bits: int, seed: int,
    near: Callable[[pa.Array, np.ndarray, pa.Array, np.ndarray], pa.Table], schema: str,
) -> DataFrame:
    """What ``near`` finds in each cell of the grid of the ids and codes of queries and vectors."""
    codes = _sign_codes(queries, tables, bits, seed)

    def coded(df: DataFrame, name: str) -> DataFrame:
        @F.arrow_udf("binary")
        def code(embeddings: pa.Array) -> pa.Array:
            own = codes.of(_matrix(embeddings)) if len(embeddings) else np.zeros((0, tables), np.int64)
            return pa.array([row.tobytes() for row in own.astype(np.int64)], pa.binary())

        return df.select(name, "embedding").dropna().select(name, code(F.col("embedding")).alias("code")).distinct()

    def matrix(column: pa.Array) -> np.ndarray:
        return _narrow(np.frombuffer(b"".join(column.to_pylist()), np.int64).reshape(len(column), tables), bits)

    def meet(wanted: pa.Table, held: pa.Table) -> pa.Table:
        ids, vec_ids = _one(wanted.column("query_id")), _one(held.column("vec_id"))
        return near(ids, matrix(_one(wanted.column("code"))), vec_ids, matrix(_one(held.column("code"))))

    asked, stored = coded(queries, "query_id"), coded(vectors, "vec_id")
    shape = {"list": F.lit(0)}
    for side, df in (("query_blocks", queries), ("vector_blocks", vectors)):
        shape[side] = F.lit(max(1, -(-df.count() // CODED_ROWS)))
    return grid_hits(asked.withColumns(shape), stored.withColumns(shape), meet, schema)
