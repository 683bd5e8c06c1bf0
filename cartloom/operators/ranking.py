"""Top-k per key with a total order, and two-stage ranking."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def top_k(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    k: int,
    rank_col: str = "rank",
) -> DataFrame:
    """The first ``k`` rows per key, numbered from 1 in ``rank_col``.

    End ``order`` with a unique column so that ties are decided. Spark limits every
    group before the shuffle (WindowGroupLimit), so a key that holds a large share of
    the rows sends at most ``k`` rows per input task.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(window)).where(F.col(rank_col) <= k)


def rerank(
    df: DataFrame,
    keys: Sequence[str],
    cheap_order: Sequence[Column],
    n: int,
    order: Sequence[Column],
    k: int,
    rank_col: str = "rank",
) -> DataFrame:
    """Keep ``n`` rows per key by a cheap order, then the best ``k`` of those by ``order``.

    Both steps partition by ``keys``, so the second one sorts but does not shuffle.
    ``cheap_rank`` holds the rank of the first step.
    """
    pool = top_k(df, keys, cheap_order, n, "cheap_rank")
    return top_k(pool, keys, order, k, rank_col)
