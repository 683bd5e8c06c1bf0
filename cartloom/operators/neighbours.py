"""Stored neighbours: the pair table both ways, in buckets of products, with the strongest beside it.

Both tables are bucketed by product, so a lookup meets them where they lie: only its keys are
shuffled, or sent if they are few. The ``strongest`` neighbours of each product are a table of
their own with their rank, which most lookups need alone; a hot product costs that many rows.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from cartloom.operators.ranking import top_k

STRONGEST = 50


@dataclass(frozen=True)
class NeighbourTable:
    """Tables ``name_all`` and ``name_best`` of the session's catalogue."""

    spark: SparkSession
    name: str
    strongest: int

    def all_pairs(self) -> DataFrame:
        """``(product_id, other_id, co_purchase_count)`` of every pair, both ways."""
        return self.spark.table(f"{self.name}_all")

    def best(self) -> DataFrame:
        """``(product_id, rank, other_id, co_purchase_count)`` of the strongest neighbours."""
        return self.spark.table(f"{self.name}_best")

    def of(self, keys: DataFrame, k: int) -> DataFrame:
        """``(product_id, rank, other_id, co_purchase_count)`` of the ``k`` strongest of each keyed product."""
        wanted = keys.select("product_id").distinct()
        if k <= self.strongest:
            return self.best().where(F.col("rank") <= k).join(wanted, "product_id")
        order = [F.desc("co_purchase_count"), F.asc("other_id")]
        return top_k(self.all_pairs().join(wanted, "product_id", "left_semi"), ["product_id"], order, k)

    def drop(self) -> None:
        """Forget the tables; their files stay."""
        for part in ("all", "best"):
            self.spark.sql(f"DROP TABLE IF EXISTS {self.name}_{part}")


def write_neighbours(
    affinity: DataFrame, products: DataFrame, path: str, strongest: int = STRONGEST, buckets: int | None = None
) -> NeighbourTable:
    """Write the neighbours of a pair table at a new folder ``path``.

    A neighbour that is not among ``products`` is left out. ``buckets`` are as many as the session's
    shuffle partitions; Spark shuffles tables of fewer.
    """
    spark = affinity.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = NeighbourTable(spark, f"neighbours_{uuid.uuid4().hex}", strongest)
    a, b = F.col("product_id_a"), F.col("product_id_b")
    ways = F.array(
        F.struct(a.alias("product_id"), b.alias("other_id")), F.struct(b.alias("product_id"), a.alias("other_id"))
    )
    known = products.select(F.col("product_id").alias("other_id")).distinct()
    both = affinity.select(F.inline(ways), "co_purchase_count").join(known, "other_id", "left_semi")
    # not dealt by product before it is written: a task writes a file per bucket, and a hot product stays spread
    _bucketed(both.select("product_id", "other_id", "co_purchase_count"), f"{table.name}_all", f"{path}/all", buckets)
    order = [F.desc("co_purchase_count"), F.asc("other_id")]
    best = top_k(table.all_pairs(), ["product_id"], order, strongest)
    _bucketed(
        best.select("product_id", "rank", "other_id", "co_purchase_count").repartition(buckets, "product_id"),
        f"{table.name}_best", f"{path}/best", buckets,
    )
    return table


def _bucketed(df: DataFrame, name: str, path: str, buckets: int) -> None:
    df.write.bucketBy(buckets, "product_id").sortBy("product_id").option("path", path).format("parquet").saveAsTable(name)
