"""Upkeep of the feature tables: new order lines are added as counted runs, old lines are not read.

A batch of lines becomes one run with three tables: the (order, product, customer) purchases that
were not known, units and orders per product and customer, and pair counts. Counts of runs are
added up, so velocity and affinity of all lines follow from the runs alone. Lines that come
late for a known order recount that order only: its pairs with the new lines less its pairs without.

``fan_in`` runs are compacted to one, whose counts are one row per key. A run is named by the
batches that it holds and counts when it is complete, so a batch that failed is written again under
its number.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from cartloom.operators.features import basket_affinity
from cartloom.session import materialize

PURCHASE = ("order_id", "product_id", "customer_id")
SCHEMAS = {
    "purchases": "order_id long, product_id long, customer_id long",
    "sales": "product_id long, customer_id long, units long, orders long",
    "pairs": "product_id_a long, product_id_b long, n long",
}


class FeatureRuns:
    """The runs in a shared folder."""

    def __init__(self, spark: SparkSession, folder: str, units: str = "count", fan_in: int = 8) -> None:
        if units not in ("count", "quantity"):
            raise ValueError(f"units must be 'count' or 'quantity', not {units!r}")
        self.spark, self.folder, self.units, self.fan_in = spark, folder, units, fan_in

    def _runs(self) -> list[tuple[int, int]]:
        """First and last batch of the complete runs in use: of those that begin alike the longest."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        files = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(path):
            return []
        longest: dict[int, int] = {}
        for status in files.listStatus(path):
            name = status.getPath().getName()
            # the pairs are written last
            if files.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}/pairs/_SUCCESS")):
                first, last = (int(part) for part in name.split("-"))
                longest[first] = max(last, longest.get(first, 0))
        out, at = [], 1
        while at in longest:
            out.append((at, longest[at]))
            at = longest[at] + 1
        return out

    def _table(self, name: str, runs: list[tuple[int, int]] | None = None) -> DataFrame:
        paths = [f"{self._path(run)}/{name}" for run in (self._runs() if runs is None else runs)]
        if not paths:
            return self.spark.createDataFrame([], SCHEMAS[name])
        return self.spark.read.schema(SCHEMAS[name]).parquet(*paths)

    def _path(self, run: tuple[int, int]) -> str:
        return f"{self.folder}/{run[0]:08d}-{run[1]:08d}"

    def add(self, lines: DataFrame) -> None:
        """Add a batch of ``(order_id, product_id, customer_id, quantity)``."""
        runs = self._runs()
        number = runs[-1][1] + 1 if runs else 1
        target = self._path((number, number))
        amount = F.count(F.lit(1)) if self.units == "count" else F.sum("quantity").cast("bigint")
        bought = materialize(
            lines.where(F.col("product_id").isNotNull()).groupBy(*PURCHASE).agg(amount.alias("units")), "upkeep-batch"
        )
        # what is known of the orders of this batch
        asked = bought.select(F.col("order_id").alias("asked_id")).distinct()
        known = materialize(
            self._table("purchases").join(asked, F.col("order_id").eqNullSafe(F.col("asked_id")), "left_semi"), "upkeep-known"
        )
        same = reduce(lambda a, b: a & b, [F.col(f"now.{c}").eqNullSafe(F.col(f"old.{c}")) for c in PURCHASE])
        new = materialize(bought.alias("now").join(known.alias("old"), same, "left_anti").select(*PURCHASE), "upkeep-new")
        new.write.mode("overwrite").parquet(f"{target}/purchases")
        orders = new.select("product_id", "customer_id", F.lit(0).cast("long").alias("units"), F.lit(1).cast("long").alias("orders"))
        sold = bought.select("product_id", "customer_id", F.coalesce("units", F.lit(0)).alias("units"), F.lit(0).cast("long").alias("orders"))
        self._summed("sales", sold.unionByName(orders)).write.mode("overwrite").parquet(f"{target}/sales")
        after, before = basket_affinity(known.unionByName(new)), basket_affinity(known)
        pairs = after.withColumnRenamed("co_purchase_count", "n").unionByName(
            before.select("product_id_a", "product_id_b", (-F.col("co_purchase_count")).alias("n"))
        )
        self._summed("pairs", pairs).where("n <> 0").write.mode("overwrite").parquet(f"{target}/pairs")
        self._compact()

    def _compact(self) -> None:
        """Put the last ``fan_in`` runs of one size together while there are so many."""
        runs = self._runs()
        while len(runs) >= self.fan_in:
            last = runs[-self.fan_in :]
            if len({b - a for a, b in last}) > 1:
                return
            target = self._path((last[0][0], last[-1][1]))
            for name in SCHEMAS:
                self._summed(name, self._table(name, last)).write.mode("overwrite").parquet(f"{target}/{name}")
            runs = self._runs()

    @staticmethod
    def _summed(name: str, rows: DataFrame) -> DataFrame:
        keys = {"sales": ("product_id", "customer_id"), "pairs": ("product_id_a", "product_id_b")}.get(name)
        if not keys:
            return rows
        return rows.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in rows.columns if c not in keys])

    def velocity(self, products: DataFrame) -> DataFrame:
        """The same rows as :func:`cartloom.operators.features.sku_velocity` over all lines added."""
        return (
            self._summed("sales", self._table("sales"))
            .groupBy("product_id")
            .agg(
                F.sum("units").alias("total_units"),
                F.sum("orders").alias("total_orders"),
                (F.sum(F.col("orders") - 1) / F.sum("orders")).alias("reorder_rate"),
            )
            .join(products.select("product_id", "product_name", "department_id"), "product_id")
            .select("product_id", "product_name", "department_id", "total_units", "total_orders", "reorder_rate")
        )

    def affinity(self, min_count: int = 1) -> DataFrame:
        """The same rows as :func:`cartloom.operators.features.basket_affinity` over all lines added."""
        counts = self._summed("pairs", self._table("pairs")).withColumnRenamed("n", "co_purchase_count")
        return counts.where(F.col("co_purchase_count") >= min_count)
