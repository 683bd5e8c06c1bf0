"""Connected components of a link table, by alternating stars.

Each round lets every node pass its smallest neighbour to its larger and then to its smaller
neighbours; the number of rounds grows with the logarithm of the longest path. Every round is
written to the shared folder, so a lost executor costs one round, and a node with many links
is aggregated before its shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartloom.session import materialize


def _star(links: DataFrame, smaller: bool) -> DataFrame:
    """One star step; ``smaller`` looks at smaller neighbours only."""
    around = links if smaller else links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = around.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
    seen = around.select("a", "b").join(least, "a")
    moved = seen.where("least <> b") if smaller else seen.where("b > a")
    out = moved.select(F.col("b").alias("a"), F.col("least").alias("b"))
    if smaller:
        out = out.unionAll(least.select("a", F.col("least").alias("b")))
    return out.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links (a, b)``; root is the smallest node of its component."""
    links = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    links, state = materialize(links, "links"), None
    while True:
        new = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if new == state or not new[0]:
            return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(
                links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
        state = new
        links = materialize(_star(_star(links, smaller=False), smaller=True), "links")
