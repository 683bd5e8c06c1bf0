"""Small helpers shared by the operators of this package."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def lower_ascii(column: Column) -> Column:
    """A-Z become a-z; all other characters stay."""
    return F.translate(column, UPPER, LOWER)


def share_by_hash(df: DataFrame, key: str, limit: int, seed: int = 11) -> DataFrame:
    """All rows if there are at most ``limit``, else about ``limit`` of them by a hash of ``key``."""
    n = df.count()
    if n <= limit:
        return df
    return df.where(F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1 << 30)) < int((1 << 30) * limit / n))
