"""Product documents and the vector table over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from cartloom import schemas


def write_documents(documents: DataFrame, path: str) -> None:
    """Replace the documents at ``path``."""
    schemas.require(documents, schemas.DOCUMENTS).write.mode("overwrite").parquet(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """The documents at ``path``."""
    return spark.read.schema(schemas.DOCUMENTS).parquet(path)


def rebuild_vectors(documents: DataFrame, vectors: DataFrame, path: str) -> DataFrame:
    """Write ``(product_id, text, embedding)`` for every document with a vector to ``path``.

    ``path`` must be a new folder: it may not be one that the inputs are read from.
    Returns the load report: rows written and rows read back.
    """
    table = documents.join(vectors.select("product_id", "embedding"), "product_id")
    return write_counted(table, path)


def write_counted(df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` to a new folder and compare the rows counted on the way with a read-back."""
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("errorifexists").parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    return load_report(back, seen.get["rows"])


def load_report(df: DataFrame, written: int) -> DataFrame:
    """One row: rows written, rows found, and whether they agree."""
    return df.agg(F.count(F.lit(1)).alias("rows_found")).select(
        F.lit(written).cast("bigint").alias("rows_written"),
        "rows_found",
        (F.col("rows_found") == written).alias("complete"),
    )
