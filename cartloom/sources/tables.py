"""Reading transactions and warehouse tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, types as T, functions as F

from cartloom import schemas

CORRUPT = "_corrupt_record"


def read_transactions(
    spark: SparkSession,
    path: str,
    schema: T.StructType = schemas.ORDER_LINES,
    mode: str = "PERMISSIVE",
    header: bool = True,
) -> DataFrame:
    """CSV rows in a declared schema.

    In ``PERMISSIVE`` mode a row that does not fit keeps its text in ``_corrupt_record``
    (see :func:`split_rejects`); ``DROPMALFORMED`` and ``FAILFAST`` are Spark's own.
    """
    reader = spark.read.option("header", header).option("mode", mode)
    if mode.upper() == "PERMISSIVE":
        schema = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
        reader = reader.option("columnNameOfCorruptRecord", CORRUPT)
    return reader.schema(schema).csv(path)


def split_rejects(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that fit their schema, and those that did not with their text in ``_corrupt_record``.

    The reader parses only columns that a query uses and finds no fault with the others.
    Both tests therefore use every column, by a hash that is true for any row, so that a
    row is good or bad whatever is selected from it later.
    """
    parsed = F.xxhash64(*[name for name in rows.columns if name != CORRUPT]) >= F.lit(-(2**63))
    good = rows.where(F.col(CORRUPT).isNull() & parsed).drop(CORRUPT)
    return good, rows.where(F.col(CORRUPT).isNotNull() & parsed)


def read_table(
    spark: SparkSession, folder: str, name: str, schema: T.StructType | None = None
) -> DataFrame:
    """A parquet table of a warehouse folder, checked against ``schema`` if one is given."""
    table = spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")
    return schemas.require(table, schema) if schema else table
