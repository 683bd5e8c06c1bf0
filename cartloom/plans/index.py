"""The chunk index of a file tree: list, cut, write, and report what was found."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from cartloom.functions import fixed_values as fixed
from cartloom.operators.corpus import index_files
from cartloom.session import materialize
from cartloom.sources.text import read_text_tree, write_chunks


def build_index(
    spark: SparkSession,
    root: str,
    path: str,
    extensions: Sequence[str] = fixed.TEXT_EXTENSIONS,
    skip_prefixes: Sequence[str] = fixed.TEXT_SKIP_PREFIXES,
    file_format: str = "parquet",
) -> DataFrame:
    """Write the chunks of all files below ``root`` to ``path``; returns the report.

    One row: ``files`` read, ``empty_files`` without a chunk, ``chunks`` written. Files are read once
    and counted on the way; code files are cut at headings, others by lines.
    """
    read = Observation()
    files = materialize(
        read_text_tree(spark, root, extensions, skip_prefixes).observe(
            read, F.count(F.lit(1)).alias("files"), F.count(F.when(F.length("text") == 0, True)).alias("empty")
        ),
        "index-files",
    )
    written = Observation()
    write_chunks(index_files(files).observe(written, F.count(F.lit(1)).alias("chunks")), path, file_format)
    counts = [(read.get["files"], read.get["empty"], written.get["chunks"])]
    return spark.createDataFrame(counts, "files long, empty_files long, chunks long")
