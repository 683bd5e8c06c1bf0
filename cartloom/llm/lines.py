"""Line dedup: levelled sorted runs of line hashes.

A run is a table of (hash, number of documents, largest document) over one batch of
documents, sorted by hash inside its partitions. ``fan_in`` runs of one level are compacted
to one run of the next, so n batches leave at most fan_in * log(n) runs. A batch is compared
with what came before by a merge join of its sorted hashes with the runs, and then adds a run
of its own. Runs hold counts that can be added because no document is in two batches.

Two uses: :meth:`LineRuns.admit` drops a batch's lines that an earlier batch or document has
(incremental use), and :func:`frequent_lines` finds, over all batches, the lines that every
document but the largest one has to give up.

A line's key is the line without white space at both ends and with A-Z lower-cased; it is
compared by 128 bits of hash. Lines with shorter keys are never dropped. Defined results:
null text is one empty line; documents without id count for no line and keep all of theirs;
rows with one id count once as a document, and each keeps or loses its own lines.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from cartloom.llm.tables import SPACES, lower_ascii
from cartloom.session import materialize, scratch_path

MIN_CHARS = 40
MIN_DOCS = 5
BATCHES = 4
HASH = ("h1", "h2")


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return lower_ascii(F.btrim(line, F.lit(SPACES)))


def row_mark(text: Column) -> Column:
    """Tells apart rows of one id that have different texts."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def hashed_lines(documents: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, mark, pos, h1, h2) of every line whose key is long enough, of documents with an id."""
    lines = documents.where("doc_id IS NOT NULL").select(
        "doc_id", row_mark(F.col("text")).alias("mark"), F.posexplode(split_lines(F.col("text"))).alias("pos", "line")
    )
    keys = lines.select("doc_id", "mark", "pos", line_key(F.col("line")).alias("line_key"))
    return keys.where(F.length("line_key") >= min_chars).select(
        "doc_id", "mark", "pos", F.xxhash64("line_key").alias("h1"), F.xxhash64(F.lit(1), "line_key").alias("h2")
    )


class LineRuns:
    """Sorted runs of line hashes in a shared folder, by level."""

    def __init__(self, spark: SparkSession, fan_in: int = 4) -> None:
        self.spark, self.fan_in = spark, fan_in
        self.levels: list[list[DataFrame]] = []

    def add(self, lines: DataFrame) -> None:
        """Write the run of a batch of hashed lines, then compact what is full."""
        counted = lines.select("doc_id", *HASH).distinct().groupBy(*HASH).agg(
            F.count("*").alias("n_docs"), F.max("doc_id").alias("max_doc")
        )
        self._put(counted, 0)

    def _put(self, run: DataFrame, level: int) -> None:
        if len(self.levels) == level:
            self.levels.append([])
        self.levels[level].append(materialize(run.sortWithinPartitions(*HASH), f"lines-run-{level}"))
        if len(self.levels[level]) == self.fan_in:
            full, self.levels[level] = self.levels[level], []
            self._put(self._merged(full), level + 1)

    @staticmethod
    def _merged(runs: list[DataFrame]) -> DataFrame:
        return reduce(DataFrame.unionAll, runs).groupBy(*HASH).agg(
            F.sum("n_docs").alias("n_docs"), F.max("max_doc").alias("max_doc")
        )

    def all(self) -> DataFrame | None:
        """One row per hash over all runs; None before the first batch."""
        runs = [run for level in self.levels for run in level]
        return (self._merged(runs) if len(runs) > 1 else runs[0]) if runs else None

    def admit(self, lines: DataFrame) -> DataFrame:
        """The lines of a batch that no run and no smaller document of the batch has; adds the batch."""
        known = self.all()
        first = F.row_number().over(Window.partitionBy(*HASH).orderBy("doc_id", "pos"))
        new = lines if known is None else lines.join(known.select(*HASH), list(HASH), "left_anti")
        kept = materialize(new.withColumn("nth", first).where("nth = 1").drop("nth"), "lines-admitted")
        self.add(lines)
        return kept


def frequent_lines(documents: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS,
                   batches: int = BATCHES, fan_in: int = 4) -> DataFrame:
    """(doc_id, mark, pos) of the lines to drop: in at least ``min_docs`` documents, not in the largest."""
    spark = documents.sparkSession
    path = scratch_path(spark, "lines-hashed")
    hashed_lines(documents, min_chars).withColumn("batch", F.pmod(F.xxhash64("doc_id"), F.lit(batches))).write.partitionBy(
        "batch"
    ).parquet(path)
    schema = "doc_id long, mark long, pos int, h1 long, h2 long, batch long"
    lines = spark.read.schema(schema).parquet(path)
    runs = LineRuns(spark, fan_in)
    for batch in range(batches):
        runs.add(lines.where(F.col("batch") == batch))
    frequent = runs.all().where(F.col("n_docs") >= min_docs).select(*HASH, "max_doc")
    return lines.join(frequent, list(HASH)).where("doc_id <> max_doc").select("doc_id", "mark", "pos")


def _mask() -> Column:
    """Bytes with ``1`` at each of the sorted ``positions`` and ``0`` before and between them."""
    return F.expr(
        "cast(array_join(transform(positions, (p, i) -> concat(repeat('0', "
        "p - if(i = 0, -1, get(positions, i - 1)) - 1), '1')), '') as binary)"
    )


def drop_lines(documents: DataFrame, dropped: DataFrame) -> DataFrame:
    """Columns ``row`` (all of ``documents``), ``n_lines``, ``n_dropped`` and ``rest``, the text that stays."""
    marks = (
        dropped.distinct().groupBy(F.col("doc_id").alias("drop_id"), F.col("mark").alias("drop_mark"))
        .agg(F.sort_array(F.collect_list("pos")).alias("positions"))
        .select("drop_id", "drop_mark", F.size("positions").cast("long").alias("n"), _mask().alias("mask"))
    )
    rows = documents.select(F.struct(*documents.columns).alias("row"))
    same = (F.col("row.doc_id") == F.col("drop_id")) & (row_mark(F.col("row.text")) == F.col("drop_mark"))
    lines = split_lines(F.col("row.text"))
    kept = F.when(F.col("mask").isNull(), F.coalesce(F.col("row.text"), F.lit(""))).otherwise(
        F.array_join(F.filter(lines, lambda _, i: F.col("mask").substr(i + 1, F.lit(1)) != F.lit(b"1")), "\n")
    )
    return rows.join(marks, same, "left").select(
        "row", F.size(lines).cast("long").alias("n_lines"), F.coalesce("n", F.lit(0)).cast("long").alias("n_dropped"),
        kept.alias("rest"),
    )
