"""Mixing sources to target weights: whole copies by repetition rate, one Bernoulli copy for the rest.

The size of a document is its number of words. Sources share ``share`` times the size of
everything by weight; no target exceeds ``most`` times its source's size, and what a capped
source leaves over goes to the others by weight until none is above. A document is emitted
floor(rate) times, plus once more if a number drawn from the hash of its id is below the
fraction of the rate.

The reshared targets are min(cap, level * weight) for one level, found from running totals
over the sources in the order in which they reach their caps.

Defined results: null text has size 0; the null source is a source of its own, last in order;
a source of size 0 has target 0 and takes nothing; rows with equal ids draw alike, and a null
id draws as the text ``null``; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from cartloom.llm.words import n_words
from cartloom.session import materialize

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
#: A table of at most so many sources, with names of so many characters in all, is broadcast.
BROADCAST_SOURCES, BROADCAST_CHARS = 10_000, 1 << 20


def draw(doc_id: Column, seed: str = "mix") -> Column:
    """A whole number below 2**32 that depends only on the id."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def targets(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """One row per source of a table of (source, size): source_size, target, rate."""
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    kinds = F.array(*[F.lit(w) for w in weights])
    ranked = sums.withColumn("weight", kinds[(F.row_number().over(order) - 1) % len(weights)])
    cap = F.col("source_size") * most
    by_ratio = Window.orderBy(cap / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    levels = ranked.select(
        "*",
        cap.alias("cap"),
        (
            (F.sum("source_size").over(everything) * share - F.coalesce(F.sum(cap).over(before), F.lit(0)))
            / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        ).alias("level"),
    )
    reached = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(
        (F.col("cap") / F.col("weight")).alias("ratio"), F.col("level").alias("level")
    ))).over(everything)
    target = F.least(F.col("cap").cast("double"), reached["level"] * F.col("weight"))
    return (
        levels.withColumn("target", F.coalesce(target, F.col("cap").cast("double")))
        .withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
        .select("source", "source_size", "target", "rate")
    )


def rates(sized: DataFrame, **how) -> DataFrame:
    """The targets, to be broadcast if they are few."""
    goal = materialize(targets(sized, **how), "mixing-targets")
    bound = goal.agg(F.count("*"), F.coalesce(F.sum(F.length("source")), F.lit(0))).first()
    few = bound[0] <= BROADCAST_SOURCES and bound[1] <= BROADCAST_CHARS
    goal = goal.withColumnRenamed("source", "rated_source")
    return F.broadcast(goal) if few else goal


def copies(doc_id: Column, rate: Column) -> Column:
    """How often a document is taken."""
    extra = draw(doc_id) < (rate - F.floor(rate)) * float(1 << 32)
    return F.floor(rate) + extra.cast("long")


def sized(documents: DataFrame) -> DataFrame:
    """doc_id, source and size of every document, written once."""
    return materialize(documents.select("doc_id", "source", n_words(F.col("text")).alias("size")), "mixing-sizes")


def taken(documents: DataFrame, **how) -> DataFrame:
    """doc_id, size, source_size, target and copies of every document; texts are read once."""
    own = sized(documents)
    goal = rates(own, **how)
    return own.join(goal, F.col("source").eqNullSafe(F.col("rated_source")), "left").select(
        "doc_id", "size", "source_size", "target", copies(F.col("doc_id"), F.col("rate")).alias("copies")
    )


def mix(documents: DataFrame, **how) -> DataFrame:
    """Every document as often as it is taken, with the number of the copy, from 1, in a last column ``copy``.

    If the documents have a column of that name, the new one is called ``mix_copy``, and so on.
    """
    name = "copy"
    while name.lower() in {c.lower() for c in documents.columns}:
        name = "mix_" + name
    goal = rates(sized(documents), **how)
    rows = documents.select(F.struct(*documents.columns).alias("row"))
    rows = rows.join(goal, F.col("row.source").eqNullSafe(F.col("rated_source")), "left")
    n = copies(F.col("row.doc_id"), F.col("rate"))
    return rows.select("row", F.explode(F.sequence(F.lit(1), F.greatest(n, F.lit(1)).cast("int"))).alias("n"), n.alias("most")).where(
        "n <= most"
    ).select(*[F.col("row")[c].alias(c) for c in documents.columns], F.col("n").alias(name))
