"""A stored index of grams, for searching the same texts again and again.

The index holds the texts in numbered parts and, for every gram and part, the rows of the part
that hold the gram. A search reads the lists of a term's rarest grams, intersects them part by
part and tests what is left in full, so it reads lists and the parts with hits, not the texts.
Lists end at parts, so none grows with the number of texts. The rows found are those of
:func:`cartloom.operators.matching.term_hits` over the same texts.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cartloom.operators.matching import found_in, key_grams, like_pattern
from cartloom.operators.ranking import top_k
from cartloom.session import materialize

#: Rows of a part, a power of two.
PART_ROWS = 1 << 14
BUCKETS = 64
#: How many of a term's grams are looked up.
RAREST = 3
#: So many grams or parts, at most, become literals of a filter that prunes files.
LITERALS = 2000
#: Characters of text whose grams are formed at once, more only where one text alone is longer.
BLOCK_CHARS = 1 << 20
POSTINGS = "bucket int, gram string, part long, n int, places array<int>"


@dataclass(frozen=True)
class GramIndex:
    """A written index over ``columns`` of texts that are known by ``keys``."""

    spark: SparkSession
    path: str
    keys: tuple[str, ...]
    columns: tuple[str, ...]
    schema: str

    def texts(self) -> DataFrame:
        """``(part, place, *keys, *columns)`` of all texts."""
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/texts")

    def postings(self) -> DataFrame:
        """``(bucket, gram, part, n, places)``: the ``n`` rows of a part that hold a gram."""
        return self.spark.read.schema(POSTINGS).parquet(f"{self.path}/postings")

    def hits(self, terms: DataFrame, wildcards: bool = False, rarest: int = RAREST) -> DataFrame:
        """``(term, *keys, found)`` for every text that holds a term of ``terms.term``, ignoring case.

        ``found`` holds one boolean per column. With ``wildcards`` the characters ``%`` and
        ``_`` of a term match any text and any one character.
        """
        pattern = like_pattern(F.col("term")) if wildcards else F.col("term")
        asked = materialize(
            terms.select("term").where(F.col("term").isNotNull()).distinct().select(
                "term", F.lower(pattern).alias("pattern"), F.explode(key_grams(F.col("term"), wildcards)).alias("gram")
            ),
            "index-terms",
        )
        wanted = asked.select("gram").distinct()
        lists = _literals(self.postings(), wanted.select(_bucket().alias("value")), "bucket")
        lists = _literals(lists, wanted.select(F.col("gram").alias("value")), "gram")
        # a term with a gram that no text holds has no hit; for the others the rarest grams are enough
        held = lists.select("gram", "n").groupBy("gram").agg(F.sum("n").alias("rows"))
        counted = asked.join(held, "gram", "left")
        keyed = top_k(counted, ["term"], [F.asc_nulls_first("rows"), F.asc("gram")], rarest)
        chosen = keyed.groupBy("term", "pattern").agg(F.collect_list("gram").alias("grams"), F.count(F.lit(1)).alias("need"))
        spread = chosen.select("term", "pattern", "need", F.explode("grams").alias("gram"))
        common = (
            spread.join(lists, "gram")
            .groupBy("term", "pattern", "part")
            .agg(F.collect_list("places").alias("lists"), F.max("need").alias("need"))
            .where(F.size("lists") == F.col("need"))
            .select("term", "pattern", F.col("part").alias("in_part"), F.explode(_intersected()).alias("in_place"))
        )
        candidates = materialize(common, "index-candidates")
        parts = _literals(self.texts(), candidates.select(F.col("in_part").alias("value")).distinct(), "part")
        same = (F.col("part") == F.col("in_part")) & (F.col("place") == F.col("in_place"))
        lowered = F.array(*[F.lower(column) for column in self.columns]).alias("lowered")
        pairs = parts.select("part", "place", *self.keys, lowered).join(candidates, same)
        match = F.like if wildcards else F.contains
        tested = pairs.select("term", *self.keys, found_in(match, F.col("pattern")).alias("found"))
        return tested.where(F.exists("found", lambda x: x))

    def matches(self, terms: DataFrame, wildcards: bool = False) -> DataFrame:
        """``(term, *keys)`` of :meth:`hits`."""
        return self.hits(terms, wildcards).select("term", *self.keys)


def _bucket() -> Column:
    return F.pmod(F.xxhash64("gram"), F.lit(BUCKETS)).cast("int")


def _intersected() -> Column:
    rest = F.slice("lists", F.lit(2), F.greatest(F.size("lists") - 1, F.lit(0)))
    return F.aggregate(rest, F.col("lists")[0], F.array_intersect)


def _literals(df: DataFrame, values: DataFrame, column: str) -> DataFrame:
    """``df`` where ``column`` is one of ``values.value``: as literals if there are few, else by a join."""
    few = values.distinct().limit(LITERALS + 1).collect()
    if len(few) <= LITERALS:
        return df.where(F.col(column).isin(*[row.value for row in few]))
    return df.join(values.distinct(), F.col(column) == F.col("value"), "left_semi")


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(part, gram, places)`` of blocks of texts ``(part, place, lowered)``, the grams as
    :func:`cartloom.operators.matching.grams` forms them."""
    for batch in batches:
        parts, places = (batch.column(at).to_numpy() for at in (0, 1))
        order = np.lexsort((places, parts))
        parts, places, texts = parts[order], places[order], batch.column(2).take(pa.array(order)).to_pylist()
        ends = np.cumsum([len(text) for text in texts])
        first = 0
        while first < len(texts):
            before = ends[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(ends, before + BLOCK_CHARS, "right")))
            for size in range(4):
                yield _gram_rows(parts[first:last], places[first:last], texts[first:last], size)
            first = last


def _gram_rows(parts: np.ndarray, places: np.ndarray, texts: list[str], size: int) -> pa.RecordBatch:
    chars = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    own = np.repeat(np.arange(len(texts)), [len(text) for text in texts])
    if size == 0:
        grams, own = np.zeros(len(texts), np.uint64), np.arange(len(texts))
    else:
        n = max(0, len(chars) - size + 1)
        inside = np.flatnonzero(own[:n] == own[size - 1 :][:n])
        grams = _packed(chars, inside, size)
        # in Spark's regular expressions a run also begins at the second half of a character beyond 16 bits, written as ?
        halved = inside[chars[inside] > 0xFFFF] if size > 1 else inside[:0]
        mark = chars.copy()
        mark[halved] = ord("?")
        rest = grams[np.searchsorted(inside, halved)] - _packed(chars, halved, 1) + _packed(mark, halved, 1)
        grams, own = np.concatenate([grams, rest]), own[np.concatenate([inside, halved])]
    # rows come by part and place, so one sorted number orders grams, parts and places
    coded = pc.dictionary_encode(pa.array(grams))
    key = coded.indices.to_numpy().astype(np.int64)
    key *= len(texts)
    key += own
    key.sort()
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    number, row = np.divmod(key[new], len(texts))
    part = parts[row]
    new = np.ones(len(row), bool)
    new[1:] = (number[1:] != number[:-1]) | (part[1:] != part[:-1])
    starts = np.flatnonzero(new)
    lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(row)), pa.int32()), pa.array(places[row], pa.int32()))
    gram = _unpacked(coded.dictionary.to_numpy(), size).take(pa.array(number[starts]))
    return pa.RecordBatch.from_arrays([pa.array(part[starts]), gram, lists], names=["part", "gram", "places"])


def _packed(chars: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """The ``size`` characters from each place, 21 bits for each, the first in the lowest."""
    out = np.zeros(len(at), np.uint64)
    for k in range(size):
        out |= chars[at + k].astype(np.uint64) << np.uint64(21 * k)
    return out


def _unpacked(grams: np.ndarray, size: int) -> pa.Array:
    chars = np.stack([grams >> np.uint64(21 * k) & np.uint64(0x1FFFFF) for k in range(size)], 1) if size else grams[:, None][:, :0]
    width = 1 + (chars > 0x7F) + (chars > 0x7FF).astype(int) + (chars > 0xFFFF)
    data = chars.astype(np.uint32).tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")
    offsets = np.append(0, np.cumsum(width.sum(1))).astype(np.int32)
    return pa.StringArray.from_buffers(len(grams), pa.py_buffer(offsets), pa.py_buffer(data))


def build_gram_index(
    texts: DataFrame, keys: Sequence[str], columns: Sequence[str], path: str, part_rows: int = PART_ROWS
) -> GramIndex:
    """Write the index of ``columns`` of ``texts`` at a new folder ``path``.

    Rows may have null or equal keys and null texts; each is found by itself.
    """
    if part_rows < 1 or part_rows & (part_rows - 1):
        raise ValueError("part_rows must be a power of two")
    bits = part_rows.bit_length() - 1
    number = F.monotonically_increasing_id()
    stored = list(dict.fromkeys([*keys, *columns]))
    kinds = ", ".join(f"`{c}` {texts.schema[c].dataType.simpleString()}" for c in stored)
    index = GramIndex(texts.sparkSession, path, tuple(keys), tuple(columns), f"part long, place int, {kinds}")
    texts.select(*stored).withColumn("number", number).select(
        F.shiftright("number", bits).alias("part"), F.col("number").bitwiseAND(part_rows - 1).cast("int").alias("place"), *stored
    ).write.partitionBy("part").parquet(f"{path}/texts")
    lowered = F.explode(F.array(*[F.lower(column) for column in columns])).alias("lowered")
    (
        index.texts()
        .select("part", "place", lowered)
        .where(F.col("lowered").isNotNull())
        .mapInArrow(_listed, "part long, gram string, places array<int>")
        .groupBy("part", "gram")
        .agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("places")))).alias("places"))
        .withColumn("n", F.size("places"))
        .select(_bucket().alias("bucket"), "gram", "part", "n", "places")
        .repartitionByRange("bucket", "gram", "part")
        .sortWithinPartitions("bucket", "gram", "part")
        .write.partitionBy("bucket")
        .parquet(f"{path}/postings")
    )
    return index
