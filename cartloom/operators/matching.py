"""Which terms occur in which texts, in the scan of the texts.

A handful of terms is inlined into the scan as literals. More terms travel to it in blocks
of checked size and meet the texts on shared grams of up to three characters: every term is
keyed by the one of its grams that the fewest terms hold, the distinct grams of a text are
looked up, and each pair that shares a key is tested in full. A text holds the key of a term
at most once, so a pair comes up once. Either way the text stays in its row: it is never
shuffled, and rows with null or equal keys are found like any others.
"""

from __future__ import annotations

from collections.abc import Callable, Collection, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from cartloom.session import materialize

LITERAL_TERMS = 32
LITERAL_CHARS = 65536
#: Characters of terms that are sent to the texts at once.
BLOCK_CHARS = 2_000_000
GRAM_SIZES = (3, 2)


def like_pattern(term: Column) -> Column:
    r"""``%term%`` in which ``%`` and ``_`` stay wildcards.

    A backslash escapes any character; before one that needs no escape it is dropped.
    """
    known = F.regexp_replace(term, r"(?s)(\\[%_\\])|\\(.)", "$1$2")
    return F.concat(F.lit("%"), known, F.lit("%"))


def term_matches(
    terms: DataFrame,
    texts: DataFrame,
    keys: Sequence[str],
    text: str,
    wildcards: bool = False,
    literal_terms: int = LITERAL_TERMS,
) -> DataFrame:
    """One row ``(term, *keys)`` for every row of ``texts`` and term of ``terms.term`` in its text.

    Comparison ignores case; with ``wildcards`` the characters ``%`` and ``_`` of a term match
    any text and any one character.
    """
    return term_hits(terms, texts, keys, [text], wildcards, literal_terms).select("term", *keys)


def term_hits(
    terms: DataFrame,
    texts: DataFrame,
    keys: Sequence[str],
    columns: Sequence[str],
    wildcards: bool = False,
    literal_terms: int = LITERAL_TERMS,
) -> DataFrame:
    """As :func:`term_matches` for several columns: ``(term, *keys, found)``.

    ``found`` holds one boolean per column; at least one of them is true.
    """
    match = F.like if wildcards else F.contains
    pattern = like_pattern(F.col("term")) if wildcards else F.col("term")
    terms = (
        terms.select("term")
        .where(F.col("term").isNotNull())
        .distinct()
        .select("term", F.lower(pattern).alias("pattern"), key_grams(F.col("term"), wildcards).alias("grams"))
    )
    # Written once: the terms are counted here and used below.
    terms = materialize(terms, "terms")
    size = terms.agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.sum(F.length("pattern")), F.lit(0)).alias("chars"),
        F.collect_set(F.length(F.col("grams")[0])).alias("kinds"),
    ).first()
    lowered = texts.select(*keys, F.array(*[F.lower(column) for column in columns]).alias("lowered"))
    if size.n <= literal_terms and size.chars <= LITERAL_CHARS:
        return _by_literals(terms, lowered, keys, match)
    return _by_grams(terms, lowered, keys, match, size.kinds, -(-size.chars // BLOCK_CHARS))


def found_in(match: Callable[[Column, Column], Column], pattern: Column) -> Column:
    return F.transform("lowered", lambda text: F.coalesce(match(text, pattern), F.lit(False)))


def _by_literals(
    terms: DataFrame, texts: DataFrame, keys: Sequence[str], match: Callable[[Column, Column], Column]
) -> DataFrame:
    """``terms`` has at most ``literal_terms`` rows here, checked by the caller."""
    hits = [
        F.struct(F.lit(row.term).alias("term"), found_in(match, F.lit(row.pattern)).alias("found"))
        for row in terms.collect()
    ]
    kind = "array<struct<term: string, found: array<boolean>>>"
    pairs = F.filter(F.array(*hits), lambda hit: F.exists(hit["found"], lambda x: x)) if hits else F.array()
    return texts.select(*keys, F.explode(pairs.cast(kind)).alias("hit")).select("hit.term", *keys, "hit.found")


def grams(lowered: Column, kinds: Collection[int] = (3, 2, 1, 0)) -> Column:
    """Distinct grams of a lower-cased text: runs of three and two characters, characters, and ``''``."""
    by_kind = {
        **{n: F.regexp_extract_all(lowered, F.lit(_gram(n)), F.lit(1)) for n in GRAM_SIZES},
        1: F.filter(F.split(lowered, ""), lambda char: char != ""),
        0: F.array(F.lit("")),
    }
    return F.array_distinct(F.concat(*[by_kind[kind] for kind in sorted(kinds)]))


def _gram(n: int) -> str:
    return f"(?s)(?=(.{{{n}}}))"


def key_grams(term: Column, wildcards: bool) -> Column:
    """Grams that every text with the term must hold: the longest kind that the term has."""
    lowered = F.lower(term)
    runs = F.split(lowered, r"[%_\\]+") if wildcards else F.array(lowered)
    single = F.filter(
        F.flatten(F.transform(runs, lambda run: F.split(run, ""))), lambda char: char != ""
    )
    found = F.when(F.size(single) > 0, single).otherwise(F.array(F.lit("")))
    for n in reversed(GRAM_SIZES):
        long = _runs_of(runs, n)
        found = F.when(F.size(long) > 0, long).otherwise(found)
    return F.array_distinct(found)


def _runs_of(runs: Column, n: int) -> Column:
    return F.flatten(F.transform(runs, lambda run: F.regexp_extract_all(run, F.lit(_gram(n)), F.lit(1))))


def _by_grams(
    terms: DataFrame,
    texts: DataFrame,
    keys: Sequence[str],
    match: Callable[[Column, Column], Column],
    kinds: Collection[int],
    blocks: int,
) -> DataFrame:
    """``kinds`` are the lengths of the grams that the terms use; no others are formed."""
    spread = terms.select("term", "pattern", F.explode("grams").alias("gram"))
    held = spread.groupBy("gram").agg(F.count(F.lit(1)).alias("terms"))
    keyed = materialize(
        spread.join(held, "gram").groupBy("term", "pattern").agg(F.min(F.struct("terms", "gram"))["gram"].alias("gram")),
        "keys",
    )
    all_grams = F.array_distinct(
        F.flatten(F.transform("lowered", lambda text: F.coalesce(grams(text, kinds), F.array().cast("array<string>"))))
    )
    looked_up = texts.select(*keys, "lowered", F.explode(all_grams).alias("gram"))
    parts = []
    for block in range(blocks):
        # BLOCK_CHARS bounds the expected size of each block
        own = keyed.where(F.pmod(F.xxhash64("term"), F.lit(blocks)) == block) if blocks > 1 else keyed
        pairs = looked_up.join(F.broadcast(own), "gram").select("term", *keys, found_in(match, F.col("pattern")).alias("found"))
        parts.append(pairs.where(F.exists("found", lambda x: x)))
    return reduce(DataFrame.unionAll, parts)
