"""String expressions: product cards, product families, lines, hashes, paths."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from cartloom.functions import fixed_values as fixed

# Characters that end a line besides the line feed; CRLF counts as one break.
RARE_BREAKS = tuple(map(chr, (0x0D, 0x0B, 0x0C, 0x1C, 0x1D, 0x1E, 0x85, 0x2028, 0x2029)))
LINE_BREAK = "(?:\r\n|[\n" + "".join(RARE_BREAKS) + "])"


def split_lines(text: Column) -> Column:
    """The lines of ``text``: none for empty text, none after a final line break.

    Text with line feeds only, the usual case, is split on that one character, which is
    several times faster than the pattern of all breaks.
    """
    ends = F.endswith(text, F.lit("\n"))
    rare = F.lit(False)
    for char in RARE_BREAKS:
        ends = ends | F.endswith(text, F.lit(char))
        rare = rare | F.contains(text, F.lit(char))
    tail = F.when(F.endswith(text, F.lit("\r\n")), 2).when(ends, 1).otherwise(0)
    body = F.substring(text, 1, F.length(text) - tail)
    return (
        F.when(text == "", F.array().cast("array<string>"))
        .when(rare, F.split(body, LINE_BREAK, -1))
        .otherwise(F.split(body, "\n", -1))
    )


def rate_text(rate: Column) -> Column:
    """A rate with three decimals."""
    return rate.cast("decimal(10,3)").cast("string")


def card_text(
    product_id: Column,
    name: Column,
    aisle_id: Column,
    department_id: Column,
    units: Column,
    orders: Column,
    rate: Column,
) -> Column:
    """The five-line product card."""
    return F.concat_ws(
        "\n",
        F.concat(F.lit("Product ID: "), product_id.cast("string")),
        F.concat(F.lit("Name: "), name),
        F.concat(
            F.lit("Aisle ID: "), aisle_id.cast("string"),
            F.lit(" | Department ID: "), department_id.cast("string"),
        ),
        F.concat(
            F.lit("Demand: total_units="), units.cast("string"),
            F.lit(", total_orders="), orders.cast("string"),
            F.lit(", reorder_rate="), rate_text(rate),
        ),
        F.lit(fixed.CARD_USE),
    )


def family_key(
    name: Column,
    buckets: Sequence[tuple[str, str]] = fixed.FAMILY_BUCKETS,
    stop_words: Sequence[str] = fixed.FAMILY_STOP_WORDS,
) -> Column:
    """The family of a product name, so that a bundle does not hold two of a kind.

    A bucket keyword decides first. Otherwise the name without stop words, other
    characters than a-z and short words is the family.
    """
    lowered = F.lower(F.coalesce(name, F.lit("")))
    plain = lowered
    if stop_words:
        plain = F.regexp_replace(plain, rf"(?U)\b({'|'.join(stop_words)})\b", "")
    plain = F.regexp_replace(plain, r"(?U)[^a-z\s]", " ")
    words = F.filter(
        F.split(plain, r"(?U)\s+"), lambda word: F.length(word) >= fixed.FAMILY_MIN_WORD
    )
    rest = F.substring(F.array_join(words, " "), 1, fixed.FAMILY_MAX_CHARS)
    fallback = F.when(rest == "", F.lit(fixed.FAMILY_DEFAULT)).otherwise(rest)
    return first_match(
        [(F.contains(lowered, F.lit(word)), F.lit(family)) for word, family in buckets], fallback
    )


def first_match(cases: Sequence[tuple[Column, Column]], default: Column) -> Column:
    """The value of the first true condition, else ``default``."""
    if not cases:
        return default
    chain = F.when(*cases[0])
    for condition, value in cases[1:]:
        chain = chain.when(condition, value)
    return chain.otherwise(default)


def contains_any(text: Column, words: Sequence[str]) -> Column:
    """Whether any of ``words`` occurs in ``text``."""
    found = F.lit(False)
    for word in words:
        found = found | F.contains(text, F.lit(word))
    return found


def strip(text: Column) -> Column:
    """``text`` without white space of any kind at its ends."""
    return F.regexp_replace(text, r"(?U)\A\s+|\s+\z", "")


def normalise_query(query: Column) -> Column:
    """The stripped, lower-cased query."""
    return F.lower(strip(query))


def query_words(query: Column) -> Column:
    """The white-space separated words of the normalised query."""
    return F.filter(F.split(normalise_query(query), r"(?U)\s+"), lambda word: word != "")


def content_hash(*parts: Column, sep: str = "") -> Column:
    """SHA-256 over the parts; a null part counts as empty.

    The default puts nothing between the parts; pass
    ``sep`` to keep ("ab", "c") apart from ("a", "bc").
    """
    return F.sha2(F.concat_ws(sep, *[F.coalesce(part, F.lit("")) for part in parts]), 256)


def joined(names: Column) -> Column:
    """An array of names as one ``|``-joined string, for :func:`content_hash`."""
    return F.array_join(names, "|")


def file_stem(path: Column) -> Column:
    """The last path element without its last suffix; a leading dot starts no suffix."""
    name = F.regexp_extract(path, r"([^/]+)/*$", 1)
    return F.regexp_replace(name, r"(?<=.)\.[^.]+$", "")


def file_suffix(path: Column) -> Column:
    """The last suffix of a path, lower-cased, with its dot; empty if there is none."""
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)$", 1))
