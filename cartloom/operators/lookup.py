"""Catalogue lookups: demand signals, names, cards, neighbours, popular products."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cartloom.functions import fixed_values as fixed
from cartloom.functions.text import card_text, strip
from cartloom.operators.gram_index import GramIndex, build_gram_index
from cartloom.operators.matching import term_matches
from cartloom.operators.neighbours import NeighbourTable
from cartloom.operators.ranking import top_k


def with_demand(products: DataFrame, velocity: DataFrame) -> DataFrame:
    """Products with units, orders and reorder rate, zero where a product was never sold."""
    demand = velocity.select("product_id", "total_units", "total_orders", "reorder_rate")
    return products.join(demand, "product_id", "left").select(
        "product_id",
        "product_name",
        "aisle_id",
        "department_id",
        F.coalesce("total_units", F.lit(0)).alias("total_units"),
        F.coalesce("total_orders", F.lit(0)).alias("total_orders"),
        F.coalesce("reorder_rate", F.lit(0.0)).alias("reorder_rate"),
    )


def lookup(keys: DataFrame, df: DataFrame, on: str) -> DataFrame:
    """Rows of ``df`` whose ``on`` value is among the keys; repeated keys do not repeat rows.

    Keys are made distinct before the shuffle, so one that is repeated very often is not
    sent to a single task over and over.
    """
    return df.join(keys.select(on).distinct(), on, "left_semi")


def symmetric(affinity: DataFrame) -> DataFrame:
    """Both directions of the pair table from one scan: ``(product_id, other_id, count)``."""
    a, b = F.col("product_id_a"), F.col("product_id_b")
    ways = F.array(
        F.struct(a.alias("product_id"), b.alias("other_id")),
        F.struct(b.alias("product_id"), a.alias("other_id")),
    )
    return affinity.select(F.inline(ways), "co_purchase_count")


def _best_sellers_per_name(products: DataFrame, velocity: DataFrame, k: int) -> DataFrame:
    """The first ``k`` products of every name; a query needs no more than those of one name."""
    return top_k(
        with_demand(products, velocity).where(F.col("product_name").isNotNull()),
        ["product_name"],
        by_demand(),
        k,
        "name_rank",
    )


def by_demand() -> list[Column]:
    """Most sold first, then most reordered, then by id."""
    return [F.desc("total_units"), F.desc("reorder_rate"), F.asc("product_id")]


def find_by_exact_name(
    names: DataFrame, products: DataFrame, velocity: DataFrame, k: int = 5
) -> DataFrame:
    """Products whose name is one of a query's names, most sold first.

    ``names`` holds ``(query_id, product_name)``. The catalogue is cut to ``k`` products
    per requested name before the join, so a name that many products share costs ``k``
    rows per query.
    """
    names = names.select("query_id", "product_name").distinct()
    asked = lookup(names, products, "product_name")
    best = top_k(
        with_demand(asked, velocity),
        ["product_name"],
        [F.desc("total_units"), F.asc("product_id")],
        k,
        "name_rank",
    )
    return top_k(
        names.join(best, "product_name"),
        ["query_id"],
        [F.desc("total_units"), F.asc("product_id")],
        k,
    ).select("query_id", "rank", "product_id", "product_name", "total_units")


def name_index(products: DataFrame, path: str) -> GramIndex:
    """An index of the distinct product names, for :func:`search_by_name`."""
    names = products.select("product_name").dropna().distinct()
    return build_gram_index(names, ["product_name"], ["product_name"], path)


def search_by_name(
    queries: DataFrame,
    products: DataFrame,
    velocity: DataFrame,
    k: int = 15,
    escape: bool = False,
    index: GramIndex | None = None,
) -> DataFrame:
    """Products whose name contains the query, ignoring case, most sold first.

    ``queries`` holds ``(query_id, user_query)``; a blank query finds nothing. ``%`` and
    ``_`` in a query act as wildcards unless ``escape`` is set. Each distinct query text
    is matched once, against each distinct name once, and only the first ``k`` products
    of a name can be among the first ``k`` of a query. ``index``, from :func:`name_index`, saves the
    scan of the names.
    """
    asked = queries.select("query_id", strip(F.col("user_query")).alias("term")).where(
        F.col("term") != ""
    )
    if index is None:
        names = products.select("product_name").dropna().distinct()
        matches = term_matches(
            asked.select("term"), names, ["product_name"], "product_name", wildcards=not escape
        )
    else:
        matches = index.matches(asked.select("term"), wildcards=not escape)
    found = top_k(
        matches.join(_best_sellers_per_name(products, velocity, k), "product_name"),
        ["term"],
        by_demand(),
        k,
    )
    return asked.join(found, "term").select(
        "query_id", "rank", "product_id", "product_name", "total_units", "reorder_rate"
    )


def product_card(keys: DataFrame, products: DataFrame, velocity: DataFrame) -> DataFrame:
    """The card of every requested product; an unknown id gets a stub with no fields."""
    asked = keys.select("product_id").distinct()
    known = with_demand(products, velocity).withColumn("known", F.lit(True))
    stub = F.concat(F.lit("Product ID: "), F.col("product_id").cast("string"), F.lit(fixed.TEXT_UNKNOWN))
    return asked.join(known, "product_id", "left").select(
        "product_id",
        "product_name",
        "aisle_id",
        "department_id",
        "total_units",
        "total_orders",
        "reorder_rate",
        F.when(F.col("known"), _card()).otherwise(stub).alias("text"),
    )


def _card() -> Column:
    return card_text(
        F.col("product_id"),
        F.col("product_name"),
        F.col("aisle_id"),
        F.col("department_id"),
        F.col("total_units"),
        F.col("total_orders"),
        F.col("reorder_rate"),
    )


def build_documents(products: DataFrame, velocity: DataFrame) -> DataFrame:
    """One document ``(product_id, text)`` per product."""
    return with_demand(products, velocity).select("product_id", _card().alias("text"))


def strongest_neighbours(
    keys: DataFrame, affinity: DataFrame | NeighbourTable, products: DataFrame, k: int
) -> DataFrame:
    """The ``k`` known products most often bought with each keyed one, with name and department.

    ``affinity`` is the pair table, of which each direction is reduced to the keys where it is
    scanned, or the stored neighbours, which are not shuffled. Only ids and counts are cut to ``k``
    rows; names are joined to what is left.
    """
    other = products.select(
        F.col("product_id").alias("other_id"), "product_name", "department_id"
    )
    if isinstance(affinity, NeighbourTable):
        return affinity.of(keys, k).join(other, "other_id")
    wanted = keys.select(F.col("product_id").alias("wanted")).distinct()
    a, b = F.col("product_id_a"), F.col("product_id_b")

    def one_way(here: Column, there: Column) -> DataFrame:
        return affinity.join(wanted, here == F.col("wanted"), "left_semi").select(
            here.alias("product_id"), there.alias("other_id"), "co_purchase_count"
        )

    known = lookup(
        products.select(F.col("product_id").alias("other_id")),
        one_way(a, b).unionAll(one_way(b, a)),
        "other_id",
    )
    best = top_k(known, ["product_id"], [F.desc("co_purchase_count"), F.asc("other_id")], k)
    return best.join(other, "other_id")


def co_purchase(
    keys: DataFrame, affinity: DataFrame | NeighbourTable, products: DataFrame, k: int = 10
) -> DataFrame:
    """The ``k`` products most often bought together with each keyed product."""
    return strongest_neighbours(keys, affinity, products, k).select(
        "product_id", "rank", "other_id", "product_name", "co_purchase_count"
    )


def popular_alternatives(departments: DataFrame, velocity: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` most reordered, then most sold, products of each keyed department.

    Departments are cut to ``k`` rows before they meet the keys, so a department that
    holds much of the catalogue is never joined as a whole.
    """
    best = top_k(
        velocity,
        ["department_id"],
        [F.desc("reorder_rate"), F.desc("total_units"), F.asc("product_id")],
        k,
    )
    return lookup(departments, best, "department_id").select(
        "department_id", "rank", "product_id", "product_name", "total_units", "reorder_rate"
    )


def promo_candidates(
    anchors: DataFrame,
    affinity: DataFrame | NeighbourTable,
    products: DataFrame,
    velocity: DataFrame,
    k: int = fixed.CANDIDATE_POOL,
) -> DataFrame:
    """The ``k`` strongest co-purchased products of each anchor, with their demand.

    Demand is joined after the cut to ``k`` rows, so velocity meets the candidates and
    not every pair.
    """
    anchors = anchors.select(F.col("anchor_id").alias("product_id"))
    best = strongest_neighbours(anchors, affinity, products, k)
    demand = velocity.select(F.col("product_id").alias("other_id"), "total_units", "reorder_rate")
    return best.join(demand, "other_id", "left").select(
        F.col("product_id").alias("anchor_id"),
        "rank",
        F.col("other_id").alias("product_id"),
        "product_name",
        "department_id",
        "co_purchase_count",
        F.coalesce("total_units", F.lit(0)).alias("total_units"),
        F.coalesce("reorder_rate", F.lit(0.0)).alias("reorder_rate"),
    )
