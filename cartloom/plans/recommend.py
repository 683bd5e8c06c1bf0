"""Recommendations: query, product, products bought with it, or popular ones instead."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cartloom.functions import fixed_values as fixed
from cartloom.functions.text import rate_text
from cartloom.operators.lookup import (
    co_purchase,
    find_by_exact_name,
    popular_alternatives,
    product_card,
)
from cartloom.operators.matching import term_matches
from cartloom.operators.neighbours import NeighbourTable
from cartloom.session import materialize


def default_aliases(spark: SparkSession) -> DataFrame:
    """The fixed alias rules as a table ``(keyword, product_name)``."""
    return spark.createDataFrame(list(fixed.ALIASES), "keyword string, product_name string")


def choose_product(
    queries: DataFrame,
    hits: DataFrame,
    aliases: DataFrame,
    products: DataFrame,
    velocity: DataFrame,
) -> DataFrame:
    """The product of every query: ``(query_id, product_id, source)``.

    The best seller among the names that a keyword in the query stands for; without one
    the first retrieved hit; without that null. Each distinct query text is resolved once.
    """
    asked = queries.select("query_id", F.lower("user_query").alias("asked"))
    texts = asked.select("asked").dropna().distinct()
    matches = term_matches(
        aliases.select(F.col("keyword").alias("term")), texts, ["asked"], "asked"
    )
    names = matches.join(aliases, F.col("term") == F.col("keyword")).select(
        F.col("asked").alias("query_id"), "product_name"
    )
    named = (
        find_by_exact_name(names, products, velocity)
        .where(F.col("rank") == 1)
        .select(F.col("query_id").alias("asked"), F.col("product_id").alias("by_alias"))
    )
    first = hits.where(F.col("rank") == 1).select("query_id", F.col("product_id").alias("by_hit"))
    return (
        asked.join(named, "asked", "left")
        .join(first, "query_id", "left")
        .select(
            "query_id",
            F.coalesce("by_alias", "by_hit").alias("product_id"),
            F.when(F.col("by_alias").isNotNull(), "alias")
            .when(F.col("by_hit").isNotNull(), "hit")
            .otherwise("none")
            .alias("source"),
        )
    )


def recommend(
    queries: DataFrame,
    hits: DataFrame,
    aliases: DataFrame,
    products: DataFrame,
    velocity: DataFrame,
    affinity: DataFrame | NeighbourTable,
    k: int = 10,
) -> DataFrame:
    """Recommendations per query, at least one row for every query.

    ``source`` is ``co_purchase`` for products bought together with the chosen one,
    ``popular`` for popular ones of its department if there are none, ``no_pairs`` for
    neither, ``no_match`` if no product was found. Every distinct product is worked out
    once, however many queries choose it; the choices are written to the shared folder
    first, and everything after them starts from that table.
    """
    chosen = choose_product(queries, hits, aliases, products, velocity).select(
        "query_id", F.col("product_id").alias("chosen_id")
    )
    chosen = materialize(chosen, "chosen")
    keys = chosen.where(F.col("chosen_id").isNotNull()).select("chosen_id").distinct()
    together = co_purchase(
        keys.select(F.col("chosen_id").alias("product_id")), affinity, products, k
    ).select(
        F.col("product_id").alias("chosen_id"),
        F.lit("co_purchase").alias("source"),
        "rank",
        F.col("other_id").alias("product_id"),
        "product_name",
        "co_purchase_count",
    )
    # used twice: in the result, and to tell which products are without
    together = materialize(together, "together")
    alone = (
        keys.join(together, "chosen_id", "left_anti")
        .join(products.select(F.col("product_id").alias("chosen_id"), "department_id"), "chosen_id")
        .where(F.col("department_id").isNotNull())
    )
    popular = alone.join(popular_alternatives(alone, velocity, k), "department_id").select(
        "chosen_id",
        F.lit("popular").alias("source"),
        "rank",
        "product_id",
        "product_name",
        "total_units",
        "reorder_rate",
    )
    found = together.unionByName(popular, allowMissingColumns=True)
    nothing = F.when(F.col("chosen_id").isNull(), "no_match").otherwise("no_pairs")
    return chosen.join(found, "chosen_id", "left").select(
        "query_id",
        "chosen_id",
        F.coalesce("source", nothing).alias("source"),
        "rank",
        "product_id",
        "product_name",
        "co_purchase_count",
        "total_units",
        "reorder_rate",
    )


def render_recommendations(
    recommended: DataFrame, products: DataFrame, velocity: DataFrame, hits: DataFrame | None = None
) -> DataFrame:
    """One text per query, ``(query_id, chosen_id, text)``, from the rows of :func:`recommend`.

    A query has at most ``k`` recommendations, so its lines fit one array. ``hits`` with a column
    ``text`` are the retrieved documents: a query without a chosen product gets the first one, which
    then is a document that belongs to no product.
    """
    line = F.when(
        F.col("source") == "co_purchase",
        F.concat(
            F.lit("- "), F.col("product_name"),
            F.lit(" (co_purchase_count="), F.col("co_purchase_count").cast("string"), F.lit(")"),
        ),
    ).when(
        F.col("source") == "popular",
        F.concat(
            F.lit("- "), F.col("product_name"),
            F.lit(" (reorder_rate="), rate_text(F.col("reorder_rate")),
            F.lit(", units="), F.col("total_units").cast("string"), F.lit(")"),
        ),
    )
    grouped = recommended.groupBy("query_id", "chosen_id").agg(
        F.max("source").alias("source"),
        F.sort_array(F.collect_list(F.struct("rank", line.alias("line")))).alias("lines"),
    )
    cards = product_card(
        grouped.where(F.col("chosen_id").isNotNull()).select(F.col("chosen_id").alias("product_id")),
        products,
        velocity,
    ).select(F.col("product_id").alias("chosen_id"), "department_id", F.col("text").alias("card"))
    lines = F.array_join(F.transform("lines", lambda item: item["line"]), "\n")
    if hits is None:
        grouped = grouped.withColumn("top", F.lit(None).cast("string"))
    else:
        top = hits.where("rank = 1").groupBy("query_id").agg(F.min("text").alias("top"))
        grouped = grouped.join(top, "query_id", "left")
    no_product = (F.col("source") == "no_match") & F.col("top").isNotNull()
    return grouped.join(cards, "chosen_id", "left").select(
        "query_id",
        "chosen_id",
        F.when(no_product, F.concat(F.lit(fixed.TEXT_TOP_HIT + "\n"), F.col("top")))
        .when(F.col("source") == "no_match", F.lit(fixed.TEXT_NO_MATCH))
        .otherwise(F.concat_ws("\n", *_text_parts(lines)))
        .alias("text"),
    )


def _text_parts(lines: Column) -> list[Column]:
    chosen = F.col("chosen_id").cast("string")
    popular = F.col("source") == "popular"
    department = F.col("department_id").cast("string")
    heading = F.concat(
        F.lit(fixed.TEXT_POPULAR), department, F.lit("):")
    )
    return [
        F.lit(fixed.TEXT_CHOSEN),
        F.col("card"),
        F.lit(""),
        F.concat(
            F.lit(fixed.TEXT_TOGETHER),
            chosen,
            F.lit(":"),
        ),
        F.when(F.col("source") == "co_purchase", lines).otherwise(F.lit(fixed.TEXT_NO_PAIRS)),
        F.when(F.col("source") != "co_purchase", F.concat(F.lit("\n"), heading)),
        F.when(popular, lines),
    ]
