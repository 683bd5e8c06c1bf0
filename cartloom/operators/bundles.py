"""Promotion bundles: anchor choice, pair scores, disjoint selection, decoration, text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cartloom.functions import fixed_values as fixed
from cartloom.functions import rules
from cartloom.functions.rules import Cuts
from cartloom.functions.scores import AddonWeights, AnchorWeights, addon_score, anchor_score
from cartloom.functions.text import family_key, rate_text
from cartloom.operators.lookup import by_demand, search_by_name
from cartloom.operators.ranking import top_k


def choose_anchor(
    queries: DataFrame,
    products: DataFrame,
    velocity: DataFrame,
    hits: DataFrame,
    weights: AnchorWeights = AnchorWeights(),
    pool: int = fixed.ANCHOR_POOL,
) -> DataFrame:
    """The anchor product of every query: ``(query_id, user_query, anchor_id, source, score)``.

    The ``pool`` best sellers whose name contains the query are scored and the best one
    is taken; a query without any takes its first retrieved hit, from ``hits`` with
    ``(query_id, rank, product_id)``; without that either, the anchor is null. Each
    distinct query text is searched and scored once.
    """
    texts = queries.select(F.col("user_query").alias("query_id"), "user_query").dropna().distinct()
    scored = search_by_name(texts, products, velocity, pool).withColumn(
        "score",
        anchor_score(
            F.col("query_id"),
            F.col("product_name"),
            F.col("total_units"),
            F.col("reorder_rate"),
            weights,
        ),
    )
    best = top_k(
        scored.drop("rank"), ["query_id"], [F.desc("score"), *by_demand()], 1
    ).select(F.col("query_id").alias("user_query"), F.col("product_id").alias("by_name"), "score")
    first = hits.where(F.col("rank") == 1).select("query_id", F.col("product_id").alias("by_hit"))
    return (
        queries.select("query_id", "user_query")
        .join(best, "user_query", "left")
        .join(first, "query_id", "left")
        .select(
            "query_id",
            "user_query",
            F.coalesce("by_name", "by_hit").alias("anchor_id"),
            F.when(F.col("by_name").isNotNull(), "name")
            .when(F.col("by_hit").isNotNull(), "hit")
            .otherwise("none")
            .alias("source"),
            "score",
        )
    )


def score_candidates(
    candidates: DataFrame, anchors: DataFrame, weights: AddonWeights = AddonWeights()
) -> DataFrame:
    """Candidates with their ``relevance`` to the anchor.

    ``anchors`` holds ``(anchor_id, exempt, anchor_department_id)``: one row per anchor
    and per answer to whether the query lifts the penalty.
    """
    return candidates.join(anchors, "anchor_id").withColumn(
        "relevance",
        addon_score(
            F.col("co_purchase_count"),
            F.col("reorder_rate"),
            F.col("total_units"),
            F.col("department_id"),
            F.col("anchor_department_id"),
            F.col("product_name"),
            F.col("exempt"),
            weights,
        ),
    )


def candidate_sets(
    scored: DataFrame, n: int = fixed.PAIR_POOL, family: Column | None = None
) -> DataFrame:
    """The ``n`` most relevant candidates per anchor as one array, ``(anchor_id, exempt, items)``.

    From here on an anchor is one row: its at most ``n`` candidates, their pairs and the
    selected bundles are arrays worked out inside the row, without joins or shuffles.
    """
    family = family_key(F.col("product_name")) if family is None else family
    order = [F.desc("relevance"), F.asc("rank")]
    item = F.struct(
        "rk",
        "product_id",
        "product_name",
        "co_purchase_count",
        "reorder_rate",
        "total_units",
        "relevance",
        family.alias("family"),
    )
    return (
        top_k(scored, ["anchor_id", "exempt"], order, n, "rk")
        .groupBy("anchor_id", "exempt")
        .agg(F.sort_array(F.collect_list(item)).alias("items"))
    )


def score_pairs(sets: DataFrame, weights: AddonWeights = AddonWeights()) -> DataFrame:
    """Adds ``pairs``: all pairs of an anchor's items that differ in family, best first.

    A pair holds ``cost``, the negated score, and the items ``a`` and ``b``. The score is
    the sum of both relevances plus the synergy of the weaker count; equal scores keep
    the order of the items.
    """
    items = F.col("items")

    def pair(a: Column, b: Column) -> Column:
        weaker = F.least(a["co_purchase_count"], b["co_purchase_count"])
        score = a["relevance"] + b["relevance"] + F.lit(weights.synergy) * weaker
        return F.struct(
            (-score).alias("cost"),
            a["rk"].alias("rk_a"),
            b["rk"].alias("rk_b"),
            a.alias("a"),
            b.alias("b"),
            weaker.alias("min_count"),
        )

    def partners(a: Column, at: Column) -> Column:
        later = F.filter(
            F.slice(items, at + 2, F.size(items)), lambda b: ~b["family"].eqNullSafe(a["family"])
        )
        return F.transform(later, lambda b: pair(a, b))

    return sets.withColumn("pairs", F.sort_array(F.flatten(F.transform(items, partners))))


def select_disjoint(paired: DataFrame, m: int = fixed.BUNDLES_PER_ANCHOR) -> DataFrame:
    """Adds ``selected``: the best pairs that share no product, at most ``m``.

    Pairs are taken best first and skipped if a product was used before.
    """
    kind = paired.schema["pairs"].dataType.simpleString()

    def add(taken: Column, pair: Column) -> Column:
        ids = [pair["a"]["product_id"], pair["b"]["product_id"]]
        clash = F.exists(
            taken,
            lambda other: other["a"]["product_id"].isin(*ids) | other["b"]["product_id"].isin(*ids),
        )
        full = F.size(taken) >= m
        return F.when(full | clash, taken).otherwise(F.concat(taken, F.array(pair)))

    return paired.withColumn("selected", F.aggregate("pairs", F.array().cast(kind), add))


def anchor_record() -> Column:
    """The anchor part of a bundle, from card columns."""
    return F.struct(
        "product_id",
        "product_name",
        "aisle_id",
        "department_id",
        "reorder_rate",
        "total_units",
        "total_orders",
    )


def decorate(
    selected: DataFrame,
    cuts: Cuts = Cuts(),
    theme_rules=fixed.THEME_RULES,
    placement_rules=fixed.PLACEMENT_RULES,
) -> DataFrame:
    """Adds ``bundles``: the selected pairs as full records, for the row's ``anchor`` record."""
    anchor = F.col("anchor")
    rate, units = anchor["reorder_rate"], anchor["total_units"]

    def add_on(item: Column) -> Column:
        names = ("product_id", "product_name", "co_purchase_count", "reorder_rate", "total_units")
        return F.struct(*[item[name].alias(name) for name in names])

    def themed(pair: Column, at: Column) -> Column:
        names = F.array(pair["a"]["product_name"], pair["b"]["product_name"])
        return F.struct(
            pair.alias("pair"),
            at.alias("at"),
            rules.theme(anchor["product_name"], names, theme_rules).alias("theme"),
        )

    def bundle(row: Column) -> Column:
        pair = row["pair"]
        weaker = pair["min_count"]
        return F.struct(
            (row["at"] + 1).alias("rank"),
            F.round(-pair["cost"], 1).alias("bundle_score"),
            row["theme"].alias("theme"),
            rules.offer(rate, units, weaker, cuts).alias("offer"),
            rules.confidence(weaker, cuts).alias("confidence"),
            rules.expected_impact(rate, units, weaker, cuts).alias("expected_impact"),
            rules.placement(row["theme"], placement_rules).alias("placement"),
            anchor.alias("anchor"),
            F.array(add_on(pair["a"]), add_on(pair["b"])).alias("add_ons"),
        )

    return selected.withColumn("bundles", F.transform(F.transform("selected", themed), bundle))


def render_bundles(bundles: Column, card: Column) -> Column:
    """The promotion text for an anchor's card and its array of bundles."""

    def item_line(item: Column) -> Column:
        return F.concat(
            F.lit("   - "), item["product_name"],
            F.lit(" (affinity="), item["co_purchase_count"].cast("string"),
            F.lit(", rr="), rate_text(item["reorder_rate"]),
            F.lit(", units="), item["total_units"].cast("string"), F.lit(")"),
        )

    def block(bundle: Column) -> Column:
        def labelled(label: str, value: Column) -> Column:
            return F.concat(F.lit(f"   {label}: "), value)

        told = [bundle[name] for name in ("theme", "offer", "confidence", "expected_impact")]
        told.append(F.array_join(bundle["placement"], ", "))
        return F.concat_ws(
            "\n",
            F.concat(
                bundle["rank"].cast("string"),
                F.lit(fixed.TEXT_SCORE),
                bundle["bundle_score"].cast("decimal(20,1)").cast("string"),
            ),
            *(labelled(*pair) for pair in zip(fixed.TEXT_LABELS, told, strict=True)),
            F.concat(F.lit("   - "), bundle["anchor"]["product_name"], F.lit(fixed.TEXT_IS_ANCHOR)),
            item_line(bundle["add_ons"][0]),
            item_line(bundle["add_ons"][1]),
            F.lit(""),
        )

    return F.concat_ws(
        "\n",
        F.lit(fixed.TEXT_HEAD),
        F.lit(""),
        F.lit(fixed.TEXT_ANCHOR),
        card,
        F.lit(""),
        F.lit(fixed.TEXT_BUNDLES),
        F.array_join(F.transform(bundles, block), "\n"),
        *map(F.lit, fixed.TEXT_WHY),
    )
