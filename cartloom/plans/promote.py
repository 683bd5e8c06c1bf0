"""Promotions: query, anchor, candidates, scored pairs, disjoint bundles, one row per query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cartloom import schemas
from cartloom.functions import fixed_values as fixed
from cartloom.functions.rules import Cuts
from cartloom.functions.scores import AddonWeights, AnchorWeights, penalty_exempt
from cartloom.operators.bundles import (
    anchor_record,
    candidate_sets,
    choose_anchor,
    decorate,
    render_bundles,
    score_candidates,
    score_pairs,
    select_disjoint,
)
from cartloom.operators.lookup import product_card, promo_candidates
from cartloom.operators.neighbours import NeighbourTable
from cartloom.session import materialize


def promote(
    queries: DataFrame,
    hits: DataFrame,
    products: DataFrame,
    velocity: DataFrame,
    affinity: DataFrame | NeighbourTable,
    cuts: Cuts = Cuts(),
    anchor_weights: AnchorWeights = AnchorWeights(),
    addon_weights: AddonWeights = AddonWeights(),
    family: Column | None = None,
    theme_rules=fixed.THEME_RULES,
) -> DataFrame:
    """One row per query: ``(query_id, user_query, anchor_id, anchor_name, status, bundles,
    result_text)``.

    ``status`` is ``ok``, ``no_anchor``, ``unknown_product``, ``no_candidates`` or
    ``no_bundles``; only ``ok`` rows have bundles. Bundles depend on the anchor and on
    whether the query lifts the add-on penalty, so they are worked out once for each such
    pair, however many queries share it. The chosen anchors are written to the shared folder
    first: everything after them starts from that table.
    """
    chosen = choose_anchor(queries, products, velocity, hits, anchor_weights)
    exempt = F.coalesce(penalty_exempt(F.col("user_query"), addon_weights), F.lit(False))
    asked = materialize(chosen.select("query_id", "user_query", "anchor_id", exempt.alias("exempt")), "asked")
    anchors = asked.where(F.col("anchor_id").isNotNull()).select("anchor_id", "exempt").distinct()
    planned = plan_anchors(
        anchors, products, velocity, affinity, cuts, addon_weights, family, theme_rules
    )
    empty = F.array().cast(planned.schema["bundles"].dataType)
    return asked.join(planned, ["anchor_id", "exempt"], "left").select(
        "query_id",
        "user_query",
        "anchor_id",
        "anchor_name",
        F.coalesce("status", F.lit("no_anchor")).alias("status"),
        F.coalesce("bundles", empty).alias("bundles"),
        F.coalesce("result_text", F.lit(fixed.TEXT_NO_ANCHOR)).alias("result_text"),
    )


def plan_anchors(
    anchors: DataFrame,
    products: DataFrame,
    velocity: DataFrame,
    affinity: DataFrame | NeighbourTable,
    cuts: Cuts = Cuts(),
    weights: AddonWeights = AddonWeights(),
    family: Column | None = None,
    theme_rules=fixed.THEME_RULES,
) -> DataFrame:
    """Bundles, status and text per ``(anchor_id, exempt)``."""
    ids = anchors.select("anchor_id").distinct()
    cards = (
        product_card(ids.select(F.col("anchor_id").alias("product_id")), products, velocity)
        .withColumn("anchor", anchor_record())
        .withColumnRenamed("product_id", "anchor_id")
        .select("anchor_id", "anchor", F.col("text").alias("card"))
    )
    asked = anchors.join(cards, "anchor_id")
    scored = score_candidates(
        promo_candidates(ids, affinity, products, velocity),
        asked.select(
            "anchor_id", "exempt", F.col("anchor.department_id").alias("anchor_department_id")
        ),
        weights,
    )
    sets = candidate_sets(scored, family=family)
    planned = asked.join(sets, ["anchor_id", "exempt"], "left")
    bundled = decorate(select_disjoint(score_pairs(planned, weights)), cuts, theme_rules)
    status = (
        F.when(F.col("anchor.total_units").isNull(), "unknown_product")
        .when(F.col("items").isNull(), "no_candidates")
        .when(F.size("bundles") == 0, "no_bundles")
        .otherwise("ok")
    )
    named = F.concat(
        F.lit("Anchor: "), F.coalesce("anchor.product_name", F.lit("(unknown)")), F.lit(". ")
    )
    text = (
        F.when(F.col("status") == "ok", render_bundles(F.col("bundles"), F.col("card")))
        .when(F.col("status") == "no_bundles", F.concat(named, F.lit(fixed.TEXT_NO_BUNDLES)))
        .otherwise(F.concat(named, F.lit(fixed.TEXT_NO_CANDIDATES)))
    )
    kind = f"array<{schemas.BUNDLE_STRUCT.simpleString()}>"
    return bundled.withColumn("status", status).select(
        "anchor_id",
        "exempt",
        F.col("anchor.product_name").alias("anchor_name"),
        "status",
        F.when(F.col("status") == "ok", F.col("bundles").cast(kind)).alias("bundles"),
        text.alias("result_text"),
    )


def flat_bundles(promoted: DataFrame) -> DataFrame:
    """One flat row per bundle of :func:`promote`, for reports and comparison."""
    bundle = F.col("bundle")
    first, second = bundle["add_ons"][0], bundle["add_ons"][1]
    return promoted.select(
        "query_id", "anchor_id", "status", F.explode_outer("bundles").alias("bundle")
    ).select(
        "query_id",
        "anchor_id",
        "status",
        bundle["rank"].alias("rank"),
        bundle["bundle_score"].alias("bundle_score"),
        bundle["theme"].alias("theme"),
        bundle["offer"].alias("offer"),
        bundle["confidence"].alias("confidence"),
        bundle["expected_impact"].alias("expected_impact"),
        F.array_join(bundle["placement"], ", ").alias("placement"),
        first["product_id"].alias("product_id_1"),
        second["product_id"].alias("product_id_2"),
        F.least(first["co_purchase_count"], second["co_purchase_count"]).alias("min_count"),
    )
