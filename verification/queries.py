"""One query per operator, each over whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cartloom.functions import rules, text
from cartloom.functions.rules import Cuts
from cartloom.functions.scores import AddonWeights, penalty_exempt
from cartloom.operators import (
    bundles, corpus, features, gram_index, graph, incremental, lookup, ranking, vector_index, vectors
)
from cartloom.operators.state_table import keyed_state
from cartloom.operators.upkeep import FeatureRuns
from cartloom.plans import index as indexing
from cartloom.plans import modules as pages
from cartloom.plans import promote as promotion
from cartloom.plans import recommend as recommendation
from cartloom.plans import retrieve as retrieval
from cartloom.session import materialize, scratch_path
from cartloom.sources import documents as store
from cartloom.sources import roles, runlog, tables
from cartloom.sources import text as text_files

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# Cut-offs, weights and theme words that suit the test tables.
CUTS = Cuts(
    discount=((80, "Save $1"), (71, "Save $2"), (64, "Save $3")),
    confidence=((80, "High"), (71, "Medium")),
    trial_rate=0.25,
    basket_affinity=80,
    basket_units=1000,
    attach_affinity=71,
)
WEIGHTS = AddonWeights(same_department=10.0, penalty=4.0, penalty_word="ring", exempt_words=("ring", "red"))
THEMES = (
    ("anchor", ("widget", "gizmo"), "Healthy Breakfast / Smoothie"),
    ("anchor", ("anvil",), "Fresh Prep / Cooking (Guac & Sides)"),
    ("items", ("gear", "rod"), "Snack & Beverage"),
)
ALIAS_WORDS = ("anvil", "bolt", "gear")
STEP = 5


def query(name: str) -> Callable[[Query], Query]:
    """Register a query under its key."""

    def add(function: Query) -> Query:
        QUERIES[name] = function
        return function

    return add


def query_of_grains(name: str) -> Callable:
    """Register a query of a grain of all parts as ``name``, with never-sold suppliers as ``name_wide``."""

    def add(function):
        QUERIES[name] = lambda spark, sf: function(spark, sf, "part")
        QUERIES[name + "_wide"] = lambda spark, sf: function(spark, sf, "wide")
        return function

    return add


def query_of_names(name: str) -> Callable:
    """Register a query over the products of distinct names as ``name``, over all products as ``name_wide``."""

    def add(function):
        QUERIES[name] = lambda spark, sf: function(spark, sf, "name")
        QUERIES[name + "_wide"] = lambda spark, sf: function(spark, sf, "wide")
        return function

    return add


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({column: F.round(column, digits) for column in columns})


def noun() -> Column:
    return F.split_part("product_name", F.lit(" "), F.lit(2))


# Feature tables


@query("f1_sku_velocity")
def f1(spark, sf):
    found = features.sku_velocity(roles.part_lines(spark, sf), roles.part_products(spark, sf))
    return rounded(found, "reorder_rate")


@query("f1_sku_velocity_quantity")
def f1_quantity(spark, sf):
    products = roles.part_products(spark, sf)
    found = features.sku_velocity(roles.part_lines(spark, sf), products, units="quantity")
    return rounded(found, "reorder_rate")


@query("f1_sku_velocity_names")
def f1_names(spark, sf):
    lines = roles.to_names(roles.part_lines(spark, sf), spark, sf)
    return rounded(features.sku_velocity(lines, roles.name_products(spark, sf)), "reorder_rate")


@query("f2_basket_affinity")
def f2(spark, sf):
    return features.basket_affinity(roles.part_baskets(spark, sf))


@query("f2_basket_affinity_names")
def f2_names(spark, sf):
    return features.basket_affinity(roles.to_names(roles.part_baskets(spark, sf), spark, sf))


@query("f2_basket_affinity_frequent")
def f2_frequent(spark, sf):
    return features.basket_affinity(roles.part_baskets(spark, sf), min_count=2)


@query("f2_basket_affinity_blocks")
def f2_blocks(spark, sf):
    return features.basket_affinity(roles.part_baskets(spark, sf), block=3)


def _runs(spark: SparkSession, sf: str) -> FeatureRuns:
    """A base of half of the lines and three batches; most orders have lines in several of them."""
    lines = roles.part_lines(spark, sf).withColumn("batch", F.pmod(F.xxhash64("order_id", "product_id", "quantity"), F.lit(6)))
    runs = FeatureRuns(spark, scratch_path(spark, "feature-runs"), fan_in=3)
    for own in ("batch < 3", "batch = 3", "batch = 4", "batch = 5"):
        runs.add(lines.where(own))
    return runs


@query("f1_sku_velocity_upkeep")
def f1_upkeep(spark, sf):
    return rounded(_runs(spark, sf).velocity(roles.part_products(spark, sf)), "reorder_rate")


@query("f2_basket_affinity_upkeep")
def f2_upkeep(spark, sf):
    return _runs(spark, sf).affinity()


@query("a5_calibrate")
def a5(spark, sf):
    house = roles.warehouse(spark, sf)
    found = features.calibrate(house.affinity, house.velocity)
    return rounded(found, *found.columns)


@query("a5_calibrate_parts")
def a5_parts(spark, sf):
    house = roles.warehouse(spark, sf, "part")
    found = features.calibrate(house.affinity, house.velocity)
    return rounded(found, *found.columns)


@query("a5_calibrate_sketches")
def a5_sketches(spark, sf):
    """Whether each cut-off from merged sketches has a rank within the error of its exact one."""
    house = roles.warehouse(spark, sf, "part")
    shard = F.pmod(F.xxhash64("product"), F.lit(5)).alias("shard")
    pairs = house.affinity.select(F.col("product_id_a").alias("product"), "co_purchase_count").select(shard, "co_purchase_count")
    sold = house.velocity.select(F.col("product_id").alias("product"), "total_units", "reorder_rate").select(
        shard, "total_units", "reorder_rate"
    )
    sketches = features.quantile_sketches(pairs, ["co_purchase_count"], ["shard"]).unionByName(
        features.quantile_sketches(sold, ["total_units", "reorder_rate"], ["shard"])
    )
    cuts = features.calibrate_sketches(sketches)
    wanted = (
        ("affinity_high", pairs, "co_purchase_count", 0.75), ("affinity_mid", pairs, "co_purchase_count", 0.5),
        ("affinity_low", pairs, "co_purchase_count", 0.25), ("units_mid", sold, "total_units", 0.5),
        ("rate_low", sold, "reorder_rate", 0.25),
    )
    error, out = 3 * features.rank_error(), None
    for name, rows, column, prob in wanted:
        at = cuts.select(F.col(name)).scalar()
        ranks = rows.select(column, at.alias("cut")).agg(
            F.avg((F.col(column) < F.col("cut")).cast("double")).alias("below"),
            F.avg((F.col(column) <= F.col("cut")).cast("double")).alias("upto"),
        )
        row = ranks.select(
            F.lit(name).alias("cut_off"), ((F.col("below") <= prob + error) & (F.col("upto") >= prob - error)).alias("within_error")
        )
        out = row if out is None else out.unionAll(row)
    return out


# Lookups


@query("s2_read_table")
def s2(spark, sf):
    return roles.part_products(spark, sf)


@query("j1_symmetric")
def j1(spark, sf):
    return lookup.symmetric(roles.warehouse(spark, sf).affinity)


@query("w1_top_k")
def w1(spark, sf):
    house = roles.warehouse(spark, sf)
    order = [F.desc("co_purchase_count"), F.asc("other_id")]
    return ranking.top_k(lookup.symmetric(house.affinity), ["product_id"], order, 5)


@query("o3_rerank")
def o3(spark, sf):
    house = roles.warehouse(spark, sf, "part")
    return rounded(
        ranking.rerank(
            lookup.with_demand(house.products, house.velocity),
            ["department_id"],
            [F.desc("total_units"), F.asc("product_id")],
            25,
            [F.desc("reorder_rate"), F.desc("total_units"), F.asc("product_id")],
            10,
        ),
        "reorder_rate",
    )


@query("p1_with_demand")
def p1(spark, sf):
    house = roles.warehouse(spark, sf, "part")
    return rounded(lookup.with_demand(house.products, house.velocity), "reorder_rate")


@query("p1_with_demand_wide")
def p1_wide(spark, sf):
    house = roles.warehouse(spark, sf, "wide")
    return rounded(lookup.with_demand(house.products, house.velocity), "reorder_rate")


@query("p2_lookup")
def p2(spark, sf):
    house = roles.warehouse(spark, sf, "part")
    baskets = roles.part_baskets(spark, sf)
    return rounded(lookup.lookup(baskets, house.velocity, "product_id"), "reorder_rate")


@query_of_grains("p3_exact_name")
def p3(spark, sf, grain):
    house = roles.warehouse(spark, sf, grain)
    asked = roles.queries(spark, sf).select("query_id", F.col("user_query").alias("product_name"))
    return lookup.find_by_exact_name(asked, house.products, house.velocity)


@query_of_grains("p4_search_by_name")
def p4(spark, sf, grain):
    house = roles.warehouse(spark, sf, grain)
    found = lookup.search_by_name(roles.queries(spark, sf), house.products, house.velocity)
    return rounded(found, "reorder_rate")


@query("p4_search_wildcards")
def p4_wildcards(spark, sf):
    house = roles.warehouse(spark, sf, "part")
    asked = roles.queries(spark, sf).select(
        "query_id", F.translate(F.upper("user_query"), " AE", "%_").alias("user_query")
    )
    return rounded(lookup.search_by_name(asked, house.products, house.velocity), "reorder_rate")


@query_of_grains("p4_search_indexed")
def p4_indexed(spark, sf, grain):
    """The index of names is written once and asked twice, by other queries the second time."""
    house = roles.warehouse(spark, sf, grain)
    index = lookup.name_index(house.products, scratch_path(spark, "name-index"))
    asked = roles.queries(spark, sf)
    both = (asked, asked.withColumn("user_query", F.translate(F.upper("user_query"), " AE", "%_")))
    found = [lookup.search_by_name(one, house.products, house.velocity, index=index) for one in both]
    return rounded(found[0].withColumn("run", F.lit(1)).unionByName(found[1].withColumn("run", F.lit(2))), "reorder_rate")


@query("p4_search_escaped")
def p4_escaped(spark, sf):
    house = roles.warehouse(spark, sf, "part")
    asked = roles.queries(spark, sf)
    found = lookup.search_by_name(asked, house.products, house.velocity, escape=True)
    return rounded(found, "reorder_rate")


@query("r2_co_purchase")
def r2(spark, sf):
    house = roles.warehouse(spark, sf)
    return lookup.co_purchase(house.products, house.neighbours, house.products)


@query("r2_co_purchase_parts")
def r2_parts(spark, sf):
    house = roles.warehouse(spark, sf, "part")
    return lookup.co_purchase(house.products, house.neighbours, house.products)


@query("r2_co_purchase_pairs")
def r2_pairs(spark, sf):
    """From the pair table itself, which is scanned once for each direction."""
    house = roles.warehouse(spark, sf, "part")
    return lookup.co_purchase(house.products, house.affinity, house.products)


@query("r2_co_purchase_many")
def r2_many(spark, sf):
    """More neighbours than are kept beside the pairs."""
    house = roles.warehouse(spark, sf)
    return lookup.co_purchase(house.products, house.neighbours, house.products, k=house.neighbours.strongest + 5)


@query("r3_popular_alternatives")
def r3(spark, sf):
    house = roles.warehouse(spark, sf, "part")
    return rounded(lookup.popular_alternatives(house.products, house.velocity), "reorder_rate")


@query_of_grains("r4_product_card")
def r4(spark, sf, grain):
    """Cards for every customer number: most are no product and give a stub."""
    house = roles.warehouse(spark, sf, grain)
    keys = house.products.select("product_id").unionAll(
        tables.read_table(spark, sf, "customer").select(F.col("c_custkey") + F.lit(1000000))
    )
    return rounded(lookup.product_card(keys, house.products, house.velocity), "reorder_rate")


@query_of_grains("d1_documents")
def d1(spark, sf, grain):
    house = roles.warehouse(spark, sf, grain)
    return lookup.build_documents(house.products, house.velocity)


# Column rules


@query("c1_card_text")
def c1(spark, sf):
    house = roles.warehouse(spark, sf)
    return lookup.build_documents(house.products, house.velocity)


@query("c2_family_key")
def c2(spark, sf):
    names = [
        tables.read_table(spark, sf, table).select(F.col(column).alias("name"))
        for table, column in (("part", "p_name"), ("nation", "n_name"), ("customer", "c_name"))
    ]
    name = F.col("name")
    return (
        names[0].unionAll(names[1]).unionAll(names[2]).distinct().select(
            name,
            text.family_key(name).alias("family"),
            text.family_key(name, (("ring", "rings"), ("old", "vintage")), ("large", "new")).alias(
                "family_of_rules"
            ),
        )
    )


@query("c3_theme")
def c3(spark, sf):
    """Themes of every pair of products bought together, under both rule tables."""
    house = roles.warehouse(spark, sf)
    names = house.products.select("product_id", "product_name")
    pairs = house.affinity.join(
        names.toDF("product_id_a", "anchor"), "product_id_a"
    ).join(names.toDF("product_id_b", "item"), "product_id_b")
    anchor, items = F.col("anchor"), F.array("item")
    return pairs.select(
        "anchor",
        "item",
        rules.theme(anchor, items, THEMES).alias("theme"),
        rules.theme(anchor, items).alias("default_theme"),
    )


def _pair_numbers(spark: SparkSession, sf: str) -> DataFrame:
    house = roles.warehouse(spark, sf)
    return house.affinity.join(
        house.velocity.withColumnRenamed("product_id", "product_id_a"), "product_id_a"
    )


@query("c4_discount")
def c4(spark, sf):
    count = F.col("co_purchase_count")
    return _pair_numbers(spark, sf).select(
        "product_id_a",
        "product_id_b",
        rules.discount(count, CUTS).alias("discount"),
        rules.discount(count * 400).alias("default_discount"),
    )


@query("c5_confidence")
def c5(spark, sf):
    count = F.col("co_purchase_count")
    return _pair_numbers(spark, sf).select(
        "product_id_a",
        "product_id_b",
        rules.confidence(count, CUTS).alias("confidence"),
        rules.confidence(count * 200).alias("default_confidence"),
    )


@query("c6_impact")
def c6(spark, sf):
    rate, units, count = F.col("reorder_rate"), F.col("total_units"), F.col("co_purchase_count")
    return _pair_numbers(spark, sf).select(
        "product_id_a",
        "product_id_b",
        rules.expected_impact(rate, units, count, CUTS).alias("impact"),
        rules.expected_impact(rate * 2.5, units * 50, count * 250).alias("default_impact"),
    )


@query("c7_offer")
def c7(spark, sf):
    rate, units, count = F.col("reorder_rate"), F.col("total_units"), F.col("co_purchase_count")
    return _pair_numbers(spark, sf).select(
        "product_id_a",
        "product_id_b",
        rules.offer(rate, units, count, CUTS).alias("offer"),
        rules.offer(rate * 2.5, units * 50, count * 400).alias("default_offer"),
    )


@query("c8_placement")
def c8(spark, sf):
    return c3(spark, sf).select(
        "anchor", "item", F.array_join(rules.placement(F.col("theme")), ", ").alias("placement")
    )


@query("c9_normalise_query")
def c9(spark, sf):
    asked = tables.read_table(spark, sf, "conversations")
    return asked.select(
        "conv_id",
        "turn",
        text.normalise_query(F.col("text")).alias("normalised"),
        F.size(text.query_words(F.col("text"))).alias("words"),
        (F.size(text.query_words(F.col("text"))) == 1).alias("one_word"),
    )


@query("c11_content_hash")
def c11(spark, sf):
    docs = tables.read_table(spark, sf, "documents")
    parts = F.col("text"), F.col("lang"), F.col("source")
    return docs.select(
        "doc_id",
        text.content_hash(*parts).alias("hash"),
        text.content_hash(*parts, sep="|").alias("separated_hash"),
    )


@query("c11_content_hash_lists")
def c11_lists(spark, sf):
    """Text, callers and callees, the lists joined: customers of a nation, and regions of its number."""
    nations = tables.read_table(spark, sf, "nation")
    buyers = tables.read_table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(
        F.sort_array(F.collect_list("c_name")).alias("callers")
    )
    areas = tables.read_table(spark, sf, "region").groupBy(F.col("r_regionkey").alias("n_nationkey")).agg(
        F.collect_list("r_name").alias("callees")
    )
    parts = nations.join(buyers, "n_nationkey", "left").join(areas, "n_nationkey", "left")
    lists = [text.joined(F.col("callers")), text.joined(F.col("callees"))]
    return parts.select("n_nationkey", text.content_hash(F.col("n_name"), *lists).alias("hash"))


@query("c12_file_stem")
def c12(spark, sf):
    pages = tables.read_table(spark, sf, "pages")
    return pages.select("page_id", text.file_stem(F.col("url")).alias("stem"))


# Promotion


def _anchors(spark: SparkSession, sf: str, grain: str = "name") -> DataFrame:
    return roles.warehouse(spark, sf, grain).products.select(F.col("product_id").alias("anchor_id"))


def _candidates(spark: SparkSession, sf: str, grain: str = "name") -> DataFrame:
    house = roles.warehouse(spark, sf, grain)
    return lookup.promo_candidates(
        _anchors(spark, sf, grain), house.neighbours, house.products, house.velocity
    )


def _scored(spark: SparkSession, sf: str, grain: str) -> DataFrame:
    anchors = roles.warehouse(spark, sf, grain).products.select(
        F.col("product_id").alias("anchor_id"),
        penalty_exempt(F.col("product_name"), WEIGHTS).alias("exempt"),
        F.col("department_id").alias("anchor_department_id"),
    )
    return bundles.score_candidates(_candidates(spark, sf, grain), anchors, WEIGHTS)


def _pairs(spark: SparkSession, sf: str, grain: str) -> DataFrame:
    sets = bundles.candidate_sets(_scored(spark, sf, grain), family=noun())
    return bundles.score_pairs(sets, WEIGHTS)


def _hits(spark: SparkSession, sf: str, grain: str = "name") -> DataFrame:
    products = roles.warehouse(spark, sf, grain).products
    return retrieval.retrieve(
        roles.query_vectors(spark, sf), roles.product_vectors(spark, sf, products)
    )


@query("b1_candidates")
def b1(spark, sf):
    return rounded(_candidates(spark, sf), "reorder_rate")


@query("b1_candidates_wide")
def b1_wide(spark, sf):
    house = roles.warehouse(spark, sf, "wide")
    anchors = house.products.select(F.col("product_id").alias("anchor_id"))
    found = lookup.promo_candidates(anchors, house.affinity, house.products, house.velocity)
    return rounded(found, "reorder_rate")


@query_of_names("b2_anchor")
def b2(spark, sf, grain):
    house = roles.warehouse(spark, sf, grain)
    chosen = bundles.choose_anchor(
        roles.queries(spark, sf), house.products, house.velocity, _hits(spark, sf, grain)
    )
    return rounded(chosen.drop("user_query"), "score")


@query_of_names("b3_addon_score")
def b3(spark, sf, grain):
    return rounded(
        _scored(spark, sf, grain).select("anchor_id", "product_id", "exempt", "relevance"), "relevance"
    )


@query_of_names("b4_pairs")
def b4(spark, sf, grain):
    return (
        _pairs(spark, sf, grain)
        .select("anchor_id", F.explode("pairs").alias("pair"))
        .select(
            "anchor_id",
            F.col("pair.a.product_id").alias("product_id_1"),
            F.col("pair.b.product_id").alias("product_id_2"),
            F.round(-F.col("pair.cost"), 6).alias("score"),
        )
    )


@query_of_names("b5_disjoint")
def b5(spark, sf, grain):
    return (
        bundles.select_disjoint(_pairs(spark, sf, grain))
        .select("anchor_id", F.posexplode("selected").alias("at", "pair"))
        .select(
            "anchor_id",
            (F.col("at") + 1).alias("rank"),
            F.col("pair.a.product_id").alias("product_id_1"),
            F.col("pair.b.product_id").alias("product_id_2"),
            F.round(-F.col("pair.cost"), 6).alias("score"),
        )
    )


@query_of_names("b6_decorate")
def b6(spark, sf, grain):
    house = roles.warehouse(spark, sf, grain)
    cards = lookup.product_card(house.products, house.products, house.velocity).select(
        F.col("product_id").alias("anchor_id"), bundles.anchor_record().alias("anchor")
    )
    selected = bundles.select_disjoint(_pairs(spark, sf, grain)).join(cards, "anchor_id")
    bundle = F.col("bundle")
    return (
        bundles.decorate(selected, CUTS, THEMES)
        .select("anchor_id", F.explode("bundles").alias("bundle"))
        .select(
            "anchor_id",
            *[
                bundle[name].alias(name)
                for name in ("rank", "bundle_score", "theme", "offer", "confidence", "expected_impact")
            ],
            F.array_join(bundle["placement"], ", ").alias("placement"),
            bundle["anchor"]["product_name"].alias("anchor_name"),
            bundle["add_ons"][0]["product_name"].alias("name_1"),
            bundle["add_ons"][1]["product_name"].alias("name_2"),
        )
    )


def _promoted(spark: SparkSession, sf: str, grain: str = "name") -> DataFrame:
    house = roles.warehouse(spark, sf, grain)
    return promotion.promote(
        roles.queries(spark, sf),
        _hits(spark, sf, grain),
        house.products,
        house.velocity,
        house.neighbours,
        cuts=CUTS,
        addon_weights=WEIGHTS,
        family=noun(),
        theme_rules=THEMES,
    )


@query("b7_render")
def b7(spark, sf):
    return _promoted(spark, sf).select("query_id", "status", "result_text")


@query("b8_promote")
def b8(spark, sf):
    return promotion.flat_bundles(_promoted(spark, sf))


@query("b8_promote_wide")
def b8_wide(spark, sf):
    """Every part and supplier as a product; suppliers have no candidates."""
    return promotion.flat_bundles(_promoted(spark, sf, "wide"))


@query("b8_statuses")
def b8_statuses(spark, sf):
    """All products and some unknown keys as anchors, over so few pairs that many have one candidate or none."""
    house = roles.warehouse(spark, sf, "wide")
    few = house.affinity.where("(product_id_a * 31 + product_id_b) % 60 = 0")
    unknown = tables.read_table(spark, sf, "nation").select((-F.col("n_nationkey") - 1).cast("long").alias("anchor_id"))
    anchors = _anchors(spark, sf, "wide").unionAll(unknown).withColumn("exempt", F.col("anchor_id") % 2 == 0)
    planned = promotion.plan_anchors(
        anchors, house.products, house.velocity, few, CUTS, WEIGHTS, family=noun(), theme_rules=THEMES
    )
    return planned.select(
        "anchor_id", "exempt", "status", F.greatest(F.size("bundles"), F.lit(0)).alias("n_bundles"),
        F.when(F.col("status") != "ok", F.col("result_text")).alias("message"),
    )


@query("b7_render_wide")
def b7_wide(spark, sf):
    return _promoted(spark, sf, "wide").select("query_id", "status", "result_text")


# Retrieval and recommendation


@query("v1_vector_search")
def v1(spark, sf):
    table = tables.read_table(spark, sf, "embeddings")
    asked = table.select(F.col("vec_id").alias("query_id"), "embedding")
    return rounded(vectors.vector_search(asked, table), "score")


@query("v1_vector_search_blocks")
def v1_blocks(spark, sf):
    table = tables.read_table(spark, sf, "embeddings")
    asked = table.select(F.col("vec_id").alias("query_id"), "embedding")
    return rounded(vectors.vector_search(asked, table, broadcast_queries=7, query_rows=300, vector_rows=400), "score")


@query("v1_search_documents")
def v1_documents(spark, sf):
    house = roles.warehouse(spark, sf, "part")
    found = retrieval.search_documents(
        roles.query_vectors(spark, sf),
        roles.product_vectors(spark, sf, house.products),
        lookup.build_documents(house.products, house.velocity),
    )
    return rounded(found, "score")


@query("v2_vector_lsh")
def v2(spark, sf):
    table = tables.read_table(spark, sf, "embeddings")
    asked = table.select(F.col("vec_id").alias("query_id"), "embedding")
    return rounded(vectors.vector_search_lsh(asked, table), "score")


@query("v2_lsh_quality")
def v2_quality(spark, sf):
    """Whether hashing keeps enough of the exact hits and prunes enough of all pairs."""
    table = tables.read_table(spark, sf, "embeddings")
    asked = table.select(F.col("vec_id").alias("query_id"), "embedding")
    exact = vectors.vector_search(asked, table).select("query_id", "vec_id")
    near = vectors.vector_search_lsh(asked, table).select("query_id", "vec_id")
    found = exact.join(near, ["query_id", "vec_id"]).agg(F.count("*").alias("found"))
    scored = vectors.lsh_counts(asked, table).agg(F.sum("scored").alias("scored"))
    total = table.agg((F.count("*") * F.count("*")).alias("pairs"))
    asked_for = exact.agg(F.count("*").alias("wanted"))
    return total.select(
        (found.scalar() >= asked_for.scalar() * 0.65).alias("recall_reached"),
        (scored.scalar() <= F.col("pairs") * 0.45).alias("share_kept"),
    )


def _index(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, vector_index.VectorIndex]:
    """All vectors as queries, all vectors, and an inverted file of them."""
    table = tables.read_table(spark, sf, "embeddings")
    asked = table.select(F.col("vec_id").alias("query_id"), "embedding")
    return asked, table, vector_index.build_index(table, scratch_path(spark, "vector-index"))


@query("v2_vector_index")
def v2_index(spark, sf):
    asked, _, index = _index(spark, sf)
    return rounded(vector_index.search_index(asked, index), "score")


@query("v2_vector_index_all_lists")
def v2_index_all(spark, sf):
    """Every list is probed and every code may be read in full, so the result is exact."""
    asked, table, index = _index(spark, sf)
    found = vector_index.search_index(asked, index, probes=index.lists, rerank=table.count())
    return rounded(found, "score")


@query("v2_index_quality")
def v2_index_quality(spark, sf):
    """Recall of the five nearest, and what is read of all vectors: in full, and with codes an eighth as large."""
    asked, table, index = _index(spark, sf)
    # both are used twice
    exact = materialize(vectors.vector_search(asked, table).select("query_id", "vec_id"), "exact-hits")
    best = materialize(vector_index.candidates(asked, index, 20), "index-candidates")
    near = vector_index.search_index(asked, index, best=best).select("query_id", "vec_id")
    found = exact.join(near, ["query_id", "vec_id"]).agg(F.count("*").alias("found"))
    wanted = exact.agg(F.count("*").alias("wanted"))
    return vector_index.share_read(asked, index, 20, best=best).select(
        (found.scalar() >= wanted.scalar() * 0.9).alias("recall_reached"),
        (F.col("vectors_read") <= 0.2).alias("vectors_kept"),
        (F.col("codes_read") / 8 + F.col("vectors_read") <= 0.2).alias("bytes_kept"),
    )


def _aliases(spark: SparkSession, sf: str) -> DataFrame:
    """The old and the new kind of some things, asked for by the thing's word; suppliers by name."""
    words = tables.read_table(spark, sf, "part").select(
        F.split_part("p_name", F.lit(" "), F.lit(2)).alias("keyword")
    )
    kinds = (
        words.distinct()
        .where(F.col("keyword").isin(*ALIAS_WORDS))
        .select(
            "keyword",
            F.explode(
                F.array(
                    F.concat(F.lit("old "), F.col("keyword")),
                    F.concat(F.lit("new "), F.col("keyword")),
                )
            ).alias("product_name"),
        )
    )
    suppliers = tables.read_table(spark, sf, "supplier")
    return kinds.unionAll(suppliers.select(F.lower("s_name"), "s_name"))


def _part_hits(spark: SparkSession, sf: str, house: roles.Warehouse) -> DataFrame:
    return retrieval.retrieve(
        roles.query_vectors(spark, sf), roles.product_vectors(spark, sf, house.products)
    )


@query_of_grains("r1_choose_product")
def r1(spark, sf, grain):
    house = roles.warehouse(spark, sf, grain)
    return recommendation.choose_product(
        roles.queries(spark, sf),
        _part_hits(spark, sf, house),
        _aliases(spark, sf),
        house.products,
        house.velocity,
    )


def _recommended(
    spark: SparkSession, sf: str, grain: str
) -> tuple[DataFrame, roles.Warehouse]:
    house = roles.warehouse(spark, sf, grain)
    found = recommendation.recommend(
        roles.queries(spark, sf),
        _part_hits(spark, sf, house),
        _aliases(spark, sf),
        house.products,
        house.velocity,
        house.neighbours,
    )
    return found, house


@query_of_grains("r5_recommend")
def r5(spark, sf, grain):
    return rounded(_recommended(spark, sf, grain)[0], "reorder_rate")


@query_of_grains("r5_recommend_text")
def r5_text(spark, sf, grain):
    found, house = _recommended(spark, sf, grain)
    return recommendation.render_recommendations(found, house.products, house.velocity)


# Sources and sinks


@query("s1_csv_ingest")
def s1(spark, sf):
    path = scratch_path(spark, "lines-csv")
    roles.part_lines(spark, sf).write.option("header", True).csv(path)
    good, _ = tables.split_rejects(tables.read_transactions(spark, path))
    return good.withColumn("order_ts", F.date_format("order_ts", "yyyy-MM-dd HH:mm:ss"))


@query("s3_write_documents")
def s3(spark, sf):
    house = roles.warehouse(spark, sf, "part")
    path = scratch_path(spark, "documents")
    store.write_documents(lookup.build_documents(house.products, house.velocity), path)
    return store.read_documents(spark, path)


@query("s5_rebuild_vectors")
def s5(spark, sf):
    house = roles.warehouse(spark, sf, "part")
    vecs = roles.product_vectors(spark, sf, house.products)
    path = scratch_path(spark, "vectors")
    retrieval.build_store(
        house.products, house.velocity, vecs, scratch_path(spark, "documents"), path
    )
    stored = spark.read.parquet(path)
    elements = F.transform("embedding", lambda x: F.floor(x.cast("double") * 10000).cast("string"))
    return stored.select("product_id", "text", F.array_join(elements, " ").alias("elements"))


@query("s6_load_report")
def s6(spark, sf):
    docs = tables.read_table(spark, sf, "documents")
    return store.write_counted(docs, scratch_path(spark, "load"))


@query("a4_counts")
def a4(spark, sf):
    return corpus.counts(corpus.chunk_lines(roles.corpus(spark, sf), STEP), "path")


@query("s7_text_tree")
def s7(spark, sf):
    """Every conversation turn as a text file, read back as a tree and joined by folder."""
    path = _conversation_files(spark, sf, part_rows=2)
    joined = text_files.joined_by_folder(text_files.read_text_tree(spark, path, extensions=(".txt",)))
    return joined.select(
        F.regexp_extract("folder", r"conv_id=([0-9]+)$", 1).cast("bigint").alias("conv_id"), "text"
    )


def _conversation_files(spark: SparkSession, sf: str, part_rows: int = 10000) -> str:
    path = scratch_path(spark, "conversations")
    turns = tables.read_table(spark, sf, "conversations")
    text_files.write_grouped_text(turns, "conv_id", "turn", "text", path, part_rows)
    return path


@query("s8_chunk_round_trip")
def s8(spark, sf):
    path = scratch_path(spark, "chunks")
    text_files.write_chunks(corpus.chunk_lines(roles.corpus(spark, sf), STEP), path, "json")
    return text_files.read_chunks(spark, path, "json")


@query("s9_run_log")
def s9(spark, sf):
    """All columns of the log; long names, failed requests with long messages, and the payload's fields."""
    path = scratch_path(spark, "runs")
    promoted = _promoted(spark, sf).withColumn("anchor_name", F.repeat("anchor_name", F.lit(30)))
    failed = F.startswith("query_id", F.lit("nation-"))
    log = runlog.run_log(
        promoted,
        "batch-1",
        latency_ms=F.length("user_query") * 1.5,
        error=F.when(failed, F.repeat("user_query", F.lit(200))),
        run_date=F.lit("2024-05-06").cast("date"),
    )
    runlog.append_run_log(log, path)
    payload = lambda field: F.get_json_object("payload", f"$.{field}")
    return spark.read.parquet(path).select(
        "run_id", "query", "endpoint", "debug", "status", "latency_ms", "bundle_count", "anchor_product_id",
        "anchor_name", "error_message", F.date_format("run_date", "yyyy-MM-dd").alias("run_day"),
        payload("query").alias("payload_query"),
        payload("result_text").alias("payload_text"),
        payload("bundles[0].theme").alias("payload_theme"),
        F.coalesce(F.json_array_length(payload("bundles")), F.lit(0)).cast("bigint").alias("payload_bundles"),
    )


@query("s10_grouped_text")
def s10(spark, sf):
    """One row per line of the grouped files, with its file and its place there."""
    path = _conversation_files(spark, sf, part_rows=3)
    files = text_files.read_text_tree(spark, path, extensions=(".txt",))
    lines = files.select("path", F.posexplode(F.split(F.regexp_replace("text", "\n$", ""), "\n")).alias("nr", "line"))
    return lines.select(
        F.regexp_extract("path", "conv_id=([0-9]+)/", 1).cast("bigint").alias("conv_id"),
        F.regexp_extract("path", "part=([0-9]+)/", 1).cast("bigint").alias("part"),
        "nr",
        "line",
    )


# Corpus


@query("t1_chunk_lines")
def t1(spark, sf):
    return corpus.chunk_lines(roles.corpus(spark, sf))


@query("t1_chunk_lines_short")
def t1_short(spark, sf):
    return corpus.chunk_lines(roles.corpus(spark, sf), STEP)


@query("t2_head_chunk")
def t2(spark, sf):
    return corpus.head_chunk(roles.corpus(spark, sf), STEP)


def _turns(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    turns = tables.read_table(spark, sf, "conversations")
    level = F.when(F.col("role") == "user", 0).when(F.col("role") == "assistant", 1)
    headings = turns.select(
        F.col("conv_id").alias("doc"),
        F.col("turn").alias("pos"),
        level.alias("level"),
        F.concat(F.col("role"), F.col("turn").cast("string")).alias("name"),
    ).where(F.col("level").isNotNull())
    return headings, turns.groupBy(F.col("conv_id").alias("doc")).agg(F.max("turn").alias("last"))


@query("t3_segment_blocks")
def t3(spark, sf):
    return corpus.segment_blocks(*_turns(spark, sf))


@query("t3_segment_blocks_pieces")
def t3_pieces(spark, sf):
    return corpus.segment_blocks(*_turns(spark, sf), piece=2)


@query("t3_chunk_blocks")
def t3_chunks(spark, sf):
    """Documents cut at lines that start with two words, by the length of the first."""
    return corpus.chunk_blocks(
        roles.corpus(spark, sf), r"^([A-Za-z]+)( )([A-Za-z]+) ", ((" ", "passage"),), STEP
    )


@query("t3_index_files")
def t3_index(spark, sf):
    """Conversations written as code, a class per question and a method per answer, and the documents."""
    turns = tables.read_table(spark, sf, "conversations")
    number = F.col("turn").cast("string")
    line = (
        F.when(F.col("role") == "user", F.concat(F.lit("class User"), number, F.lit(":")))
        .when(F.col("role") == "assistant", F.concat(F.lit("    def turn"), number, F.lit("(self):")))
        .otherwise("        pass")
    )
    code = corpus.concat_ordered(turns.withColumn("line", line), "conv_id", "turn", "line").select(
        F.concat(F.lit("conv"), F.col("conv_id").cast("string"), F.lit(".py")).alias("path"), "text"
    )
    return corpus.index_files(code.unionByName(roles.corpus(spark, sf)))


@query("t3_index_tree")
def t3_tree(spark, sf):
    """The conversations as files, indexed from their folder: chunks of each, with the report's totals."""
    path = scratch_path(spark, "index")
    report = indexing.build_index(spark, _conversation_files(spark, sf, part_rows=2), path, (".txt",))
    chunks = text_files.read_chunks(spark, path).select(
        F.regexp_extract("path", "conv_id=([0-9]+)/", 1).cast("bigint").alias("conv_id"), "start_line", "end_line", "kind"
    )
    lines = F.sum(F.col("end_line") - F.col("start_line") + 1)
    found = chunks.groupBy("conv_id", "kind").agg(F.count(F.lit(1)).alias("n_chunks"), lines.alias("n_lines"))
    totals = report.first().asDict()
    return found.withColumns({name: F.lit(n).cast("bigint") for name, n in totals.items()})


def _words(spark: SparkSession, sf: str) -> DataFrame:
    """The words of part names and the languages of documents as search terms."""
    words = tables.read_table(spark, sf, "part").select(F.explode(F.split("p_name", " ")))
    langs = tables.read_table(spark, sf, "documents").select("lang")
    return words.unionAll(langs).distinct().toDF("term")


@query("t4_grep")
def t4(spark, sf):
    return corpus.grep(_words(spark, sf), corpus.chunk_lines(roles.corpus(spark, sf), STEP))


@query("t4_grep_indexed")
def t4_indexed(spark, sf):
    chunks = corpus.chunk_lines(roles.corpus(spark, sf), STEP)
    path = scratch_path(spark, "gram-index")
    return corpus.grep(_words(spark, sf), gram_index.build_gram_index(chunks, corpus.FILE_ORDER, ["text"], path, part_rows=1024))


@query("t4_grep_items")
def t4_items(spark, sf):
    terms = tables.read_table(spark, sf, "benchmark").select(F.col("text").alias("term"))
    chunks = roles.corpus(spark, sf).select(
        "path", F.lit("").alias("symbol"), F.lit(1).alias("start_line"), "text"
    )
    return corpus.grep(terms, chunks)


def _catalogue_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Part names as symbols, the part types as paths."""
    return tables.read_table(spark, sf, "part").select(
        F.concat(F.lower("p_type"), F.lit("/"), F.lower("p_brand")).alias("path"),
        F.col("p_name").alias("symbol"),
        F.lit("file").alias("kind"),
        F.col("p_partkey").cast("int").alias("start_line"),
        F.col("p_partkey").cast("int").alias("end_line"),
        F.concat_ws(" ", "p_name", "p_brand", "p_type").alias("text"),
    )


@query("t5_find_symbol")
def t5(spark, sf):
    terms = roles.queries(spark, sf).select(F.col("user_query").alias("term"))
    return corpus.find_symbol(terms, _catalogue_chunks(spark, sf))


@query("t6_rank_chunks")
def t6(spark, sf):
    terms = roles.queries(spark, sf).select(F.col("user_query").alias("term"))
    rule = ((("economy/",), -500), (("promo/brand#1", "large/"), 60))
    return corpus.rank_chunks(terms, _catalogue_chunks(spark, sf), prefix_rules=rule)


@query("t6_rank_chunks_indexed")
def t6_indexed(spark, sf):
    terms = roles.queries(spark, sf).select(F.col("user_query").alias("term"))
    rule = ((("economy/",), -500), (("promo/brand#1", "large/"), 60))
    path = scratch_path(spark, "gram-index")
    index = gram_index.build_gram_index(_catalogue_chunks(spark, sf), corpus.FILE_ORDER, ["text", "symbol"], path, part_rows=256)
    return corpus.rank_chunks(terms, index, prefix_rules=rule)


@query("p6_select_chunks")
def p6(spark, sf):
    chunks = corpus.chunk_lines(roles.corpus(spark, sf), STEP)
    return corpus.select_chunks(chunks, ("src1/", "src2"), ".md", ("file",)).drop("text")


@query("a6_concat_ordered")
def a6(spark, sf):
    turns = tables.read_table(spark, sf, "conversations")
    return corpus.concat_ordered(turns, "conv_id", "turn", "text")


@query("a6_concat_parts")
def a6_parts(spark, sf):
    """Parts of three rows; the positions have gaps and fractions."""
    turns = tables.read_table(spark, sf, "conversations")
    apart = turns.withColumn("at", F.col("turn") * F.col("turn") * 7.5)
    return corpus.concat_ordered(apart, "conv_id", "at", "text", part_rows=3)


@query("a3_adjacency")
def a3(spark, sf):
    return graph.adjacency(roles.edges(spark, sf))


@query("t7_trace")
def t7(spark, sf):
    """Suppliers and parts as terms; dotted terms with an unknown head fall back to their tail."""
    edges = roles.edges(spark, sf)
    plain = edges.select("src", F.split_part("dst", F.lit("."), F.lit(2)).alias("dst"))
    parts = tables.read_table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("key"))
    terms = parts.select(F.concat(F.lit("s."), F.col("key")).alias("term"))
    return graph.trace(terms, plain)


@query("t9_filter_edges")
def t9(spark, sf):
    promoted = tables.read_table(spark, sf, "part").where(F.col("p_type") == "PROMO")
    stop = promoted.select(F.concat(F.lit("p."), F.col("p_partkey").cast("string")).alias("dst"))
    return graph.filter_edges(roles.edges(spark, sf), stop)


def _document_state(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Documents, and an older state: only labelled documents, toxic ones with another hash."""
    docs = tables.read_table(spark, sf, "documents").select(
        "doc_id", text.content_hash(F.col("text")).alias("hash"), "text"
    )
    labels = tables.read_table(spark, sf, "labels").select("doc_id", "toxic")
    state = docs.join(labels, "doc_id").select(
        "doc_id",
        F.when(F.col("toxic") == 1, F.reverse("hash")).otherwise(F.col("hash")).alias("hash"),
        F.lit("kept").alias("payload"),
    )
    return docs, state


@query("t8_refresh")
def t8(spark, sf):
    docs, state = _document_state(spark, sf)
    return incremental.refresh(
        docs,
        state,
        "doc_id",
        "hash",
        lambda df: df.select(
            "doc_id", "hash", F.concat(F.lit("new:"), F.length("text").cast("string")).alias("payload")
        ),
    )


def _module_versions(spark: SparkSession, sf: str) -> tuple[DataFrame, str]:
    """Two versions of pages over parts and suppliers as functions; suppliers call the parts they deliver.

    The first version has other texts for small parts, no parts of some keys, parts that vanish, a
    part without name, and neither the suppliers' edges that come nor the ones that stay away.
    """
    parts = tables.read_table(spark, sf, "part").select(
        F.concat(F.lit("shop/"), F.col("p_type"), F.lit(".py")).alias("path"),
        F.concat(F.lit("p."), F.col("p_partkey").cast("string")).alias("symbol"),
        F.col("p_partkey").cast("int").alias("start_line"), F.concat_ws(" ", "p_name", "p_brand").alias("text"),
        F.col("p_partkey").alias("number"), F.col("p_size").alias("size"),
    )
    suppliers = tables.read_table(spark, sf, "supplier").select(
        F.lit("shop/suppliers.py").alias("path"), F.concat(F.lit("s."), F.col("s_suppkey").cast("string")).alias("symbol"),
        F.col("s_suppkey").cast("int").alias("start_line"), F.col("s_name").alias("text"),
        F.col("s_suppkey").alias("number"), F.lit(50).alias("size"),
    )
    nameless = suppliers.where("number = 1").withColumn("symbol", F.lit(None).cast("string"))
    now = parts.unionByName(suppliers).unionByName(nameless).withColumns(
        {"kind": F.lit("function"), "end_line": F.col("start_line") + 1}
    )
    gone = now.where("number % 13 = 0").withColumn("symbol", F.concat("symbol", F.lit("_old")))
    before = now.where("number % 11 <> 0").unionByName(gone).withColumn(
        "text", F.when(F.col("size") < 5, F.upper("text")).otherwise(F.col("text"))
    )
    edges = roles.deliveries(spark, sf)
    added = F.endswith("src", F.lit("7")) & F.endswith("dst", F.lit("3"))
    removed = edges.where(F.endswith("src", F.lit("9")) & F.endswith("dst", F.lit("1"))).select(
        "src", F.concat("dst", F.lit("0")).alias("dst")
    )
    folder = scratch_path(spark, "modules")
    columns = ["path", "symbol", "kind", "start_line", "end_line", "text"]

    def summary(changed: DataFrame) -> DataFrame:
        return changed.select("key", "hash", F.concat(F.lit("summary of "), F.length("text").cast("string")).alias("summary"))

    for chunks, own in ((before, edges.where(~added).unionByName(removed)), (now, edges)):
        state = pages.refresh_modules(chunks.select(*columns), own, folder, summary, names=100_000)
    return state, folder


@query("t8_refresh_modules")
def t8_modules(spark, sf):
    """The state of the second version; ``version`` is 2 exactly for the chunks that were computed again."""
    return _module_versions(spark, sf)[0].select("key", "hash", "payload.summary", "payload.version")


@query("s10_module_pages")
def s10_pages(spark, sf):
    """The pages of the second version, read back from their files."""
    _, folder = _module_versions(spark, sf)
    files = text_files.read_text_tree(spark, f"{folder}/version=000002/modules", extensions=(".txt",))
    return text_files.joined_by_folder(files, digest=True).select(
        F.regexp_extract("folder", r"module=([^/]*)$", 1).alias("module"), F.col("sha256").alias("page_hash"),
        F.col("chars").cast("int").alias("chars"),
    )


@query("j6_state_table")
def j6_state(spark, sf):
    """A stored state of labelled documents brought to all documents, then to those of two languages."""
    docs, state = _document_state(spark, sf)
    held = keyed_state(spark, f"state_{uuid.uuid4().hex}", scratch_path(spark, "state"), key="bigint")
    describe = lambda name: lambda df: df.select("doc_id", "hash", F.lit(name).alias("payload"))
    held.refresh(state, "doc_id", "hash", describe("first"))
    held.refresh(docs, "doc_id", "hash", describe("second"))
    some = tables.read_table(spark, sf, "documents").where("lang IN ('en', 'de')").select("doc_id")
    found = held.refresh(docs.join(some, "doc_id", "left_semi"), "doc_id", "hash", describe("third"))
    return found.select(F.col("key").alias("doc_id"), "hash", "payload")


@query("j6_changed_rows")
def j6(spark, sf):
    docs, state = _document_state(spark, sf)
    return incremental.changed_rows(docs, state, "doc_id", "hash").select("doc_id", "hash")
