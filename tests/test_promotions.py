import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from cartloom import schemas
from cartloom.functions import fixed_values as fixed
from cartloom.functions.scores import AddonWeights
from cartloom.operators import bundles, lookup
from cartloom.plans import promote as promotion
from cartloom.plans import recommend as recommendation

QUERY = "query_id string, user_query string"
HIT = "query_id string, rank int, product_id long"


def items_table(spark, anchors):
    """Candidate sets ``{anchor: [(product, count, relevance, family)]}``, already in order."""
    rows = [
        (
            anchor,
            False,
            [
                (i + 1, product, f"p{product}", count, 0.5, 10, float(relevance), family)
                for i, (product, count, relevance, family) in enumerate(items)
            ],
        )
        for anchor, items in anchors.items()
    ]
    item = (
        "struct<rk int, product_id long, product_name string, co_purchase_count long, "
        "reorder_rate double, total_units long, relevance double, family string>"
    )
    return spark.createDataFrame(rows, f"anchor_id long, exempt boolean, items array<{item}>")


def greedy(items, m=3, synergy=0.3):
    scored = [
        (a[2] + b[2] + synergy * min(a[1], b[1]), a[0], b[0])
        for a, b in combinations(items, 2)
        if a[3] != b[3]
    ]
    used, taken = set(), []
    for score, a, b in sorted(scored, key=lambda row: -row[0]):
        if not {a, b} & used and len(taken) < m:
            taken.append((a, b, score))
            used |= {a, b}
    return taken


def test_greedy_selection_matches_a_loop(spark):
    rng = random.Random(11)
    anchors = {
        anchor: [
            (product, rng.randrange(5), rng.randrange(6), rng.choice("abc"))
            for product in rng.sample(range(100), rng.randrange(0, 11))
        ]
        for anchor in range(60)
    }
    selected = bundles.select_disjoint(
        bundles.score_pairs(items_table(spark, anchors), AddonWeights())
    )
    for row in selected.collect():
        got = [
            (p["a"]["product_id"], p["b"]["product_id"], pytest.approx(-p["cost"]))
            for p in row.selected
        ]
        assert got == greedy(anchors[row.anchor_id])
        products = [p for pair in got for p in pair[:2]]
        assert len(set(products)) == len(products) and len(got) <= 3


def test_same_family_gives_no_pair(spark):
    sets = items_table(spark, {1: [(5, 10, 3, "milk"), (6, 9, 2, "milk")], 2: [(5, 10, 3, "milk")]})
    assert [r.pairs for r in bundles.score_pairs(sets).collect()] == [[], []]


def test_candidates_know_both_directions_and_drop_unknown_products(spark, catalogue):
    products, velocity, affinity = catalogue
    anchors = spark.createDataFrame([(2,), (5,)], "anchor_id long")
    got = lookup.promo_candidates(anchors, affinity, products, velocity).collect()
    assert [(r.anchor_id, r.product_id, r.co_purchase_count, r.total_units) for r in got] in (
        [(2, 1, 9000, 60000), (5, 1, 6000, 60000)],
        [(5, 1, 6000, 60000), (2, 1, 9000, 60000)],
    )


def test_every_query_has_one_row_and_a_status(spark, catalogue):
    products, velocity, affinity = catalogue
    queries = spark.createDataFrame(
        [
            ("ok", "eggs"), ("fruit", "eggs and fruit"), ("hit", "no such name"), ("none", "zzz"),
            ("stub", "what"), ("alone", "soda"), ("few", "lime"), ("blank", " "),
        ],
        QUERY,
    )
    hits = spark.createDataFrame([("fruit", 1, 1), ("hit", 2, 3), ("hit", 1, 1), ("stub", 1, 77)], HIT)
    got = promotion.promote(queries, hits, products, velocity, affinity)
    assert got.schema["bundles"].dataType.elementType.fieldNames() == schemas.BUNDLE_STRUCT.fieldNames()
    rows = {r.query_id: r for r in got.collect()}
    assert {k: r.status for k, r in rows.items()} == {
        "ok": "ok", "fruit": "ok", "hit": "ok", "none": "no_anchor", "stub": "unknown_product",
        "alone": "no_candidates", "few": "no_bundles", "blank": "no_anchor",
    }
    assert rows["none"].bundles == [] and rows["none"].result_text == fixed.TEXT_NO_ANCHOR
    assert rows["stub"].result_text == "Anchor: (unknown). " + fixed.TEXT_NO_CANDIDATES
    assert rows["alone"].result_text == "Anchor: Soda. " + fixed.TEXT_NO_CANDIDATES
    assert rows["few"].result_text == "Anchor: Lime. " + fixed.TEXT_NO_BUNDLES
    # Milk 9000 + 160 + 18 + 5000 and Lime 6000 + 50 + 14 pair best once bananas are penalised.
    first = rows["ok"].bundles[0]
    assert [a.product_name for a in first.add_ons] == ["Whole Milk", "Lime"]
    assert first.bundle_score == round(14178 + 6064 + 0.3 * 6000, 1)
    assert first.theme == "Breakfast Essentials"
    assert first.offer == fixed.OFFER_TWO + "Save $3"
    assert first.confidence == "Medium" and first.expected_impact == fixed.IMPACT_ATTACH
    # Lime with a banana is left: two bananas are one family and never a pair.
    assert len(rows["ok"].bundles) == 1
    second = rows["fruit"].bundles[0]
    assert [a.product_name for a in second.add_ons] == ["Whole Milk", "Bananas"]
    assert [a.product_name for a in rows["fruit"].bundles[1].add_ons] == ["Organic Bananas", "Lime"]
    text = rows["ok"].result_text.split("\n")
    assert text[0] == fixed.TEXT_HEAD and text[2] == fixed.TEXT_ANCHOR
    assert "1. Bundle Score=22042.0" in text
    assert "   - Large Eggs (Anchor)" in text
    assert "   - Lime (affinity=6000, rr=0.250, units=700)" in text
    assert text[-1] == fixed.TEXT_WHY[-1]


def test_exact_names_and_cards(spark, catalogue):
    products, velocity, _ = catalogue
    names = spark.createDataFrame(
        [("q", "Bananas"), ("q", "Organic Bananas"), ("q", "bananas")],
        "query_id string, product_name string",
    )
    got = lookup.find_by_exact_name(names, products, velocity).orderBy("rank").collect()
    assert [r.product_id for r in got] == [4, 3]
    keys = spark.createDataFrame([(6,), (77,), (6,)], "product_id long")
    cards = {r.product_id: r for r in lookup.product_card(keys, products, velocity).collect()}
    assert cards[77].text == "Product ID: 77 (not found)" and cards[77].total_units is None
    assert cards[6].total_units == 0 and "reorder_rate=0.000" in cards[6].text


def test_recommendations(spark, catalogue):
    products, velocity, affinity = catalogue
    queries = spark.createDataFrame(
        [("alias", "Banana bread"), ("hit", "x"), ("far", "y"), ("none", "z"), ("odd", "w")], QUERY
    )
    hits = spark.createDataFrame([("hit", 1, 2), ("far", 1, 6), ("odd", 1, 77), ("alias", 1, 1)], HIT)
    # Without its pair, milk has nobody but an unknown product.
    affinity = affinity.where("product_id_b <> 2")
    got = recommendation.recommend(
        queries, hits, recommendation.default_aliases(spark), products, velocity, affinity
    )
    rows = {}
    for row in got.orderBy("query_id", "rank").collect():
        rows.setdefault(row.query_id, []).append((row.chosen_id, row.source, row.product_id))
    assert rows == {
        "alias": [(4, "co_purchase", 1)],
        "hit": [(2, "popular", 2), (2, "popular", 1)],
        "far": [(6, "no_pairs", None)],
        "odd": [(77, "no_pairs", None)],
        "none": [(None, "no_match", None)],
    }
    text = recommendation.render_recommendations(got, products, velocity)
    texts = {r.query_id: r.text for r in text.collect()}
    assert texts["none"] == fixed.TEXT_NO_MATCH
    assert texts["alias"].endswith("product_id=4:\n- Large Eggs (co_purchase_count=7000)")
    assert texts["hit"].endswith(
        "(department_id=1):\n- Whole Milk (reorder_rate=0.800, units=900)\n"
        "- Large Eggs (reorder_rate=0.700, units=60000)"
    )
    assert texts["odd"].endswith(fixed.TEXT_NO_PAIRS)
    assert "Product ID: 77 (not found)" in texts["odd"]
    documents = spark.createDataFrame(
        [("none", 2, None, "second"), ("none", 1, None, "a guide"), ("hit", 1, 2, "milk")],
        "query_id string, rank int, product_id long, text string",
    )
    found = recommendation.render_recommendations(got, products, velocity, documents)
    found = {r.query_id: r.text for r in found.collect()}
    assert found["none"] == f"{fixed.TEXT_TOP_HIT}\na guide"
    assert {q: t for q, t in found.items() if q != "none"} == {q: t for q, t in texts.items() if q != "none"}


def test_hot_anchor_is_planned_once(spark, catalogue):
    """A thousand queries for one anchor give a thousand rows from one plan of that anchor."""
    products, velocity, affinity = catalogue
    queries = spark.range(1000).select(
        F.col("id").cast("string").alias("query_id"), F.lit("Eggs").alias("user_query")
    )
    hits = spark.createDataFrame([], HIT)
    got = promotion.promote(queries, hits, products, velocity, affinity)
    assert got.count() == 1000
    assert got.select("result_text").distinct().count() == 1
