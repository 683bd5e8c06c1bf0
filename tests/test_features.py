import random
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from cartloom.functions import fixed_values as fixed
from cartloom.functions.rules import Cuts
from cartloom.operators import features


def pair_counts(lines):
    baskets = defaultdict(set)
    for order, product in lines:
        if order is not None and product is not None:
            baskets[order].add(product)
    return Counter(pair for items in baskets.values() for pair in combinations(sorted(items), 2))


def affinity(spark, lines, **options):
    df = spark.createDataFrame(lines, "order_id long, product_id long")
    rows = features.basket_affinity(df, **options).collect()
    got = {(r.product_id_a, r.product_id_b): r.co_purchase_count for r in rows}
    assert len(got) == len(rows)
    return got


@pytest.fixture(scope="module")
def skewed_lines():
    """A third of all lines is in one order, a third is of one product; some lines repeat."""
    rng = random.Random(3)
    lines = [(1, p) for p in range(200)] * 2
    lines += [(order, 7) for order in range(2, 400)]
    lines += [(rng.randrange(2, 150), rng.randrange(60)) for _ in range(400)]
    return lines + [(None, 5), (5, None)]


@pytest.mark.parametrize("block", [2, 16, 512])
def test_affinity_counts_every_pair(spark, skewed_lines, block):
    assert affinity(spark, skewed_lines, block=block) == pair_counts(skewed_lines)


@pytest.mark.parametrize("minimum", [2, 5])
def test_affinity_minimum(spark, skewed_lines, minimum):
    want = {pair: n for pair, n in pair_counts(skewed_lines).items() if n >= minimum}
    assert affinity(spark, skewed_lines, min_count=minimum, block=16) == want


def test_velocity(spark):
    lines = spark.createDataFrame(
        [
            (1, 10, 100, 2.0), (1, 10, 100, 3.0), (2, 10, 100, 1.0), (3, 10, 100, 1.0),
            (4, 10, 200, 1.0), (4, 11, 200, 6.0), (5, 12, 200, 1.0), (6, None, 1, 1.0),
        ],
        "order_id long, product_id long, customer_id long, quantity double",
    )
    products = spark.createDataFrame(
        [(10, "a", 1), (11, "b", 2), (13, "never sold", 2)],
        "product_id long, product_name string, department_id int",
    )
    got = {r.product_id: r for r in features.sku_velocity(lines, products).collect()}
    assert set(got) == {10, 11}
    assert (got[10].total_units, got[10].total_orders, got[10].reorder_rate) == (5, 4, 0.5)
    assert (got[11].total_units, got[11].total_orders, got[11].reorder_rate) == (1, 1, 0.0)
    by_quantity = {
        r.product_id: r.total_units
        for r in features.sku_velocity(lines, products, units="quantity").collect()
    }
    assert by_quantity == {10: 8, 11: 6}
    with pytest.raises(ValueError):
        features.sku_velocity(lines, products, units="weight")


@pytest.mark.parametrize("data", ["even", "hot", "single", "two"])
def test_quantiles_are_exact(spark, data):
    rng = random.Random(5)
    numbers = {
        "even": [rng.random() * 1000 for _ in range(3001)],
        "hot": [7.0] * 1500 + [float(rng.randrange(3000)) for _ in range(1501)],
        "single": [4.0],
        "two": [1.0, 2.0],
    }[data]
    df = spark.createDataFrame([(x,) for x in numbers] + [(None,)], "x double")
    probs = {"min": 0.0, "low": 0.1, "mid": 0.5, "high": 0.99, "max": 1.0}
    got = {r.name: r.value for r in features.quantiles(df, "x", probs).collect()}
    for name, prob in probs.items():
        assert got[name] == pytest.approx(np.quantile(numbers, prob), rel=1e-12)


def test_calibrated_cuts(spark, catalogue):
    _, velocity, affinity_table = catalogue
    row = features.calibrate(affinity_table, velocity).first()
    cuts = Cuts.from_row(row)
    assert cuts.discount[1] == (7000.0, fixed.DISCOUNT_STEPS[1][1])
    assert cuts.basket_units == 900.0
    assert cuts.trial_rate == 0.5


def test_sketches_merge_and_keep_their_rank_error(spark):
    values = spark.range(200_000).select(
        F.pmod(F.xxhash64("id"), F.lit(100_000)).cast("double").alias("v"), (F.col("id") % 7).alias("day")
    )
    odd = spark.createDataFrame([(None, 7), (float("nan"), 8)], "v double, day long")
    sketches = features.quantile_sketches(values.unionByName(odd), ["v"], ["day"])
    assert sketches.count() == 7
    probs = {"low": 0.01, "mid": 0.5, "high": 0.99}
    got = {r.quantile: r.value for r in features.approximate_quantiles(sketches, {"v": probs}).collect()}
    for name, prob in probs.items():
        below, upto = values.agg(F.avg((F.col("v") < got[name]).cast("double")), F.avg((F.col("v") <= got[name]).cast("double"))).first()
        assert below - 3 * features.rank_error() <= prob <= upto + 3 * features.rank_error()
    # a sketch is bounded: seven times the rows make it no seven times larger
    sizes = features.quantile_sketches(values, ["v"]).select(F.length("sketch")).first()[0]
    assert sizes < 8 * 200_000 / 5
    assert features.quantile_sketches(values.limit(0), ["v"]).count() == 0


def test_cut_offs_from_sketches_are_near_the_exact_ones(spark):
    affinity = spark.range(5000).select((F.col("id") % 101).alias("co_purchase_count"))
    velocity = spark.range(5000).select(F.col("id").alias("total_units"), (F.col("id") / 5000).alias("reorder_rate"))
    sketches = features.quantile_sketches(affinity, ["co_purchase_count"]).unionByName(
        features.quantile_sketches(velocity, ["total_units", "reorder_rate"])
    )
    near, exact = features.calibrate_sketches(sketches).first(), features.calibrate(affinity, velocity).first()
    assert near.asDict().keys() == exact.asDict().keys()
    assert abs(near.affinity_mid - exact.affinity_mid) <= 1 and abs(near.units_mid - exact.units_mid) <= 15


def test_rows_of_orders_are_not_merged_to_few_tasks(spark):
    lines = spark.createDataFrame([(1, 7), (1, 8), (2, 7), (2, 8), (2, 9)], "order_id long, product_id long")
    found = features.basket_affinity(lines)
    plan = found._jdf.queryExecution().executedPlan().toString()
    # adaptive execution leaves these partitions as they are
    dealt = [line for line in plan.splitlines() if "REPARTITION_BY_NUM" in line]
    assert any("order_id" in line and "product_id" in line for line in dealt)
    assert any("order_id" in line and "product_id" not in line for line in dealt)
    assert sorted(map(tuple, found.collect())) == [(7, 8, 2), (7, 9, 1), (8, 9, 1)]
