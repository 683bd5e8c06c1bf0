import pytest
from pyspark.sql import functions as F

from cartloom.operators import lookup, neighbours


@pytest.fixture
def stored(spark, catalogue, tmp_path):
    products, _, affinity = catalogue
    table = neighbours.write_neighbours(affinity, products, str(tmp_path / "pairs"), strongest=2, buckets=4)
    yield table
    table.drop()


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("k", [1, 2, 3, 10])
def test_stored_neighbours_are_those_of_the_pairs(catalogue, stored, k):
    products, velocity, affinity = catalogue
    keys = products.select("product_id").unionAll(products.select("product_id")).unionAll(products.select(F.lit(None).cast("long")))
    assert rows(lookup.co_purchase(keys, stored, products, k)) == rows(lookup.co_purchase(keys, affinity, products, k))
    anchors = keys.select(F.col("product_id").alias("anchor_id"))
    want = lookup.promo_candidates(anchors, affinity, products, velocity, k)
    assert rows(lookup.promo_candidates(anchors, stored, products, velocity, k)) == rows(want)


@pytest.mark.parametrize("k", [2, 3])
def test_the_pairs_are_not_shuffled(spark, catalogue, stored, k):
    products, _, _ = catalogue
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = stored.of(products.select("product_id"), k)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # one exchange for the keys and one to make them distinct at most, none above the scan of the pairs
    lines = plan.split("\n")
    scan = next(i for i, line in enumerate(lines) if "Bucketed: true" in line)
    depth = [len(line) - len(line.lstrip(" :+-")) for line in lines]
    above, deepest = [], depth[scan]
    for i in range(scan, -1, -1):
        if depth[i] < deepest:
            above.append(lines[i])
            deepest = depth[i]
    assert above and not any("Exchange" in line for line in above)


def test_empty_pairs(catalogue, tmp_path):
    products, _, affinity = catalogue
    table = neighbours.write_neighbours(affinity.limit(0), products, str(tmp_path / "none"), buckets=2)
    assert lookup.co_purchase(products, table, products).count() == 0
    table.drop()
