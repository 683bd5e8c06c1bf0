import random

import pytest

from cartloom.operators import features
from cartloom.operators.upkeep import FeatureRuns

LINE = "order_id long, product_id long, customer_id long, quantity int"
PRODUCTS = [(i, f"product {i}", i, i % 2) for i in range(1, 9)]


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def batches_of(n, size, seed=3):
    rng = random.Random(seed)
    pick = lambda most: rng.choice([None, *range(1, most)])
    return [[(pick(6), pick(9), pick(4), rng.choice([1, 2, 5])) for _ in range(size)] for _ in range(n)]


@pytest.mark.parametrize("units", ["count", "quantity"])
@pytest.mark.parametrize("fan_in", [2, 10])
def test_runs_equal_the_rebuild_after_every_batch(spark, tmp_path, units, fan_in):
    products = spark.createDataFrame(PRODUCTS, "product_id long, product_name string, aisle_id int, department_id int")
    runs, seen = FeatureRuns(spark, str(tmp_path / "runs"), units, fan_in), []
    for batch in [*batches_of(3, 25), [], batches_of(1, 3, 9)[0]]:
        runs.add(spark.createDataFrame(batch, LINE))
        seen += batch
        lines = spark.createDataFrame(seen, LINE)
        assert rows(runs.affinity()) == rows(features.basket_affinity(lines))
    assert rows(runs.affinity(2)) == rows(features.basket_affinity(lines, 2))
    assert rows(runs.velocity(products)) == rows(features.sku_velocity(lines, products, units))
    assert runs._runs() == ([(1, 4), (5, 5)] if fan_in == 2 else [(i, i) for i in range(1, 6)])


def test_a_batch_that_failed_is_written_again(spark, tmp_path, monkeypatch):
    runs = FeatureRuns(spark, str(tmp_path / "runs"))
    first, second = batches_of(2, 20)
    runs.add(spark.createDataFrame(first, LINE))

    def fail(*args):
        raise OSError("disk")

    with monkeypatch.context() as broken:
        broken.setattr("cartloom.operators.upkeep.basket_affinity", fail)
        with pytest.raises(OSError):
            runs.add(spark.createDataFrame(second, LINE))
    want = rows(features.basket_affinity(spark.createDataFrame(first, LINE)))
    assert rows(runs.affinity()) == want
    runs.add(spark.createDataFrame(second, LINE))
    assert rows(runs.affinity()) == rows(features.basket_affinity(spark.createDataFrame(first + second, LINE)))


def test_no_lines(spark, tmp_path):
    runs = FeatureRuns(spark, str(tmp_path / "runs"))
    products = spark.createDataFrame(PRODUCTS, "product_id long, product_name string, aisle_id int, department_id int")
    assert runs.affinity().count() == 0 and runs.velocity(products).count() == 0
    with pytest.raises(ValueError):
        FeatureRuns(spark, str(tmp_path / "runs"), "weight")
