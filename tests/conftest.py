import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from cartloom.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests",
        "local[4]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.driver.memory": "6g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def catalogue(spark):
    """Six products, five of them sold; pairs with product 1 only."""
    products = spark.createDataFrame(
        [
            (1, "Large Eggs", 10, 1),
            (2, "Whole Milk", 11, 1),
            (3, "Bananas", 12, 2),
            (4, "Organic Bananas", 12, 2),
            (5, "Lime", 13, 2),
            (6, "Soda", 14, None),
        ],
        "product_id long, product_name string, aisle_id int, department_id int",
    )
    velocity = spark.createDataFrame(
        [
            (1, "Large Eggs", 1, 60000, 500, 0.7),
            (2, "Whole Milk", 1, 900, 400, 0.8),
            (3, "Bananas", 2, 800, 300, 0.5),
            (4, "Organic Bananas", 2, 950, 300, 0.6),
            (5, "Lime", 2, 700, 200, 0.25),
        ],
        "product_id long, product_name string, department_id int, total_units long, "
        "total_orders long, reorder_rate double",
    )
    affinity = spark.createDataFrame(
        [(1, 2, 9000), (1, 3, 8000), (1, 4, 7000), (1, 5, 6000), (2, 99, 50)],
        "product_id_a long, product_id_b long, co_purchase_count long",
    )
    return products, velocity, affinity
