"""Order-and-part tables read in the roles of a retail warehouse.

Part grain takes every part as a product. Name grain takes every distinct part name as
one product, with the smallest part key as its id.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from cartloom import schemas
from cartloom.operators.features import basket_affinity, sku_velocity
from cartloom.operators.neighbours import NeighbourTable, write_neighbours
from cartloom.session import dealt, materialize, scratch_path, spread
from cartloom.sources.tables import read_table

# Department ids of the part types.
DEPARTMENTS = (
    ("ECONOMY", 1), ("LARGE", 2), ("MEDIUM", 3), ("PROMO", 4), ("SMALL", 5), ("STANDARD", 6),
)
#: Suppliers join the wide catalogue under ids from here on.
SUPPLIER_IDS = 1_000_000_000


@dataclass(frozen=True)
class Warehouse:
    """A catalogue with its feature tables, each written when it is first asked for."""

    grain: str
    products: DataFrame
    lines: DataFrame
    baskets: DataFrame

    @cached_property
    def velocity(self) -> DataFrame:
        return materialize(sku_velocity(self.lines, self.products), f"velocity-{self.grain}")

    @cached_property
    def affinity(self) -> DataFrame:
        return materialize(basket_affinity(self.baskets), f"affinity-{self.grain}")

    @cached_property
    def neighbours(self) -> NeighbourTable:
        path = scratch_path(self.products.sparkSession, f"neighbours-{self.grain}")
        return write_neighbours(self.affinity, self.products, path)


def part_products(spark: SparkSession, folder: str) -> DataFrame:
    """Every part as a product."""
    department = F.lit(None).cast("int")
    for name, number in DEPARTMENTS:
        department = F.when(F.col("p_type") == name, number).otherwise(department)
    products = read_table(spark, folder, "part").select(
        F.col("p_partkey").alias("product_id"),
        F.col("p_name").alias("product_name"),
        F.regexp_extract("p_brand", r"([0-9]+)", 1).cast("int").alias("aisle_id"),
        department.alias("department_id"),
    )
    return schemas.require(products, schemas.PRODUCTS)


def name_products(spark: SparkSession, folder: str) -> DataFrame:
    """Every distinct part name as a product; aisle and department are codes of its two words."""
    noun = F.split_part("product_name", F.lit(" "), F.lit(2))
    products = (
        read_table(spark, folder, "part")
        .groupBy(F.col("p_name").alias("product_name"))
        .agg(F.min("p_partkey").alias("product_id"))
        .select(
            "product_id",
            "product_name",
            F.ascii("product_name").alias("aisle_id"),
            (F.ascii(noun) * 100 + F.ascii(F.substring(noun, 2, 1))).alias("department_id"),
        )
    )
    return schemas.require(products, schemas.PRODUCTS)


def part_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Order lines with the part key as product."""
    items = dealt(read_table(spark, folder, "lineitem"), "l_orderkey")
    orders = dealt(read_table(spark, folder, "orders"), "o_orderkey")
    lines = items.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_partkey").alias("product_id"),
        F.col("o_custkey").alias("customer_id"),
        F.col("o_orderdate").cast("timestamp").alias("order_ts"),
        F.col("l_quantity").alias("quantity"),
    )
    return schemas.require(lines, schemas.ORDER_LINES)


def part_baskets(spark: SparkSession, folder: str) -> DataFrame:
    """Order and product of every line, without the join to the orders."""
    return read_table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("order_id"), F.col("l_partkey").alias("product_id")
    )


def to_names(lines: DataFrame, spark: SparkSession, folder: str) -> DataFrame:
    """Lines with their part key replaced by the product id of its name."""
    names = name_products(spark, folder).select("product_name", F.col("product_id").alias("named"))
    ids = (
        read_table(spark, folder, "part")
        .join(names, F.col("p_name") == F.col("product_name"))
        .select(F.col("p_partkey").alias("product_id"), "named")
    )
    columns = [
        F.col("named").alias("product_id") if name == "product_id" else F.col(name)
        for name in lines.columns
    ]
    return lines.join(ids, "product_id").select(*columns)


def with_suppliers(products: DataFrame, spark: SparkSession, folder: str) -> DataFrame:
    """The catalogue and every supplier as a product that no line holds.

    Suppliers are dealt to seven departments, of which the last has no sold product.
    """
    suppliers = read_table(spark, folder, "supplier").select(
        (F.col("s_suppkey") + SUPPLIER_IDS).alias("product_id"),
        F.col("s_name").alias("product_name"),
        F.col("s_nationkey").cast("int").alias("aisle_id"),
        (F.col("s_suppkey") % 7 + 1).cast("int").alias("department_id"),
    )
    return schemas.require(products.unionByName(suppliers), schemas.PRODUCTS)


_written: dict[tuple, Warehouse] = {}


def _changed_at(spark: SparkSession, folder: str) -> tuple[int, ...]:
    """When each of the tables behind a warehouse was last written."""
    out = []
    for name in ("lineitem", "orders", "part", "supplier"):
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}.parquet")
        out.append(path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).getModificationTime())
    return tuple(out)


def warehouse(spark: SparkSession, folder: str, grain: str = "name") -> Warehouse:
    """Catalogue and feature tables of a grain, each feature written once for unchanged tables.

    ``grain`` is ``name``, ``part``, or ``wide`` for part grain with the suppliers as products
    that were never sold.
    """
    key = (spark.sparkContext.applicationId, folder, grain, _changed_at(spark, folder))
    if key not in _written:
        products, lines = part_products(spark, folder), part_lines(spark, folder)
        baskets = part_baskets(spark, folder)
        if grain == "name":
            products = name_products(spark, folder)
            lines, baskets = to_names(lines, spark, folder), to_names(baskets, spark, folder)
        elif grain == "wide":
            products = with_suppliers(products, spark, folder)
        elif grain != "part":
            raise ValueError(f"unknown grain {grain!r}")
        _written[key] = Warehouse(grain, products, lines, baskets)
    return _written[key]


def queries(spark: SparkSession, folder: str) -> DataFrame:
    """Query texts found in the tables: ``(query_id, user_query)``.

    Part names, the words of part names, benchmark texts, nation names and supplier names. The
    last three match no part name.
    """

    def texts(prefix: str, table: DataFrame, key: str, text: str) -> DataFrame:
        return table.select(
            F.concat(F.lit(prefix), F.col(key).cast("string")).alias("query_id"),
            F.col(text).alias("user_query"),
        )

    part = read_table(spark, folder, "part")
    words = part.select(F.explode(F.split("p_name", " ")).alias("word")).distinct()
    return (
        texts("part-", part, "p_partkey", "p_name")
        .unionAll(texts("word-", words, "word", "word"))
        .unionAll(texts("item-", read_table(spark, folder, "benchmark"), "item_id", "text"))
        .unionAll(texts("nation-", read_table(spark, folder, "nation"), "n_name", "n_name"))
        .unionAll(texts("supplier-", read_table(spark, folder, "supplier"), "s_suppkey", "s_name"))
    )


def query_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors of part and benchmark queries whose number has one: ``(query_id, embedding)``."""
    vectors = read_table(spark, folder, "embeddings")
    items = read_table(spark, folder, "benchmark").select(F.col("item_id").alias("vec_id"))

    def named(prefix: str, df: DataFrame) -> DataFrame:
        return df.select(
            F.concat(F.lit(prefix), F.col("vec_id").cast("string")).alias("query_id"), "embedding"
        )

    return named("part-", vectors).unionAll(named("item-", vectors.join(items, "vec_id")))


def product_vectors(spark: SparkSession, folder: str, products: DataFrame) -> DataFrame:
    """Vectors of the products that have one: ``(product_id, embedding)``."""
    vectors = read_table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("product_id"), "embedding"
    )
    return vectors.join(products.select("product_id"), "product_id", "left_semi")


def deliveries(spark: SparkSession, folder: str) -> DataFrame:
    """Which supplier delivers which part, as an edge of strings per order line."""
    return read_table(spark, folder, "lineitem").select(
        F.concat(F.lit("s."), F.col("l_suppkey").cast("string")).alias("src"),
        F.concat(F.lit("p."), F.col("l_partkey").cast("string")).alias("dst"),
    )


def edges(spark: SparkSession, folder: str) -> DataFrame:
    """Which supplier delivers which part, as distinct edges of strings."""
    return deliveries(spark, folder).distinct()


def corpus(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as ``(path, text)``."""
    documents = read_table(spark, folder, "documents").select("doc_id", "source", "text")
    return spread(documents, "doc_id").select(
        F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"),
        "text",
    )
