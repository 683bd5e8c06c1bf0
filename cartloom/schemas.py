"""Column layouts shared by the readers, operators and tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, types as T


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields])


ORDER_LINES = _struct(
    ("order_id", T.LongType()),
    ("product_id", T.LongType()),
    ("customer_id", T.LongType()),
    ("order_ts", T.TimestampType()),
    ("quantity", T.DoubleType()),
)
PRODUCTS = _struct(
    ("product_id", T.LongType()),
    ("product_name", T.StringType()),
    ("aisle_id", T.IntegerType()),
    ("department_id", T.IntegerType()),
)
VELOCITY = _struct(
    ("product_id", T.LongType()),
    ("product_name", T.StringType()),
    ("department_id", T.IntegerType()),
    ("total_units", T.LongType()),
    ("total_orders", T.LongType()),
    ("reorder_rate", T.DoubleType()),
)
AFFINITY = _struct(
    ("product_id_a", T.LongType()),
    ("product_id_b", T.LongType()),
    ("co_purchase_count", T.LongType()),
)
DOCUMENTS = _struct(("product_id", T.LongType()), ("text", T.StringType()))
VECTORS = _struct(("vec_id", T.LongType()), ("embedding", T.ArrayType(T.FloatType())))
CHUNKS = _struct(
    ("path", T.StringType()),
    ("symbol", T.StringType()),
    ("kind", T.StringType()),
    ("start_line", T.IntegerType()),
    ("end_line", T.IntegerType()),
    ("text", T.StringType()),
)
EDGES = _struct(("src", T.StringType()), ("dst", T.StringType()))

ANCHOR_STRUCT = _struct(
    ("product_id", T.LongType()),
    ("product_name", T.StringType()),
    ("aisle_id", T.IntegerType()),
    ("department_id", T.IntegerType()),
    ("reorder_rate", T.DoubleType()),
    ("total_units", T.LongType()),
    ("total_orders", T.LongType()),
)
ADDON_STRUCT = _struct(
    ("product_id", T.LongType()),
    ("product_name", T.StringType()),
    ("co_purchase_count", T.LongType()),
    ("reorder_rate", T.DoubleType()),
    ("total_units", T.LongType()),
)
BUNDLE_STRUCT = _struct(
    ("rank", T.IntegerType()),
    ("bundle_score", T.DoubleType()),
    ("theme", T.StringType()),
    ("offer", T.StringType()),
    ("confidence", T.StringType()),
    ("expected_impact", T.StringType()),
    ("placement", T.ArrayType(T.StringType())),
    ("anchor", ANCHOR_STRUCT),
    ("add_ons", T.ArrayType(ADDON_STRUCT)),
)


def require(df: DataFrame, schema: T.StructType) -> DataFrame:
    """``df`` reduced to the columns of ``schema``; raises if one is missing or of another type."""
    have = {field.name: field.dataType.simpleString() for field in df.schema.fields}
    wrong = [
        f"{field.name} {field.dataType.simpleString()}"
        for field in schema.fields
        if have.get(field.name) != field.dataType.simpleString()
    ]
    if wrong:
        raise ValueError(f"expected {', '.join(wrong)}; found {have}")
    return df.select(*schema.fieldNames())
