"""Feature tables over order lines: product velocity, basket affinity and cut-offs.

The formulas are this library's own definitions:

* ``total_units`` counts order lines, or sums their quantity on request;
* ``total_orders`` counts distinct orders of the product;
* ``reorder_rate`` is the share of a product's (customer, order) purchases that are
  not the customer's first purchase of it;
* ``co_purchase_count`` counts orders that hold both products of a pair, each
  unordered pair held once with ``product_id_a < product_id_b``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from cartloom.session import dealt

BASKET_BLOCK = 512


def sku_velocity(lines: DataFrame, products: DataFrame, units: str = "count") -> DataFrame:
    """Units, orders and reorder rate per product that was sold.

    A customer who bought a product in n orders reordered it n - 1 times whatever the
    dates, so no per-customer ordering is needed. The three groupings get coarser step
    by step, each with a partial aggregate before its shuffle: a product or a
    (product, customer) pair that holds a large share of the lines stays spread out
    until it is a handful of partial rows.
    """
    amounts: dict[str, Column] = {
        "count": F.count(F.lit(1)),
        "quantity": F.sum("quantity").cast("bigint"),
    }
    if units not in amounts:
        raise ValueError(f"units must be one of {sorted(amounts)}, not {units!r}")
    velocity = (
        lines.where(F.col("product_id").isNotNull())
        .groupBy("product_id", "customer_id", "order_id")
        .agg(amounts[units].alias("units"))
        .groupBy("product_id", "customer_id")
        .agg(F.sum("units").alias("units"), F.count(F.lit(1)).alias("orders"))
        .groupBy("product_id")
        .agg(
            F.sum("units").alias("total_units"),
            F.sum("orders").alias("total_orders"),
            (F.sum(F.col("orders") - 1) / F.sum("orders")).alias("reorder_rate"),
        )
    )
    return velocity.join(
        products.select("product_id", "product_name", "department_id"), "product_id"
    ).select(
        "product_id", "product_name", "department_id", "total_units", "total_orders", "reorder_rate"
    )


def basket_affinity(
    lines: DataFrame, min_count: int = 1, block: int = BASKET_BLOCK
) -> DataFrame:
    """How many orders hold both products, for every pair of products that share one.

    Lines are first reduced to distinct (order, product), which also bounds the largest
    order by the catalogue. Orders of up to ``block`` products form their pairs inside
    one array. A larger order is cut into blocks of about ``block`` products by a hash
    of the product, and each pair of blocks is a group of its own, so that no task
    holds more than two blocks and the pairs of one order spread over the cluster. The
    pair counts are combined before they are shuffled. Rows are dealt to all shuffle
    partitions, as few compressed bytes become many rows, pairs and sorted sets in a task.

    ``min_count`` keeps pairs seen at least that often. A product in fewer orders than
    that cannot be part of such a pair, so it is dropped before pairs are formed.
    """
    sold = lines.select("order_id", "product_id").where(
        F.col("order_id").isNotNull() & F.col("product_id").isNotNull()
    )
    items = dealt(sold, "order_id", "product_id").distinct()
    if min_count > 1:
        frequent = (
            items.groupBy("product_id")
            .agg(F.count(F.lit(1)).alias("orders"))
            .where(F.col("orders") >= min_count)
            .select("product_id")
        )
        items = items.join(frequent, "product_id")

    items = dealt(items, "order_id")
    large = (
        items.groupBy("order_id")
        .agg(F.count(F.lit(1)).alias("products"))
        .where(F.col("products") > block)
        .select("order_id", F.ceil(F.col("products") / block).cast("int").alias("blocks"))
    )
    # A left join with a null test, not an anti join: that would be pushed below distinct()
    # and the distinct rows would be worked out again for each of their uses.
    sized = items.join(large, "order_id", "left")
    small_sets = (
        sized.where(F.col("blocks").isNull())
        .groupBy("order_id")
        .agg(F.collect_list("product_id").alias("items"))
        .where(F.size("items") > 1)
        .select("items")
    )
    # an order came to one task; its rows are spread again before they are repeated for each block
    blocks = _block_sets(sized.where(F.col("blocks").isNotNull()).repartition("order_id", "product_id"))
    pairs = (
        _pairs_within(small_sets)
        .unionAll(_pairs_within(blocks.where("same").select(F.col("left").alias("items"))))
        .unionAll(_pairs_across(blocks.where("NOT same")))
    )
    counts = pairs.groupBy("product_id_a", "product_id_b").agg(
        F.count(F.lit(1)).alias("co_purchase_count")
    )
    return counts if min_count <= 1 else counts.where(F.col("co_purchase_count") >= min_count)


def _block_sets(items: DataFrame) -> DataFrame:
    """Products of large orders as one row per pair of blocks, the blocks in two arrays."""
    blocked = items.withColumn(
        "mine", F.pmod(F.xxhash64("product_id"), F.col("blocks")).cast("int")
    )
    cells = blocked.select(
        "order_id",
        "product_id",
        "mine",
        F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"),
    ).select(
        "order_id",
        "product_id",
        "mine",
        F.least("mine", "other").alias("i"),
        F.greatest("mine", "other").alias("j"),
    )
    return (
        cells.repartition("order_id", "i", "j")
        .groupBy("order_id", "i", "j")
        .agg(
            F.collect_list(F.when(F.col("mine") == F.col("i"), F.col("product_id"))).alias("left"),
            F.collect_list(F.when(F.col("mine") == F.col("j"), F.col("product_id"))).alias("right"),
        )
        .select("left", "right", (F.col("i") == F.col("j")).alias("same"))
    )


def _pairs_within(sets: DataFrame) -> DataFrame:
    """Every pair of a set once: each item with the sorted ones after it."""
    items = F.col("items")
    return (
        sets.select(F.sort_array("items").alias("items"))
        .select(F.posexplode("items").alias("at", "product_id_a"), "items")
        .select("product_id_a", F.explode(F.slice(items, F.col("at") + 2, F.size(items))).alias("product_id_b"))
    )


def _pairs_across(sets: DataFrame) -> DataFrame:
    """Pairs of an item of the left and one of the right array, which share none."""
    return (
        sets.withColumn("l", F.explode("left"))
        .select("l", F.explode("right").alias("r"))
        .select(
            F.least("l", "r").alias("product_id_a"),
            F.greatest("l", "r").alias("product_id_b"),
        )
    )


def quantiles(
    df: DataFrame, column: str, probs: Mapping[str, float], pieces: int = 64
) -> DataFrame:
    """Exact interpolated quantiles of a column, one row ``(name, value)`` per entry of ``probs``.

    Equal values are counted first. The distinct values are then cut into pieces at
    approximate quantiles (at most ``pieces`` numbers on the driver); running totals
    inside each piece plus the totals of the pieces before it give every value's
    position, so that no task sorts the whole column.
    """
    counts = (
        df.where(F.col(column).isNotNull())
        .groupBy(F.col(column).cast("double").alias("v"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    steps = [i / pieces for i in range(1, pieces)]
    cuts = counts.select(F.percentile_approx("v", steps, 1000)).first()[0] or []
    bounds = F.array(*[F.lit(float(cut)) for cut in sorted(set(cuts))]).cast("array<double>")
    placed = counts.withColumn(
        "piece", F.size(F.filter(bounds, lambda bound: bound < F.col("v")))
    )
    # One row per piece, at most ``pieces`` rows.
    everything = Window.partitionBy()
    offsets = (
        placed.groupBy("piece")
        .agg(F.sum("n").alias("in_piece"))
        .select(
            "piece",
            (F.sum("in_piece").over(everything.orderBy("piece")) - F.col("in_piece")).alias(
                "offset"
            ),
            F.sum("in_piece").over(everything).alias("total"),
        )
    )
    located = (
        placed.withColumn("upto", F.sum("n").over(Window.partitionBy("piece").orderBy("v")))
        .join(F.broadcast(offsets), "piece")
        .select(
            "v",
            "total",
            (F.col("offset") + F.col("upto") - F.col("n")).alias("first"),
            (F.col("offset") + F.col("upto") - 1).alias("last"),
        )
    )
    wanted = F.array(
        *[
            F.struct(F.lit(name).alias("name"), F.lit(float(prob)).alias("prob"))
            for name, prob in probs.items()
        ]
    )
    at = F.col("prob") * (F.col("total") - 1)

    def value_at(position: Column) -> Column:
        return F.max(F.when(position.between(F.col("first"), F.col("last")), F.col("v")))

    return (
        located.select("*", F.inline(wanted))
        .groupBy("name")
        .agg(
            value_at(F.floor(at)).alias("low"),
            value_at(F.ceil(at)).alias("high"),
            F.max(at - F.floor(at)).alias("part"),
        )
        .select("name", (F.col("low") + F.col("part") * (F.col("high") - F.col("low"))).alias("value"))
    )


#: Items that a sketch keeps a level; more make it larger and its ranks more exact.
SKETCH_SIZE = 4096


def rank_error(size: int = SKETCH_SIZE) -> float:
    """How far the rank of an approximate quantile is off, of all values, with a confidence of 99 percent."""
    return 2.296 / size**0.9723


def quantile_sketches(df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), size: int = SKETCH_SIZE) -> DataFrame:
    """``(*by, name, sketch)``: a sketch of the values of each column, per group of ``by``.

    A sketch has a bounded size whatever it was built from, and sketches merge, so those of new
    days, partitions or files are added to the stored ones without reading old rows again. Null
    and NaN are no values.
    """
    own = [
        F.kll_sketch_agg_double(F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")), F.lit(size)).alias(f"of_{at}")
        for at, c in enumerate(columns)
    ]
    rows = df.groupBy(*by).agg(*own)
    named = F.array(*[F.struct(F.lit(c).alias("name"), F.col(f"of_{at}").alias("sketch")) for at, c in enumerate(columns)])
    return rows.select(*by, F.inline(named)).where(F.col("sketch").isNotNull() & (F.kll_sketch_get_n_double("sketch") > 0))


def approximate_quantiles(sketches: DataFrame, probs: Mapping[str, Mapping[str, float]], size: int = SKETCH_SIZE) -> DataFrame:
    """``(name, quantile, value)`` from the merged sketches of each name.

    ``probs`` gives the quantiles of each name by their names. The rank of a value is off by at
    most :func:`rank_error`, with its confidence, of the number of values.
    """
    merged = sketches.groupBy("name").agg(F.kll_merge_agg_double("sketch", F.lit(size)).alias("sketch"))
    found = F.array(*[
        F.struct(
            F.lit(name).alias("own"), F.lit(key).alias("quantile"),
            F.kll_sketch_get_quantile_double("sketch", F.lit(float(prob))).alias("value"),
        )
        for name, own in probs.items() for key, prob in own.items()
    ])
    return merged.select("name", F.inline(found)).where(F.col("name") == F.col("own")).select("name", "quantile", "value")


def calibrate_sketches(
    sketches: DataFrame,
    affinity_probs: tuple[float, float, float] = (0.75, 0.5, 0.25),
    units_prob: float = 0.5,
    rate_prob: float = 0.25,
) -> DataFrame:
    """The cut-offs of :func:`calibrate` from sketches of its three columns."""
    levels = dict(zip(("affinity_high", "affinity_mid", "affinity_low"), affinity_probs))
    probs = {"co_purchase_count": levels, "total_units": {"units_mid": units_prob}, "reorder_rate": {"rate_low": rate_prob}}
    names = [*levels, "units_mid", "rate_low"]
    found = approximate_quantiles(sketches, probs)
    return found.groupBy().agg(*[F.max(F.when(F.col("quantile") == name, F.col("value"))).alias(name) for name in names])


def calibrate(
    affinity: DataFrame,
    velocity: DataFrame,
    affinity_probs: tuple[float, float, float] = (0.75, 0.5, 0.25),
    units_prob: float = 0.5,
    rate_prob: float = 0.25,
) -> DataFrame:
    """One row of cut-offs taken from the data instead of fixed numbers.

    Columns ``affinity_high``, ``affinity_mid``, ``affinity_low``, ``units_mid`` and
    ``rate_low``; :meth:`cartloom.functions.rules.Cuts.from_row` reads them.
    """
    levels = dict(zip(("affinity_high", "affinity_mid", "affinity_low"), affinity_probs))
    rows = (
        quantiles(affinity, "co_purchase_count", levels)
        .unionAll(quantiles(velocity, "total_units", {"units_mid": units_prob}))
        .unionAll(quantiles(velocity, "reorder_rate", {"rate_low": rate_prob}))
    )
    return rows.groupBy().agg(
        *[
            F.max(F.when(F.col("name") == name, F.col("value"))).alias(name)
            for name in (*levels, "units_mid", "rate_low")
        ]
    )
