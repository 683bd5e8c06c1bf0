"""The log of served requests: one appended row per query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

NAME_CHARS = 200
ERROR_CHARS = 500


def run_log(
    promoted: DataFrame,
    batch_id: str,
    endpoint: str = "/promo-recommendations",
    debug: bool = False,
    latency_ms: Column | None = None,
    error: Column | None = None,
    run_date: Column | None = None,
) -> DataFrame:
    """Log rows for the result of a promotion run.

    ``run_id`` is a hash of the batch and the query, so a repeated task writes the same
    row again and not another one.
    """
    message = F.lit(None).cast("string") if error is None else error
    return promoted.select(
        F.sha2(F.concat_ws("|", F.lit(batch_id), F.col("query_id").cast("string")), 256).alias(
            "run_id"
        ),
        F.col("user_query").alias("query"),
        F.lit(endpoint).alias("endpoint"),
        F.lit(debug).alias("debug"),
        F.when(message.isNull(), "ok").otherwise("error").alias("status"),
        (F.lit(None).cast("double") if latency_ms is None else latency_ms).alias("latency_ms"),
        F.size("bundles").cast("bigint").alias("bundle_count"),
        F.col("anchor_id").alias("anchor_product_id"),
        F.substring("anchor_name", 1, NAME_CHARS).alias("anchor_name"),
        F.substring(message, 1, ERROR_CHARS).alias("error_message"),
        F.to_json(
            F.struct(F.col("user_query").alias("query"), "bundles", "result_text"),
            {"ignoreNullFields": "false"},
        ).alias("payload"),
        (F.current_date() if run_date is None else run_date).alias("run_date"),
    )


def append_run_log(log: DataFrame, path: str) -> None:
    """Append log rows, one folder per day."""
    log.write.mode("append").partitionBy("run_date").parquet(path)
