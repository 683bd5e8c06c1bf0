"""Requests as a stream: each micro-batch of queries is one promotion run.

The feature tables are static, so a micro-batch is an ordinary batch plan. Results and
log go to a folder per batch that a repeated batch overwrites, so a restart after a lost
driver neither drops nor doubles requests. Intermediate tables of a batch are deleted after it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from cartloom.session import materialize, scratch_scope
from cartloom.sources.runlog import run_log


def serve(
    requests: DataFrame,
    answer: Callable[[DataFrame], DataFrame],
    results_path: str,
    log_path: str,
    checkpoint_path: str,
    **trigger,
) -> StreamingQuery:
    """Answer a stream ``(query_id, user_query)`` with ``answer``, a promotion run over a batch."""

    def batch(queries: DataFrame, batch_id: int) -> None:
        with scratch_scope(queries.sparkSession):
            promoted = materialize(answer(queries), f"batch-{batch_id}")
            promoted.write.mode("overwrite").parquet(f"{results_path}/batch={batch_id}")
            run_log(promoted, str(batch_id)).write.mode("overwrite").parquet(
                f"{log_path}/batch={batch_id}"
            )

    writer = requests.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint_path)
    return writer.trigger(**trigger).start() if trigger else writer.start()
