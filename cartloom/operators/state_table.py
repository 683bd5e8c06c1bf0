"""A keyed state that stays where it is: refreshes add what changed and shuffle no stored row.

The state is a table in buckets of a hash of the key. A refresh deals the new keys and hashes to
the buckets, compares them there, and appends rows for the keys that are new, changed or gone, with
the number of the refresh. The state of a key is its last row. Rows that did not change are read
for the comparison, by key and hash alone, and neither moved nor written again.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cartloom.session import materialize


def _slot(key: str) -> Column:
    """The hash that keys are dealt by; that of the null key is no null."""
    return F.xxhash64(key)


def _same(*pairs: tuple[str, str]) -> Column:
    """Whether all pairs are equal, null to null; written so that a join stays one on the slot alone."""
    equal = [F.col(a).eqNullSafe(F.col(b)).cast("int") for a, b in pairs]
    return F.least(*equal, F.lit(1)) == 1


@dataclass(frozen=True)
class KeyedState:
    """A state table of the session's catalogue: ``(slot, key, hash, payload, version, gone)``."""

    spark: SparkSession
    name: str
    buckets: int

    def rows(self) -> DataFrame:
        """All rows of all refreshes."""
        return self.spark.table(self.name)

    def current(self) -> DataFrame:
        """``(key, hash, payload)`` of every key that is not gone."""
        return self._last("hash", "payload").select("key", "hash", "payload")

    def _last(self, *columns: str) -> DataFrame:
        last = F.max_by(F.struct(*columns, "gone"), "version").alias("last")
        return self.rows().groupBy("slot", "key").agg(last).where("NOT last.gone").select("slot", "key", "last.*")

    def changed(self, now: DataFrame, key: str, hash_col: str) -> DataFrame:
        """Rows of ``now`` that are new or whose hash differs from the state's; the state is not shuffled."""
        held = self._last("hash").select(F.col("slot").alias("own_slot"), F.col("key").alias("own_key"), F.col("hash").alias("own_hash"))
        asked = now.withColumn("own_place", _slot(key))
        unchanged = (F.col("own_place") == F.col("own_slot")) & _same((key, "own_key"), (hash_col, "own_hash"))
        return asked.join(held, unchanged, "left_anti").drop("own_place")

    def vanished(self, now: DataFrame, key: str) -> DataFrame:
        """``(slot, key)`` of the keys of the state that ``now`` does not hold; the state is not shuffled."""
        asked = now.select(_slot(key).alias("own_slot"), F.col(key).alias("own_key")).distinct()
        held = (F.col("slot") == F.col("own_slot")) & _same(("key", "own_key"))
        return self._last("hash").join(asked, held, "left_anti").select("slot", "key")

    def refresh(
        self,
        now: DataFrame,
        key: str,
        hash_col: str,
        compute: Callable[[DataFrame], DataFrame],
        keep_missing: bool = False,
    ) -> DataFrame:
        """Bring the state to ``now`` and return it, as :func:`cartloom.operators.incremental.refresh` does.

        ``compute`` turns changed rows into ``(key, hash, payload)`` rows. The rows to add are
        written to the shared folder before they are appended, all at once.
        """
        number = (self.rows().agg(F.max("version")).first()[0] or 0) + 1
        kinds = dict(self.rows().dtypes)
        fresh = compute(self.changed(now, key, hash_col)).select(
            _slot(key).alias("slot"), F.col(key).alias("key"), F.col(hash_col).alias("hash"), "payload",
            F.lit(number).alias("version"), F.lit(False).alias("gone"),
        )
        if not keep_missing:
            fresh = fresh.unionByName(self.vanished(now, key).select(
                "slot", "key", F.lit(None).cast(kinds["hash"]).alias("hash"), F.lit(None).cast(kinds["payload"]).alias("payload"),
                F.lit(number).alias("version"), F.lit(True).alias("gone"),
            ))
        added = materialize(fresh, "state-added")
        added.repartition(self.buckets, "slot").write.insertInto(self.name)
        return self.current()

    def drop(self) -> None:
        """Forget the table; its files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def keyed_state(
    spark: SparkSession, name: str, path: str, key: str = "string", hash_type: str = "string", payload: str = "string",
    buckets: int | None = None,
) -> KeyedState:
    """The state at ``path``, an empty one if the folder is new, as table ``name`` of this session.

    ``key``, ``hash_type`` and ``payload`` are the types of the columns. ``buckets`` has to be the
    same each time; it is the number of the session's shuffle partitions unless given, and Spark
    shuffles tables of fewer.
    """
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {name} (slot BIGINT, key {key}, hash {hash_type}, payload {payload}, version INT, gone BOOLEAN) "
        f"USING parquet CLUSTERED BY (slot) SORTED BY (slot) INTO {buckets} BUCKETS LOCATION '{path}'"
    )
    return KeyedState(spark, name, buckets)
