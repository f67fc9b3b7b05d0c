"""Stored tables that take batches of changes (#56, #58-#61 on a written table).

A table is partitioned by a hash of its key into a fixed number of buckets. A
batch of changes reads and rewrites only the buckets that hold rows it changes
(dynamic partition overwrite); the files of all others stay as they are. Every
row carries the place of the last change applied to it, and changes at or before
that place are passed over. So a batch applied twice, also after later ones,
changes nothing and writes nothing, and a batch that was cut short is finished
by applying it again.

A key's changes must come in the order of their places; the key identifies a row.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tickets as TK

BUCKET, APPLIED = "_bucket", "_applied"


@dataclass(frozen=True)
class StoredTable:
    spark: SparkSession
    path: str
    key: str
    place: str      # type of the changes' places: a sequence number or a time
    buckets: int = 64

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(F.col(self.key).cast("string")), F.lit(self.buckets)).cast("int")

    def create(self, rows: DataFrame) -> StoredTable:
        """Write ``rows`` as a new table, one file a bucket."""
        self._write(rows.withColumn(APPLIED, F.lit(None).cast(self.place)).withColumn(BUCKET, self.bucket()), "errorifexists")
        return self

    def _write(self, rows: DataFrame, mode: str) -> None:
        writer = rows.repartition(F.col(BUCKET)).write.mode(mode).option("partitionOverwriteMode", "dynamic")
        writer.partitionBy(BUCKET).parquet(self.path)

    def _stored(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def read(self) -> DataFrame:
        """The table's rows and their own columns."""
        return self._stored().drop(BUCKET, APPLIED)

    def pending(self, changes: DataFrame, place: str) -> DataFrame:
        """The changes to stored rows that come after the last one applied there."""
        at = self._stored().select(self.key, APPLIED)
        return changes.join(at, self.key).where(F.col(APPLIED).isNull() | (F.col(place) > F.col(APPLIED))).drop(APPLIED)

    def apply(self, changes: DataFrame, place: str, change: Callable[[DataFrame, DataFrame], DataFrame]) -> list[int]:
        """Apply ``change(rows, changes)`` to the buckets that pending changes touch; returns these buckets.

        ``change`` returns the rows it got, with new values; it may add columns.
        """
        pending = self.pending(changes, place).checkpoint(eager=True)
        touched = sorted(r[0] for r in pending.select(self.bucket()).distinct().collect())  # ``buckets`` rows at most
        if touched:
            old = self._stored().where(F.col(BUCKET).isin(touched))
            last = pending.groupBy(self.key).agg(F.max(place).cast(self.place).alias("_last"))
            new = change(old.drop(BUCKET), pending).join(last, self.key, "left")
            new = new.withColumn(APPLIED, F.coalesce("_last", APPLIED)).drop("_last").withColumn(BUCKET, self.bucket())
            self._write(new, "overwrite")
        return touched


def create_tickets(spark: SparkSession, path: str, rows: DataFrame, place: str, buckets: int = 64) -> StoredTable:
    """A stored ticket table with every column that updates write."""
    return StoredTable(spark, path, "ticket_id", place, buckets).create(TK.with_update_columns(rows))


def create_queue(spark: SparkSession, path: str, rows: DataFrame, buckets: int = 64) -> StoredTable:
    """A stored triage queue with every column that actions write."""
    return StoredTable(spark, path, "ticket_id", "bigint", buckets).create(TK.evolve_schema(rows, TK.QUEUE_COLUMNS))


def apply_patches(table: StoredTable, patches: DataFrame, time_col: str = "patched_at") -> list[int]:
    """#56 on a stored ticket table."""
    return table.apply(patches, time_col, lambda rows, p: TK.patch_tickets(rows, p, time_col))


def apply_actions(queue: StoredTable, table: StoredTable, actions: DataFrame) -> tuple[list[int], list[int]]:
    """#58-#61 on a stored queue and its stored ticket table; each remembers what it has applied."""
    return (queue.apply(actions, "seq", TK.replay_queue), table.apply(actions, "seq", TK.replay_tickets))
