"""Keyed tables kept as hash buckets, so that a merge reads and writes only the buckets its batch touches.

A table is a folder with ``rows``, Parquet partitioned by slot (one bucket's rows of one commit), and ``log``, one
small file per commit that names the slots it wrote and whether each takes the place of the bucket's earlier slots.
A reader sees the slots that the log makes current. A commit writes its rows first and its log file last, in one
rename: whatever ends a job before that leaves the old state, and unnamed slots are never read.

One writer at a time is assumed. The log has a row per bucket of a commit; ``compact`` keeps it and the number of
slots small.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from perkwise.operators.keyed import new_rows, upsert
from perkwise.session import drop_path, folders, path_exists

BUCKETS = 256
_LOG = "commit bigint, batch string, bucket int, slot string, replaces boolean"


@dataclass(frozen=True)
class BucketedTable:
    """A table of unique ``keys`` below ``path``; buckets should hold what one task can merge."""

    spark: SparkSession
    path: str
    keys: tuple[str, ...]
    schema: T.StructType
    buckets: int = BUCKETS

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def log(self) -> DataFrame:
        """(commit, batch, bucket, slot, replaces) of all commits."""
        if not path_exists(self.spark, f"{self.path}/log"):
            return self.spark.createDataFrame([], _LOG)
        return self.spark.read.schema(_LOG).parquet(f"{self.path}/log")

    def current(self) -> DataFrame:
        """(bucket, slot) of the slots that make up the table now."""
        log = self.log()
        since = log.groupBy("bucket").agg(F.max(F.when(F.col("replaces"), F.col("commit"))).alias("since"))
        fresh = F.col("since").isNull() | (F.col("commit") >= F.col("since"))
        return log.join(since, "bucket").filter(F.col("slot").isNotNull() & fresh).select("bucket", "slot")

    def read(self, only: Sequence[int] | None = None) -> DataFrame:
        """The rows, or those of some buckets; other slots are pruned before any file is opened."""
        current = self.current()
        if only is not None:
            current = current.filter(F.col("bucket").isin(list(only)))
        slots = [r["slot"] for r in current.collect()]
        if not slots:
            return self.spark.createDataFrame([], self.schema)
        whole = T.StructType([*self.schema.fields, T.StructField("slot", T.StringType())])
        rows = self.spark.read.schema(whole).parquet(f"{self.path}/rows")
        return rows.filter(F.col("slot").isin(slots)).drop("slot")

    def touched(self, batch: DataFrame) -> list[int]:
        """The buckets of a batch, at most ``buckets`` numbers."""
        return sorted(r[0] for r in batch.select(self._bucket()).distinct().collect())

    def _commit(self, rows: DataFrame, touched: Sequence[int], replaces: bool, batch: str | None) -> int:
        number = (self.log().agg(F.max("commit")).first()[0] or 0) + 1
        slot = F.format_string(f"%06d-{number:010d}", F.col("_bucket"))
        placed = rows.select(*self.schema.names, self._bucket().alias("_bucket"))
        (
            placed.repartition("_bucket").withColumn("slot", slot).drop("_bucket")
            .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("slot").parquet(f"{self.path}/rows")
        )
        self.publish(number, touched, replaces, batch)
        return number

    def publish(self, number: int, touched: Sequence[int], replaces: bool, batch: str | None) -> None:
        """Append the one file that makes a commit visible. A commit without rows is noted too, so that a batch is known."""
        entries = [(number, batch, b, f"{b:06d}-{number:010d}", replaces) for b in touched]
        entries = entries or [(number, batch, -1, None, False)]
        self.spark.createDataFrame(entries, _LOG).coalesce(1).write.mode("append").parquet(f"{self.path}/log")

    def seen(self, batch: str | None) -> bool:
        """Whether a batch of this name was committed."""
        return batch is not None and not self.log().filter(F.col("batch") == batch).isEmpty()

    def insert_ignore(self, batch: DataFrame, order: Sequence[str], name: str | None = None) -> bool:
        """Add the first row per key of the batch where the key is new; only keys of touched buckets are read.

        Nothing that is stored is written again. A batch whose name was committed before changes nothing.
        """
        if self.seen(name):
            return False
        touched = self.touched(batch)
        added = new_rows(self.read(touched), batch, list(self.keys), order)
        self._commit(added, touched, False, name)
        return True

    def upsert(self, batch: DataFrame, order: Sequence[str], preserve: Sequence[str] = (), name: str | None = None) -> bool:
        """Insert or overwrite by key as ``keyed.upsert`` does; only touched buckets are read and written.

        A batch whose name was committed before changes nothing.
        """
        if self.seen(name):
            return False
        touched = self.touched(batch)
        merged = upsert(self.read(touched), batch, list(self.keys), order, preserve)
        self._commit(merged, touched, True, name)
        return True

    def compact(self) -> None:
        """Write every bucket of several slots as one."""
        several = [r["bucket"] for r in self.current().groupBy("bucket").count().filter("count > 1").collect()]
        if several:
            self._commit(self.read(several), several, True, None)

    def vacuum(self) -> int:
        """Delete the slots that no commit makes current; returns how many."""
        kept = {r["slot"] for r in self.current().collect()}
        old = [f for f in folders(self.spark, f"{self.path}/rows") if f.startswith("slot=") and f.removeprefix("slot=") not in kept]
        for folder in old:
            drop_path(self.spark, f"{self.path}/rows/{folder}")
        return len(old)

