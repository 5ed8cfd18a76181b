"""A persistent table keyed by digest, bucketed and sorted by it, to which rows are only appended.

At `location` lie the folders of the rows and a log: one line for each folder that was current, with its
bucket count; the last line counts. Compaction writes a new folder beside the old one and then adds its line,
so whoever opens the location sees the rows either before or after it. One writer at a time; readers keep
only the first row of a digest should two writers have added one each.

Defined results: a location without a log is an empty store; an append of no rows changes nothing; null value
columns stay null; columns besides the store's own are ignored."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bazaarlake.llm.common import log_rows, shared_dir, task_count

LOG = "version long, folder string, buckets int"


class DigestStore:
    """digest BINARY plus value columns, in `buckets` buckets by digest, each file sorted by digest.

    Joins on digest read the bucketed side without a shuffle. `location` outlives the session: opening
    the same location again (in any session) sees the rows of all earlier appends. An append is a plain
    Spark write job with its commit protocol, so a lost executor only reruns its tasks, and appending a
    batch twice is harmless because callers append only what `missing` returned."""

    def __init__(self, spark: SparkSession, columns: str, location: str | None = None, buckets: int = 64):
        self.spark, self.columns = spark, columns
        self.location = (location or f"{shared_dir(spark)}/digests-{uuid.uuid4().hex}").rstrip("/")
        self.version, folder, self.buckets = max(map(tuple, log_rows(spark, f"{self.location}/log", LOG)), default=(-1, "", buckets))
        if self.version < 0:
            self._log(f"rows-{uuid.uuid4().hex}", buckets)
        else:
            self.table = self._opened(folder, self.buckets)

    def _opened(self, folder: str, buckets: int) -> str:
        table = f"digests_{uuid.uuid4().hex}"
        self.spark.sql(
            f"CREATE TABLE {table} (digest BINARY, {self.columns}) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{self.location}/{folder}'"
        )
        return table

    def _log(self, folder: str, buckets: int) -> None:
        """From now on folder holds the rows."""
        self.version, self.buckets, self.table = self.version + 1, buckets, self._opened(folder, buckets)
        self.spark.createDataFrame([(self.version, folder, buckets)], LOG).coalesce(1).write.mode("append").json(f"{self.location}/log")

    def rows(self) -> DataFrame:
        return self.spark.table(self.table)

    def missing(self, batch: DataFrame, *keys: str) -> DataFrame:
        """Rows of batch whose (digest, keys) the store lacks: a sort-merge anti-join."""
        on = ["digest", *keys]
        return batch.join(self.rows().select(*on).hint("merge"), on, "left_anti")

    def _write(self, rows: DataFrame, table: str, buckets: int) -> None:
        names = self.spark.table(table).columns
        rows.select(*names).repartition(buckets, "digest").sortWithinPartitions("digest").write.insertInto(table)
        self.spark.catalog.refreshTable(table)

    def append(self, rows: DataFrame) -> None:
        self._write(rows, self.table, self.buckets)

    def compact(self, buckets: int | None = None) -> None:
        """Rewrite the store with one sorted file a bucket, as many appends leave one each; buckets: how many from now on."""
        buckets, old = buckets or self.buckets, self.table
        folder = f"rows-{uuid.uuid4().hex}"
        fresh = self._opened(folder, buckets)
        self._write(self.rows(), fresh, buckets)
        self.spark.sql(f"DROP TABLE {fresh}")  # its files stay
        self._log(folder, buckets)
        self.spark.sql(f"DROP TABLE {old}")


ROWS_A_BUCKET = 50_000  # of the first batch


def buckets_for(docs: DataFrame) -> int:
    """Buckets for an index that begins with docs: as task_count() says."""
    return task_count(docs.sparkSession, docs.count(), ROWS_A_BUCKET)


def digest_of(column) -> F.Column:
    """SHA-256 as 32 bytes."""
    return F.unhex(F.sha2(column, 256))
