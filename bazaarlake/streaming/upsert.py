"""Idempotent upserts of listings into a versioned Parquet table: latest row of a key wins, some fields are sticky.

The table is dealt to buckets by the hash of its keys. A batch rewrites the buckets that it touches and no others; a log
line names the current folder of each rewritten bucket, so readers see a batch whole or not at all.

A batch is known by its query and its number: the same pair again is a replay and changes nothing, whereas another stream, or the same
one with a new checkpoint, counts its batches anew under its own name. Rows with a null key are a key like any other."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bazaarlake.sources.tables import stored

LOG = "seq long, query string, batch long, bucket int, folder string"


def latest(batch: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*(F.desc(c) for c in order))
    return batch.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def merge(current: DataFrame, batch: DataFrame, keys: list[str], sticky: list[str]) -> DataFrame:
    """Full outer join on the keys: a new row overwrites the old one, nulls included, but for sticky fields, which only disclosed values replace."""
    old, new = current.alias("old"), batch.withColumn("_new", F.lit(True)).alias("new")
    joined = old.join(new, [F.col(f"old.{k}").eqNullSafe(F.col(f"new.{k}")) for k in keys], "full_outer")

    def pick(name: str) -> Column:
        o, n = F.col(f"old.{name}"), F.col(f"new.{name}")
        return (F.coalesce(n, o) if name in keys or name in sticky else F.when(F.col("new._new"), n).otherwise(o)).alias(name)

    return joined.select(*(pick(c) for c in current.columns))


class VersionedTable:
    """A table under path; writing a batch of a query twice changes nothing, so foreachBatch may replay it. One writer at a time."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], order: list[str], sticky: list[str], buckets: int = 16):
        self.spark, self.path, self.keys, self.order, self.sticky, self.buckets = spark, path.rstrip("/"), keys, order, sticky, buckets

    def _log(self) -> list:
        try:
            return self.spark.read.schema(LOG).json(f"{self.path}/log").collect()  # a line a rewritten bucket of each batch
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return []

    def _current(self, log: list) -> dict[int, str]:
        """The folder of each bucket after the last batch that rewrote it."""
        return {r["bucket"]: r["folder"] for r in sorted(log, key=lambda r: r["seq"]) if r["bucket"] >= 0}

    def _rows(self, folders: list[str]) -> DataFrame | None:
        return self.spark.read.parquet(*(f"{self.path}/{f}" for f in folders)) if folders else None

    def read(self) -> DataFrame | None:
        return self._rows(sorted(self._current(self._log()).values()))

    def write(self, batch: DataFrame, batch_id: int, query: str = "") -> None:
        log = self._log()
        if any((r["query"], r["batch"]) == (query, batch_id) for r in log):
            return
        seq = max((r["seq"] for r in log), default=-1) + 1
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        fresh = stored(latest(batch, self.keys, self.order), "upsert-batch")
        touched = sorted(r["_bucket"] for r in fresh.select(bucket.alias("_bucket")).distinct().collect())  # `buckets` at most
        held, out = self._current(log), fresh
        current = self._rows([held[b] for b in touched if b in held])
        if current is not None:
            out = merge(current, fresh, self.keys, self.sticky)
        folder = f"batch={seq:010d}-{uuid.uuid4().hex}"
        out.withColumn("bucket", bucket).write.partitionBy("bucket").parquet(f"{self.path}/{folder}")
        lines = [(seq, query, batch_id, b, f"{folder}/bucket={b}") for b in touched] or [(seq, query, batch_id, -1, "")]
        self.spark.createDataFrame(lines, LOG).coalesce(1).write.mode("append").json(f"{self.path}/log")

    def each_batch(self, query: str):
        """What foreachBatch calls: query names the stream and its checkpoint."""
        return lambda batch, batch_id: self.write(batch, batch_id, query)
