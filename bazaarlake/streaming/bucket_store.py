"""Tables under one path that change together: a batch's files of all of them are named by one line of a log.

A keyed part is dealt to buckets by its key, and a batch rewrites the buckets that it touches and no others; a part without a key only
grows. Readers see a batch whole or not at all; a batch is known by its query and number, so a replay finds its line. One
writer at a time."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LOG = "seq long, query string, batch long, files array<struct<part: string, bucket: int, folder: string>>"


def fields_of(schema: str) -> list[str]:
    return SparkSession.active().createDataFrame([], schema).columns


class BucketStore:
    """parts: of each its columns and the key of its buckets, None for a part that only grows."""

    def __init__(self, spark: SparkSession, path: str, parts: dict[str, tuple[str, list[str] | None]], buckets: int = 16):
        self.spark, self.path, self.parts, self.buckets = spark, path.rstrip("/"), parts, buckets

    def log(self) -> list:
        try:
            return sorted(self.spark.read.schema(LOG).json(f"{self.path}/log").collect(), key=lambda r: r["seq"])  # a line a batch
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return []

    def folders(self, log: list, part: str) -> dict:
        """Present folders of a part, by bucket; of a part that grows, by place in the log."""
        held = {}
        for line in log:
            for f in line["files"]:
                if f["part"] == part:
                    held[f["bucket"] if self.parts[part][1] else (line["seq"], f["bucket"])] = f["folder"]
        return held

    def rows(self, part: str, folders: list[str]) -> DataFrame:
        return self.spark.read.schema(self.parts[part][0]).parquet(*(f"{self.path}/{f}" for f in folders)) if folders else self.spark.createDataFrame([], self.parts[part][0])

    def read(self, part: str) -> DataFrame:
        """A part as the last commit left it."""
        return self.rows(part, sorted(self.folders(self.log(), part).values()))

    def bucket(self, part: str) -> Column:
        return F.pmod(F.xxhash64(*self.parts[part][1]), F.lit(self.buckets)).cast("int").alias("bucket")

    def present(self, part: str, keys: DataFrame, log: list) -> DataFrame:
        """The present rows of the buckets that keys touch."""
        held = self.folders(log, part)
        buckets = [r["bucket"] for r in keys.select(self.bucket(part)).distinct().collect()]  # `buckets` at most
        return self.rows(part, sorted(held[b] for b in buckets if b in held))

    def touched(self, part: str, keys: DataFrame, log: list) -> tuple[DataFrame, DataFrame]:
        """Of the buckets that keys touch: the present rows with one of the keys, and the others."""
        key = self.parts[part][1]
        present, own = self.present(part, keys, log), keys.select(*key).distinct()
        return present.join(own, key, "left_semi"), present.join(own, key, "left_anti")

    def write(self, part: str, rows: DataFrame, folder: str, keys: DataFrame | None = None) -> list[tuple]:
        """Write rows; of a keyed part they are all rows of the touched buckets. keys: what touched them, where a bucket may be left without rows."""
        names = fields_of(self.parts[part][0])
        if self.parts[part][1] is None:
            rows.select(*names).write.parquet(f"{self.path}/{folder}/{part}")
            return [(part, 0, f"{folder}/{part}")]
        bucket = F.col("bucket") if "bucket" in rows.columns else self.bucket(part)  # rows that come in order of it are not sorted again
        rows.select(*names, bucket).write.option("compression", "zstd").partitionBy("bucket").parquet(f"{self.path}/{folder}/{part}")
        written = {r["bucket"] for r in self.spark.read.schema(f"{self.parts[part][0]}, bucket int").parquet(f"{self.path}/{folder}/{part}").select("bucket").distinct().collect()}
        files = [(part, b, f"{folder}/{part}/bucket={b}") for b in sorted(written)]
        gone = set() if keys is None else {r["bucket"] for r in keys.select(self.bucket(part)).distinct().collect()} - written
        if gone:
            self.spark.createDataFrame([], self.parts[part][0]).write.parquet(f"{self.path}/{folder}/{part}-none")
        return files + [(part, b, f"{folder}/{part}-none") for b in sorted(gone)]

    def next_batch(self, log: list, query: str, batch: int | None) -> tuple[int, str] | None:
        """The number and a new folder for a batch of the query (its next one, if none is named); None if it was committed before."""
        done = {r["batch"] for r in log if r["query"] == query}
        if batch in done:
            return None
        seq = log[-1]["seq"] + 1 if log else 0
        return max(done, default=-1) + 1 if batch is None else batch, f"batch-{seq:08d}-{uuid.uuid4().hex}"

    def commit(self, log: list, query: str, batch: int, files: list[tuple]) -> None:
        seq = log[-1]["seq"] + 1 if log else 0
        self.spark.createDataFrame([(seq, query, batch, files)], LOG).coalesce(1).write.mode("append").json(f"{self.path}/log")
