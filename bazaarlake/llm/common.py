"""Shared pieces of the training-data operators: null-safe document access, tables in the shared
folder (lineage cuts that outlive executors), bounded Arrow batches and skew-safe lookups."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parents[2])
#: A key is hot when it owns more than 1/HOT_SHARE of the rows, so fewer than HOT_SHARE keys are hot.
HOT_SHARE = 1000
BATCH_ROWS, BATCH_BYTES = 1024, 4 << 20


def prepare(spark: SparkSession) -> None:
    """Bound the Arrow batches (texts may be very long), drop a query's shuffle files as soon as it has ended, and let
    Python workers import this package. Results are lazy, so these settings of the session stay."""
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    env = spark.sparkContext.environment
    if ROOT not in (os.environ.get("PYTHONPATH", "") + ":" + env.get("PYTHONPATH", "")).split(":"):
        env["PYTHONPATH"] = f"{env['PYTHONPATH']}:{ROOT}" if env.get("PYTHONPATH") else ROOT


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def texts(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with null texts empty; other columns, whatever their names, are dropped."""
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"], F.lit("")).alias("text"))


@lru_cache(maxsize=1)
def _own_dir() -> str:
    return f"file://{tempfile.mkdtemp(prefix='bazaarlake-')}"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a local session (tests) gets a temporary folder and a cluster one beside the warehouse's tables."""
    if path := spark.conf.get("spark.checkpoint.dir", None):
        return path.rstrip("/")
    if spark.sparkContext.master.split("[")[0] == "local":
        return _own_dir()
    return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_bazaarlake"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: the lineage is cut, nothing is recomputed."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def log_rows(spark: SparkSession, path: str, schema: str) -> list:
    """The rows of a small JSON log at path, none if there is no log yet."""
    try:
        return spark.read.schema(schema).json(path).collect()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return []


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, however often (also within lambdas) body uses it."""
    return F.transform(F.array(value), body)[0]


def task_count(spark: SparkSession, rows: int, rows_a_task: int) -> int:
    """About one task for rows_a_task rows, at least two for each core and at most one for each shuffle partition."""
    most = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(1, min(most, max(2 * spark.sparkContext.defaultParallelism, -(-rows // rows_a_task))))


def right_sized(df: DataFrame, rows: int, rows_a_task: int) -> DataFrame:
    """df in task_count() tasks. Starting a Python task costs more than a small partition's work;
    neighbouring partitions are read by one task, without another shuffle."""
    return df.coalesce(task_count(df.sparkSession, rows, rows_a_task))


def lookup(facts: DataFrame, dim: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """facts LEFT JOIN dim on key (unique in dim), safe for hot keys.

    size is dim's column with the number of fact rows of its key, total their sum. Keys that hold more
    than total/HOT_SHARE rows are fewer than HOT_SHARE, so that part of dim is broadcast; the rest is
    sort-merge joined and no partition gets a hot key. size itself is kept from dim."""
    is_hot = F.col(size) * F.lit(HOT_SHARE) > F.lit(total)
    hot = F.broadcast(dim.filter(is_hot))
    first = facts.join(hot, key, "inner")
    rest = facts.join(F.broadcast(dim.filter(is_hot).select(key)), key, "left_anti").join(dim.filter(~is_hot), key, "left")
    return first.unionByName(rest)


def return_memory() -> None:
    """Give freed memory back to the system: Python workers outlive their tasks and share the executor's limit."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def arrow_map(df: DataFrame, schema: str, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]]) -> DataFrame:
    """mapInArrow with a function built once for each task; a batch that gives None yields no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            if batch.num_rows and (out := step(batch)) is not None:
                yield out
        del step
        return_memory()

    return df.mapInArrow(run, schema)


def utf8_list(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """The column's texts as UTF-8 bytes."""
    return batch.column(batch.schema.get_field_index(name)).cast(pa.binary()).to_pylist()


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser on a uint64 array."""
    x = x.copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Memo(dict):
    """A bounded cache of a function of a word: when full, it starts afresh."""

    def __init__(self, make: Callable, limit: int):
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.clear()
        self[key] = value = self.make(key)
        return value


def ragged_arange(lengths: np.ndarray) -> np.ndarray:
    """0..n-1 for each n of lengths, concatenated."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lengths, lengths)
