"""Tables written between steps: they cut lineage and survive lost executors."""

from __future__ import annotations

import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession


@lru_cache(maxsize=1)
def _own_dir() -> str:
    return f"file://{tempfile.mkdtemp(prefix='bazaarlake-')}"


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a temporary folder in a local session and one beside the warehouse's tables on a cluster."""
    if path := spark.conf.get("spark.checkpoint.dir", None):
        return path.rstrip("/")
    if spark.sparkContext.master.split("[")[0] == "local":
        return _own_dir()
    return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_bazaarlake"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
