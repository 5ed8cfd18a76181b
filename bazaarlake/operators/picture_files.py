"""Picture files: read with Spark's binary source, hashed in Arrow batches, taken into the image tables, searched by their bytes.

Files of more than the largest size aren't opened. A file that is no readable PNG has a null hash and size, and is left out where
rows for the image tables are made. Null content is such a file."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bazaarlake.functions.pictures import picture_hash, png_of
from bazaarlake.operators.hashjoin import search_all
from bazaarlake.operators.matching import SEARCH_DISTANCE, SEARCH_ROWS
from bazaarlake.operators.media import MAX_BYTES
from bazaarlake.sources.catalog import Catalog


def hashed(pictures: DataFrame) -> DataFrame:
    """pictures (key, content) to key, n_bytes, sha256, width, height, phash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [picture_hash(data) or (None, None, None) for data in batch.column(3).to_pylist()]
            width, height, phash = (list(c) for c in zip(*found, strict=True)) if found else ([], [], [])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(width, pa.int32()), pa.array(height, pa.int32()), pa.array(phash, pa.int64())], ["key", "n_bytes", "sha256", "width", "height", "phash"])

    kind = pictures.schema["key"].dataType.simpleString()
    rows = pictures.select("key", F.octet_length("content").cast("long").alias("n_bytes"), F.sha2("content", 256).alias("sha256"), "content")
    return rows.mapInArrow(run, f"key {kind}, n_bytes long, sha256 string, width int, height int, phash long")


def picture_files(spark: SparkSession, path: str, max_bytes: int = MAX_BYTES) -> DataFrame:
    """The files under path that aren't too large, by their path, with hash and size."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).filter((F.col("length") > 0) & (F.col("length") <= max_bytes))
    return hashed(files.select(F.col("path").alias("key"), "content"))


def new_images(listed: DataFrame, files: DataFrame) -> DataFrame:
    """Rows for media.taken_in(): listed (owner_id, url, position, key) with what their files (picture_files) are; unreadable ones are left out."""
    return listed.join(files.filter("phash IS NOT NULL"), "key").select("owner_id", "url", "position", "n_bytes", "sha256", "width", "height", "phash")


def search_bytes(wanted: DataFrame, pool: DataFrame, distance: int = SEARCH_DISTANCE, limit: int = SEARCH_ROWS) -> DataFrame:
    """Products nearest to pictures given as bytes, wanted (query, content), in pool (image_id, product_id, phash)."""
    asked = hashed(wanted.select(F.col("query").alias("key"), "content")).filter("phash IS NOT NULL").select(F.col("key").alias("query"), "phash")
    return search_all(asked, pool, distance, limit)


def drawn(vectors: DataFrame, times: int = 1) -> DataFrame:
    """(key, content): vectors (key, embedding) drawn as square PNG pictures, each value `times` pixels wide, filters in turn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, vector in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                values = np.nan_to_num(np.array(vector or [0.0], float))
                side = int(np.ceil(np.sqrt(len(values))))
                square = np.pad(values, (0, side * side - len(values))).reshape(side, side)
                reach = float(np.ptp(square)) or 1.0
                out.append(png_of(np.kron(np.round((square - square.min()) * 255 / reach), np.ones((times, times))), (key or 0) % 5))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["key", "content"])

    return vectors.select("key", "embedding").mapInArrow(run, "key long, content binary")


def picture_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as picture files: size, content and perceptual hash of each."""
    rows = Catalog(spark, sf_dir).table("embeddings").select(F.col("vec_id").cast("long").alias("key"), "embedding")
    return hashed(drawn(rows, 5)).withColumnRenamed("key", "image_id")


QUERIES = {"picture_hashes": picture_hashes}
ORACLES: dict[str, str] = {}
