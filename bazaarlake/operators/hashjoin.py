"""All pairs of 64-bit picture hashes within a Hamming distance.

Within a small distance by multi-index hashing: two hashes within it differ little in at least one of four 16-bit bands: of distance
r = 4 a + b, by at most a bits in one of the first b + 1 bands or at most a - 1 in another. A band has 65,536 values at most, whatever the
number of pictures, so the values that occur are led to their neighbours first, and hashes meet only through neighbouring values. A
pair is taken at the first band that brings it together and verified on all bits, so none is lost and none comes twice.

From a distance on at which a band may differ by more than NEAR_BITS, a band leads to a few hundredths of all values, so that most work would be
in pairs that bands bring for nothing. Then blocks of hashes meet whole, one pair of blocks after another, with all bits
compared at once: work grows with the square of the number of hashes, memory doesn't.

Hashes that many pictures share are compared once; their pictures come back by membership. Null hashes are near nothing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bazaarlake.functions import similarity
from bazaarlake.operators.matching import SEARCH_DISTANCE, SEARCH_ROWS, images
from bazaarlake.sources.catalog import Catalog
from bazaarlake.sources.tables import stored

BANDS, BITS = 4, 16
NEAR_BITS = 2  # by which a band may differ where bands are used
BLOCK, LEAST_BLOCKS = 1 << 15, 8  # hashes of a block, about; blocks of few hashes, so that they meet in several tasks
STRIPE, TILE = 64, 4096  # hashes compared at once: so many of a block with so many of the other


def radii(distance: int) -> list[int]:
    """Bits by which each band may differ; below 0 a band needn't be looked at."""
    share, more = divmod(distance, BANDS)
    return [share if k <= more else share - 1 for k in range(BANDS)]


def band_distance(x: Column, y: Column, band: int) -> Column:
    return F.bit_count(F.shiftrightunsigned(x.bitwiseXOR(y), BITS * (BANDS - 1 - band)).bitwiseAND(2**BITS - 1))


def banded(hashes: DataFrame, distance: int) -> DataFrame:
    """phash with its bands (band, value) that count for the distance."""
    kept = [k for k, r in enumerate(radii(distance)) if r >= 0]
    return hashes.select("phash", F.explode(similarity.bands(F.col("phash"))).alias("b")).select("phash", "b.band", F.col("b.value").cast("int").alias("value")).filter(F.col("band").isin(kept))


def neighbours(left: DataFrame, right: DataFrame, distance: int) -> DataFrame:
    """(band, value, other): values of left's bands with those of right's that lie near enough; at most 65,536 values a band on each side."""
    values = left.select("band", "value").distinct()
    limit = F.element_at(F.array(*map(F.lit, radii(distance))), F.col("band") + 1)
    masks = values.sparkSession.range(2**BITS).select(F.col("id").cast("int").alias("mask"), F.bit_count("id").alias("bits")).filter(F.col("bits") <= max(radii(distance)))
    around = values.join(F.broadcast(masks), F.col("bits") <= limit).select("band", "value", F.col("value").bitwiseXOR(F.col("mask")).alias("other"))
    return around.join(right.select("band", F.col("value").alias("other")).distinct(), ["band", "other"], "left_semi")


def blocks(hashes: DataFrame) -> DataFrame:
    """(block, hashes): distinct hashes (phash) dealt to blocks of about BLOCK."""
    n = max(LEAST_BLOCKS, -(-hashes.count() // BLOCK))
    return stored(hashes.groupBy(F.pmod(F.xxhash64("phash"), F.lit(n)).alias("block")).agg(F.collect_list("phash").alias("hashes")), "hash-blocks")


def compared(distance: int):
    """For mapInArrow over pairs of blocks (xs, ys, same): (x, y, distance) of their hashes within the distance; of one block with itself (same), x <= y only."""

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, counts = np.empty((STRIPE, TILE), np.int64), np.empty((STRIPE, TILE), np.uint8)
        for batch in batches:
            for k in range(batch.num_rows):
                xs, ys = (batch.column(c)[k].values.to_numpy() for c in ("xs", "ys"))
                same = batch.column("same")[k].as_py()
                for i in range(0, len(xs), STRIPE):
                    for j in range(0, len(ys), TILE):
                        x, y = xs[i : i + STRIPE], ys[j : j + TILE]
                        d = np.bitwise_count(np.bitwise_xor(x[:, None], y, out=bits[: len(x), : len(y)]).view(np.uint64), out=counts[: len(x), : len(y)])
                        at, other = np.divmod(np.flatnonzero(d <= distance), len(y))
                        if same:
                            kept = x[at] <= y[other]
                            at, other = at[kept], other[kept]
                        if len(at):
                            yield pa.RecordBatch.from_arrays([pa.array(x[at]), pa.array(y[other]), pa.array(d[at, other].astype(np.int64))], ["x", "y", "distance"])

    return near


def met_in_blocks(left: DataFrame, right: DataFrame | None, distance: int) -> DataFrame:
    """near_hashes() by pairs of blocks, each pair in a task of its own."""
    a = blocks(left)
    b = a if right is None else blocks(right)
    one, other = a.select(F.col("block").alias("i"), F.col("hashes").alias("xs")), b.select(F.col("block").alias("j"), F.col("hashes").alias("ys"))
    met = one.crossJoin(other) if right is not None else one.join(other, F.col("i") <= F.col("j"))
    n, m = a.count(), b.count()
    cells = max(1, n * m if right is not None else n * (n + 1) // 2)
    dealt = met.select("xs", "ys", (F.col("i") == F.col("j") if right is None else F.lit(False)).alias("same")).repartition(cells)
    near = dealt.mapInArrow(compared(distance), "x long, y long, distance long")
    return near if right is not None else near.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"), "distance")


def met_in_bands(left: DataFrame, right: DataFrame | None, distance: int) -> DataFrame:
    """near_hashes() by neighbouring values of bands."""
    a = stored(banded(left, distance), "hash-bands")
    b = a if right is None else stored(banded(right, distance), "hash-bands")
    met = a.withColumnRenamed("phash", "x").join(neighbours(a, b, distance), ["band", "value"]).join(b.select(F.col("phash").alias("y"), "band", F.col("value").alias("other")), ["band", "other"])
    x, y, limits = F.col("x"), F.col("y"), radii(distance)
    if right is None:
        met = met.filter(x <= y)
    first = F.lit(None)
    for k in reversed(range(BANDS)):
        first = F.when(band_distance(x, y, k) <= limits[k], F.lit(k)).otherwise(first)
    d = similarity.hamming(x, y)
    return met.filter((d <= distance) & (F.col("band") == first)).select("x", "y", d.cast("long").alias("distance"))


def near_hashes(left: DataFrame, right: DataFrame | None, distance: int = SEARCH_DISTANCE) -> DataFrame:
    """(x, y, distance) of all hashes of left and right (phash) within the distance, equal ones included, each pair once. Without right, of
    left with itself, x <= y."""
    if not 0 <= distance <= 64:
        raise ValueError("a distance of 64-bit hashes lies between 0 and 64")
    a, b = (side if side is None else stored(side.select("phash").dropna().distinct(), "hashes") for side in (left, right))
    return (met_in_bands if max(radii(distance)) <= NEAR_BITS else met_in_blocks)(a, b, distance)


def pairs_within(pool: DataFrame, distance: int = SEARCH_DISTANCE) -> DataFrame:
    """low_id, high_id, distance of all pictures of pool (image_id, phash) within the distance."""
    named = stored(pool.select("image_id", "phash"), "pictures")
    near = near_hashes(named, None, distance)
    ends = near.join(named.select(F.col("image_id").alias("i"), F.col("phash").alias("x")), "x").join(named.select(F.col("image_id").alias("j"), F.col("phash").alias("y")), "y")
    return ends.filter("x < y OR i < j").select(F.least("i", "j").alias("low_id"), F.greatest("i", "j").alias("high_id"), "distance")


def search_all(wanted: DataFrame, pool: DataFrame, distance: int = SEARCH_DISTANCE, limit: int = SEARCH_ROWS) -> DataFrame:
    """Products nearest to every wanted picture (query, phash): best distance and picture of each product of pool (image_id, product_id, phash), the
    picture itself left out, the limit nearest by (distance, image_id)."""
    near = near_hashes(wanted, pool, distance)
    rows = near.join(wanted.select("query", F.col("phash").alias("x")), "x").join(pool.select("image_id", "product_id", F.col("phash").alias("y")), "y").filter("query <> image_id")
    best = rows.groupBy("query", "product_id").agg(F.min(F.struct("distance", "image_id")).alias("m"))
    place = Window.partitionBy("query").orderBy("m.distance", "m.image_id")
    ranked = best.withColumn("place", F.row_number().over(place)).filter(F.col("place") <= limit)
    return ranked.select("query", "place", "product_id", "m.distance", "m.image_id", similarity.confidence(F.col("m.distance")).alias("confidence"))


def image_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of pictures within the search distance."""
    return pairs_within(images(Catalog(spark, sf_dir)).select("image_id", "phash"))


def image_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every twentieth picture as a query against all, at once."""
    pool = stored(images(Catalog(spark, sf_dir)), "pictures")
    return search_all(pool.filter("image_id % 20 = 0").select(F.col("image_id").alias("query"), "phash"), pool, SEARCH_DISTANCE + 2, 5)


QUERIES = {f.__name__: f for f in (image_pairs, image_queries)}
_BITS = "img AS (SELECT vec_id, label, list_transform(embedding, lambda v: (v > 0)::INT) AS bits FROM embeddings)"
_DIST = "list_sum(list_transform(list_zip(a.bits, b.bits), lambda z: (z[1] <> z[2])::INT))::BIGINT"
ORACLES = {
    "image_pairs": f"WITH {_BITS} SELECT a.vec_id AS low_id, b.vec_id AS high_id, {_DIST} AS distance FROM img a JOIN img b ON a.vec_id < b.vec_id WHERE {_DIST} <= {SEARCH_DISTANCE}",
    "image_queries": f"WITH {_BITS}, d AS (SELECT a.vec_id AS query, b.label AS product_id, b.vec_id AS image_id, {_DIST} AS distance FROM img a JOIN img b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id), n AS (SELECT *, row_number() OVER (PARTITION BY query, product_id ORDER BY distance, image_id) AS rn FROM d WHERE distance <= {SEARCH_DISTANCE + 2}), p AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY distance, image_id)::INT AS place FROM n WHERE rn = 1) SELECT query, place, product_id, distance, image_id, CASE WHEN distance <= 2 THEN 'identical image' WHEN distance <= 10 THEN 'same photo' ELSE 'visually similar' END AS confidence FROM p WHERE place <= 5",
}
