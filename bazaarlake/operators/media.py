"""Images of listings: full-size addresses, which ones to keep, copies by content, orphaned files, search by perceptual hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bazaarlake.functions import similarity
from bazaarlake.operators.matching import images
from bazaarlake.operators.monitoring import events
from bazaarlake.sources.catalog import Catalog

#: Images of a listing, the largest file and the shortest edge that count, suffixes of small versions, hits of a search, hours of grace.
PER_LISTING, MAX_BYTES, MIN_EDGE, HITS, GRACE_HOURS = 8, 12 * 1024 * 1024, 80, 30, 24
SIZES = ["_220x220", "_300x300", "_640x640", "_50x50", "_100x100", "_960x960"]
SAMPLE_BYTES, SAMPLE_OWNERS, SAMPLE_QUERIES, SAMPLE_NOW = 6_000, 50, [3, 17, 40, 77, 101], "2024-01-20"


def full_size_url(url: Column) -> Column:
    """The address of the picture itself: thumbnail suffixes gone, a query only where it isn't that CDN's transform; null for what is no web address."""
    bare = F.trim(url)
    whole = F.when(bare.startswith("//"), F.concat(F.lit("https:"), bare)).otherwise(bare)
    plain = F.regexp_replace(F.regexp_replace(whole, "|".join(SIZES), ""), r"_\.webp$", "")
    return F.when(whole.startswith("http"), F.when(F.contains(plain, F.lit("alicdn")), F.substring_index(plain, "?", 1)).otherwise(plain))


def image_list(listings: DataFrame, fetched: DataFrame) -> DataFrame:
    """(owner_id, url, position) of the first PER_LISTING pictures of each listing that were fetched. listings (owner_id, image_urls), fetched (url)."""
    urls = listings.select("owner_id", F.posexplode("image_urls").alias("at", "raw")).select("owner_id", "at", full_size_url(F.col("raw")).alias("url")).filter("url IS NOT NULL")
    once = urls.groupBy("owner_id", "url").agg(F.min("at").alias("at")).join(fetched.select("url").distinct(), "url", "left_semi")
    order = Window.partitionBy("owner_id").orderBy("at")
    return once.withColumn("position", F.row_number().over(order) - 1).filter(F.col("position") < PER_LISTING).select("owner_id", "url", "position")


def taken_in(new: DataFrame, known: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Image rows for fetched pictures, new (owner_id, url, position, n_bytes, sha256, width, height, phash), beside the known ones.

    A picture that its owner has already is left out, as are files too large and pictures too small; where the content is known
    (or comes twice), the first one's path, size and hash are shared."""
    fresh = new.join(known.select("owner_id", "url"), ["owner_id", "url"], "left_anti").filter((F.col("n_bytes") > 0) & (F.col("n_bytes") <= max_bytes))
    kept = known.groupBy("sha256").agg(F.min(F.struct("owner_id", "url", "path", "width", "height", "phash")).alias("twin"))
    first = fresh.filter(F.least("width", "height") >= MIN_EDGE).groupBy("sha256").agg(F.min(F.struct("owner_id", "url", "width", "height", "phash")).alias("own"))
    path = F.concat_ws("/", F.substring("sha256", 1, 2), F.substring("sha256", 3, 2), "sha256")
    either = lambda c: F.coalesce(f"twin.{c}", f"own.{c}").alias(c)
    rows = fresh.select("owner_id", "url", "position", "sha256").join(kept, "sha256", "left").join(first, "sha256", "left").filter("twin IS NOT NULL OR own IS NOT NULL")
    return rows.select("owner_id", "url", "position", "sha256", F.coalesce("twin.path", path).alias("path"), either("width"), either("height"), either("phash"), F.col("twin").isNotNull().alias("shared"))


def media_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as pictures: their text is the content, sizes stand in from key and length; a tenth of them is known already."""
    rows = Catalog(spark, sf_dir).table("documents").select((F.col("doc_id") % SAMPLE_OWNERS).alias("owner_id"), F.concat(F.lit("http://x/"), "doc_id").alias("url"), (F.col("doc_id") % 7).cast("int").alias("position"), "n_chars", "doc_id", F.sha2("text", 256).alias("sha256"), (F.col("n_chars") % 400).alias("width"), (F.col("doc_id") % 300).alias("height"), F.xxhash64("text").alias("phash")).withColumnRenamed("n_chars", "n_bytes")
    known = rows.filter("doc_id % 10 = 0").withColumn("path", F.concat(F.lit("old/"), "sha256"))
    out = taken_in(rows, known, SAMPLE_BYTES)
    return out.select("owner_id", "url", "position", "path", "width", "height", "shared")


def orphaned_files(files: DataFrame, referenced: DataFrame, now: Column, grace_hours: int = GRACE_HOURS) -> DataFrame:
    """Files (path, mtime) that nothing refers to and that are older than the grace, in which a crawl may still write their row."""
    old = files.filter(F.col("mtime") < now - F.expr(f"INTERVAL {grace_hours} HOURS"))
    return old.join(referenced.filter("path IS NOT NULL").select("path"), "path", "left_anti")


def media_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as files by their time, those of purchases referred to."""
    rows = events(Catalog(spark, sf_dir))
    files = rows.select(F.col("event_id").alias("path"), F.col("ts").alias("mtime"))
    used = rows.filter(F.col("user_id") % 3 != 0).select(F.col("event_id").alias("path"))
    return orphaned_files(files, used, F.lit(SAMPLE_NOW).cast("timestamp")).select("path")


def image_owner(pictures: DataFrame, offers: DataFrame) -> DataFrame:
    """pictures (image_id, direct_id, offer_id) with the product they show: their own, else their offer's; both links are followed."""
    via = offers.select(F.col("id").alias("offer_id"), F.col("product_id").alias("via_id"))
    return pictures.join(via, "offer_id", "left").withColumn("product_id", F.coalesce("direct_id", "via_id"))


def nearest(pool: DataFrame, wanted: dict[int, int], distance: int = similarity.ALIKE, limit: int = HITS) -> DataFrame:
    """Products nearest to each wanted hash (a request's pictures, a handful): best distance and image, whether a band or only the scan finds it, confidence and score.

    The scan of the whole pool is one pass, so bands don't limit what is found; they only tell the tier."""
    asked = F.explode(F.array(*(F.struct(F.lit(q).alias("query"), F.lit(h).cast("bigint").alias("wanted")) for q, h in wanted.items())))
    near = pool.select("*", asked.alias("q")).select(pool["*"], "q.*").withColumn("distance", similarity.hamming(F.col("phash"), F.col("wanted")).cast("long")).filter(F.col("distance") <= distance)
    shared = F.arrays_overlap(similarity.bands(F.col("phash")), similarity.bands(F.col("wanted")))
    best = near.groupBy("query", "product_id").agg(F.min(F.struct("distance", "image_id", F.when(shared, "band").otherwise("scan").alias("tier"))).alias("b"))
    ranked = best.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy("b.distance", "b.image_id"))).filter(F.col("place") <= limit)
    return ranked.select("query", "product_id", "b.distance", "b.image_id", "b.tier", similarity.confidence(F.col("b.distance")).alias("confidence"), similarity.nearness(F.col("b.distance")).alias("score"))


def image_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products near a few query pictures, which are in the pool themselves."""
    pool = images(Catalog(spark, sf_dir))
    wanted = {r["image_id"]: r["phash"] for r in pool.filter(F.col("image_id").isin(SAMPLE_QUERIES)).collect()}  # a handful
    return nearest(pool, wanted, 2 * similarity.ALIKE - 10).select("query", "product_id", "distance", "image_id", "tier", "confidence")


QUERIES = {f.__name__: f for f in (media_ingest, media_sweep, image_search)}
_BITS = "img AS (SELECT vec_id, label, list_transform(embedding, lambda v: (v > 0)::INT) AS bits FROM embeddings)"
_DIST = "list_sum(list_transform(list_zip(a.bits, b.bits), lambda z: (z[1] <> z[2])::INT))::BIGINT"
_SHARE = " OR ".join(f"a.bits[{16 * k + 1}:{16 * k + 16}] = b.bits[{16 * k + 1}:{16 * k + 16}]" for k in range(4))
ORACLES = {
    "media_ingest": f"WITH r AS (SELECT doc_id, doc_id % {SAMPLE_OWNERS} AS owner_id, 'http://x/' || doc_id AS url, CAST(doc_id % 7 AS INT) AS position, n_chars AS n_bytes, sha256(text) AS sha, n_chars % 400 AS width, doc_id % 300 AS height FROM documents), k AS (SELECT sha, first(width ORDER BY owner_id, url) AS w, first(height ORDER BY owner_id, url) AS h FROM r WHERE doc_id % 10 = 0 GROUP BY 1), f AS (SELECT * FROM r WHERE doc_id % 10 <> 0 AND n_bytes > 0 AND n_bytes <= {SAMPLE_BYTES}), o AS (SELECT sha, first(width ORDER BY owner_id, url) AS w, first(height ORDER BY owner_id, url) AS h FROM f WHERE least(width, height) >= {MIN_EDGE} GROUP BY 1) SELECT owner_id, url, position, CASE WHEN k.sha IS NOT NULL THEN 'old/' || f.sha ELSE f.sha[1:2] || '/' || f.sha[3:4] || '/' || f.sha END AS path, coalesce(k.w, o.w) AS width, coalesce(k.h, o.h) AS height, k.sha IS NOT NULL AS shared FROM f LEFT JOIN k USING (sha) LEFT JOIN o USING (sha) WHERE k.sha IS NOT NULL OR o.sha IS NOT NULL",
    "media_sweep": f"SELECT event_id AS path FROM events WHERE ts < TIMESTAMP '{SAMPLE_NOW}' - INTERVAL {GRACE_HOURS} HOUR AND user_id % 3 = 0",
    "image_search": f"WITH {_BITS}, d AS (SELECT a.vec_id AS query, b.label AS product_id, b.vec_id AS image_id, {_DIST} AS distance, CASE WHEN {_SHARE} THEN 'band' ELSE 'scan' END AS tier FROM img a JOIN img b ON a.vec_id IN ({', '.join(map(str, SAMPLE_QUERIES))})), n AS (SELECT *, row_number() OVER (PARTITION BY query, product_id ORDER BY distance, image_id) AS rn FROM d WHERE distance <= {2 * similarity.ALIKE - 10}), p AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY distance, image_id) AS place FROM n WHERE rn = 1) SELECT query, product_id, distance, image_id, tier, CASE WHEN distance <= 2 THEN 'identical image' WHEN distance <= 10 THEN 'same photo' ELSE 'visually similar' END AS confidence FROM p WHERE place <= {HITS}",
}
