"""Entity resolution: blocking by shared keys, scoring of blocked pairs, cannot-link rulings, image search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bazaarlake.functions import similarity, text
from bazaarlake.operators import setjoin
from bazaarlake.sources.catalog import Catalog

#: Weights of the signals and thresholds of the decision.
WEIGHTS = {"image": 0.45, "title": 0.35, "specs": 0.20}
MERGE, REVIEW, CODE_BONUS, CONFLICT = 0.86, 0.70, 0.12, 0.75
SEARCH_DISTANCE, SEARCH_ROWS, QUERY_IMAGE = 18, 30, 0
TITLE_JACCARD = 0.3


def score(image: Column, title: Column, specs: Column, overlap: Column, shared_code: Column, conflict: Column) -> Column:
    """Weighted mean of the signals that can be evaluated (null: cannot), lifted or bounded by a strong image, then by model codes."""
    parts = [(image, WEIGHTS["image"]), (title, WEIGHTS["title"]), (F.when(overlap > 0, specs), WEIGHTS["specs"])]
    total = sum((F.when(s.isNotNull(), F.lit(w)).otherwise(0.0) for s, w in parts), F.lit(0.0))
    base = sum((F.coalesce(s * w, F.lit(0.0)) for s, w in parts), F.lit(0.0)) / F.nullif(total, F.lit(0.0))
    near, t = F.coalesce(image, F.lit(0.0)) >= 0.85, F.coalesce(title, F.lit(0.0))
    lifted = F.when(near & (t >= 0.40), F.greatest(base, F.lit(0.90))).when(near & (specs >= 0.8) & (overlap >= 2), F.greatest(base, F.lit(0.88))).when(near & (t < 0.25), F.least(base, F.lit(REVIEW + 0.05))).otherwise(base)
    with_code = F.least(F.lit(1.0), lifted + F.when(shared_code, CODE_BONUS).otherwise(0.0))
    return F.when(total > 0, F.round(with_code * F.when(conflict, CONFLICT).otherwise(1.0), 4)).otherwise(0.0)  # least() would skip a null


def decide(score: Column) -> Column:
    return F.when(score >= MERGE, "merge").when(score >= REVIEW, "review").otherwise("new")


def without_rejected(pairs: DataFrame, rejections: DataFrame) -> DataFrame:
    """Pairs (low_id, high_id) that no ruling forbids."""
    return pairs.join(rejections, ["low_id", "high_id"], "left_anti")


def images(catalog: Catalog) -> DataFrame:
    return catalog.table("embeddings").select(F.col("vec_id").alias("image_id"), F.col("label").alias("product_id"), similarity.sign_hash(F.col("embedding")).alias("phash"))


def lsh_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image pairs that share a 16-bit band, within the search distance: an equi-join on bands, then the exact distance. Bands find every
    pair within distance 3 and others by chance; for a search that misses none, media.nearest() scans."""
    banded = images(Catalog(spark, sf_dir)).withColumn("b", F.explode(similarity.bands(F.col("phash")))).select("image_id", "phash", "b.band", "b.value")
    a, b = banded.alias("a"), banded.alias("b")
    d = similarity.hamming(F.col("a.phash"), F.col("b.phash"))
    near = a.join(b, (F.col("a.band") == F.col("b.band")) & (F.col("a.value") == F.col("b.value")) & (F.col("a.image_id") < F.col("b.image_id")) & (d <= SEARCH_DISTANCE))
    return near.select(F.col("a.image_id").alias("low_id"), F.col("b.image_id").alias("high_id"), d.cast("long").alias("distance")).distinct()


def image_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products nearest to one query image: best distance of each within the bound, one pass without bands or caps."""
    pool = images(Catalog(spark, sf_dir))
    query = pool.filter(F.col("image_id") == QUERY_IMAGE).select(F.col("phash").alias("wanted"))
    near = pool.filter(F.col("image_id") != QUERY_IMAGE).join(F.broadcast(query)).withColumn("distance", similarity.hamming(F.col("phash"), F.col("wanted")).cast("long"))  # one row
    best = near.filter(F.col("distance") <= 2 * SEARCH_DISTANCE).groupBy("product_id").agg(F.min(F.struct("distance", "image_id")).alias("m"))
    return best.select("product_id", F.col("m.distance").alias("distance"), F.col("m.image_id").alias("image_id")).orderBy("distance", "image_id").limit(SEARCH_ROWS)


def titles(catalog: Catalog) -> DataFrame:
    return catalog.products().select("title").distinct()


def title_jaccard_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of distinct titles by token overlap, joined on the rarest tokens only."""
    tokens = titles(Catalog(spark, sf_dir)).select(F.col("title").alias("key"), F.split(F.lower("title"), " ").alias("tokens"))
    return setjoin.similar_pairs(tokens, TITLE_JACCARD).select(F.col("low_key").alias("title_a"), F.col("high_key").alias("title_b"), "jaccard")


def same_title_pairs(catalog: Catalog) -> DataFrame:
    """Pairs of products of one brand and title: a product and the next one in order of id, which is enough to connect them."""
    from pyspark.sql import Window

    w = Window.partitionBy("brand", "title").orderBy("product_id")
    rows = catalog.products().select("product_id", "brand", "title", "size").withColumns({"high_id": F.lead("product_id").over(w), "next_size": F.lead("size").over(w)})
    return rows.filter("high_id IS NOT NULL").select(F.col("product_id").alias("low_id"), "high_id", "size", "next_size")


def rejection_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate pairs less those that a ruling forbids (here: sizes more than 20 apart)."""
    pairs = same_title_pairs(Catalog(spark, sf_dir))
    return without_rejected(pairs.select("low_id", "high_id"), pairs.filter("abs(size - next_size) > 20").select("low_id", "high_id"))


def gtin_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = (F.lit(400000000000) + F.col("product_id") * 7).cast("string")
    return Catalog(spark, sf_dir).products().select("product_id", text.normalize_gtin(code).alias("gtin14"))


def pair_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of title pairs with a common token; the string ratio runs on blocked pairs only."""
    pairs = title_jaccard_pairs(spark, sf_dir)
    a, b = text.normalize_title(F.col("title_a")), text.normalize_title(F.col("title_b"))
    title = 0.6 * similarity.token_set_ratio_udf(a, b) / 100 + 0.4 * F.col("jaccard")
    none = F.lit(None).cast("double")
    s = score(none, title, none, F.lit(0), F.lit(False), F.lit(False))
    return pairs.select("title_a", "title_b", s.alias("score")).withColumn("decision", decide(F.col("score")))


QUERIES = {f.__name__: f for f in (lsh_pairs, image_topk, title_jaccard_pairs, rejection_antijoin, gtin_check, pair_scores)}
_BITS = "img AS (SELECT vec_id, label, list_transform(embedding, lambda v: (v > 0)::INT) AS bits FROM embeddings)"
_DIST = "list_sum(list_transform(list_zip(a.bits, b.bits), lambda z: (z[1] <> z[2])::INT))::BIGINT"
_SHARE = " OR ".join(f"a.bits[{16 * k + 1}:{16 * k + 16}] = b.bits[{16 * k + 1}:{16 * k + 16}]" for k in range(4))
ORACLES = {
    "lsh_pairs": f"WITH {_BITS} SELECT a.vec_id AS low_id, b.vec_id AS high_id, {_DIST} AS distance FROM img a JOIN img b ON a.vec_id < b.vec_id WHERE ({_SHARE}) AND {_DIST} <= {SEARCH_DISTANCE}",
    "image_topk": f"WITH {_BITS}, d AS (SELECT b.label AS product_id, b.vec_id AS image_id, {_DIST} AS distance FROM img a JOIN img b ON a.vec_id = {QUERY_IMAGE} AND b.vec_id <> {QUERY_IMAGE}) SELECT product_id, distance, image_id FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY distance, image_id) AS rn FROM d WHERE distance <= {2 * SEARCH_DISTANCE}) WHERE rn = 1 ORDER BY distance, image_id LIMIT {SEARCH_ROWS}",
    "title_jaccard_pairs": "WITH t AS (SELECT DISTINCT p_name AS title, list_distinct(string_split(lower(p_name), ' ')) AS tok FROM part) SELECT title_a, title_b, c / (na + nb - c) AS jaccard FROM (SELECT a.title AS title_a, b.title AS title_b, len(list_intersect(a.tok, b.tok)) AS c, len(a.tok) AS na, len(b.tok) AS nb FROM t a JOIN t b ON a.title < b.title) WHERE c / (na + nb - c) >= 0.3",
    "rejection_antijoin": "SELECT low_id, high_id FROM (SELECT p_partkey AS low_id, lead(p_partkey) OVER w AS high_id, p_size AS size, lead(p_size) OVER w AS next_size FROM part WINDOW w AS (PARTITION BY p_brand, p_name ORDER BY p_partkey)) WHERE high_id IS NOT NULL AND abs(size - next_size) <= 20",
    "gtin_check": "WITH g AS (SELECT p_partkey AS product_id, lpad((400000000000 + p_partkey * 7)::VARCHAR, 14, '0') AS g FROM part) SELECT product_id, CASE WHEN (10 - list_sum(list_transform(range(1, 14), lambda i: substring(g, i, 1)::INT * CASE WHEN i % 2 = 1 THEN 3 ELSE 1 END)) % 10) % 10 = substring(g, 14, 1)::INT THEN g END AS gtin14 FROM g",
}
