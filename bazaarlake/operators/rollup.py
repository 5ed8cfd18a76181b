"""Product rollups, votes, medians and counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bazaarlake.sources.catalog import OFFERS_SQL, Catalog, first_per_key, least_by

LANDED = "price_usd * greatest(moq, 1) + coalesce(shipping, 0)"


def roll_up(offers: DataFrame) -> DataFrame:
    """Per product over its active offers: counts, best price with its site, worst price, least landed cost and MOQ, newest sighting.

    One shuffle on product_id after partial aggregation; a price of zero or less never wins. A product
    without a priced offer gets null prices."""
    priced = F.when(F.col("price_usd") > 0, F.struct("price_usd", "supplier_id", "site_id"))
    return offers.groupBy("product_id").agg(
        F.count("*").alias("offer_count"),
        F.size(F.collect_set("site_id")).cast("long").alias("site_count"),
        F.min(priced)["price_usd"].alias("best_price_usd"),
        F.min(priced)["site_id"].alias("best_price_site_id"),
        F.max("price_usd").alias("max_price_usd"),
        F.min(F.expr(LANDED)).alias("best_landed_usd"),
        F.min(F.coalesce("moq", F.lit(1))).alias("min_moq"),
        F.max("last_seen").alias("last_seen"),
    )


def product_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog = Catalog(spark, sf_dir)
    rolled = catalog.products().select("product_id").join(roll_up(catalog.active_offers()), "product_id", "left")
    return rolled.withColumns({"offer_count": F.coalesce("offer_count", F.lit(0)), "site_count": F.coalesce("site_count", F.lit(0)), "is_active": F.col("offer_count").isNotNull()}).withColumn("is_active", F.col("offer_count") > 0)


ROLLUP_SQL = f"""rolled AS (SELECT product_id, count(*) AS offer_count, count(DISTINCT site_id) AS site_count, min(price_usd) FILTER (price_usd > 0) AS best_price_usd,
  first(site_id ORDER BY price_usd, supplier_id) FILTER (price_usd > 0) AS best_price_site_id, max(price_usd) AS max_price_usd,
  min({LANDED}) AS best_landed_usd, min(coalesce(moq, 1)) AS min_moq, max(last_seen) AS last_seen FROM offers WHERE is_active GROUP BY product_id)"""


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 36 most compared products with their rollups."""
    catalog = Catalog(spark, sf_dir)
    return roll_up(catalog.active_offers()).orderBy(F.desc("site_count"), F.desc("offer_count"), "product_id").limit(36)


def primary_by_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per brand the item of the largest area (size x price stands for width x height), the least id on ties."""
    area = F.col("size") * F.col("list_price")
    best = Catalog(spark, sf_dir).products().groupBy("brand").agg(F.max(F.struct(area.alias("area"), (-F.col("product_id")).alias("neg"))).alias("m"))
    return best.select("brand", (-F.col("m.neg")).alias("product_id"), F.col("m.area").alias("area"))


def median_length_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per brand the upper median title by length (ties by id), from two window counts instead of gathered lists."""
    of_brand = Window.partitionBy("brand")
    ranked = Catalog(spark, sf_dir).products().select("brand", "title", F.row_number().over(of_brand.orderBy(F.length("title"), "product_id")).alias("rn"), F.count("*").over(of_brand).alias("n"))
    return ranked.filter("rn = n div 2 + 1").select("brand", "title")


def spec_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per key the value with most votes, then the longest, then the first in order."""
    votes = Catalog(spark, sf_dir).table("orders").groupBy(F.col("o_custkey").alias("spec_key"), F.col("o_orderpriority").alias("spec_value")).agg(F.count("*").alias("votes"))
    return first_per_key(votes, ["spec_key"], [F.desc("votes"), F.desc(F.length("spec_value")), F.asc("spec_value")])


def category_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products per category, subtrees included: each path counts for all its prefixes."""
    parts = F.split("path", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    return Catalog(spark, sf_dir).products().select(F.explode(prefixes).alias("path")).groupBy("path").agg(F.count("*").alias("product_count"))


def supplier_recount(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Catalog(spark, sf_dir).active_offers().groupBy("supplier_id").agg(F.count("*").alias("offer_count"))


def supplier_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers per (site, normalised name): latest known rating, verified if ever, first url; upserts arrive in order of their key."""
    rows = Catalog(spark, sf_dir).table("supplier").select("s_suppkey", F.col("s_nationkey").alias("site_id"), F.lower(F.trim("s_name")).alias("name_norm"), F.when(F.col("s_acctbal") > 0, F.col("s_acctbal")).alias("rating"), (F.col("s_acctbal") > 5000).alias("verified"))
    return rows.groupBy("site_id", "name_norm").agg(F.max_by("rating", F.when(F.col("rating").isNotNull(), F.col("s_suppkey"))).alias("rating"), F.bool_or("verified").alias("verified"), F.min("s_suppkey").alias("first_supplier_id"))


def site_counts_incl_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog = Catalog(spark, sf_dir)
    counts = catalog.active_offers().groupBy("site_id").agg(F.count("*").alias("n"))
    return catalog.sites().join(counts, "site_id", "left").select("site_key", F.coalesce("n", F.lit(0)).alias("offer_count"))


def catalog_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog = Catalog(spark, sf_dir)
    return catalog.offers().agg(F.count("*").alias("offers"), F.count_if("is_active").alias("active"), F.count_if(F.expr("is_active AND in_stock")).alias("in_stock"), F.count_if(F.col("shipping").isNull()).alias("undisclosed_shipping"))


def identity_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per product the first non-null shipping, in-stock offers first, then by supplier."""
    known = Catalog(spark, sf_dir).active_offers().filter("shipping IS NOT NULL").withColumn("later", ~F.col("in_stock"))
    return known.groupBy("product_id").agg(least_by("shipping", "later", "supplier_id").alias("shipping"))


def variant_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per order (an offer of several variants) min and max over in-stock variants; max only if they differ."""
    stock = Catalog(spark, sf_dir).table("lineitem").filter("l_returnflag <> 'R' AND l_extendedprice > 0")
    out = stock.groupBy("l_orderkey").agg(F.min("l_extendedprice").alias("price_min"), F.max("l_extendedprice").alias("top"))
    return out.select("l_orderkey", "price_min", F.when(F.col("top") > F.col("price_min"), F.col("top")).alias("price_max"))


QUERIES = {f.__name__: f for f in (product_rollup, flagship, primary_by_area, median_length_title, spec_vote, category_counts, supplier_recount, supplier_merge, site_counts_incl_zero, catalog_stats, identity_fields, variant_prices)}

ORACLES = {
    "product_rollup": f"WITH {OFFERS_SQL}, {ROLLUP_SQL} SELECT p_partkey AS product_id, coalesce(offer_count, 0) AS offer_count, coalesce(site_count, 0) AS site_count, best_price_usd, best_price_site_id, max_price_usd, best_landed_usd, min_moq, last_seen, coalesce(offer_count, 0) > 0 AS is_active FROM part LEFT JOIN rolled ON product_id = p_partkey",
    "flagship": f"WITH {OFFERS_SQL}, {ROLLUP_SQL} SELECT * FROM rolled ORDER BY site_count DESC, offer_count DESC, product_id LIMIT 36",
    "primary_by_area": "SELECT p_brand AS brand, first(p_partkey ORDER BY p_size * p_retailprice DESC, p_partkey) AS product_id, max(p_size * p_retailprice) AS area FROM part GROUP BY 1",
    "median_length_title": "SELECT brand, title FROM (SELECT p_brand AS brand, p_name AS title, row_number() OVER (PARTITION BY p_brand ORDER BY length(p_name), p_partkey) AS rn, count(*) OVER (PARTITION BY p_brand) AS n FROM part) WHERE rn = n // 2 + 1",
    "spec_vote": "SELECT spec_key, spec_value, votes FROM (SELECT o_custkey AS spec_key, o_orderpriority AS spec_value, count(*) AS votes, row_number() OVER (PARTITION BY o_custkey ORDER BY count(*) DESC, length(o_orderpriority) DESC, o_orderpriority) AS rn FROM orders GROUP BY 1, 2) WHERE rn = 1",
    "category_counts": "SELECT path, count(*) AS product_count FROM (SELECT lower(p_type) AS path FROM part UNION ALL SELECT lower(p_type) || '/' || lower(p_brand) FROM part) GROUP BY 1",
    "supplier_recount": f"WITH {OFFERS_SQL} SELECT supplier_id, count(*) AS offer_count FROM offers WHERE is_active GROUP BY 1",
    "supplier_merge": "SELECT s_nationkey AS site_id, lower(trim(s_name)) AS name_norm, last(s_acctbal ORDER BY s_suppkey) FILTER (s_acctbal > 0) AS rating, bool_or(s_acctbal > 5000) AS verified, min(s_suppkey) AS first_supplier_id FROM supplier GROUP BY 1, 2",
    "site_counts_incl_zero": f"WITH {OFFERS_SQL} SELECT lower(n_name) AS site_key, count(product_id) AS offer_count FROM nation LEFT JOIN offers ON site_id = n_nationkey AND is_active GROUP BY 1",
    "catalog_stats": f"WITH {OFFERS_SQL} SELECT count(*) AS offers, count(*) FILTER (is_active) AS active, count(*) FILTER (is_active AND in_stock) AS in_stock, count(*) FILTER (shipping IS NULL) AS undisclosed_shipping FROM offers",
    "identity_fields": f"WITH {OFFERS_SQL} SELECT product_id, first(shipping ORDER BY NOT in_stock, supplier_id) AS shipping FROM offers WHERE is_active AND shipping IS NOT NULL GROUP BY 1",
    "variant_prices": "SELECT l_orderkey, min(l_extendedprice) AS price_min, CASE WHEN max(l_extendedprice) > min(l_extendedprice) THEN max(l_extendedprice) END AS price_max FROM lineitem WHERE l_returnflag <> 'R' AND l_extendedprice > 0 GROUP BY 1",
}
