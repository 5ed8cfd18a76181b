"""Listings read back from saved answers, over the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bazaarlake.sources.catalog import Catalog
from bazaarlake.sources.mappings import listings
from bazaarlake.sources.vendors import lcsc


def mapped_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part's answer as a distributor gives it, with a ladder of the least price for each quantity sold, and the listing that the mapping makes of it."""
    catalog = Catalog(spark, sf_dir)
    lines = catalog.table("lineitem").groupBy("l_partkey", F.col("l_quantity").cast("bigint").alias("ladder")).agg(F.min("l_extendedprice").alias("usdPrice"))
    ladders = lines.groupBy("l_partkey").agg(F.collect_list(F.struct("ladder", "usdPrice")).alias("productPriceList"))
    parts = catalog.table("part").join(ladders, F.col("p_partkey") == F.col("l_partkey"), "left")
    item = F.struct(F.col("p_partkey").alias("productCode"), F.col("p_type").alias("productModel"), F.col("p_name").alias("productIntroEn"), F.col("p_brand").alias("brandNameEn"), F.col("p_size").alias("stockNumber"), "productPriceList")
    answers = parts.select(F.to_json(F.struct(F.lit(200).alias("code"), F.struct(F.array(item).alias("productList")).alias("result"))).alias("answer"))
    return listings(answers, "answer", lcsc()).select(
        "site_product_id", "title", "brand", "moq", "price_min", "price_max", "in_stock", F.size("tiers").alias("n_tiers"), F.get("tiers", F.lit(0))["max_qty"].alias("first_max_qty"), "url"
    )


QUERIES = {"mapped_listings": mapped_listings}
ORACLES = {
    "mapped_listings": """
        WITH steps AS (SELECT l_partkey, l_quantity::BIGINT AS qty, min(l_extendedprice) AS price FROM lineitem WHERE l_quantity IS NOT NULL AND l_extendedprice IS NOT NULL GROUP BY ALL),
        ladders AS (SELECT l_partkey, count(*) AS n, min(qty) AS least, min(price) AS low, max(price) AS high, list(qty ORDER BY qty)[2] - 1 AS first_max FROM steps GROUP BY l_partkey)
        SELECT p_partkey::VARCHAR AS site_product_id, trim(concat_ws(' ', p_type, coalesce(p_name, p_type))) AS title, p_brand AS brand, greatest(1, coalesce(least, 1)) AS moq,
               low AS price_min, high AS price_max, p_size > 0 AS in_stock, coalesce(n, 0)::INTEGER AS n_tiers, first_max AS first_max_qty,
               'https://www.lcsc.com/product-detail/' || p_partkey || '.html' AS url
        FROM part LEFT JOIN ladders ON l_partkey = p_partkey WHERE p_partkey IS NOT NULL AND coalesce(p_type, p_name) IS NOT NULL
    """,
}
