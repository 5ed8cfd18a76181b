"""Price history: daily series, change detection, retention, staleness."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bazaarlake.sources.catalog import OFFERS_SQL, Catalog

NOW = "1998-08-01"  # queries take the present as a parameter
KEEP_DAYS, STALE_DAYS, SERIES_DAYS, REFRESH_ROWS = 400, 30, 180, 100
OFFER = ["product_id", "supplier_id"]

HISTORY_SQL = "history AS (SELECT l_partkey AS product_id, l_suppkey AS supplier_id, CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS day, min(l_extendedprice / l_quantity) AS price_usd FROM lineitem GROUP BY 1, 2, 3)"


def price_history(catalog: Catalog) -> DataFrame:
    line = catalog.table("lineitem")
    return line.groupBy(F.col("l_partkey").alias("product_id"), F.col("l_suppkey").alias("supplier_id"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("day")).agg(F.min(F.col("l_extendedprice") / F.col("l_quantity")).alias("price_usd"))


def daily_min_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest SERIES_DAYS days of each product's least price."""
    daily = price_history(Catalog(spark, sf_dir)).groupBy("product_id", "day").agg(F.min("price_usd").alias("price_usd"))
    newest = Window.partitionBy("product_id").orderBy(F.desc("day"))
    return daily.withColumn("rn", F.row_number().over(newest)).filter(F.col("rn") <= SERIES_DAYS).drop("rn")


def changes(history: DataFrame) -> DataFrame:
    """Rows that are an offer's first or differ (null-safe) from the one before."""
    w = Window.partitionBy(*OFFER).orderBy("day")
    marked = history.withColumn("previous", F.lag("price_usd").over(w)).withColumn("rn", F.row_number().over(w))
    return marked.filter((F.col("rn") == 1) | ~F.col("price_usd").eqNullSafe(F.col("previous"))).drop("rn")


def history_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes(price_history(Catalog(spark, sf_dir)))


def history_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What retention keeps: rows inside the window, and each offer's newest row however old."""
    newest = Window.partitionBy(*OFFER).orderBy(F.desc("day"))
    ranked = price_history(Catalog(spark, sf_dir)).withColumn("rn", F.row_number().over(newest))
    return ranked.filter((F.col("day") >= F.date_sub(F.lit(NOW).cast("date"), KEEP_DAYS).cast("string")) | (F.col("rn") == 1)).drop("rn")


def stale_offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Active offers that deactivation would end."""
    return Catalog(spark, sf_dir).active_offers().filter(F.col("last_seen") < F.lit(NOW).cast("timestamp") - F.expr(f"INTERVAL {STALE_DAYS} DAYS")).select(*OFFER, "last_seen")


def refresh_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The offers to look at next: oldest sighting first."""
    return Catalog(spark, sf_dir).active_offers().orderBy("last_seen", *OFFER).limit(REFRESH_ROWS).select(*OFFER, "last_seen")


QUERIES = {f.__name__: f for f in (daily_min_price, history_changes, history_prune, stale_offers, refresh_batch)}
ORACLES = {
    "daily_min_price": f"WITH {HISTORY_SQL} SELECT product_id, day, price_usd FROM (SELECT product_id, day, min(price_usd) AS price_usd, row_number() OVER (PARTITION BY product_id ORDER BY day DESC) AS rn FROM history GROUP BY 1, 2) WHERE rn <= {SERIES_DAYS}",
    "history_changes": f"WITH {HISTORY_SQL} SELECT product_id, supplier_id, day, price_usd, previous FROM (SELECT *, lag(price_usd) OVER w AS previous, row_number() OVER w AS rn FROM history WINDOW w AS (PARTITION BY product_id, supplier_id ORDER BY day)) WHERE rn = 1 OR price_usd IS DISTINCT FROM previous",
    "history_prune": f"WITH {HISTORY_SQL} SELECT product_id, supplier_id, day, price_usd FROM (SELECT *, row_number() OVER (PARTITION BY product_id, supplier_id ORDER BY day DESC) AS rn FROM history) WHERE day >= CAST(DATE '{NOW}' - {KEEP_DAYS} AS VARCHAR) OR rn = 1",
    "stale_offers": f"WITH {OFFERS_SQL} SELECT product_id, supplier_id, last_seen FROM offers WHERE is_active AND last_seen < TIMESTAMP '{NOW}' - INTERVAL {STALE_DAYS} DAY",
    "refresh_batch": f"WITH {OFFERS_SQL} SELECT product_id, supplier_id, last_seen FROM offers WHERE is_active ORDER BY last_seen, product_id, supplier_id LIMIT {REFRESH_ROWS}",
}
