"""Filters, sorts, pages and facets of the product list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bazaarlake.functions.parsing import money_text
from bazaarlake.operators.rollup import ROLLUP_SQL, roll_up
from bazaarlake.sources.catalog import OFFERS_SQL, Catalog

PAGE, EXPORTED = 36, 15
#: Price facet: lower and upper bound (exclusive) and label. Fixed values.
BUCKETS = [(0.0, 100.0, "under 100"), (100.0, 500.0, "100-500"), (500.0, 1000.0, "500-1000"), (1000.0, 5000.0, "1000-5000"), (5000.0, None, "5000 and more")]


def listing(catalog: Catalog) -> DataFrame:
    """Active products with title, brand, path, first sighting and rollup."""
    return catalog.products().join(roll_up(catalog.active_offers()), "product_id").join(catalog.first_seen(), "product_id")


LISTING_SQL = f"WITH {OFFERS_SQL}, {ROLLUP_SQL}, listing AS (SELECT p_partkey AS product_id, p_name AS title, p_brand AS brand, lower(p_type) || '/' || lower(p_brand) AS path, offer_count, site_count, best_price_usd, best_price_site_id, max_price_usd, best_landed_usd, min_moq, last_seen, first_seen FROM part JOIN rolled ON product_id = p_partkey JOIN (SELECT l_partkey, min(l_shipdate) AS first_seen FROM lineitem GROUP BY 1) ON l_partkey = p_partkey)"
CARD = ["product_id", "title", "best_price_usd", "max_price_usd", "site_count", "offer_count"]
_CARD = ", ".join(CARD)

SORTS = ("price_asc", "price_desc", "newest", "sites", "savings")


def sort_order(sort: str) -> list[Column]:
    """The columns of a sort, which always end with the id."""
    orders = {
        "price_asc": [F.asc_nulls_last("best_price_usd")],
        "price_desc": [F.desc_nulls_last("best_price_usd")],
        "newest": [F.desc("first_seen")],
        "sites": [F.desc("site_count"), F.desc("offer_count")],
        "savings": [F.desc_nulls_last(F.expr("max_price_usd - best_price_usd"))],
    }
    return [*orders[sort], F.asc("product_id")]


_SORTS_SQL = {"price_asc": "best_price_usd ASC NULLS LAST", "price_desc": "best_price_usd DESC NULLS LAST", "newest": "first_seen DESC", "sites": "site_count DESC, offer_count DESC", "savings": "max_price_usd - best_price_usd DESC NULLS LAST"}


def page(df: DataFrame, order: list[Column], number: int, size: int = PAGE) -> DataFrame:
    """Page `number` (from 1; less counts as 1): a bounded top-k, then the rows past the offset."""
    number = max(1, number)
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def sorted_page(sort: str, number: int = 1):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return page(listing(Catalog(spark, sf_dir)), sort_order(sort), number).select(*CARD)

    return query


def with_offer(products: DataFrame, offers: DataFrame, site_ids: list[int] | None = None, direct_only: bool = False, max_moq: int | None = None, sites: DataFrame | None = None) -> DataFrame:
    """Products with one active offer that meets all conditions at once: a left semi-join."""
    if site_ids is not None:
        offers = offers.filter(F.col("site_id").isin(site_ids))
    if max_moq is not None:
        offers = offers.filter(F.coalesce("moq", F.lit(1)) <= max_moq)
    if direct_only and sites is not None:
        offers = offers.join(sites.filter("NOT needs_agent").select("site_id"), "site_id", "left_semi")
    return products.join(offers.select("product_id"), "product_id", "left_semi")


def in_subtree(path: Column, root: str) -> Column:
    return (path == root) | path.startswith(root + "/")


def search_filter_price_moq(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog = Catalog(spark, sf_dir)
    cheap = listing(catalog).filter(F.col("best_price_usd").between(50, 2000))
    return with_offer(cheap, catalog.active_offers(), direct_only=True, max_moq=10, sites=catalog.sites()).select(*CARD)


def subtree_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Catalog(spark, sf_dir).products().filter(in_subtree(F.col("path"), "promo")).select("product_id", "path")


def brand_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Catalog(spark, sf_dir).products().filter(F.lower("brand") == "brand#12").select("product_id", "brand")


def like_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Substring search over several columns when the index has no hit; score 0."""
    found = Catalog(spark, sf_dir).products().filter(F.col("title").ilike("%red%") | F.col("brand").ilike("%red%") | F.col("path").ilike("%red%"))
    return found.select("product_id", F.lit(0.0).alias("score"))


def facet_brand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing(Catalog(spark, sf_dir)).groupBy("brand").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "brand").limit(12)


def facet_site(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog = Catalog(spark, sf_dir)
    counts = catalog.active_offers().groupBy("site_id").agg(F.count_distinct("product_id").alias("n"))
    return counts.join(catalog.sites(), "site_id").select("site_key", "n")


def facet_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    price, label = F.col("best_price_usd"), None
    for low, high, name in BUCKETS:
        inside = (price >= low) if high is None else (price >= low) & (price < high)
        label = F.when(inside, name) if label is None else label.when(inside, name)
    return listing(Catalog(spark, sf_dir)).withColumn("bucket", label).filter("bucket IS NOT NULL").groupBy("bucket").agg(F.count("*").alias("n"))


def savings(best: Column, most: Column) -> Column:
    """Percent saved at the best price, rounded half to even; null unless the highest price is above a positive best one."""
    return F.when((most > best) & (best > 0), F.bround(100 * (1 - best / most), 0).cast("long"))


def savings_pct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing(Catalog(spark, sf_dir)).select("product_id", savings(F.col("best_price_usd"), F.col("max_price_usd")).alias("savings_pct"))


def slug_of(title: Column) -> Column:
    return F.regexp_replace(F.lower(title), r"[^a-z0-9]+", "-")


def product_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a list shows of each product: rollup, savings, best site and category."""
    catalog = Catalog(spark, sf_dir)
    sites = catalog.sites().select(F.col("site_id").alias("best_price_site_id"), F.col("site_key").alias("best_site"))
    cards = listing(catalog).join(F.broadcast(sites), "best_price_site_id", "left")  # 25 sites at any scale
    return cards.select(*CARD, "brand", "best_landed_usd", "min_moq", "best_site", savings(F.col("best_price_usd"), F.col("max_price_usd")).alias("savings_pct"), F.substring_index("path", "/", -1).alias("category"), F.col("path").alias("category_path"), "last_seen")


def day(ts: Column) -> Column:
    return F.coalesce(F.date_format(ts, "yyyy-MM-dd"), F.lit(""))


def export_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the products' CSV: money with four decimals at most and no trailing zeros, nulls as empty text."""
    catalog = Catalog(spark, sf_dir)
    sites = catalog.sites().select(F.col("site_id").alias("best_price_site_id"), F.col("site_key").alias("best_site"))
    rows = listing(catalog).join(F.broadcast(sites), "best_price_site_id", "left")  # 25 sites at any scale
    saved = savings(F.col("best_price_usd"), F.col("max_price_usd")).cast("string")
    return rows.select(
        F.col("title").alias("product"), F.coalesce("brand", F.lit("")).alias("brand"), F.col("path").alias("category"), F.col("site_count").alias("sites"), F.col("offer_count").alias("listings"),
        money_text("best_price_usd").alias("best_unit_usd"), money_text("max_price_usd").alias("highest_unit_usd"), F.coalesce(saved, F.lit("")).alias("spread_pct"), money_text("best_landed_usd").alias("best_landed_usd"),
        F.coalesce(F.col("min_moq").cast("string"), F.lit("")).alias("min_moq"), F.coalesce("best_site", F.lit("")).alias("best_site"), F.concat(F.lit("/product/"), slug_of(F.col("title")), F.lit("-"), "product_id").alias("url"), day(F.col("last_seen")).alias("last_seen"),
    )


def export_offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of one product's CSV: its active offers by price, unpriced ones last; undisclosed shipping is empty, not 0."""
    catalog = Catalog(spark, sf_dir)
    rows = catalog.active_offers().filter(F.col("product_id") == EXPORTED).join(F.broadcast(catalog.sites()), "site_id")  # 25 sites at any scale
    landed = F.expr("price_usd * greatest(moq, 1) + coalesce(shipping, 0.0)")
    yes = lambda c: F.when(c, "yes").otherwise("")
    return rows.orderBy(F.asc_nulls_last("price_usd"), "supplier_id").select(
        F.col("site_key").alias("site"), "supplier_id", money_text("price_usd").alias("unit_price_usd"), F.coalesce("moq", F.lit(1)).alias("moq"), money_text("shipping").alias("shipping_usd"), money_text(landed).alias("landed_usd"), yes(F.col("needs_agent")).alias("needs_agent"), day(F.col("last_seen")).alias("last_seen")
    )


_BUCKET_SQL = "CASE " + " ".join(f"WHEN best_price_usd >= {lo}" + (f" AND best_price_usd < {hi}" if hi else "") + f" THEN '{name}'" for lo, hi, name in BUCKETS) + " END"

_SAVED = "CASE WHEN max_price_usd > best_price_usd AND best_price_usd > 0 THEN CAST(round_even(100 * (1 - best_price_usd / max_price_usd), 0) AS BIGINT) END"
_MONEY = "coalesce(rtrim(rtrim(printf('%.4f', {}), '0'), '.'), '')"

QUERIES = {f"sort_{s}": sorted_page(s) for s in SORTS} | {"page_2": sorted_page("price_asc", 2)} | {f.__name__: f for f in (search_filter_price_moq, subtree_filter, brand_ci, like_fallback, facet_brand, facet_site, facet_price, savings_pct, product_cards, export_products, export_offers)}
ORACLES = {f"sort_{s}": f"{LISTING_SQL} SELECT {_CARD} FROM listing ORDER BY {o}, product_id LIMIT {PAGE}" for s, o in _SORTS_SQL.items()} | {
    "page_2": f"{LISTING_SQL} SELECT {_CARD} FROM listing ORDER BY best_price_usd ASC NULLS LAST, product_id LIMIT {PAGE} OFFSET {PAGE}",
    "search_filter_price_moq": f"{LISTING_SQL} SELECT {_CARD} FROM listing l WHERE best_price_usd BETWEEN 50 AND 2000 AND EXISTS (SELECT 1 FROM offers o JOIN nation ON n_nationkey = o.site_id JOIN region ON r_regionkey = n_regionkey WHERE o.product_id = l.product_id AND is_active AND r_name <> 'ASIA' AND coalesce(moq, 1) <= 10)",
    "subtree_filter": "SELECT p_partkey AS product_id, lower(p_type) || '/' || lower(p_brand) AS path FROM part WHERE lower(p_type) || '/' || lower(p_brand) = 'promo' OR lower(p_type) || '/' || lower(p_brand) LIKE 'promo/%'",
    "brand_ci": "SELECT p_partkey AS product_id, p_brand AS brand FROM part WHERE lower(p_brand) = 'brand#12'",
    "like_fallback": "SELECT p_partkey AS product_id, 0.0::DOUBLE AS score FROM part WHERE p_name ILIKE '%red%' OR p_brand ILIKE '%red%' OR (lower(p_type) || '/' || lower(p_brand)) ILIKE '%red%'",
    "facet_brand": f"{LISTING_SQL} SELECT brand, count(*) AS n FROM listing GROUP BY 1 ORDER BY n DESC, brand LIMIT 12",
    "facet_site": f"WITH {OFFERS_SQL} SELECT lower(n_name) AS site_key, count(DISTINCT product_id) AS n FROM offers JOIN nation ON n_nationkey = site_id WHERE is_active GROUP BY 1",
    "facet_price": f"{LISTING_SQL} SELECT {_BUCKET_SQL} AS bucket, count(*) AS n FROM listing GROUP BY 1 HAVING {_BUCKET_SQL.replace('best_price_usd', 'any_value(best_price_usd)')} IS NOT NULL",
    "savings_pct": f"{LISTING_SQL} SELECT product_id, {_SAVED} AS savings_pct FROM listing",
    "product_cards": f"{LISTING_SQL} SELECT {_CARD}, brand, best_landed_usd, min_moq, lower(n_name) AS best_site, {_SAVED} AS savings_pct, split_part(path, '/', 2) AS category, path AS category_path, last_seen FROM listing LEFT JOIN nation ON n_nationkey = best_price_site_id",
    "export_products": f"{LISTING_SQL} SELECT title AS product, brand, path AS category, site_count AS sites, offer_count AS listings, {_MONEY.format('best_price_usd')} AS best_unit_usd, {_MONEY.format('max_price_usd')} AS highest_unit_usd, coalesce({_SAVED}::VARCHAR, '') AS spread_pct, {_MONEY.format('best_landed_usd')} AS best_landed_usd, min_moq::VARCHAR AS min_moq, lower(n_name) AS best_site, '/product/' || regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g') || '-' || product_id AS url, strftime(last_seen, '%Y-%m-%d') AS last_seen FROM listing LEFT JOIN nation ON n_nationkey = best_price_site_id",
    "export_offers": f"WITH {OFFERS_SQL} SELECT lower(n_name) AS site, supplier_id, {_MONEY.format('price_usd')} AS unit_price_usd, coalesce(moq, 1) AS moq, {_MONEY.format('shipping')} AS shipping_usd, {_MONEY.format('price_usd * greatest(moq, 1) + coalesce(shipping, 0.0)')} AS landed_usd, CASE WHEN r_name = 'ASIA' THEN 'yes' ELSE '' END AS needs_agent, strftime(last_seen, '%Y-%m-%d') AS last_seen FROM offers JOIN nation ON n_nationkey = site_id JOIN region ON r_regionkey = n_regionkey WHERE is_active AND product_id = {EXPORTED}",
}
