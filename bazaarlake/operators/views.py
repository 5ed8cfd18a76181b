"""What pages show of an offer, a watch and a pending review: rows with their children and neighbours joined in.

A title is the translated one where there is one. Children are arrays: tiers by quantity, variants by price, those without a price last. A watch whose
product is gone keeps its row; it is hit where a price is known, a target is set (not 0) and reached. Reviews whose listing or product is gone
are left out; the first picture of a listing is the one of the least position. Null flags count as off."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bazaarlake.operators import demand, economics
from bazaarlake.operators.matching import same_title_pairs
from bazaarlake.operators.ordering import agent_notice
from bazaarlake.operators.rebuild import known
from bazaarlake.sources.catalog import OFFERS_SQL, Catalog

REMOVED, PENDING = "(product removed)", 50  # fixed values: title of a product that is gone; reviews on a page


def offer_views(offers: DataFrame, sites: DataFrame, tiers: DataFrame, variants: DataFrame, key: tuple[str, ...] = ("offer_id",)) -> DataFrame:
    """offers (offer_id, site_id, title_en, title_raw, ...) with their site, tiers (offer_id, min_qty, price, ...) and variants (offer_id, sku, price_usd, ...).
    sites is a small table of settings; key: the columns that name an offer in all of them. Children dealt by the key before are not shuffled again."""
    children = lambda rows, *order: rows.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(*(o.alias(f"o{n}") for n, o in enumerate(order)), F.struct(*(c for c in rows.columns if c not in key)).alias("row")))).alias("a")).select(*key, F.transform("a", lambda x: x["row"]).alias("rows"))
    t = children(tiers, F.col("min_qty")).withColumnRenamed("rows", "tiers")
    v = children(variants, F.col("price_usd").isNull(), F.col("price_usd"), F.col("sku")).withColumnRenamed("rows", "variants")
    rows = offers.join(F.broadcast(sites), "site_id", "left").join(t, list(key), "left").join(v, list(key), "left")
    translated = known(F.col("title_en"))
    return rows.withColumns({
        "title": F.coalesce(translated, "title_raw"), "was_translated": F.coalesce(translated != F.col("title_raw"), F.lit(False)), "variant_count": F.greatest(F.lit(0), F.coalesce(F.size("variants"), F.lit(0))), "agent_notice": agent_notice(F.initcap("site_key"), F.coalesce("needs_agent", F.lit(False))),
        **{c: F.coalesce(c, F.lit(False)) for c in ("needs_agent", "is_wholesale", "is_baseline")},
    })


def watch_rows(watches: DataFrame, prices: DataFrame, products: DataFrame) -> DataFrame:
    """watches (watch_id, product_id, target, ...) with the product's title, its price and site now (prices: watch_id, price, site), and whether the target is hit."""
    now = prices.select("watch_id", F.col("price").alias("current_usd"), F.col("site").alias("current_site"))
    rows = watches.join(products.select("product_id", "title"), "product_id", "left").join(now, "watch_id", "left")
    hit = F.col("current_usd").isNotNull() & (F.coalesce("target", F.lit(0.0)) != 0) & (F.col("current_usd") <= F.col("target"))
    return rows.withColumns({"title": F.coalesce("title", F.lit(REMOVED)), "hit": F.coalesce(hit, F.lit(False))})


def review_rows(reviews: DataFrame, offers: DataFrame, products: DataFrame, pictures: DataFrame, limit: int = PENDING) -> DataFrame:
    """The pending reviews of the highest scores: reviews (review_id, offer_id, product_id, score, status) beside the offer's title and first picture and the product's.
    offers (offer_id, offer_title), products (product_id, product_title, product_picture), pictures (offer_id, position, picture)."""
    top = reviews.filter("status = 'pending'").join(offers, "offer_id").join(products, "product_id").orderBy(F.desc("score"), "review_id").limit(limit)
    first = pictures.join(top.select("offer_id").distinct(), "offer_id", "left_semi").groupBy("offer_id").agg(F.min_by("picture", F.struct("position", "picture")).alias("offer_picture"))
    return top.join(first, "offer_id", "left").withColumn("score", F.bround("score", 3))


def offer_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every active offer with its site, ladder and variants (its lines)."""
    catalog = Catalog(spark, sf_dir)
    key = ("product_id", "supplier_id")
    title = catalog.products().select("product_id", "title")
    offers = catalog.active_offers().join(title, "product_id").select(*key, "site_id", F.when(F.col("supplier_id") % 2 == 0, F.concat("title", F.lit(" en"))).when(F.col("supplier_id") % 5 == 0, "").alias("title_en"), F.col("title").alias("title_raw"), "price_usd", "moq")
    line = catalog.table("lineitem")
    variants = line.select(F.col("l_partkey").alias("product_id"), F.col("l_suppkey").alias("supplier_id"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("sku"), F.when(F.col("l_returnflag") != "R", F.col("l_extendedprice")).alias("price_usd"))
    out = offer_views(offers, catalog.sites(), economics.tiers(catalog, dealt=True), variants, key)
    skus = F.array_join(F.transform("variants", lambda v: v["sku"]), " ")
    return out.select(F.concat_ws("-", *key).alias("offer_id"), "site_key", "needs_agent", "is_wholesale", "is_baseline", "title", "was_translated", "price_usd", "moq", F.array_join(F.transform("tiers", lambda t: t["min_qty"].cast("string")), " ").alias("tiers"), F.md5(skus).alias("skus"), F.col("variant_count").cast("long").alias("variant_count"), F.col("agent_notice").isNotNull().alias("warned"))


def watch_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A watch of every third product, some of which are gone, with prices now."""
    catalog, k = Catalog(spark, sf_dir), F.col("product_id")
    watches = catalog.products().filter("product_id % 3 = 0").select(
        k.alias("watch_id"), F.when(k % 7 == 0, -k).otherwise(k).alias("product_id"), (k % 2 == 0).alias("use_landed"), F.lit(False).alias("direct_only"), F.when(k % 4 != 0, (k % 5) * 700.0).alias("target"),
    )
    prices = demand.watch_prices(catalog.active_offers(), catalog.sites(), watches)
    return watch_rows(watches, prices, catalog.products()).select("watch_id", "title", "target", "current_usd", "hit")


def review_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of one title as reviews, listing beside product, with pictures by label."""
    catalog = Catalog(spark, sf_dir)
    pairs = same_title_pairs(catalog)
    reviews = pairs.select(F.col("low_id").alias("review_id"), F.col("low_id").alias("offer_id"), F.col("high_id").alias("product_id"), (0.7 + (F.col("low_id") % 15) / 100).alias("score"), F.when(F.col("low_id") % 4 == 0, "done").otherwise("pending").alias("status"))
    offers = catalog.products().filter("product_id % 9 <> 0").select(F.col("product_id").alias("offer_id"), F.col("title").alias("offer_title"))
    image = catalog.table("embeddings").select(F.col("label").cast("long").alias("offer_id"), F.col("vec_id").alias("position"), F.concat(F.lit("p"), "vec_id").alias("picture"))
    products = catalog.products().select("product_id", F.col("title").alias("product_title"), F.concat(F.lit("q"), "product_id").alias("product_picture"))
    return review_rows(reviews, offers, products, image).select("review_id", "score", "offer_title", "offer_picture", "product_title", "product_picture")


QUERIES = {f.__name__: f for f in (offer_pages, watch_list, review_list)}
ORACLES = {
    "offer_pages": f"""WITH {OFFERS_SQL}, t AS (SELECT l_partkey || '-' || l_suppkey AS offer_id, array_to_string(list_transform(list_sort(list(DISTINCT CAST(l_quantity AS INTEGER))), lambda q: q::VARCHAR), ' ') AS tiers, md5(string_agg(l_orderkey || '-' || l_linenumber, ' ' ORDER BY l_returnflag = 'R', CASE WHEN l_returnflag <> 'R' THEN l_extendedprice END, l_orderkey || '-' || l_linenumber)) AS skus, count(*) AS variant_count FROM lineitem GROUP BY 1),
o AS (SELECT product_id || '-' || supplier_id AS offer_id, lower(n_name) AS site_key, r_name = 'ASIA' AS needs_agent, r_name = 'EUROPE' AS is_wholesale, r_name = 'AMERICA' AS is_baseline, p_name || CASE WHEN supplier_id % 2 = 0 THEN ' en' ELSE '' END AS title, supplier_id % 2 = 0 AS was_translated, price_usd, moq FROM offers JOIN part ON p_partkey = product_id JOIN nation ON n_nationkey = site_id JOIN region ON r_regionkey = n_regionkey WHERE is_active)
SELECT o.*, tiers, skus, variant_count, needs_agent AS warned FROM o JOIN t USING (offer_id)""",
    "watch_list": f"""WITH {OFFERS_SQL}, w AS (SELECT p_partkey AS watch_id, CASE WHEN p_partkey % 7 = 0 THEN -p_partkey ELSE p_partkey END AS product_id, CASE WHEN p_partkey % 4 <> 0 THEN (p_partkey % 5) * 700.0::DOUBLE END AS target FROM part WHERE p_partkey % 3 = 0),
c AS (SELECT watch_id, min(v) AS current_usd FROM (SELECT watch_id, CASE WHEN watch_id % 2 = 0 THEN price_usd * greatest(moq, 1) + coalesce(shipping, 0.0) ELSE price_usd END AS v FROM w JOIN offers USING (product_id) WHERE is_active) WHERE v > 0 GROUP BY 1)
SELECT watch_id, coalesce(p_name, '{REMOVED}') AS title, target, current_usd, coalesce(target <> 0 AND current_usd <= target, false) AS hit FROM w LEFT JOIN part ON p_partkey = product_id LEFT JOIN c USING (watch_id)""",
    "review_list": f"""WITH p AS (SELECT p_partkey AS low_id, lead(p_partkey) OVER (PARTITION BY p_brand, p_name ORDER BY p_partkey) AS high_id, p_name FROM part), i AS (SELECT label, 'p' || min(vec_id) AS picture FROM embeddings GROUP BY 1)
SELECT low_id AS review_id, round_even(0.7::DOUBLE + (low_id % 15) / 100, 3) AS score, p_name AS offer_title, picture AS offer_picture, p_name AS product_title, 'q' || high_id AS product_picture FROM p LEFT JOIN i ON label = low_id WHERE high_id IS NOT NULL AND low_id % 4 <> 0 AND low_id % 9 <> 0 ORDER BY 0.7::DOUBLE + (low_id % 15) / 100 DESC, low_id LIMIT {PENDING}""",
}
