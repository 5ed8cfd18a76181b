"""Ingest and curation steps: source dedupe, enrichment merge, slugs, merges and rulings, galleries, orphans, lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bazaarlake.functions import units
from bazaarlake.operators import economics
from bazaarlake.operators.economics import bom_cost
from bazaarlake.operators.matching import same_title_pairs
from bazaarlake.operators.rollup import roll_up
from bazaarlake.sources.catalog import OFFERS_SQL, Catalog, first_per_key

SUPPLIER, SUPPLIER_ROWS, PRODUCT, TOP, OPTIONS, IMAGE_SUPPLIERS = 7, 200, 15, 12, 20, 10
CURRENCIES = ["USD", "CNY", "EUR", "XXX"]
KEYWORDS = ["fr page", "example 12", "de ref"]


def source_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First event of each (user, type), as a source keeps the first listing of an id."""
    return first_per_key(Catalog(spark, sf_dir).table("events").select("user_id", "event_type", "event_id", "ts"), ["user_id", "event_type"], [F.asc("ts"), F.asc("event_id")])


def fx_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order totals in dollars; an unknown currency gives null. The currency stands in from the order's key."""
    currency = F.element_at(F.array(*map(F.lit, CURRENCIES)), (F.col("o_orderkey") % len(CURRENCIES) + 1).cast("int"))
    return Catalog(spark, sf_dir).table("orders").select("o_orderkey", (F.col("o_totalprice") / units.rate(currency)).alias("usd"))


def merge_detail(listed: DataFrame, detail: DataFrame, key: str, override: list[str]) -> DataFrame:
    """Enrich listings: what a listing has stays, but for the fields in override, which the detail replaces where it has them. An empty array or map is
    none."""
    many = lambda rows, c: rows.schema[c].dataType.typeName() in ("array", "map")
    has = lambda rows, c: F.when(F.size(rows[c]) > 0, rows[c]) if many(rows, c) else rows[c]
    d = detail.select(key, *(has(detail, c).alias(f"_d_{c}") for c in detail.columns if c != key))
    listed = listed.select(*(has(listed, c).alias(c) for c in listed.columns))
    both = set(detail.columns) - {key}
    pick = lambda c: F.coalesce(f"_d_{c}", c) if c in override else F.coalesce(c, f"_d_{c}")
    return listed.join(d, key, "left").select(key, *((pick(c) if c in both else F.col(c)).alias(c) for c in listed.columns if c != key))


def unique_slugs(rows: DataFrame) -> DataFrame:
    """rows (product_id, base) with a slug each: the second and later of a base get -2, -3, ...; a number that another base already
    spells out (a title that itself ends in -2) is passed over, as many times as it takes."""
    order = Window.partitionBy("base").orderBy("product_id")
    taken = rows.select(F.col("base").alias("spelt")).distinct()
    parts = taken.select(F.regexp_extract("spelt", r"^(.*)-(\d+)$", 1).alias("base"), F.expr(r"try_cast(regexp_extract(spelt, '-([0-9]+)$', 1) AS INT)").alias("n"))
    spelt = parts.filter("n >= 2").groupBy("base").agg(F.array_sort(F.collect_set("n")).alias("used"))
    numbered = rows.withColumn("k", F.row_number().over(order)).join(spelt, "base", "left")
    # The k-th product takes the (k - 1)-th number from 2 on that isn't used: skip each used number that is not above it.
    n = F.aggregate(F.coalesce("used", F.array().cast("array<int>")), F.col("k"), lambda acc, u: F.when(u <= acc, acc + 1).otherwise(acc))
    return numbered.select("product_id", F.when(F.col("k") == 1, F.col("base")).otherwise(F.concat_ws("-", "base", n)).alias("slug"))


def slug_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unique slugs of all titles; every fortieth title spells out a number of its own."""
    base = F.regexp_replace(F.lower("title"), r"[^a-z0-9]+", "-")
    spelt = F.when(F.col("product_id") % 40 == 0, F.concat(base, F.lit("-3"))).otherwise(base)
    return unique_slugs(Catalog(spark, sf_dir).products().select("product_id", spelt.alias("base")))


def orphan_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images whose offer is gone: a left anti-join. An image's offer stands in from its label and key."""
    catalog = Catalog(spark, sf_dir)
    images = catalog.table("embeddings").select(F.col("vec_id").alias("image_id"), F.col("label").cast("long").alias("product_id"), (F.col("vec_id") % IMAGE_SUPPLIERS).alias("supplier_id"))
    return images.join(catalog.active_offers().select("product_id", "supplier_id"), ["product_id", "supplier_id"], "left_anti").select("image_id", "product_id", "supplier_id")


def gallery_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document per distinct content, the longest name first, as a gallery shows each picture once."""
    rows = Catalog(spark, sf_dir).table("documents").select("doc_id", F.sha2("text", 256).alias("sha256"), "n_chars")
    best = rows.groupBy("sha256").agg(F.max(F.struct("n_chars", (-F.col("doc_id")).alias("neg"))).alias("b"))
    return best.select("sha256", (-F.col("b.neg")).alias("doc_id"))


def merge_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rollup after products of one brand and title were merged into the one with the least id."""
    catalog = Catalog(spark, sf_dir)
    target = F.min("product_id").over(Window.partitionBy("brand", "title"))
    ids = catalog.products().select("product_id", target.alias("merged_id"))
    offers = catalog.active_offers().join(ids, "product_id").drop("product_id").withColumnRenamed("merged_id", "product_id")
    return roll_up(offers).select("product_id", "offer_count", "site_count", "best_price_usd")


def record_rejections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ruling on two products, expanded to their suppliers' offers, smaller first, each pair once."""
    catalog = Catalog(spark, sf_dir)
    ruled = same_title_pairs(catalog).filter("abs(size - next_size) > 45").select("low_id", "high_id")
    offers = catalog.active_offers().select("product_id", "supplier_id")
    low = offers.select(F.col("product_id").alias("low_id"), F.col("supplier_id").alias("a"))
    high = offers.select(F.col("product_id").alias("high_id"), F.col("supplier_id").alias("b"))
    both = ruled.join(low, "low_id").join(high, "high_id").filter("a <> b")
    return both.select(F.least("a", "b").alias("low_supplier"), F.greatest("a", "b").alias("high_supplier")).distinct()


def supplier_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A supplier's cheapest offers, then their distinct products in that order."""
    rows = Catalog(spark, sf_dir).active_offers().filter(F.col("supplier_id") == SUPPLIER).orderBy("price_usd", "product_id").limit(SUPPLIER_ROWS)
    return rows.groupBy("product_id").agg(F.min("price_usd").alias("price_usd")).orderBy("price_usd", "product_id")


def product_offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One product's offers by price, unpriced ones first."""
    return Catalog(spark, sf_dir).active_offers().filter(F.col("product_id") == PRODUCT).orderBy(F.asc_nulls_first("price_usd"), "supplier_id").select("product_id", "supplier_id", "price_usd", "shipping")


def most_compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = roll_up(Catalog(spark, sf_dir).active_offers()).filter("site_count > 1")
    return rows.orderBy(F.desc("site_count"), F.desc("offer_count"), "product_id").limit(TOP).select("product_id", "site_count", "offer_count")


def newest_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The TOP active products that were listed last."""
    catalog = Catalog(spark, sf_dir)
    active = catalog.active_offers().select("product_id").distinct()
    return catalog.first_seen().join(active, "product_id", "left_semi").orderBy(F.desc("first_seen"), "product_id").limit(TOP)


def bom_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of a bill of materials over unrounded lines."""
    return bom_cost(spark, sf_dir).agg(F.sum(F.col("total").cast("decimal(18,4)")).cast("double").alias("total"), F.count_if(F.col("total").isNull()).alias("unmatched"), F.sum("overage").cast("long").alias("overage"))


def sku_cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants of each brand: its sizes times its types in order, the first OPTIONS of them."""
    sets = Catalog(spark, sf_dir).table("part").groupBy("p_brand").agg(F.array_sort(F.collect_set("p_size")).alias("sizes"), F.array_sort(F.collect_set("p_type")).alias("types"))
    pairs = F.flatten(F.transform("sizes", lambda s: F.transform("types", lambda t: F.concat_ws("/", s, t))))
    return sets.select("p_brand", F.explode(F.slice(pairs, 1, OPTIONS)).alias("variant"))


def keyword_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose address has every token of a keyword, as a sitemap search finds them: keywords of two tokens from a list."""
    words = F.transform(F.array(*map(F.lit, KEYWORDS)), lambda k: F.struct(k.alias("keyword"), F.split(k, " ").alias("tokens")))
    rows = Catalog(spark, sf_dir).table("pages").select("page_id", F.lower("url").alias("url"), F.explode(words).alias("k"))
    return rows.filter(F.forall("k.tokens", lambda t: F.contains(F.col("url"), t))).select("page_id", F.col("k.keyword").alias("keyword"))


QUERIES = {f.__name__: f for f in (source_dedupe, fx_convert, slug_suffix, orphan_images, gallery_dedupe, merge_products, record_rejections, supplier_products, product_offers, most_compared, newest_products, bom_totals, sku_cross, keyword_pages)}
_RATES = ", ".join(f"({n}, {units.FALLBACK_RATES[c]})" for n, c in enumerate(CURRENCIES) if c in units.FALLBACK_RATES)
ORACLES = {
    "source_dedupe": "SELECT user_id, event_type, event_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS rn FROM events) WHERE rn = 1",
    "fx_convert": f"SELECT o_orderkey, o_totalprice / r::DOUBLE AS usd FROM orders LEFT JOIN (VALUES {_RATES}) t(n, r) ON n = o_orderkey % {len(CURRENCIES)}",
    "slug_suffix": "WITH b AS (SELECT p_partkey AS product_id, regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g') || CASE WHEN p_partkey % 40 = 0 THEN '-3' ELSE '' END AS base FROM part), k AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY product_id) AS k FROM b), s AS (SELECT *, k + CASE WHEN k >= 3 AND EXISTS (SELECT 1 FROM b o WHERE o.base = k.base || '-3') THEN 1 ELSE 0 END AS n FROM k) SELECT product_id, CASE WHEN k = 1 THEN base ELSE base || '-' || n END AS slug FROM s",
    "orphan_images": f"WITH {OFFERS_SQL} SELECT vec_id AS image_id, label::BIGINT AS product_id, vec_id % {IMAGE_SUPPLIERS} AS supplier_id FROM embeddings WHERE NOT EXISTS (SELECT 1 FROM offers o WHERE is_active AND o.product_id = label AND o.supplier_id = vec_id % {IMAGE_SUPPLIERS})",
    "gallery_dedupe": "SELECT sha256(text) AS sha256, first(doc_id ORDER BY n_chars DESC, doc_id) AS doc_id FROM documents GROUP BY 1",
    "merge_products": f"WITH {OFFERS_SQL}, m AS (SELECT p_partkey, min(p_partkey) OVER (PARTITION BY p_brand, p_name) AS to_id FROM part) SELECT to_id AS product_id, count(*) AS offer_count, count(DISTINCT site_id) AS site_count, min(price_usd) FILTER (price_usd > 0) AS best_price_usd FROM offers JOIN m ON p_partkey = product_id WHERE is_active GROUP BY 1",
    "record_rejections": f"WITH {OFFERS_SQL}, p AS (SELECT p_partkey AS low_id, lead(p_partkey) OVER w AS high_id, abs(p_size - lead(p_size) OVER w) AS d FROM part WINDOW w AS (PARTITION BY p_brand, p_name ORDER BY p_partkey)) SELECT DISTINCT least(a.supplier_id, b.supplier_id) AS low_supplier, greatest(a.supplier_id, b.supplier_id) AS high_supplier FROM p JOIN offers a ON a.product_id = low_id JOIN offers b ON b.product_id = high_id WHERE d > 45 AND a.is_active AND b.is_active AND a.supplier_id <> b.supplier_id",
    "supplier_products": f"WITH {OFFERS_SQL} SELECT product_id, min(price_usd) AS price_usd FROM (SELECT * FROM offers WHERE is_active AND supplier_id = {SUPPLIER} ORDER BY price_usd, product_id LIMIT {SUPPLIER_ROWS}) GROUP BY product_id",
    "product_offers": f"WITH {OFFERS_SQL} SELECT product_id, supplier_id, price_usd, shipping FROM offers WHERE is_active AND product_id = {PRODUCT}",
    "most_compared": f"WITH {OFFERS_SQL} SELECT product_id, count(DISTINCT site_id) AS site_count, count(*) AS offer_count FROM offers WHERE is_active GROUP BY 1 HAVING count(DISTINCT site_id) > 1 ORDER BY 2 DESC, 3 DESC, 1 LIMIT {TOP}",
    "newest_products": f"WITH {OFFERS_SQL} SELECT l_partkey AS product_id, min(l_shipdate) AS first_seen FROM lineitem WHERE l_partkey IN (SELECT product_id FROM offers WHERE is_active) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT {TOP}",
    "bom_totals": f"SELECT CAST(sum(CAST(total AS DECIMAL(18,4))) AS DOUBLE) AS total, count(*) FILTER (total IS NULL) AS unmatched, CAST(sum(overage) AS BIGINT) AS overage FROM ({economics.ORACLES['bom_cost']})",
    "sku_cross": f"WITH s AS (SELECT p_brand, size, type, row_number() OVER (PARTITION BY p_brand ORDER BY size, type) AS rn FROM (SELECT DISTINCT p_brand, p_size AS size FROM part) JOIN (SELECT DISTINCT p_brand, p_type AS type FROM part) USING (p_brand)) SELECT p_brand, size || '/' || type AS variant FROM s WHERE rn <= {OPTIONS}",
    "keyword_pages": f"SELECT page_id, keyword FROM pages, (SELECT unnest({KEYWORDS}) AS keyword) WHERE list_bool_and(list_transform(string_split(keyword, ' '), lambda t: contains(lower(url), t)))",
}
