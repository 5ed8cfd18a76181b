"""A product from its active offers: attributes by vote, identity fields, title.

offers: product_id, offer_id, title, lang, brand, model, mpn, gtin, description, verified, specs (array of key, value in order). Attributes are
spelt with capitals at word starts; of their values the one with most votes counts, then the longest, then the one that came first by
offer and place. Names of more than KEY_CHARS characters, empty names and empty values don't vote. A field is the first known one, verified
suppliers first, then by offer; what the product has already stays. The title is the upper median by length of the English ones (ties by
offer), cut to TITLE_CHARS; without an English one the product keeps its own. Null and empty strings are unknown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bazaarlake.sources.catalog import OFFERS_SQL, Catalog

KEY_CHARS, TITLE_CHARS = 80, 512  # fixed values
ENGLISH = ["en", "und"]
IDENTITY = ["brand", "model", "mpn", "gtin", "description"]


def titled(key: Column) -> Column:
    """Each run of letters with a capital first, whatever stands between them."""
    return F.array_join(F.transform(F.regexp_extract_all(F.lower(key), F.lit(r"\p{L}+|[^\p{L}]+"), 0), F.initcap), "")


def known(value: Column) -> Column:
    return F.nullif(value, F.lit(""))


def voted_specs(offers: DataFrame) -> DataFrame:
    """product_id and specs, the map of voted attributes. Votes are counted before a product's attributes meet."""
    rows = offers.select("product_id", "offer_id", F.posexplode("specs").alias("at", "s")).select("product_id", "offer_id", "at", titled(F.col("s.key")).alias("key"), F.trim("s.value").alias("value"))
    votes = rows.filter(F.length("key").between(1, KEY_CHARS) & (F.length("value") > 0)).groupBy("product_id", "key", "value").agg(F.count("*").alias("votes"), F.min(F.struct("offer_id", "at")).alias("first"))
    best = votes.groupBy("product_id", "key").agg(F.min(F.struct((-F.col("votes")).alias("v"), (-F.length("value")).alias("l"), "first", "value")).alias("b"))
    return best.groupBy("product_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", F.col("b.value").alias("value"))))).alias("specs"))


def identity(offers: DataFrame) -> DataFrame:
    order = F.struct(~F.coalesce("verified", F.lit(False)), F.col("offer_id"))
    return offers.groupBy("product_id").agg(*(F.min_by(c, F.when(known(F.col(c)).isNotNull(), order)).alias(c) for c in IDENTITY))


def english_titles(offers: DataFrame) -> DataFrame:
    """product_id and the upper median title."""
    english = offers.filter(known(F.col("title")).isNotNull() & (F.col("lang").isNull() | F.col("lang").isin(ENGLISH)))
    of_product = Window.partitionBy("product_id")
    ranked = english.select("product_id", "title", F.row_number().over(of_product.orderBy(F.length("title"), "offer_id")).alias("rn"), F.count("*").over(of_product).alias("n"))
    return ranked.filter("rn = n div 2 + 1").select("product_id", F.substring("title", 1, TITLE_CHARS).alias("title"))


def rebuilt(offers: DataFrame, products: DataFrame) -> DataFrame:
    """products (product_id, title and the identity fields) after their offers were looked at; those without offers stay as they are, without attributes."""
    new = identity(offers).select("product_id", *(F.col(c).alias(f"_{c}") for c in IDENTITY))
    titles = english_titles(offers).withColumnRenamed("title", "_title")
    rows = products.join(new, "product_id", "left").join(titles, "product_id", "left").join(voted_specs(offers), "product_id", "left")
    return rows.select("product_id", F.coalesce("_title", "title").alias("title"), *(F.coalesce(known(F.col(c)), f"_{c}").alias(c) for c in IDENTITY), "specs")


def sample_offers(catalog: Catalog) -> DataFrame:
    """The active offers with titles, languages, identity fields and attributes by supplier and quantity."""
    supplier = catalog.table("supplier").select(F.col("s_suppkey").alias("supplier_id"), "s_name", (F.col("s_acctbal") > 3000).alias("verified"))
    s, rows = F.col("supplier_id"), catalog.active_offers().join(supplier, "supplier_id").join(catalog.products().select("product_id", F.col("title").alias("name")), "product_id")
    spec = lambda key, value: F.struct(F.lit(key).alias("key"), value.alias("value"))
    return rows.select(
        "product_id", s.alias("offer_id"), F.concat("name", F.repeat(F.lit(" x"), (s % 5).cast("int"))).alias("title"), F.when(s % 4 == 0, "zh").when(s % 4 == 1, "en").when(s % 4 == 2, "und").alias("lang"), F.when(s % 3 == 0, F.concat(F.lit("Brand "), s)).when(s % 3 == 1, "").alias("brand"),
        F.when(F.col("moq") > 25, F.concat(F.lit("M-"), "moq")).alias("model"), F.lit(None).cast("string").alias("mpn"), F.when(s % 7 == 0, "00012345678905").alias("gtin"), F.col("s_name").alias("description"), "verified",
        F.array(spec("pack-size no2x", (F.col("moq") % 4).cast("string")), spec("in stock", F.when(F.col("in_stock"), "yes").otherwise("sold out")), spec("void", F.lit(" ")), spec("k" * 81, F.lit("v"))).alias("specs"),
    )


def rebuilt_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every product rebuilt from its offers; every sixth has a brand of its own."""
    catalog = Catalog(spark, sf_dir)
    none = F.lit(None).cast("string")
    products = catalog.products().select("product_id", "title", F.when(F.col("product_id") % 6 == 0, F.col("brand")).alias("brand"), *(none.alias(c) for c in IDENTITY[1:]))
    out = rebuilt(sample_offers(catalog), products)
    return out.select("product_id", "title", *IDENTITY, F.array_join(F.transform(F.map_entries("specs"), lambda e: F.concat_ws("=", e["key"], e["value"])), ";").alias("specs"))


QUERIES = {"rebuilt_products": rebuilt_products}
_FIRST = "first({0} ORDER BY NOT verified, offer_id) FILTER (coalesce({0}, '') <> '')"
_OFFERS = """o AS (SELECT product_id, supplier_id AS offer_id, p_name || repeat(' x', CAST(supplier_id % 5 AS INT)) AS title, CASE supplier_id % 4 WHEN 0 THEN 'zh' WHEN 1 THEN 'en' WHEN 2 THEN 'und' END AS lang, CASE supplier_id % 3 WHEN 0 THEN 'Brand ' || supplier_id WHEN 1 THEN '' END AS brand,
  CASE WHEN moq > 25 THEN 'M-' || moq END AS model, CASE WHEN supplier_id % 7 = 0 THEN '00012345678905' END AS gtin, s_name AS description, s_acctbal > 3000 AS verified, (moq % 4)::VARCHAR AS pack, CASE WHEN in_stock THEN 'yes' ELSE 'sold out' END AS stock
  FROM offers JOIN supplier ON s_suppkey = supplier_id JOIN part ON p_partkey = product_id WHERE is_active)"""
ORACLES = {
    "rebuilt_products": f"""WITH {OFFERS_SQL}, {_OFFERS},
i AS (SELECT product_id, {', '.join(f"{_FIRST.format(c)} AS {c}" for c in ('brand', 'model', 'gtin', 'description'))} FROM o GROUP BY 1),
t AS (SELECT product_id, title FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY length(title), offer_id) AS rn, count(*) OVER (PARTITION BY product_id) AS n FROM o WHERE lang IS NULL OR lang <> 'zh') WHERE rn = n // 2 + 1),
s AS (SELECT product_id, offer_id, 'Pack-Size No2X' AS key, pack AS value FROM o UNION ALL SELECT product_id, offer_id, 'In Stock', stock FROM o),
v AS (SELECT product_id, key, value, row_number() OVER (PARTITION BY product_id, key ORDER BY count(*) DESC, length(value) DESC, min(offer_id)) AS rn FROM s GROUP BY 1, 2, 3),
m AS (SELECT product_id, string_agg(key || '=' || value, ';' ORDER BY key) AS specs FROM v WHERE rn = 1 GROUP BY 1)
SELECT p_partkey AS product_id, coalesce(t.title, p_name) AS title, CASE WHEN p_partkey % 6 = 0 THEN p_brand ELSE i.brand END AS brand, i.model, NULL::VARCHAR AS mpn, i.gtin, i.description, specs FROM part LEFT JOIN i ON i.product_id = p_partkey LEFT JOIN t ON t.product_id = p_partkey LEFT JOIN m ON m.product_id = p_partkey""",
}
