"""Rules by category path as a table: of the rules whose path is a row's path or lies above it, the longest one's values count.

A path has as many prefixes as levels, so the distinct paths are exploded into them and meet rules by equality; no path is held
against all rules, and the rules may be as many as they like. The rows meet their paths' values at the end.

Slashes at the ends of paths and prefixes don't count; a null path is the empty one, which only a rule for the empty path hits. Of
several rules for one path the greatest values count. Rows without a rule get nulls, which callers fill with their defaults; null prefixes are no
rules; other columns stay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bazaarlake.sources.catalog import Catalog


def bare(path: Column) -> Column:
    return F.btrim(F.coalesce(path, F.lit("")), F.lit("/"))


def prefixes(path: Column) -> Column:
    """The path and all above it."""
    levels = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(levels)), lambda n: F.array_join(F.slice(levels, 1, n), "/"))


def ruled(rows: DataFrame, rules: DataFrame, path: str = "path") -> DataFrame:
    """rows with the value columns of rules (prefix, values...) for their path, and `rule`, the prefix that hit."""
    values = [c for c in rules.columns if c != "prefix"]
    table = rules.filter("prefix IS NOT NULL").groupBy(bare(F.col("prefix")).alias("_prefix")).agg(F.max(F.struct(*values)).alias("_values"))
    marked = rows.withColumn("_path", bare(F.col(path)))
    met = marked.select("_path").distinct().select("_path", F.explode(prefixes(F.col("_path"))).alias("_prefix")).join(table, "_prefix")
    best = met.groupBy("_path").agg(F.max(F.struct(F.length("_prefix").alias("n"), F.col("_prefix").alias("rule"), F.col("_values").alias("v"))).alias("_b"))
    return marked.join(best, "_path", "left").select(*(marked[c] for c in rows.columns), *(F.col(f"_b.v.{c}").alias(c) for c in values), F.col("_b.rule").alias("rule"))


def sample(catalog: Catalog) -> tuple[DataFrame, DataFrame]:
    """Products on three levels; rules for some products' paths on each level, as many as a third to a half of the catalog."""
    k = F.col("product_id")
    rows = catalog.products().select("product_id", F.concat_ws("/", "path", "size").alias("path"), "list_price")
    rate = lambda n: ((k % n) + 1) / 100.0
    low = rows.filter("product_id % 5 = 0").select(F.concat(F.lit("/"), "path").alias("prefix"), rate(7).alias("rate"))
    middle = catalog.products().filter("product_id % 3 = 0").select(F.concat("path", F.lit("/")).alias("prefix"), rate(5).alias("rate"))
    high = catalog.products().filter("product_id % 40 = 0").select(F.substring_index("path", "/", 1).alias("prefix"), rate(3).alias("rate"))
    return rows, low.unionByName(middle).unionByName(high)


def ruled_duties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Duty of every product by the rule nearest to its path; a default where none hits."""
    out = ruled(*sample(Catalog(spark, sf_dir)))
    return out.select("product_id", "rule", F.coalesce("rate", F.lit(0.25)).alias("rate"), (F.col("list_price") * F.coalesce("rate", F.lit(0.25))).alias("duty"))


QUERIES = {"ruled_duties": ruled_duties}
ORACLES = {
    "ruled_duties": """WITH p AS (SELECT p_partkey AS product_id, lower(p_type) || '/' || lower(p_brand) AS mid, lower(p_type) || '/' || lower(p_brand) || '/' || p_size AS path, lower(p_type) AS kind, p_retailprice AS price FROM part),
r AS (SELECT prefix, max(rate) AS rate FROM (SELECT path AS prefix, (product_id % 7 + 1) / 100.0::DOUBLE AS rate FROM p WHERE product_id % 5 = 0 UNION ALL SELECT mid, (product_id % 5 + 1) / 100.0::DOUBLE FROM p WHERE product_id % 3 = 0 UNION ALL SELECT kind, (product_id % 3 + 1) / 100.0::DOUBLE FROM p WHERE product_id % 40 = 0) GROUP BY 1),
j AS (SELECT product_id, any_value(price) AS price, arg_max(prefix, length(prefix)) AS rule, arg_max(rate, length(prefix)) AS rate FROM p LEFT JOIN r ON path = prefix OR starts_with(path, prefix || '/') GROUP BY 1)
SELECT product_id, rule, coalesce(rate, 0.25::DOUBLE) AS rate, price * coalesce(rate, 0.25::DOUBLE) AS duty FROM j""",
}
