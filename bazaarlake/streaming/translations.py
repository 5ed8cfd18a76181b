"""Translations kept between runs: distinct texts that the cache lacks are translated once and added, all others are looked up.

The cache is keyed by provider and whole text, in buckets by key; a row has the source's language by its script, both texts (cut to
STORED_CHARS), and the provider. Of two translations of a key the first one stays. Texts that need none (null, empty, or in English letters
only where `foreign_only`) stay as they are; a translation that is null or empty leaves the text and isn't kept, so it is tried again."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bazaarlake.functions import text
from bazaarlake.sources.catalog import Catalog
from bazaarlake.sources.tables import shared_dir, stored
from bazaarlake.streaming.bucket_store import BucketStore

STORED_CHARS = 20_000  # fixed value
ROW = "key_hash string, src_lang string, src_text string, dst_text string, provider string"


class TranslationCache(BucketStore):
    def __init__(self, spark: SparkSession, path: str, provider: str, buckets: int = 16):
        super().__init__(spark, path, {"translations": (ROW, ["key_hash"])}, buckets)
        self.provider = provider

    def key(self, column: Column) -> Column:
        return text.hash_key(F.lit(self.provider), column)

    def translate(self, rows: DataFrame, columns: list[str], provider: Callable[[DataFrame], DataFrame], foreign_only: bool = True) -> DataFrame:
        """rows with the columns translated. provider gets the distinct texts that are missing (src_text) and gives them with dst_text."""
        said = F.explode(F.array(*(F.col(c).cast("string") for c in columns)))
        asked = rows.select(said.alias("src_text")).filter("src_text <> ''").distinct()
        if foreign_only:
            asked = asked.filter(~text.detect_lang(F.col("src_text")).isin("en", "und"))
        asked = stored(asked.withColumn("key_hash", self.key(F.col("src_text"))), "translation-texts")
        log = self.log()
        held, others = self.touched("translations", asked, log)
        missing = asked.join(held.select("key_hash"), "key_hash", "left_anti")
        given = provider(missing.select("src_text")).select("src_text", "dst_text").filter("dst_text <> ''").dropDuplicates(["src_text"])
        fresh = stored(missing.join(given, "src_text").select("key_hash", text.detect_lang(F.col("src_text")).alias("src_lang"), F.substring("src_text", 1, STORED_CHARS).alias("src_text"), F.substring("dst_text", 1, STORED_CHARS).alias("dst_text"), F.lit(self.provider).alias("provider")), "translation-fresh")
        if not fresh.isEmpty():
            batch, folder = self.next_batch(log, self.provider, None)
            self.commit(log, self.provider, batch, self.write("translations", others.unionByName(held).unionByName(fresh), folder))
        known = stored(asked.join(held.unionByName(fresh).select("key_hash", "dst_text"), "key_hash").select("src_text", "dst_text"), "translation-known")
        for c in columns:
            rows = rows.join(known.select(F.col("src_text").alias(c), F.col("dst_text").alias("_dst")), c, "left").withColumn(c, F.coalesce("_dst", c)).drop("_dst").select(*rows.columns)
        return rows


#: The sample's provider: signs and what they mean.
SIGNS = {"红": "red ", "蓝": "blue ", "大": "large ", "小": "small "}


def by_signs(missing: DataFrame) -> DataFrame:
    """Each known sign by its meaning."""
    out = F.col("src_text")
    for sign, meaning in SIGNS.items():
        out = F.replace(out, F.lit(sign), F.lit(meaning))
    return missing.withColumn("dst_text", F.trim(out))


def cached_translations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles with a foreign sign in front of two thirds of them, translated in two batches through one cache."""
    k = F.col("product_id")
    sign = F.element_at(F.array(*map(F.lit, SIGNS)), (k % len(SIGNS) + 1).cast("int"))
    rows = Catalog(spark, sf_dir).products().select("product_id", F.when(k % 3 != 0, F.concat(sign, "title")).otherwise(F.col("title")).alias("title"))
    cache = TranslationCache(spark, f"{shared_dir(spark)}/translations-{uuid.uuid4().hex}", "signs")
    first = cache.translate(rows.filter("product_id % 2 = 0"), ["title"], by_signs)
    return first.unionByName(cache.translate(rows.filter("product_id % 2 = 1"), ["title"], by_signs))


QUERIES = {"cached_translations": cached_translations}
ORACLES = {
    "cached_translations": f"SELECT p_partkey AS product_id, CASE WHEN p_partkey % 3 <> 0 THEN {[m.strip() for m in SIGNS.values()]!r}[p_partkey % {len(SIGNS)} + 1] || ' ' || p_name ELSE p_name END AS title FROM part",
}
