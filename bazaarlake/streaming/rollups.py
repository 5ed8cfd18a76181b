"""Rollups kept up to date: a batch of changed offers recomputes the products that it touches and no others.

Offers and rollups lie in buckets by product, and a table of owners, in buckets by offer, tells where an offer was. So an offer that changes,
moves to another product or goes leaves its old product among the affected ones, whose present offers are read from their
buckets: a best price that goes is replaced by the next one without a look at the rest of the catalog. Offers, owners and rollups change in one
commit, and a replayed batch changes nothing.

Of several rows of an offer in a batch the one seen last counts (ties: the larger product, then price). An offer without product is
in no rollup; a product that loses all active offers stays with counts of 0 and no prices. Null ids are left out."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bazaarlake.operators.rollup import ROLLUP_SQL, roll_up
from bazaarlake.sources.catalog import OFFERS_SQL, Catalog
from bazaarlake.sources.tables import shared_dir, stored
from bazaarlake.streaming.bucket_store import BucketStore, fields_of

OFFER = "offer_id string, product_id long, supplier_id long, site_id int, price_usd double, moq int, shipping double, is_active boolean, last_seen timestamp"
ROLLUP = "product_id long, offer_count long, site_count long, best_price_usd double, best_price_site_id int, max_price_usd double, best_landed_usd double, min_moq int, last_seen timestamp, is_active boolean"
PARTS = {"offers": (OFFER, ["product_id"]), "owners": ("offer_id string, product_id long", ["offer_id"]), "rollups": (ROLLUP, ["product_id"])}


class RollupStore(BucketStore):
    def __init__(self, spark: SparkSession, path: str, buckets: int = 16):
        super().__init__(spark, path, PARTS, buckets)

    def apply(self, changes: DataFrame, batch: int | None = None, query: str = "") -> bool:
        """Take in offers (OFFER) that are new or changed; False for a batch that was taken in before."""
        log = self.log()
        if (named := self.next_batch(log, query, batch)) is None:
            return False
        batch, folder = named
        others_first = ["last_seen", "product_id", "price_usd"]
        order = [*others_first, *(c for c in fields_of(OFFER) if c not in ("offer_id", *others_first))]  # each column once, as they decide
        fresh = changes.filter("offer_id IS NOT NULL").groupBy("offer_id").agg(F.max(F.struct(*order)).alias("o")).select("offer_id", "o.*").select(*fields_of(OFFER))
        fresh = stored(fresh, "rollup-changes")
        known, other_owners = self.touched("owners", fresh, log)
        affected = stored(fresh.select("product_id").unionByName(known.select("product_id")).filter("product_id IS NOT NULL").distinct(), "rollup-affected")
        # an offer that changes has its old product among the affected, so it is in the buckets that they touch
        kept = self.present("offers", affected, log).join(fresh.select("offer_id"), "offer_id", "left_anti").select(*fields_of(OFFER))
        files = self.write("offers", kept.unionByName(fresh.filter("product_id IS NOT NULL")), folder, affected)
        now = self.rows("offers", [f for _, _, f in files]).filter("is_active").join(affected, "product_id", "left_semi")
        files += self.write("owners", other_owners.unionByName(fresh.select("offer_id", "product_id")), folder)
        rolled = affected.join(roll_up(now), "product_id", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("offer_count", "site_count")}).withColumn("is_active", F.col("offer_count") > 0)
        _, other_rollups = self.touched("rollups", affected, log)
        files += self.write("rollups", other_rollups.unionByName(rolled.select(*fields_of(ROLLUP))), folder)
        self.commit(log, query, batch, files)
        return True

    def deactivate(self, before, batch: int | None = None, query: str = "stale") -> bool:
        """End active offers last seen before a time."""
        stale = self.read("offers").filter(F.col("is_active") & (F.col("last_seen") < F.lit(before).cast("timestamp")))
        return self.apply(stale.withColumn("is_active", F.lit(False)), batch, query)

    def merge(self, merges: DataFrame, batch: int | None = None, query: str = "merges") -> bool:
        """Fold products into others: merges (source_id, target_id)."""
        moved, _ = self.touched("offers", merges.select(F.col("source_id").alias("product_id")), self.log())
        target = merges.select(F.col("source_id").alias("product_id"), "target_id")
        return self.apply(moved.join(target, "product_id").withColumn("product_id", F.col("target_id")).select(*fields_of(OFFER)), batch, query)


def maintained_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every product's rollup after its offers came at half price, all active, and then as they are: best prices go and come."""
    catalog = Catalog(spark, sf_dir)
    offers = catalog.offers().withColumn("offer_id", F.concat_ws("-", "product_id", "supplier_id"))
    offers = stored(offers.select(*(F.col(f.split()[0]).cast(f.split()[1]) for f in OFFER.split(", "))), "sample-offers")
    store = RollupStore(spark, f"{shared_dir(spark)}/rollups-{uuid.uuid4().hex}")
    store.apply(offers.withColumns({"price_usd": F.col("price_usd") / 2, "is_active": F.lit(True)}))
    store.apply(offers)
    return store.read("rollups")


QUERIES = {"maintained_rollup": maintained_rollup}
ORACLES = {
    "maintained_rollup": f"WITH {OFFERS_SQL}, {ROLLUP_SQL} SELECT p.product_id, coalesce(offer_count, 0) AS offer_count, coalesce(site_count, 0) AS site_count, best_price_usd, best_price_site_id, max_price_usd, best_landed_usd, min_moq, last_seen, coalesce(offer_count, 0) > 0 AS is_active FROM (SELECT DISTINCT product_id FROM offers) p LEFT JOIN rolled USING (product_id)",
}
