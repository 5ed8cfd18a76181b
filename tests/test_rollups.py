"""Maintained rollups against the full rollup through random changes; ingest in batches against one batch."""

import datetime as dt
import random
from collections import Counter

from pyspark.sql import functions as F

from bazaarlake.operators.rollup import roll_up
from bazaarlake.sources.catalog import Catalog
from bazaarlake.streaming import catalog_store, rollups, upsert


def day(n):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=n)


def full(spark, offers, products):
    rolled = roll_up(spark.createDataFrame(list(offers.values()), rollups.OFFER).filter("is_active AND product_id IS NOT NULL")).withColumn("is_active", F.lit(True))
    got = {r.product_id: tuple(r) for r in rolled.collect()}
    return {p: got.get(p, (p, 0, 0, *[None] * 6, False)) for p in products}


def test_rollups_equal_the_full_rollup_after_changes(spark, tmp_path):
    rng, store, offers, products = random.Random(3), rollups.RollupStore(spark, str(tmp_path / "s"), 4), {}, set()
    for step in range(4):
        changed = {}
        for _ in range(40):
            k = f"o{rng.randrange(60)}"
            changed[k] = (k, rng.choice([None, *range(20)]), rng.randrange(5), rng.randrange(3), rng.choice([None, 0.0, 5.0, 7.5, 9.0]), rng.choice([None, 1, 10]), rng.choice([None, 2.0]), rng.random() < 0.8, day(step))
        offers |= changed
        products |= {o[1] for o in changed.values() if o[1] is not None}
        batch = spark.createDataFrame([*changed.values(), (None, 1, 1, 1, 1.0, 1, 1.0, True, day(9))], rollups.OFFER)
        assert store.apply(batch, step, "q") and not store.apply(batch, step, "q")
    store.merge(spark.createDataFrame([(1, 2), (3, 2)], "source_id long, target_id long"))
    offers = {k: (o[0], 2 if o[1] in (1, 3) else o[1], *o[2:]) for k, o in offers.items()}
    products |= {2}
    store.deactivate(day(2))
    offers = {k: (*o[:7], o[7] and not (o[1] is not None and o[8] < day(2)), o[8]) for k, o in offers.items()}
    got = {r.product_id: tuple(r) for r in store.read("rollups").collect()}
    assert got == full(spark, offers, products)
    assert Counter(tuple(r) for r in store.read("offers").collect()) == Counter(o for o in offers.values() if o[1] is not None)


def test_a_change_rewrites_its_own_buckets_only(spark, tmp_path):
    store = rollups.RollupStore(spark, str(tmp_path / "s"), 8)
    offer = lambda k, p, price: (f"o{k}", p, 1, 1, price, 1, None, True, day(0))
    store.apply(spark.createDataFrame([offer(k, k, 5.0) for k in range(64)], rollups.OFFER))
    before = store.folders(store.log(), "offers")
    store.apply(spark.createDataFrame([(*offer(7, 7, 9.0)[:8], day(1))], rollups.OFFER))
    after = store.folders(store.log(), "offers")
    assert sum(before[b] != after[b] for b in before) == 1 and {r.best_price_usd for r in store.read("rollups").filter("product_id = 7").collect()} == {9.0}


def rows(store, part, drop=()):
    return Counter(str(tuple(v for c, v in r.asDict().items() if c not in drop)) for r in store.read(part).collect())


def test_ingest_does_not_depend_on_batches(spark, sf_dir, tmp_path):
    """A replay, a new checkpoint, a second stream and late rows lose and double nothing; all parts equal one batch's."""
    raw = catalog_store.sample_raw(Catalog(spark, sf_dir)).filter("xxhash64(listing_id) % 5 = 0").cache()
    one = catalog_store.CatalogStore(spark, str(tmp_path / "one"), 4)
    one.ingest(raw)
    many = catalog_store.CatalogStore(spark, str(tmp_path / "many"), 4)
    halves = [raw.filter("seen_at < '1995-01-01'"), raw.filter("seen_at >= '1995-01-01'")]
    assert many.ingest(halves[0], 0, "a") and not many.ingest(halves[0], 0, "a")
    before = {p: rows(many, p) for p in catalog_store.PARTS}
    assert many.ingest(halves[0], 0, "new checkpoint")
    assert {p: rows(many, p) for p in catalog_store.PARTS} == before
    many.ingest(halves[1], 1, "a")
    many.ingest(raw, 0, "second stream")
    for part in (*catalog_store.PARTS, "tiers", "variants", "specs"):
        assert rows(many, part) == rows(one, part) and rows(one, part)
    assert one.read("quarantine").filter("reason <> 'no title'").count() == 0
    raw.unpersist()


def test_ingest_as_a_stream(spark, sf_dir, tmp_path):
    raw = catalog_store.sample_raw(Catalog(spark, sf_dir)).filter("xxhash64(listing_id) % 20 = 0")
    raw.filter("seen_at < '1995-01-01'").coalesce(1).write.parquet(str(tmp_path / "in" / "p=0"))
    raw.filter("seen_at >= '1995-01-01'").coalesce(1).write.parquet(str(tmp_path / "in" / "p=1"))
    store = catalog_store.CatalogStore(spark, str(tmp_path / "s"), 2)
    stream = spark.readStream.schema(raw.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "p=*"))
    stream.writeStream.foreachBatch(store.each_batch("raw")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(300)
    assert len(store.log()) == 2
    one = catalog_store.CatalogStore(spark, str(tmp_path / "one"), 2)
    one.ingest(raw)
    assert rows(store, "listings") == rows(one, "listings") and rows(store, "history") == rows(one, "history")


def test_upserts_of_two_streams_and_null_keys(spark, tmp_path):
    table = upsert.VersionedTable(spark, str(tmp_path / "t"), ["id"], ["at"], [])
    batch = lambda *r: spark.createDataFrame(list(r), "id int, at int, price double")
    table.write(batch((1, 1, 5.0), (None, 1, 1.0)), 0, "a")
    table.write(batch((2, 1, 6.0), (None, 2, 2.0)), 0, "b")
    table.write(batch((3, 1, 7.0)), 0, "a")  # a replay
    table.write(batch((None, 3, 3.0)), 1, "a")
    assert Counter(map(tuple, table.read().collect())) == Counter([(1, 1, 5.0), (2, 1, 6.0), (None, 3, 3.0)])


def test_a_batch_writes_its_offers_once(spark, tmp_path, monkeypatch):
    """The present offers go to their buckets only; the products' rollups are taken from there, not from a copy between."""
    copies = []
    stored = rollups.stored
    monkeypatch.setattr(rollups, "stored", lambda df, name: copies.append(name) or stored(df, name))
    store = rollups.RollupStore(spark, str(tmp_path / "s"), 4)
    offer = lambda k, p, price, n=0: (f"o{k}", p, 1, 1, price, 1, None, True, day(n))
    store.apply(spark.createDataFrame([offer(k, k % 5, 5.0 + k) for k in range(20)], rollups.OFFER))
    store.apply(spark.createDataFrame([offer(0, 7, 1.0, 1), offer(1, None, 1.0, 1), offer(2, 2, 3.0, 1), offer(2, 2, 9.0)], rollups.OFFER))
    assert sorted(copies) == sorted(2 * ["rollup-changes", "rollup-affected"])
    assert sorted((r.offer_id, r.product_id) for r in store.read("offers").collect()) == sorted([("o0", 7), *((f"o{k}", k % 5) for k in range(2, 20))])
    assert {r.product_id: (r.offer_count, r.best_price_usd) for r in store.read("rollups").collect()} == {0: (3, 10.0), 1: (3, 11.0), 2: (4, 3.0), 3: (4, 8.0), 4: (4, 9.0), 7: (1, 1.0)}


def test_rows_meet_once_and_children_are_cleaned_in_place(spark, tmp_path, monkeypatch):
    """A batch makes one copy of the raw rows and one of suppliers; names in other forms agree, the first by position counts, old children stay."""
    copies = []
    stored = catalog_store.stored
    monkeypatch.setattr(catalog_store, "stored", lambda df, name: copies.append(name) or stored(df, name))
    store = catalog_store.CatalogStore(spark, str(tmp_path / "s"), 2)
    spec = lambda key, value, position: {"key": key, "value": value, "position": position}
    sku = lambda name, price, position: {"sku": "", "name": name, "price": price, "currency": "USD", "in_stock": True, "position": position}
    row = lambda n, **given: {"site_key": "s", "listing_id": "a", "url": "u", "title": "t", "seen_at": day(n), "price_min": 9.0, "seller_name": "Ａcme  Co", **given}
    raw = lambda *rows: spark.createDataFrame([{c: r.get(c) for c in spark.createDataFrame([], catalog_store.RAW).columns} for r in rows], catalog_store.RAW)
    full = row(1, brand="Ｂ", specs=[spec("Ｃolour:", "red", 2), spec("color", "blue", 1), spec(" ", "x", 0), None, spec("Weight", None, None)], variants=[sku("b", 4.0, 2), sku("b", 3.0, 1), sku(None, 1.0, 0), sku("a", 5.0, 3)])
    store.ingest(raw(full, row(0), {**row(1), "listing_id": "b", "seller_name": "acme co"}))
    (a,) = store.read("listings").filter("listing_id = 'a'").collect()
    assert (a.brand, a.versions, a.price_min, a.price_max) == ("B", 2, 3.0, 5.0)
    assert [(s.key, s.value, s.key_norm) for s in a.specs] == [("Weight", "", "weight"), ("color", "blue", "color")] and [(v.sku, v.price) for v in a.variants] == [("b", 3.0), ("a", 5.0)]
    store.ingest(raw(row(2, specs=[], price_min=8.0), row(1, title="late"), row(0), {**row(3), "title": ""}))
    (b,) = store.read("listings").filter("listing_id = 'a'").collect()
    assert (b.title, b.versions, b.specs, b.variants, b.first_seen, b.last_seen) == ("t", 3, a.specs, a.variants, day(0), day(2))
    assert [(s.name_norm, s.name.name, s.last_seen) for s in store.read("suppliers").collect()] == [("acme co", "Acme Co", day(2))]
    assert store.read("history").count() == 3 and store.read("quarantine").count() == 1 and copies == 2 * ["ingest-raw", "ingest-suppliers"]


def test_listings_of_files_without_marks_are_read(spark, tmp_path):
    """A store that was written before versions lay beside listings keeps its listings."""
    store = catalog_store.CatalogStore(spark, str(tmp_path / "s"), 1)
    spark.createDataFrame([("s", "a", "t")], "site_key string, listing_id string, title string").write.parquet(str(tmp_path / "s" / "former" / "bucket=0"))
    store.commit([], "", 0, [("listings", 0, "former/bucket=0")])
    assert [(r.listing_id, r.title) for r in store.read("listings").collect()] == [("a", "t")]
