"""Rules of ingest, demand, watches, media, duty and search on small cases."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from bazaarlake.functions import similarity, text, units
from bazaarlake.operators import curation, demand, duty, ingest, media, ordering, search
from bazaarlake.sources import catalog


def one(spark, *columns):
    return spark.range(1).select(*columns).first()[:]


def rows(df, *cols):
    return Counter(tuple(r) for r in df.select(*cols).collect())


@pytest.mark.parametrize("pasted, want", [("esp32 devkit x10", ("esp32 devkit", 10)), ("10 x esp32 devkit", ("esp32 devkit", 10)), ("esp32 devkit, 10", ("esp32 devkit", 10)), ("- esp32 devkit", ("esp32 devkit", 1)), ("0 x part", ("part", 1))])
def test_bom_lines(pasted, want):
    assert duty.parse_bom(pasted) == [want] and duty.parse_bom("# none\n\n  \n") == [] == duty.parse_bom(None)


def test_tariff_texts_and_duty(spark):
    lit = lambda x: F.lit(x).cast("string")
    assert one(spark, *(duty.tariff_rate(lit(t)) for t in ("Free", "5.3%", "", "2.5c/kg + 3%", None))) == (0.0, 0.053, None, None, None)
    due = lambda goods, **k: duty.duty(F.lit(goods).cast("double"), F.lit(0.1), **k)
    assert one(spark, due(100.0), due(None), due(100.0, enabled=False), due(100.0, de_minimis=800.0)) == ((0.1, 10.0), None, None, (0.0, 0.0))
    assert one(spark, duty.staleness_days(F.lit("2024-01-01"), F.to_date(F.lit("2024-01-31"))), duty.staleness_days(F.lit("soon"), F.to_date(F.lit("2024-01-31")))) == (30, None)


def test_weights_sizes_and_numbers(spark):
    w = lambda t: units.weight_kg(F.lit(t))
    assert [None if x is None else round(x, 5) for x in one(spark, w("5 lbs"), w("500 grams"), w("2 kgs"), w("3 ounces"), w("blue"))] == [2.26796, 0.5, 2.0, 0.08505, None]
    specs = F.create_map(F.lit("Net Weight"), F.lit("250 g"), F.lit("Package Size"), F.lit("200x150x50 mm"))
    assert one(spark, units.spec_weight(specs), units.spec_dims(specs)) == (0.25, [20.0, 15.0, 5.0])
    assert one(spark, units.number_of(F.lit("1,234.56")), units.number_of(F.lit("1.2万")), units.human_bytes(F.lit(1536)), units.rounded(F.lit(10.075))) == (1.234, 1.2, "1.5 KB", 10.07)
    assert one(spark, similarity.confidence(F.lit(2)), similarity.confidence(F.lit(10)), similarity.nearness(F.lit(19))) == ("identical image", "same photo", 0.0)


def test_text_rules(spark):
    t = spark.createDataFrame([("Ｗｉｄｇｅｔ　UPC 012345678905 blue", "Model Number:"), (None, "Battery Capacity"), ("no code 12345678", " Colour ")], "t string, k string")
    got = t.select(text.find_gtin(F.col("t")), text.spec_key(F.col("k")), text.clean(F.col("t")), text.keyword(F.col("k"))).collect()
    assert [r[0] for r in got] == ["00012345678905", None, None] and [r[1] for r in got] == ["model", "battery", "color"]
    assert got[0][2] == "Widget UPC 012345678905 blue" and got[1][2] == "" and got[2][3] == "colour"


def test_search_concepts():
    assert search.concepts_of("wireless earbuds")[0] == ["bluetooth", "bt", "wireless"]
    assert search.concepts_of("Power Bank") == [sorted(["battery pack", "portable charger", "power bank", "powerbank"])]
    assert search.concepts_of("蓝牙 耳机") == [["蓝"], ["牙"], ["耳"], ["机"]] and search.concepts_of('"*') == []
    assert search.expand("unknown, word") == [["unknown"], ["word"]]


def test_watch_steps(spark):
    schema = "watch_id int, price double, site string, in_stock boolean, sites array<int>, on_new_site boolean, on_restock boolean, target double, last_price double, last_in_stock boolean, known_sites array<int>, baseline double"
    now = [
        (1, 12.0, "a", True, [1], False, False, 15.0, 20.0, None, None, None), (2, 12.0, "a", True, [1], False, False, 15.0, 12.0, None, None, 9.0), (3, 11.0, "a", True, [1], False, False, 15.0, 25.0, None, None, None),
        (4, 9.0, "a", True, [1, 2], True, True, 15.0, 20.0, False, [1], None), (5, 9.0, "a", True, [1, 2], True, False, None, 20.0, None, None, None), (6, 9.0, "a", True, [1], False, True, None, 9.0, False, None, None),
        (7, 9.0, "a", True, [1], False, True, None, 9.0, None, None, None), (8, None, None, True, [1, 2], True, True, 15.0, 20.0, False, [1], None),
    ]
    out = {r["watch_id"]: r for r in demand.watch_step(spark.createDataFrame(now, schema)).collect()}
    assert [out[k]["fired"] for k in range(1, 9)] == ["price", None, "price", "new_site", None, "restock", None, None]
    assert out[4]["new_sites"] == [2] and out[4]["last_in_stock"] is False and out[5]["known_sites"] == [1, 2] and out[8]["last_price"] == 20.0 and out[8]["known_sites"] == [1] and out[1]["drop"] == 8.0 and out[2]["baseline"] == 9.0
    said = lambda kind, target, new: demand.alert_text(F.lit("Thing"), F.lit(kind), F.lit(9.0), F.lit("a"), F.lit(target).cast("double"), F.array(*map(F.lit, new)))
    assert one(spark, said("price", 15.0, []), said("restock", None, []), said("new_site", None, ["b", "c"])) == ("Thing is $9.00 on a (target $15.00)", "Thing is back in stock, $9.00 on a", "Thing is now available on b, c as well -- best price $9.00 on a")


def test_outcomes_in_order(spark):
    def asked(keyword="abc", results=0, inflight=False, queued=0, ago=None, started=0, client="c", **policy):
        return demand.outcome(F.lit(keyword), F.lit(results), F.lit(inflight), F.lit(queued), F.lit(ago).cast("double"), F.lit(started), F.lit(client).cast("string"), demand.Policy.of(policy))

    got = one(spark, asked(enabled=False), asked("ab"), asked(results=5), asked(inflight=True), asked(queued=20), asked(ago=3.0), asked(started=6), asked(started=6, client=None), asked(ago=25.0, max_queue=None))
    assert got == ("off", "too_short", "have_results", "pending", "busy", "cooldown", "throttled", "queued", "queued")
    assert demand.overlaid({"a": 1, "b": {"c": 2, "d": 3}}, {"b": {"d": 4}, "e": 5}) == {"a": 1, "b": {"c": 2, "d": 4}, "e": 5}


def test_failed_crawls_stamp_the_ledger(spark):
    asked = spark.createDataFrame([("k", "K", 1, "queued"), ("k", "k", 2, "queued"), ("n", "N", 1, "queued")], "keyword string, display string, ts int, status string")
    done = spark.createDataFrame([("k", 3, 0, "blocked")], "keyword string, ts int, found int, error string")
    assert rows(demand.ledger(asked, done), "keyword", "display", "requests", "last_crawled", "last_error", "status") == Counter([("k", "K", 2, 3, "blocked", "failed"), ("n", "N", 1, None, None, "queued")])


def test_brands_part_numbers_and_addresses(spark):
    words = F.array(F.lit("dhgate"), F.lit("shop"))
    brand, mpn = (lambda b: ingest.plausible_brand(F.lit(b), words)), (lambda m: ingest.plausible_mpn(F.lit(m), F.lit("77-A")))
    assert one(spark, brand("DH gate"), brand("OEM"), brand("Acme "), brand("x"), mpn("104"), mpn("77-A"), mpn("ZX-9"), mpn("zz")) == (None, None, "Acme", None, None, None, "ZX-9", None)
    url = lambda h: ingest.absolute_url(F.lit("https://a.b/c/d"), F.lit(h))
    assert one(spark, url("//x/y"), url("/p"), url("q"), url("http://z"), url("")) == ("https://x/y", "https://a.b/p", "https://a.b/q", "http://z", None)
    pic = lambda u: media.full_size_url(F.lit(u))
    assert one(spark, pic("//i.alicdn.com/a_220x220.jpg_.webp?x=1"), pic("//i.alicdn.com/a_50x50.jpg_.webp"), pic("http://o/a.jpg?w=1"), pic("data:1")) == ("https://i.alicdn.com/a.jpg_.webp", "https://i.alicdn.com/a.jpg", "http://o/a.jpg?w=1", None)


def test_listing_rules(spark):
    raw = spark.createDataFrame([("s", "1", "u", "t", 0.0, 5.0, None, "", "cny", None, None, True, None, None, None, None), ("s", None, "u", " ", 4.0, 3.0, 5, "set", None, 7.15, "CNY", False, "012345678905", "b" * 200, None, None)], "site_key string, listing_id string, url string, title string, price_min double, price_max double, moq int, moq_unit string, currency string, shipping_cost double, shipping_currency string, shipping_free boolean, gtin string, brand string, mpn string, model string")
    good, bad = ingest.checked(raw)
    assert good.count() == 1 and bad.first()["reason"] == "no listing_id, no title"
    got = [r[:] for r in ingest.normalised(raw).select("price_min", "price_max", "moq", "moq_unit", "currency", "shipping_usd", "gtin", F.length("brand")).collect()]
    assert got == [(None, 5.0, 1, "piece", "CNY", 0.0, None, None), (4.0, None, 5, "set", "USD", 1.0, "00012345678905", 120)]


def test_identifiers_from_attributes(spark):
    listings = spark.createDataFrame([("Thing 012345678905", None, None, None, None, {"brand": "Acme", "model": "Z1"}), ("x", "Own", "M", None, None, {"brand": "Acme", "model": "Z1", "ean": "012345678905"})], "title string, brand string, model string, mpn string, gtin string, specs map<string,string>")
    assert rows(ingest.harvested(listings), "brand", "model", "mpn", "gtin") == Counter([("Acme", "Z1", "Z1", "00012345678905"), ("Own", "M", None, "00012345678905")])


def test_children_and_history(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "listing_id int, v string")
    assert rows(ingest.replaced(old, spark.createDataFrame([(2, "c"), (2, "d")], "listing_id int, v string")), "listing_id", "v") == Counter([(1, "a"), (2, "c"), (2, "d")])
    specs = spark.createDataFrame([(1, "Colour", "Red", 1), (1, "color", "Blue", 2), (1, " ", "x", 3), (1, "Model No", " ", 4)], "listing_id int, key string, value string, position int")
    assert ingest.spec_map(ingest.spec_rows(specs)).first()["specs"] == {"color": "red"}
    variants = spark.createDataFrame([(1, None, "L", 1), (1, "L", "other", 2), (1, "", None, 3)], "listing_id int, sku string, name string, position int")
    assert rows(ingest.variant_rows(variants), "sku", "position") == Counter([("L", 1)])
    price = "listing_id int, price_usd double, landed_usd double"
    before, after = spark.createDataFrame([(1, 5.0, 9.0), (2, 5.0, 9.0), (3, None, None)], price), spark.createDataFrame([(1, 5.0, 9.0), (2, 5.0, 8.0), (3, None, None), (4, None, None)], price)
    assert rows(ingest.appended_history(before, after, F.lit(1)), "listing_id") == Counter([(2,), (4,)])


def test_sticky_category_paths(spark):
    listings = spark.createDataFrame([(1, 1, "Tools > X", "anvil"), (2, 1, "Tools > X", "bolt"), (3, 2, "Tools > X", "bolt"), (4, 1, None, "plate")], "id int, site_id int, raw_path string, title string")
    known = spark.createDataFrame([(2, "Tools > X", "kept", 1.0)], "site_id int, raw_path string, category string, confidence double")
    found, table = ingest.categorised(listings, known, search.CATEGORIES, search.HINTS)
    assert dict(map(tuple, found.select("id", "category").collect())) == {1: "tools", 2: "tools", 3: "kept", 4: "kitchen"} and table.count() == 2


def test_runs_and_images(spark):
    ledger = spark.createDataFrame([(1, "s", None, None, 0, None), (2, "s", None, None, 0, None)], "run_id int, site string, finished_at int, ok boolean, seen int, error string")
    ends = spark.createDataFrame([(2, 9, False, 4, "e" * 5000)], "run_id int, finished_at int, ok boolean, seen int, error string")
    assert rows(ingest.finished_runs(ledger, ends), "run_id", "ok", "seen", F.length("error")) == Counter([(1, None, 0, None), (2, False, 4, 4000)]) and ingest.crawl_totals(ledger).first()["seen"] == 0
    urls = spark.createDataFrame([(1, ["//a/1.jpg_50x50", "//a/1.jpg", "bad", "//a/2.jpg"] + [f"//a/{k}" for k in range(9)])], "owner_id int, image_urls array<string>")
    there = spark.createDataFrame([("https://a/2.jpg",), *((f"https://a/{k}",) for k in range(9))], "url string")
    assert rows(media.image_list(urls, there), "url", "position") == Counter([("https://a/2.jpg", 0), *((f"https://a/{k}", k + 1) for k in range(7))])
    owned = media.image_owner(spark.createDataFrame([(1, 5, 7), (2, None, 7), (3, None, None)], "image_id int, direct_id int, offer_id int"), spark.createDataFrame([(7, 6)], "id int, product_id int"))
    assert rows(owned, "image_id", "product_id") == Counter([(1, 5), (2, 6), (3, None)])


def test_unique_slugs(spark):
    base = [(1, "a"), (2, "a"), (3, "a"), (4, "a-2"), (5, "a-3"), (6, "a-9")]
    got = dict(map(tuple, curation.unique_slugs(spark.createDataFrame(base, "product_id int, base string")).collect()))
    assert len(set(got.values())) == 6 and got[1] == "a" and got[2] == "a-4" and got[4] == "a-2"


def test_snapshots_seeds_and_totals(spark, tmp_path):
    table, shots = spark.createDataFrame([(1, "a")], "id int, v string"), catalog.Snapshots(spark, str(tmp_path / "shots"))
    assert [shots.take({"t": table}, f"2024-01-0{k}", 2) for k in (1, 2, 3)] == [[], [], ["2024-01-01"]] and shots.names() == ["2024-01-02", "2024-01-03"]
    assert shots.read("2024-01-03", "t").count() == 1
    with pytest.raises(ValueError):
        shots.read("2024-01-01", "t")
    seeds = spark.createDataFrame([("x", "new name", True), ("y", "y", True)], "key string, name string, enabled boolean")
    now = spark.createDataFrame([("x", "old name", False), ("z", "own", True)], "key string, name string, enabled boolean")
    assert rows(catalog.seeded(now, seeds, "key", ["name"]), "key", "name", "enabled") == Counter([("x", "new name", False), ("y", "y", True), ("z", "own", True)])


def test_forwarder_addresses(spark):
    given = [("https://detail.1688.com/offer/77.html?a=1&b=~*", "1688"), ("https://item.taobao.com/item.htm?id=88", "taobao"), ("https://detail.tmall.com/123456789.htm", "tmall"), ("https://detail.tmall.com/shop", "tmall"), (None, None)]
    offers = spark.createDataFrame(given, "url string, site_key string")
    links = {(r.url, r.agent): r.link for r in ordering.forwarder_addresses(offers, {"cssbuy": "a b", "wegobuy": ""}).collect()}
    a, b, c, d = (g[0] for g in given[:4])
    assert len(links) == 5 * len(ordering.FORWARDERS)
    assert [links[u, "cssbuy"] for u in (a, b, c, d)] == [
        "https://www.cssbuy.com/item-micro-77?promotionCode=a+b", "https://www.cssbuy.com/item-88?promotionCode=a+b", "https://www.cssbuy.com/item-tmall-123456789?promotionCode=a+b",
        "https://www.cssbuy.com/?url=https%3A%2F%2Fdetail.tmall.com%2Fshop",
    ]
    assert links[a, "wegobuy"] == "https://www.wegobuy.com/en/page/buy/?from=search-input&url=https%3A%2F%2Fdetail.1688.com%2Foffer%2F77.html%3Fa%3D1%26b%3D~%2A"
    assert links[d, "cnfans"] == "https://cnfans.com/product?id=&platform=TAOBAO&productUrl=https%3A%2F%2Fdetail.tmall.com%2Fshop&productPwd="
    assert links[b, "sugargoo"].startswith("https://www.sugargoo.com/index/item/index.html?tp=taobao&searchlink=https")
    assert links[None, "superbuy"] is None
