"""Mappings of saved answers, compiled to columns."""

import json

import pytest
from pyspark.sql import functions as F

from bazaarlake.sources import mappings, vendors


def read(spark, mapping, *answers):
    rows = spark.createDataFrame([(a if a is None or isinstance(a, str) else json.dumps(a),) for a in answers], "body string")
    return [r.asDict(recursive=True) for r in mappings.listings(rows, "body", mapping).collect()]


def test_placeholders():
    spec = {"path": "/x/{keyword}", "params": ["{page}", "{other}", {"k": "${KEY}${NONE}"}], "n": 3}
    got = mappings.expand(spec, {"keyword": "a b", "page": None}, {"KEY": "s"})
    assert got == {"path": "/x/a b", "params": ["", "{other}", {"k": "s"}], "n": 3}


@pytest.mark.parametrize("name", sorted(vendors.VENDORS))
def test_nothing_from_nothing(spark, name):
    assert read(spark, vendors.VENDORS[name](), None, "", "{", "[]", {}, {"products": [], "result": None, "status": 200, "data": {"data": [{}]}}) == []


def test_bestbuy(spark):
    item = {"sku": 12, "name": " Cordless\n drill ", "salePrice": 0, "regularPrice": 49.5, "onlineAvailability": True, "weight": "3.2", "depth": 1, "width": 2, "height": 3.5, "upc": "036000291452",
            "class": "Tools", "subclass": "Drills", "image": "//a/1.jpg", "largeImage": "//a/1.jpg", "shippingLevelsOfService": [{"serviceLevelId": 1}, {"unitShippingPrice": 0}]}
    (got,) = read(spark, vendors.bestbuy(), {"products": [item, {"sku": 13}]})
    assert (got["site_product_id"], got["title"], got["price_min"], got["moq"], got["in_stock"]) == ("12", "Cordless drill", 49.5, 1, True)
    assert got["url"] == "https://www.bestbuy.com/site/-/12.p" and got["image_urls"] == ["https://a/1.jpg"] and got["category_path"] == "Tools > Drills"
    assert [(s["name"], s["value"]) for s in got["specs"]] == [("Condition", "New"), ("Weight", "3.2 lb"), ("Package Dimensions", "1 x 2 x 3.5 in")]
    assert got["gtin"] and (got["shipping_cost"], got["shipping_currency"]) == (0.0, "USD")


def test_lcsc_ladder_and_rejected_answer(spark):
    item = {"productCode": "C1", "productModel": "NE555", "productIntroEn": "timer", "minBuyNumber": 1, "stockNumber": 0,
            "productPriceList": [{"ladder": 100, "usdPrice": 0.05}, {"ladder": 5, "usdPrice": 0.1}, {"ladder": "x"}]}
    ok, other = {"code": 200, "result": {"dataList": [], "productList": [item]}}, {"ok": False, "result": {"dataList": [item]}}
    (got,) = read(spark, vendors.lcsc(), ok, other, {"code": 500, "result": {"dataList": [item]}})
    assert got["title"] == "NE555 timer" and (got["moq"], got["price_min"], got["price_max"], got["in_stock"]) == (5, 0.05, 0.1, False)
    assert [tuple(t.values()) for t in got["tiers"]] == [(5, 99, 0.1), (100, None, 0.05)]


def test_octopart_least_price_over_sellers(spark):
    price = lambda q, p, c="USD": {"quantity": q, "price": p, "currency": c}
    sellers = [{"company": {"name": "A"}, "offers": [{"clickUrl": "u/a", "prices": [price(1, 2.0), price(10, 1.5)]}]},
               {"company": {"name": "B"}, "offers": [{"clickUrl": "u/b", "prices": [price(100, 1.5), price(1, 0.1, "EUR")]}]}]
    part = {"mpn": "X 1", "manufacturer": {"name": "Acme"}, "shortDescription": "cap", "sellers": sellers}
    got, bare = read(spark, vendors.octopart(), {"data": {"supSearchMpn": {"results": [{"part": part}, {"part": {"mpn": "Y 2"}}, {}]}}})
    assert (got["site_product_id"], got["price_min"], got["price_max"], got["seller_name"], got["url"], got["moq"]) == ("Acme:X 1", 1.5, 2.0, "A", "u/a", 10)
    assert [t["min_qty"] for t in got["tiers"]] == [1, 10, 100]
    assert (bare["site_product_id"], bare["url"], bare["price_min"], bare["tiers"]) == ("Y 2", "https://octopart.com/search?q=Y+2", None, [])


def test_temu_cents_counts_and_variants(spark):
    goods = {"goodsId": 7, "title": "Lamp", "seoLinkUrl": "/lamp.html?x=1", "priceInfo": {"price": 1299}, "comment": {"commentNumTips": "5k+"}, "salesNum": "120"}
    (got,) = read(spark, vendors.temu(), {"store": {"goodsList": [{"data": goods}, {"data": {"goodsId": 8, "title": "no link"}}]}})
    assert (got["url"], got["price_min"], got["review_count"], got["orders_count"]) == ("https://www.temu.com/lamp.html", 12.99, None, 120)
    store = {"goods": {"goodsId": 7, "goodsName": "Lamp", "minOnSalePrice": 100, "maxOnSalePrice": 250, "gallery": [{"url": "a"}, {"url": "a"}], "goodsProperty": [{"key": "Power", "values": ["5 W", "6 W"]}, {"key": "Empty"}]},
             "productDetail": {"floorList": [{"items": [{"text": "one"}]}, {"items": [{"url": "x"}, {"text": "two"}]}]},
             "sku": [{"skuId": 1, "salePrice": 100, "stockQuantity": 0, "specs": [{"specKey": "Color", "specValue": "Red"}]}, {"skuId": 2}, {}]}
    (got,) = read(spark, vendors.temu_detail(), {"store": store})
    assert (got["price_min"], got["price_max"], got["image_urls"], got["description"]) == (1.0, 2.5, ["a"], "one\ntwo")
    assert got["specs"] == [{"name": "Power", "value": "5 W, 6 W"}]
    assert [(v["sku"], v["name"], v["price"], v["in_stock"]) for v in got["variants"]] == [("1", "Color: Red", 1.0, False), ("2", "2", None, True)]


def test_small_sources(spark):
    (got,) = read(spark, vendors.ebay(), {"itemSummaries": [{"itemId": "v1|99|0", "title": "t", "price": {"value": "3.50"}, "seller": {"feedbackPercentage": "99.1"}, "categories": [{"categoryName": "A"}, {"categoryName": "B"}],
                                                              "shippingOptions": [{}, {"shippingCost": {"value": "4", "currency": "EUR"}}], "condition": "Used"}]})
    assert (got["site_product_id"], got["price_min"], got["rating"], got["category_path"], got["shipping_cost"], got["shipping_currency"]) == ("99", 3.5, 99.1, "A > B", 4.0, "EUR")
    (got,) = read(spark, vendors.greetbuy(), {"status": 200, "data": {"data": [{"offerId": 5, "subject": "s", "promotionURL": "u?x=1", "priceInfo": {"price": "0"}}]}}, {"status": 500, "data": {"data": [{"offerId": 6, "subject": "s", "promotionURL": "u"}]}})
    assert (got["site_product_id"], got["url"], got["price_min"], got["currency"]) == ("5", "u", None, "CNY")
    (got,) = read(spark, vendors.liuhuamall(), {"status": True, "info": {"list": [{"goodsId": 3, "goodsName": "g", "price": "1.5", "moq": 12}]}})
    assert (got["url"], got["price_min"], got["moq"]) == ("https://www.liuhuamall.com/goods/3", 1.5, 12)
    (got,) = read(spark, vendors.buckydrop(), {"success": True, "data": {"records": [{"spuCode": "S", "spuName": "n", "thirdGoodUrl": "u", "thirdParty": "tb", "thirdGoodCode": 9}, {"spuCode": "T", "spuName": "n"}]}})
    assert (got["site_product_id"], got["origin"]) == ("S", "tb:9")
    (got,) = read(spark, vendors.taobao(), {"mods": {"itemlist": {"data": {"auctions": [{"nid": "1", "raw_title": "<b>red</b> shoe", "view_price": "12.00", "view_sales": "30 paid", "pic_url": "//p"}]}}}})
    assert (got["title"], got["price_min"], got["orders_count"], got["image_urls"]) == ("red shoe", 12.0, 30, ["https://p"])


def test_preset_with_tiers_specs_and_variants(spark):
    preset = {"items_path": ["Result.Items"], "item": {
        "id": ["Id"], "title": ["Title", "Name"], "url": "Link", "price": ["Price"], "images": ["Pictures[].Url", "Main"],
        "specs": {"list": ["Attributes"], "key": ["N"], "value": ["V"]}, "tiers": {"list": ["Ranges"], "min_qty": "Min", "price": "P"},
        "variants": {"list": ["skus"], "sku": ["id"], "price": ["p"], "stock": ["n"], "value_ref": ["refs"], "properties_list": ["props"]},
    }}
    item = {"Id": 1, "Title": "", "Name": "n", "Price": 0, "Link": "x", "Pictures": [{"Url": "a"}, {"Url": "b"}], "Attributes": [{"N": "k", "V": "v"}, {"N": "k"}],
            "skus": [{"id": "s1", "p": 4, "n": 2, "refs": ["1:10", "2:20", "2:21"]}, {"id": "s2", "p": 6, "n": 0, "refs": ["9:99"]}],
            "props": [{"propName": "color", "propNameEn": "Color", "valuesList": [{"valueId": 10, "valueName": "Red"}]}, {"propName": "Size", "valuesList": [{"valueId": 20, "valueName": "M"}, {"valueId": 21, "valueName": "L"}]}]}
    tiered = {"Id": 2, "Title": "t", "Price": 9, "Ranges": [{"Min": 20, "P": "1.5"}, {"Min": 5, "P": 2}, {"P": 1}]}
    mapping = mappings.compiled("1688", preset, url="https://h/{id}.html", trust_answer_url=False)
    one, two = sorted(read(spark, mapping, {"Result": {"Items": [item, tiered]}}), key=lambda r: r["site_product_id"])
    assert (one["title"], one["url"], one["currency"], one["price_min"], one["price_max"], one["image_urls"]) == ("n", "https://h/1.html", "CNY", 4.0, 6.0, ["a", "b"])
    assert one["specs"] == [{"name": "k", "value": "v"}]
    assert [(v["name"], v["in_stock"]) for v in one["variants"]] == [("Color: Red, Size: L", True), ("s2", False)]
    assert (two["moq"], two["price_min"], two["price_max"], two["image_urls"]) == (5, 1.5, 2.0, [])
    assert read(spark, mappings.compiled("1688", preset), {"Result": {"Items": item}})[0]["url"] == "x"


def test_documents_are_read_once_a_field(spark):
    """A field's path is looked up once, whatever conditions its value goes through; odd values stay what they were."""
    rows = spark.createDataFrame([(1, '{"a": " x  y ", "n": "1,5", "z": 0, "l": [{"q": 1}, null, 2]}'), (2, '{"a": "", "n": "none", "z": "0.0", "l": {"q": 3}}'), (3, '{"a": [], "n": "2e1", "z": -0.0, "l": "\\"v"}'), (4, "{"), (5, None)], "id int, doc string")
    doc = F.col("doc")
    fields = {"a": mappings.text("a")(doc), "n": mappings.number("n", positive=True)(doc), "z": mappings.number("z", positive=True)(doc), "l": mappings.elements(doc, ["l"])}
    for column in fields.values():
        assert rows.select(column.alias("c"))._jdf.queryExecution().analyzed().toString().count("get_json_object(") == 1
    got = [tuple(r) for r in rows.select("id", *(c.alias(n) for n, c in fields.items())).orderBy("id").collect()]
    assert got == [(1, "x y", 1.5, None, ['{"q":1}', "2"]), (2, None, None, None, ['{"q":3}']), (3, None, 20.0, None, ["v"]), (4, None, None, None, []), (5, None, None, None, [])]
