"""Cards of result pages and the structured data of product pages."""

import json

from pyspark.sql import functions as F

from bazaarlake.sources import mappings, pages, vendors


def test_picture_prefers_late_loading_attributes():
    assert pages.picture({"src": "wait.gif", "data-original": "a.jpg"}) == "a.jpg"
    assert pages.picture({"src": "data:image/gif;base64,x", "srcset": "b.jpg 1x, c.jpg 2x"}) == "b.jpg"
    assert pages.picture({"data-src": None}) is None


def test_cards(spark):
    card = lambda i, price: f'<div class="J-offer-wrapper x"><img src="data:x" data-src="//i/{i}.jpg"><a href="//h/p_{i}.html">Steel bolt {i}</a><b>{price}</b> Min. order: 50 pieces</div>'
    page = card(1234567, "US$1.20 - 2.50") + card(1234568, "Negotiable") + '<div class="J-offer-wrapper"><a href="/about.html">About</a></div>'
    rows = spark.createDataFrame([(page,), (None,), ("",)], "html string")
    one, two = (r.asDict() for r in pages.card_listings(rows, "html", "alibaba").orderBy("site_product_id").collect())
    assert (one["site_product_id"], one["title"], one["url"], one["image_url"]) == ("1234567", "Steel bolt 1234567", "https://h/p_1234567.html", "https://i/1234567.jpg")
    assert (one["price_min"], one["price_max"], one["moq"], one["currency"]) == (1.2, 2.5, 50, "USD")
    assert (two["price_min"], two["fees_note"]) == (None, "price negotiable")


def test_saved_pages_replay(spark, tmp_path):
    (tmp_path / "a.html").write_text('<li class="s-card">\n<a href="/itm/1234567">Old radio</a>\n$5</li>')
    (tmp_path / "b.html").write_text("")
    found = pages.saved_pages(spark, str(tmp_path))
    (got,) = pages.card_listings(found, "html", "ebay").collect()
    assert found.columns == ["file", "html"] and (got["site_product_id"], got["url"], got["price_min"]) == ("1234567", "https://www.ebay.com/itm/1234567", 5.0)


def test_structured_data_fills_what_is_missing(spark):
    product = {"@graph": [{"@type": "WebPage"}, {"@type": ["Thing", "Product"], "brand": {"name": "Acme"}, "sku": "AB-12", "model": "M 100", "gtin13": "4006381333931", "description": " A  lamp ",
               "image": ["//i/1.jpg", {"url": "https://i/2.jpg"}, "rel.jpg"], "additionalProperty": [{"name": "Power", "value": 5}, {"name": "Empty"}],
               "offers": [{"price": "12.50", "priceCurrency": "EUR", "highPrice": 20, "availability": "https://schema.org/OutOfStock"}], "aggregateRating": {"ratingValue": "4.5", "ratingCount": "7"}}]}
    page = f'<script type="application/ld+json">{json.dumps(product)}</script>'
    empty = {n: F.array().cast(k) if k.startswith("array") else F.lit(None).cast(k) for n, k in mappings.LISTING.items()}
    rows = spark.createDataFrame([("1", page), ("2", page), ("3", "<p>none</p>"), ("4", None)], "id string, html string")
    rows = rows.withColumns(empty | {"site": F.lit("shop"), "site_product_id": F.col("id"), "currency": F.lit("USD"), "price_min": F.when(F.col("id") == "2", 9.0), "brand": F.when(F.col("id") == "2", "Own")})
    got = {r["id"]: r.asDict(recursive=True) for r in pages.enriched(rows, "html").collect()}
    one, two = got["1"], got["2"]
    assert (one["brand"], one["mpn"], one["model"], one["description"], one["price_min"], one["price_max"], one["currency"]) == ("Acme", "AB-12", "M 100", "A lamp", 12.5, 20.0, "EUR")
    assert one["gtin"] and one["image_urls"] == ["https://i/1.jpg", "https://i/2.jpg"] and one["specs"] == [{"name": "Power", "value": "5"}]
    assert (one["in_stock"], one["rating"], one["review_count"]) == (False, 4.5, 7)
    assert (two["brand"], two["price_min"], two["price_max"], two["currency"]) == ("Own", 9.0, 20.0, "USD")
    assert all(got[k][c] in (None, []) for k in "34" for c in ("brand", "price_min", "image_urls", "specs", "rating"))


def test_pictures_from_the_script(spark):
    listed = json.dumps([{"itemcode": 1234567, "bigimagepath": "//i/[1].jpg"}, {"itemcode": 1234567, "bigimagepath": "//i/2.jpg"}, {"itemcode": 7}, None])
    page = f'<script>x = {{"totalProducts": {listed}}}</script><div class="listitem"><a href="/p/1234567.html">Old radio</a><img class="LazyLoad">US$3.50</div>'
    (got,) = pages.card_listings(spark.createDataFrame([(page,), (page.replace("listitem", "other"),), (None,)], "html string"), "html", "dhgate").collect()
    assert (got.site_product_id, got.image_url, got.price_min) == ("1234567", "https://i/[1].jpg", 3.5)


def test_listings_from_a_page_state(spark):
    one = {"productId": "11", "title": {"displayTitle": " Steel  bolt "}, "prices": {"salePrice": {"minPrice": 2.5, "currencyCode": "EUR"}, "originalPrice": {"minPrice": 4}}, "trade": {"tradeDesc": "1,200+ sold"},
           "sellingPoints": [{"tagContent": {"tagText": "Free shipping"}}, {}], "image": {"imgUrl": "//i/1.jpg"}, "images": ["//i/1.jpg", "//i/2.jpg"]}
    two = {"productId": "12", "productTitle": "Nut", "prices": {"salePrice": {"formattedPrice": "US $4.79"}}}
    state = {"a": {"noise": [{"x": 1}]}, "mods": {"itemList": {"content": [one, two, {"productId": "x", "subject": "no id"}]}}}
    page = f"<script>window.runParams = {json.dumps(state)};</script>"
    rows = pages.scripted_listings(spark.createDataFrame([(page,), ("",), (None,)], "html string"), "html", vendors.aliexpress())
    assert rows.columns == list(mappings.LISTING)
    a, b = rows.orderBy("site_product_id").collect()
    assert (a.title, a.price_min, a.price_max, a.currency, a.orders_count, a.shipping_cost, a.image_urls) == ("Steel bolt", 2.5, 4.0, "EUR", 1200, 0.0, ["https://i/1.jpg", "https://i/2.jpg"])
    assert (b.site_product_id, b.price_min, b.currency, b.shipping_cost, b.url) == ("12", 4.79, "USD", None, "https://www.aliexpress.com/item/12.html")


def test_sitemap_listings(spark):
    locs = ["https://s/wholesale/phone-parts/led/red-led-lamp-cvx-k12345", "https://s/wholesale/plain-lamp", "https://s/about/lamp", "https://s/wholesale/x/"]
    maps = spark.createDataFrame([("<urlset>" + "".join(f"<url><loc>{u}</loc></url>" for u in locs),), (None,), ("",)], "xml string")
    rows = {r.url: r for r in pages.sitemap_listings(maps, "xml").collect()}
    a, b = rows[locs[0]], rows[locs[1]]
    assert len(rows) == 2 and (a.site_product_id, a.mpn, a.title, a.category_path, a.moq) == ("cvx-k12345", "CVX-K12345", "Red Led Lamp", "Phone Parts > Led", 1)
    assert (b.site_product_id, b.title, b.category_path, b.image_urls) == ("plain-lamp", "Plain Lamp", None, [])
    count = lambda k: pages.sitemap_listings(maps, "xml", k).count()
    assert (count("LED lamp"), count("lamp"), count("a"), count("fan")) == (1, 2, 0, 0)
