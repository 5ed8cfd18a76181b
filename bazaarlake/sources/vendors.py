"""Mappings of saved answers of shops and distributors whose format is JSON, as data; `mappings.listings` applies them.

Sources that keep their JSON in a page's script are read with `readers.embedded_json_udf` first.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from bazaarlake.functions.parsing import parse_price_udf
from bazaarlake.functions.text import normalize_gtin
from bazaarlake.sources.mappings import Mapping, cents, constant, digits, each, elements, first, ladder, named, number, pairs, squeezed, templated, text, untagged, urls, variants, whole
from bazaarlake.sources.readers import json_field


def plain_url(*paths: str):
    """The link without its query part."""
    return lambda doc: F.nullif(F.substring_index(json_field(doc, list(paths)), "?", 1), F.lit(""))


def flag(path: str, default: bool = False):
    return lambda doc: F.coalesce(F.lower(json_field(doc, [path])) == "true", F.lit(default))


def joined(separator: str, *parts):
    return lambda doc: squeezed(F.concat_ws(separator, *(p(doc) for p in parts)))


def _shipping(path: str, cost: str, currency: str | None = None):
    """The first way of shipping that has an amount."""

    def of(part: str):
        def read(doc: Column) -> Column:
            ways = F.transform(elements(doc, [path]), lambda w: F.struct(number(cost)(w).alias("cost"), (text(currency)(w) if currency else F.lit("USD")).alias("currency")))
            return F.get(F.filter(ways, lambda w: w["cost"].isNotNull()), F.lit(0))[part]

        return read

    return {"shipping_cost": of("cost"), "shipping_currency": lambda doc: F.when(of("cost")(doc).isNotNull(), F.coalesce(of("currency")(doc), F.lit("USD")))}


def bestbuy() -> Mapping:
    weight = text("weight")
    return Mapping("bestbuy", ("products",), {
        "site_product_id": text("sku"), "title": text("name"), "currency": constant("USD"), "price_min": number("salePrice", "regularPrice", positive=True),
        "url": first(text("url"), templated("https://www.bestbuy.com/site/-/{}.p", text("sku"))), "brand": text("manufacturer"), "model": text("modelNumber"),
        "gtin": lambda doc: normalize_gtin(json_field(doc, ["upc"])), "seller_name": constant("Best Buy"), "rating": number("customerReviewAverage"),
        "review_count": whole("customerReviewCount"), "category_path": joined(" > ", text("class"), text("subclass")), "description": text("shortDescription"),
        "in_stock": lambda doc: flag("onlineAvailability")(doc) & flag("orderable", True)(doc), "image_urls": urls("image", "largeImage", "thumbnailImage"),
        "specs": pairs(
            Condition=first(text("condition"), constant("New")), Color=text("color"),
            Weight=lambda doc: F.when(weight(doc).rlike(r"\p{L}"), weight(doc)).otherwise(F.concat(weight(doc), F.lit(" lb"))),
            Package_Dimensions=lambda doc: F.concat(text("depth")(doc), F.lit(" x "), text("width")(doc), F.lit(" x "), text("height")(doc), F.lit(" in")),
        ),
        **_shipping("shippingLevelsOfService", "unitShippingPrice"),
    })


def lcsc() -> Mapping:
    def derived() -> dict[str, Column]:
        steps, prices = F.transform("tiers", lambda t: t["min_qty"]), F.transform("tiers", lambda t: t["price"])
        return {"moq": F.greatest(F.col("moq"), F.array_min(steps)), "price_min": F.array_min(prices), "price_max": F.array_max(prices)}

    return Mapping("lcsc", ("result.dataList", "result.productSearchResultVO.productList", "result.productList"), {
        "site_product_id": text("productCode"), "title": joined(" ", text("productModel"), text("productIntroEn", "productModel")), "mpn": text("productModel"),
        "model": text("productModel"), "brand": text("brandNameEn"), "moq": whole("minBuyNumber"), "currency": constant("USD"), "seller_name": constant("LCSC"),
        "url": templated("https://www.lcsc.com/product-detail/{}.html", text("productCode")), "category_path": text("catalogName"),
        "tiers": ladder(each("productPriceList", min_qty=whole("ladder"), price=number("usdPrice", "productPrice", positive=True)), closed=True),
        "in_stock": lambda doc: whole("stockNumber")(doc) > 0, "specs": pairs(Stock=text("stockNumber"), Package=text("encapStandard", "packageName")),
        "image_urls": lambda doc: F.slice(urls("productImageUrl", "productImageUrlBig")(doc), 1, 1),
    }, derived, lambda answer: ~flag("ok", True)(answer).eqNullSafe(F.lit(False)) & F.coalesce(json_field(answer, ["code"]).isin("200", "0"), F.lit(True)))


def octopart() -> Mapping:
    """One listing of a part over all sellers: the least price in dollars names seller, link and quantity; the first eight steps are its ladder."""

    def prices(doc: Column) -> Column:
        of_offer = lambda seller: lambda offer: F.transform(elements(offer, ["prices"]), lambda p: F.struct(
            number("price")(p).alias("price"), F.coalesce(whole("quantity")(p), F.lit(1)).alias("min_qty"), F.coalesce(text("currency")(p), F.lit("USD")).alias("currency"),
            text("company.name")(seller).alias("seller"), text("clickUrl")(offer).alias("url"),
        ))
        of_seller = lambda seller: F.flatten(F.transform(elements(seller, ["offers"]), of_offer(seller)))
        return F.filter(F.flatten(F.transform(elements(doc, ["part.sellers"]), of_seller)), lambda p: (p["currency"] == "USD") & p["price"].isNotNull())

    def best(doc: Column) -> Column:
        placed = F.transform(prices(doc), lambda p, i: F.struct(p["price"].alias("price"), i.alias("place"), p["seller"].alias("seller"), p["url"].alias("url"), p["min_qty"].alias("min_qty")))
        return F.array_min(placed)

    mpn, brand = text("part.mpn"), text("part.manufacturer.name")
    search = lambda doc: F.concat(F.lit("https://octopart.com/search?q="), F.url_encode(mpn(doc)))
    steps = lambda doc: F.transform(prices(doc), lambda p: F.struct(p["min_qty"].alias("min_qty"), F.lit(None).cast("bigint").alias("max_qty"), p["price"].alias("price")))
    return Mapping("octopart", ("data.supSearchMpn.results",), {
        "site_product_id": lambda doc: F.when(mpn(doc).isNotNull(), F.substring(F.concat_ws(":", brand(doc), mpn(doc)), 1, 120)), "mpn": mpn, "model": mpn, "brand": brand,
        "title": joined(" ", mpn, text("part.shortDescription")), "currency": constant("USD"), "best": best, "url_without_offer": search,
        "tiers": lambda doc: F.slice(F.sort_array(steps(doc)), 1, 8), "price_max": lambda doc: F.array_max(F.transform(prices(doc), lambda p: p["price"])),
        "image_urls": urls("part.bestImage.url"),
    }, lambda: {
        "price_min": F.col("best.price"), "seller_name": F.col("best.seller"), "moq": F.col("best.min_qty"), "url": F.coalesce("best.url", "url_without_offer"),
    })


def _temu_url(doc: Column) -> Column:
    path = plain_url("data.seoLinkUrl", "data.linkUrl")(doc)
    return F.concat(F.lit("https://www.temu.com"), F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path)))


def temu() -> Mapping:
    """Search pages; prices are in cents."""
    return Mapping("temu", ("store.goodsList",), {
        "site_product_id": lambda doc: F.when(_temu_url(doc).isNotNull(), text("data.goodsId")(doc)), "title": text("data.title"), "url": _temu_url,
        "price_min": cents("data.priceInfo.price"), "currency": first(text("data.priceInfo.currency"), constant("USD")), "rating": number("data.comment.goodsScore"),
        "review_count": digits("data.comment.commentNumTips"), "orders_count": digits("data.salesNum"), "seller_name": constant("Temu"), "image_urls": urls("data.image.url"),
    })


def temu_detail() -> Mapping:
    """Pages of one product, with its variants; listings of `temu` are enriched with these by (site, id)."""
    specs = lambda doc: F.transform(elements(doc, ["goods.goodsProperty"]), lambda p: F.struct(text("key")(p).alias("name"), squeezed(F.array_join(elements(p, ["values"]), ", ")).alias("value")))
    blocks = lambda doc: F.flatten(F.transform(elements(doc, ["productDetail.floorList"]), lambda f: F.transform(elements(f, ["items"]), lambda i: text("text")(i))))
    of_sku = named(each("specs", name=text("specKey"), value=text("specValue")))
    return Mapping("temu", ("store",), {
        "site_product_id": text("goods.goodsId"), "title": text("goods.goodsName"), "price_min": cents("goods.minOnSalePrice"), "price_max": cents("goods.maxOnSalePrice"),
        "currency": constant("USD"), "seller_name": text("mall.mallData.mallName"), "rating": number("reviewStore.showScore"), "review_count": whole("reviewStore.reviewNum"),
        "image_urls": lambda doc: F.array_distinct(F.flatten(F.transform(elements(doc, ["goods.gallery"]), lambda g: urls("url")(g)))), "specs": named(specs),
        "description": lambda doc: F.substring(F.nullif(F.array_join(F.filter(blocks(doc), lambda t: t.isNotNull()), "\n"), F.lit("")), 1, 5000),
        "variants": variants(["sku"], lambda item, v: of_sku(v), text("skuId"), cents("salePrice"), whole("stockQuantity"), text("thumbUrl")),
    })


def ebay() -> Mapping:
    """The seller's feedback percentage stands in `rating`."""
    parts = lambda doc: F.split(json_field(doc, ["itemId"]), r"\|")
    names = lambda doc: F.transform(elements(doc, ["categories"]), lambda c: F.coalesce(text("categoryName")(c), F.lit("")))
    images = lambda doc: F.flatten(F.transform(F.slice(elements(doc, ["additionalImages"]), 1, 5), lambda i: urls("imageUrl")(i)))
    return Mapping("ebay", ("itemSummaries",), {
        "site_product_id": lambda doc: F.when(F.size(parts(doc)) > 1, F.element_at(parts(doc), -2)).otherwise(text("itemId")(doc)), "title": text("title"),
        "url": first(text("itemWebUrl"), templated("https://www.ebay.com/itm/{}", text("itemId"))), "currency": first(text("price.currency"), constant("USD")),
        "price_min": number("price.value"), "seller_name": text("seller.username"), "rating": number("seller.feedbackPercentage"), "review_count": whole("seller.feedbackScore"),
        "category_path": lambda doc: F.nullif(F.array_join(names(doc), " > "), F.lit("")), "shipping_from": text("itemLocation.country"), "specs": pairs(Condition=text("condition")),
        "image_urls": lambda doc: F.concat(urls("image.imageUrl")(doc), images(doc)), **_shipping("shippingOptions", "shippingCost.value", "shippingCost.currency"),
    })


def greetbuy() -> Mapping:
    return Mapping("greetbuy", ("data.data",), {
        "site_product_id": lambda doc: F.when(plain_url("promotionURL")(doc).isNotNull(), text("offerId")(doc)), "title": text("subjectTrans", "subject"),
        "url": plain_url("promotionURL"), "currency": constant("CNY"), "price_min": number("priceInfo.price", positive=True), "moq": whole("minOrderQuantity"),
        "rating": number("tradeScore"), "orders_count": whole("monthSold"), "image_urls": urls("imageUrl"),
    }, accepted=lambda answer: json_field(answer, ["status"]).eqNullSafe("200"))


def liuhuamall() -> Mapping:
    return Mapping("liuhuamall", ("info.list",), {
        "site_product_id": text("goodsId"), "title": text("goodsName"), "currency": constant("USD"), "price_min": number("price", positive=True), "moq": whole("moq"),
        "url": templated("https://www.liuhuamall.com/goods/{}", text("goodsId")), "seller_name": text("shopName"), "image_urls": urls("original"),
    }, accepted=lambda answer: F.lower(json_field(answer, ["status"])).eqNullSafe("true"))


def buckydrop() -> Mapping:
    return Mapping("buckydrop", ("data.records",), {
        "site_product_id": lambda doc: F.when(text("thirdGoodUrl")(doc).isNotNull(), text("spuCode")(doc)), "title": text("spuName"), "url": text("thirdGoodUrl"),
        "currency": constant("CNY"), "price_min": number("costPrice", positive=True), "moq": whole("minOrderQuantity"), "orders_count": whole("salesVolume"),
        "image_urls": urls("mainPic"), "origin": joined(":", text("thirdParty"), text("thirdGoodCode")),
    }, accepted=flag("success"))


def taobao() -> Mapping:
    """The page configuration of search pages."""
    key = text("nid", "item_id")
    return Mapping("taobao", ("mods.itemlist.data.auctions",), {
        "site_product_id": key, "title": untagged("raw_title", "title"), "url": templated("https://item.taobao.com/item.htm?id={}", key), "currency": constant("CNY"),
        "price_min": number("view_price"), "seller_name": text("nick"), "shipping_from": text("item_loc"), "image_urls": urls("pic_url"),
        "orders_count": lambda doc: F.regexp_extract(json_field(doc, ["view_sales"]), r"(\d+)", 1).try_cast("bigint"),
    })


def aliexpress() -> Mapping:
    """Items of search pages, for `pages.scripted_listings`. Numbers go before the formatted price; the price before the discount is the greatest
    one where it is above. A note of free shipping makes the shipping cost 0."""
    key = lambda doc: F.nullif(F.regexp_extract(json_field(doc, ["productId", "product_id", "itemId"]), r"^(\d+)$", 1), F.lit(""))
    least, before = number("prices.salePrice.minPrice"), number("prices.originalPrice.minPrice")
    free = lambda doc: F.exists(elements(doc, ["sellingPoints"]), lambda p: F.coalesce(F.lower(json_field(p, ["tagContent.tagText"])).contains("free shipping"), F.lit(False)))

    def derived() -> dict[str, Column]:
        plain = F.col("least").isNull()
        return {
            "price_min": F.when(plain, F.col("shown.price_min")).otherwise(F.col("least")), "price_max": F.when(plain, F.col("shown.price_max")).when(F.col("before") > F.col("least"), F.col("before")),
            "currency": F.when(plain, F.coalesce("shown.currency", F.lit("USD"))).otherwise(F.col("written")), "shipping_currency": F.when(F.col("shipping_cost") == 0, "USD"),
        }

    return Mapping("aliexpress", ("items",), {
        "site_product_id": key, "url": templated("https://www.aliexpress.com/item/{}.html", key), "title": text("title.displayTitle", "title.seoTitle", "productTitle", "subject"),
        "least": least, "before": before, "shown": lambda doc: parse_price_udf(json_field(doc, ["prices.salePrice.formattedPrice", "prices.originalPrice.formattedPrice"])),
        "written": first(text("prices.salePrice.currencyCode", "prices.originalPrice.currencyCode"), constant("USD")), "rating": number("evaluation.starRating"),
        "orders_count": lambda doc: F.replace(F.regexp_extract(json_field(doc, ["trade.tradeDesc"]), r"(\d[\d,]*)", 1), F.lit(","), F.lit("")).try_cast("bigint"),
        "seller_name": text("store.storeName"), "seller_url": lambda doc: F.element_at(F.concat(urls("store.storeUrl")(doc), F.array(F.lit(None).cast("string"))), 1),
        "shipping_cost": lambda doc: F.when(free(doc), 0.0),
        "image_urls": lambda doc: F.array_distinct(F.concat(F.slice(urls("image.imgUrl", "imageUrl", "productImage")(doc), 1, 1), F.slice(urls("images")(doc), 1, 5))),
    }, derived)


VENDORS = {made.__name__: made for made in (aliexpress, bestbuy, lcsc, octopart, temu, temu_detail, ebay, greetbuy, liuhuamall, buckydrop, taobao)}
