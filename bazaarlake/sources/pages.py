"""Saved pages of shops as listings: result cards, and the structured data of product pages."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bazaarlake.functions.parsing import json_ld_udf, parse_moq_udf, parse_price_udf, parse_tiers_udf
from bazaarlake.functions.text import find_gtin, normalize_gtin
from bazaarlake.operators.ingest import plausible_brand, plausible_mpn
from bazaarlake.sources.mappings import LISTING, Mapping, each, elements, listings, named, number, squeezed, urls, whole
from bazaarlake.sources.readers import VOID, embedded_json, embedded_json_udf, find_items, json_field

#: Attributes that hold the picture of an image loaded late, before `src`, which then holds a placeholder.
LAZY = ("data-src", "data-lazy-src", "data-original", "data-ks-lazyload", "src")
#: Texts that stand in for a price.
NEGOTIABLE = r"(?i)negotiab|on request|inquire|contact suppl|面议"
#: An amount with its currency mark, or a range of them.
PRICE = r"(?i)(?:US|HK|NT|[RACS])?[$¥￥€£₽₩₹]\s*\d[\d.,]*(?:\s*(?:-|–|~|to)\s*(?:US)?[$¥￥€£₽₩₹]?\s*\d[\d.,]*)?|\d[\d.,]*\s*(?:USD|EUR|GBP|CNY|RMB|MAD|DH|元)"
#: Names that pages of AliExpress give their state, and what an item in it has.
STATES, ITEM_KEYS = ("_init_data_", "window.runParams", "runParams"), frozenset({"productId", "product_id"})
CARD = "array<struct<text:string,linked:string,title:string,link:string,image:string>>"


@dataclass(frozen=True)
class Shop:
    """Cards are the elements of the first selector (tag, .class, tag.class) that matches; `ids` are patterns of an id in a link, tried in turn."""

    base: str
    cards: tuple[str, ...]
    ids: tuple[str, ...]
    currency: str = "USD"
    pictures: tuple[str, str, tuple[str, ...]] | None = None  # where the page's script lists items: marker, id, paths of the picture


#: Card classes and link shapes of shops.
SHOPS = {
    "alibaba": Shop("https://www.alibaba.com", (".searchx-offer-item", "div.fy23-search-card", ".J-offer-wrapper", ".gallery-offer-item"), (r"_(\d{6,})\.html", r"/(\d{8,})\.html")),
    "1688": Shop("https://www.1688.com", (".sm-offer-item", ".offer-list-row-offer"), (r"/offer/(\d+)\.html",), "CNY"),
    "tmall": Shop("https://www.tmall.com", (".product", ".product-iWrap"), (r"[?&]id=(\d+)",), "CNY"),
    "dhgate": Shop("https://www.dhgate.com", (".gallery-main", ".listitem", ".item-wrap"), (r"/(\d{6,})\.html",), pictures=('"totalProducts":', "itemcode", ("bigimagepath", "seo300ImagePath"))),
    "globalsources": Shop("https://www.globalsources.com", ("li.card-box", ".prod-item"), (r"-(\d{6,})p\.htm(?:$|[?#])", r"(\d{7,})")),
    "tomtop": Shop("https://www.tomtop.com", (".product-item", ".goods-item", ".item-box"), (r"/(\d{5,})\.html", r"[?&](?:id|product_id|goods_id)=(\d+)")),
    "geekbuying": Shop("https://www.geekbuying.com", (".searchResultItem", ".goodsItem", ".product-item"), (r"/(\d{5,})\.html", r"[?&](?:id|product_id|goods_id)=(\d+)")),
    "madeinchina": Shop("https://www.made-in-china.com", (".prod-item", ".list-node"), (r"/([A-Za-z0-9_-]{6,})\.html",)),
    "banggood": Shop("https://www.banggood.com", (".product-item", ".goodlist_item", ".p-wrap", ".goods-item"), (r"-p-(\d+)", r"/(\d{6,})\.html", r"[?&](?:id|goods_id)=(\d+)")),
    "gearbest": Shop("https://www.gearbest.ma", (".product-layout", ".product-thumb"), (r"product_id=(\d+)", r"-p-(\d+)", r"/(\d{6,})\.html"), "MAD"),
    "ebay": Shop("https://www.ebay.com", (".s-card", ".su-card-container", "li.s-item"), (r"/itm/(\d{6,})",)),
}


def picture(attributes: dict[str, str | None]) -> str | None:
    """An image's link: late-loading attributes first, inline data never, else the first of a set of sources."""
    for name in LAZY:
        link = attributes.get(name)
        if link and not link.startswith("data:"):
            return link
    sources = (attributes.get("srcset") or "").split()
    return sources[0].rstrip(",") if sources else None


class _Cards(HTMLParser):
    """Text outside and inside links, longest link text, first link and first picture of each element of a class; nested ones belong to the outer one."""

    def __init__(self, selector: str):
        super().__init__()
        self.tag, _, self.name = selector.partition(".")
        self.depth, self.anchor, self.cards = 0, None, []

    def handle_starttag(self, tag, attrs):
        values = dict(attrs)
        if self.depth:
            self.depth += tag not in VOID
        elif (not self.tag or tag == self.tag) and self.name in (values.get("class") or "").split():
            self.depth = int(tag not in VOID)
            self.cards.append({"words": [], "linked": [], "titles": [], "link": None, "image": None})
        if not self.depth:
            return
        card = self.cards[-1]
        if tag == "a" and values.get("href"):
            card["link"] = card["link"] or values["href"]
            card["titles"].append(values.get("title") or "")
            self.anchor = []
        elif tag == "img":
            card["image"] = card["image"] or picture(values)
            card["titles"].append(values.get("alt") or "")

    def handle_endtag(self, tag):
        if self.depth and tag == "a" and self.anchor is not None:
            self.cards[-1]["titles"].append(" ".join(self.anchor))
            self.anchor = None
        self.depth -= bool(self.depth) and tag not in VOID

    def handle_data(self, data):
        if self.depth and data.strip():
            self.cards[-1]["words" if self.anchor is None else "linked"].append(data.strip())
            if self.anchor is not None:
                self.anchor.append(data.strip())


def cards_of(html: str | None, selectors: tuple[str, ...]) -> list[dict]:
    for selector in selectors:
        parser = _Cards(selector)
        parser.feed(html or "")
        if parser.cards:
            return [{"text": " ".join(c["words"]), "linked": " ".join(c["linked"]), "title": max(c["titles"], key=len, default=""), "link": c["link"], "image": c["image"]} for c in parser.cards]
    return []


def cards_udf(selectors: tuple[str, ...]):
    @F.pandas_udf(CARD)
    def cards(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for html in batches:
            yield html.map(lambda h: cards_of(h, selectors))

    return cards


def absolute(base: str, link: Column) -> Column:
    scheme = F.when(link.startswith("//"), F.concat(F.lit("https:"), link)).when(link.startswith("/"), F.concat(F.lit(base), link))
    return scheme.otherwise(link)


def saved_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Saved pages of a folder, one row a file: its path and its whole text as html."""
    return spark.read.text(folder, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("html"))


def scripted_pictures(html: Column, shop: Shop) -> Column:
    """Pairs of id and picture of the items that a page's script lists; those without either are left out."""
    if shop.pictures is None:
        return F.array().cast("array<struct<id:string,image:string>>")
    marker, key, paths = shop.pictures
    items = F.from_json(F.get(embedded_json_udf(marker)(html), F.lit(0)), "array<string>")
    found = F.transform(items, lambda i: F.struct(json_field(i, [key]).alias("id"), json_field(i, list(paths)).alias("image")))
    return F.filter(found, lambda p: p["id"].isNotNull() & p["image"].isNotNull())


def shaped_items(html: str | None, markers: tuple[str, ...], keys: frozenset[str]) -> list[str]:
    """The items (as JSON) of the first value assigned after one of the markers, in their order, that holds a list of objects with one of the keys."""
    for marker in markers:
        for blob in embedded_json(html, marker):
            items = find_items(json.loads(blob), set(keys))
            if items:
                return [json.dumps(i) for i in items if isinstance(i, dict)]
    return []


def scripted_listings(pages: DataFrame, html: str, mapping: Mapping, markers: tuple[str, ...] = STATES, keys: frozenset[str] = ITEM_KEYS) -> DataFrame:
    """Listings of saved pages whose script holds the items somewhere; they are found by shape and read by the mapping, whose items are at `items`."""

    @F.pandas_udf("array<string>")
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda h: shaped_items(h, markers, keys))

    answers = pages.select(F.concat(F.lit('{"items":['), F.array_join(found(html), ","), F.lit("]}")).alias("answer"))
    return listings(answers, "answer", mapping)


def sitemap_listings(sitemaps: DataFrame, xml: str, keyword: str | None = None, section: str = "/wholesale/", site: str = "chinavasion", seller: str = "Chinavasion") -> DataFrame:
    """A listing for each product address of saved sitemaps: its last part is the title and, at its end, the number of the part; the parts after
    the section are the category. With a keyword, only addresses whose last part has all its words of two letters or more; a keyword
    without such words finds nothing. Columns as in LISTING."""
    rows = sitemaps.select(F.explode(F.regexp_extract_all(xml, F.lit("<loc>([^<]+)</loc>"), F.lit(1))).alias("url")).where(F.col("url").contains(section))
    rows = rows.withColumn("slug", F.substring_index("url", "/", -1))
    if keyword is not None:
        words = [w for w in re.split(r"\W+", keyword.lower()) if len(w) > 1]
        rows = rows.where(reduce(lambda a, w: a & F.lower("slug").contains(w), words, F.lit(bool(words))))
    number_of_part = r"-([a-z]{3}-[a-z0-9]{6,})$"
    key = F.coalesce(F.nullif(F.regexp_extract("slug", number_of_part, 1), F.lit("")), F.substring("slug", 1, 120))
    spoken = lambda part: F.initcap(F.replace(part, F.lit("-"), F.lit(" ")))
    parts = F.split(F.substring_index("url", section, -1), "/")
    crumbs = F.transform(F.filter(F.slice(parts, 1, F.size(parts) - 1), lambda c: c != ""), spoken)
    made = {
        "site": F.lit(site), "site_product_id": key, "url": F.col("url"), "title": squeezed(spoken(F.regexp_replace("slug", number_of_part, ""))), "currency": F.lit("USD"), "moq": F.lit(1),
        "mpn": F.upper(key), "seller_name": F.lit(seller), "category_path": F.nullif(F.array_join(crumbs, " > "), F.lit("")),
    }
    empty = lambda kind: F.array() if kind.startswith("array") else F.lit(None)
    return rows.select(*(made.get(n, empty(kind)).cast(kind).alias(n) for n, kind in LISTING.items())).where("title IS NOT NULL")


def card_listings(pages: DataFrame, html: str, site: str) -> DataFrame:
    """Cards of saved result pages with an id in their link and a title; of cards with one id on a page all are kept (source dedupe comes after).

    A card without a picture takes the one that the page's script names for its id, where the shop has such a list. A card that asks to negotiate has no price. The price is the first amount with a currency, outside links before inside them.
    A ladder of quantities decides least quantity and price range.
    """
    shop = SHOPS[site]
    read = pages.select(cards_udf(shop.cards)(html).alias("cards"), scripted_pictures(F.col(html), shop).alias("scripted"))
    card = read.select(F.explode("cards").alias("card"), "scripted").select("card.*", "scripted")
    ids = F.coalesce(*(F.nullif(F.regexp_extract("link", p, 1), F.lit("")) for p in shop.ids))
    card = card.withColumn("id", ids).withColumn("image", F.coalesce("image", F.get(F.filter("scripted", lambda p: p["id"] == F.col("id")), F.lit(0))["image"]))
    found = card.select(F.col("id").alias("site_product_id"), squeezed(F.col("title")).alias("title"), absolute(shop.base, F.col("link")).alias("url"), absolute(shop.base, F.col("image")).alias("image_url"), "text", "linked")
    found = found.withColumn("text", F.concat_ws(" ", "text", "linked")).where("site_product_id IS NOT NULL AND title IS NOT NULL")
    read = found.select("*", parse_price_udf(F.regexp_extract("text", PRICE, 0)).alias("price"), parse_moq_udf("text").alias("least"), parse_tiers_udf("text").alias("tiers"))
    steps = F.transform("tiers", lambda t: t["price"])
    asks = F.col("text").rlike(NEGOTIABLE)
    currency = F.when(F.col("price.price_min").isNotNull(), F.col("price.currency")).otherwise(F.lit(shop.currency))
    return read.select(
        F.lit(site).alias("site"), "site_product_id", "url", "title", currency.alias("currency"), F.when(~asks, F.coalesce(F.array_min(steps), "price.price_min")).alias("price_min"),
        F.when(~asks, F.coalesce(F.array_max(steps), "price.price_max")).alias("price_max"), F.coalesce(F.array_min(F.transform("tiers", lambda t: t["min_qty"])), "least.moq").alias("moq"),
        F.col("least.unit").alias("moq_unit"), "image_url", "tiers", F.when(asks, F.lit("price negotiable")).alias("fees_note"),
    )


def label(node: Column, name: str) -> Column:
    """A node's property as text: of an object its name, value or id, of a list the first."""
    found = json_field(node, [f"{name}.name", f"{name}.value", f"{name}.@id", f"{name}[0].name", f"{name}[0]", name])
    return squeezed(F.when(~found.startswith("{") & ~found.startswith("["), found))


def product_node(html: Column) -> Column:
    """The first node of a page's structured data that is a product, as JSON; null without one."""
    kinds = lambda n: F.transform(elements(n, ["@type"]), F.lower)
    return F.get(F.filter(json_ld_udf(html), lambda n: F.arrays_overlap(kinds(n), F.array(F.lit("product"), F.lit("individualproduct")))), F.lit(0))


def enriched(listings: DataFrame, html: str) -> DataFrame:
    """Listings filled from the structured data of their saved product page (a column, dropped); what a listing has stays.

    Zero is no price, a greatest price counts only above the least, pictures and specs are added after those there are.
    The columns brand, mpn, model, gtin, description, image_urls, specs, price_min, price_max, currency, in_stock, rating and
    review_count are as in LISTING; a page without a product changes nothing.
    """
    node = F.col("_node")
    rows = listings.withColumn("_node", product_node(F.col(html))).drop(html)
    of = lambda name: label(node, name)
    kept_id = F.col("site_product_id")
    offer = F.coalesce(F.get(elements(node, ["offers"]), F.lit(0)), F.lit("{}"))
    price, high, shown = number("price", "lowPrice", positive=True)(offer), number("highPrice", positive=True)(offer), json_field(offer, ["availability"])
    takes = F.coalesce(F.nullif("price_min", F.lit(0.0)).isNull() & (price > 0), F.lit(False))
    pictures = F.filter(F.flatten(F.transform(elements(node, ["image"]), lambda i: F.when(i.startswith("{"), urls("url")(i)).otherwise(F.array(i)))), lambda u: u.startswith("http") | u.startswith("//"))
    specs = named(each("additionalProperty", name=lambda p: label(p, "name"), value=lambda p: label(p, "value")))(node)
    mpn = F.coalesce("mpn", plausible_mpn(F.coalesce(of("mpn"), of("sku")), kept_id))
    codes = [normalize_gtin(of(k)) for k in ("gtin14", "gtin13", "gtin12", "gtin8", "gtin")]
    least = F.when(takes, price).otherwise(F.col("price_min"))
    filled = {
        "brand": F.coalesce("brand", plausible_brand(of("brand"), F.array(F.lower("site")))), "mpn": mpn, "model": F.coalesce("model", plausible_mpn(of("model"), kept_id), mpn),
        "gtin": F.coalesce("gtin", *codes, find_gtin(of("description"))), "description": F.coalesce(F.nullif("description", F.lit("")), F.substring(of("description"), 1, 8000)),
        "image_urls": F.array_distinct(F.concat("image_urls", F.transform(pictures, lambda u: absolute("", u)))), "specs": F.concat("specs", specs),
        "price_min": least, "price_max": F.when(high > least, high).otherwise(F.col("price_max")),
        "currency": F.when(takes, F.coalesce(json_field(offer, ["priceCurrency"]), "currency")).otherwise(F.col("currency")),
        "in_stock": F.coalesce(~F.replace(F.lower(shown), F.lit(" "), F.lit("")).contains("outofstock"), "in_stock"),
        "rating": F.coalesce(F.nullif("rating", F.lit(0.0)), number("aggregateRating.ratingValue")(node)),
        "review_count": F.coalesce(F.nullif("review_count", F.lit(0)), whole("aggregateRating.reviewCount", "aggregateRating.ratingCount")(node)),
    }
    return rows.select(*(F.when(node.isNotNull(), filled[c]).otherwise(F.col(c)).alias(c) if c in filled else F.col(c) for c in listings.columns if c != html))
