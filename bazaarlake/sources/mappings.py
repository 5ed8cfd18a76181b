"""Saved JSON answers of product sources as listings: a mapping of paths, compiled to column expressions.

A field is a function from the item's JSON column to a column, made by the helpers below; nothing leaves the JVM. What an answer
lacks is null (arrays: empty), items without id or title are left out, and an answer that isn't JSON has no items.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping as Names
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from bazaarlake.functions import units
from bazaarlake.sources.readers import json_field, kept

Field = Callable[[Column], Column]

PAIR = "struct<name:string,value:string>"
TIER = "struct<min_qty:bigint,max_qty:bigint,price:double>"
VARIANT = f"struct<sku:string,name:string,price:double,stock:bigint,in_stock:boolean,image_url:string,attrs:array<{PAIR}>>"
#: Columns of a listing from any source, in order.
LISTING = {
    "site": "string", "site_product_id": "string", "url": "string", "title": "string", "currency": "string", "price_min": "double", "price_max": "double",
    "moq": "bigint", "brand": "string", "mpn": "string", "model": "string", "gtin": "string", "seller_name": "string", "seller_url": "string", "rating": "double",
    "review_count": "bigint", "orders_count": "bigint", "in_stock": "boolean", "category_path": "string", "description": "string", "shipping_from": "string",
    "shipping_cost": "double", "shipping_currency": "string", "image_urls": "array<string>", "specs": f"array<{PAIR}>", "tiers": f"array<{TIER}>",
    "variants": f"array<{VARIANT}>", "origin": "string",
}


@dataclass(frozen=True)
class Mapping:
    """Where a source's answers keep their items, and what each field of a listing is made of."""

    site: str
    items: tuple[str, ...]
    fields: Names[str, Field]
    derived: Callable[[], dict[str, Column]] = dict  # over the columns that the fields gave
    accepted: Field = lambda answer: F.lit(True)  # false for an answer that reports an error


def expand(value, context: Names[str, object], environment: Names[str, str]):
    """{name} from the context and ${NAME} from the environment (unknown: empty), through nested lists and objects; other braces stay."""
    if isinstance(value, dict):
        return {k: expand(v, context, environment) for k, v in value.items()}
    if isinstance(value, list):
        return [expand(v, context, environment) for v in value]
    if not isinstance(value, str):
        return value
    known = lambda m: environment.get(m[1], "") if m[1] else m[0] if m[2] not in context else "" if context[m[2]] is None else str(context[m[2]])
    return re.sub(r"\$\{(\w+)\}|\{(\w+)\}", known, value)


def squeezed(value: Column) -> Column:
    """White space collapsed and trimmed; empty as null."""
    return kept(F.trim(F.regexp_replace(value, r"(?U)\s+", " ")), lambda t: t != "")


def text(*paths: str) -> Field:
    return lambda doc: squeezed(json_field(doc, list(paths)))


def untagged(*paths: str) -> Field:
    """Text without its markup."""
    return lambda doc: squeezed(F.regexp_replace(json_field(doc, list(paths)), "<[^>]+>", ""))


def number(*paths: str, positive: bool = False) -> Field:
    """The first path with a number; with `positive`, zero counts as none."""

    def read(doc: Column) -> Column:
        values = [bound(json_field(doc, [p]), lambda t: F.coalesce(t.try_cast("double"), units.number_of(t))) for p in paths]
        return F.coalesce(*(kept(v, lambda x: x != 0.0) if positive else v for v in values))

    return read


def whole(*paths: str) -> Field:
    return lambda doc: number(*paths)(doc).cast("bigint")


def cents(*paths: str) -> Field:
    return lambda doc: json_field(doc, list(paths)).try_cast("double") / 100


def digits(*paths: str) -> Field:
    """A count that is written as digits only; other texts ("5k+") aren't one."""
    return lambda doc: F.regexp_extract(json_field(doc, list(paths)), r"^\s*(\d+)\s*$", 1).try_cast("bigint")


def constant(value) -> Field:
    return lambda doc: F.lit(value)


def templated(template: str, part: Field) -> Field:
    """A link with the part in place of {}; null without it."""
    before, _, after = template.partition("{}")
    return lambda doc: F.concat(F.lit(before), part(doc), F.lit(after))


def first(*fields: Field) -> Field:
    return lambda doc: F.coalesce(*(f(doc) for f in fields))


def elements(doc: Column, paths: list[str]) -> Column:
    """The array at the first path that leads to something, as JSON texts; one value counts as an array of it, none as an empty one."""

    def read(found: Column) -> Column:
        array = F.from_json(F.when(found.startswith("{"), F.concat(F.lit("["), found, F.lit("]"))).otherwise(found), ArrayType(StringType()))
        lone = F.array(F.trim(F.replace(found, F.lit('"'), F.lit(""))))
        return F.when(found.isNull(), F.array().cast("array<string>")).when(found.startswith("[") | found.startswith("{"), F.filter(array, lambda x: x.isNotNull())).otherwise(lone)

    return bound(json_field(doc, paths), read)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once, where lambdas would compute it again for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def each(*paths: str, **fields: Field) -> Field:
    """One struct for each element of the array."""
    return lambda doc: F.transform(elements(doc, list(paths)), lambda e: F.struct(*(f(e).alias(n) for n, f in fields.items())))


def urls(*paths: str) -> Field:
    """Links of all paths in order, each once, with a scheme."""

    def read(doc: Column) -> Column:
        links = F.flatten(F.array(*(elements(doc, [p]) for p in paths)))
        return F.array_distinct(F.transform(F.filter(links, lambda u: F.trim(u) != ""), lambda u: F.when(u.startswith("//"), F.concat(F.lit("https:"), u)).otherwise(u)))

    return read


def pairs(**fields: Field) -> Field:
    """Named specs; those without a value are left out."""
    return lambda doc: F.filter(F.array(*(F.struct(F.lit(n.replace("_", " ")).alias("name"), f(doc).cast("string").alias("value")) for n, f in fields.items())), lambda p: p["value"].isNotNull())


def named(found: Field) -> Field:
    """Pairs that have both a name and a value."""
    return lambda doc: F.filter(found(doc), lambda p: p["name"].isNotNull() & p["value"].isNotNull())


def ladder(steps: Field, closed: bool = False) -> Field:
    """Tiers with a quantity and a price, least quantity first; `closed` ends each just below the next."""

    def read(doc: Column) -> Column:
        whole_steps = F.filter(steps(doc), lambda t: t["min_qty"].isNotNull() & t["price"].isNotNull())
        tiers = F.transform(whole_steps, lambda t: F.struct(t["min_qty"].alias("min_qty"), (t["max_qty"] if not closed else F.lit(None).cast("bigint")).alias("max_qty"), t["price"].alias("price")))
        ordered = F.sort_array(tiers)
        if not closed:
            return ordered
        step = lambda o: lambda t, i: F.struct(t["min_qty"].alias("min_qty"), (F.get(o, i + 1)["min_qty"] - 1).alias("max_qty"), t["price"].alias("price"))
        return bound(ordered, lambda o: F.transform(o, step(o)))

    return read


def options(refs: Field, groups: Field) -> Callable[[Column, Column], Column]:
    """A variant's named options: its "property:value" references looked up in the item's property groups.

    `groups` gives structs (id, name, value) for the item; of several values of a property the last one counts.
    """

    def read(item: Column, variant: Column) -> Column:
        found = lambda known: F.flatten(F.transform(refs(variant), lambda r: F.slice(F.filter(known, lambda g: g["id"] == F.element_at(F.split(r, ":"), -1)), -1, 1)))
        names = lambda hits: F.array_distinct(F.filter(F.transform(hits, lambda h: h["name"]), lambda n: n.isNotNull()))
        last = lambda hits: lambda n: F.struct(n.alias("name"), F.element_at(F.filter(hits, lambda h: h["name"] == n), -1)["value"].alias("value"))
        return bound(bound(groups(item), found), lambda hits: F.transform(names(hits), last(hits)))

    return read


def variants(list_paths: list[str], attrs: Callable[[Column, Column], Column], sku: Field, price: Field, stock: Field, image: Field) -> Field:
    """Variants with a sku; named by their options, or by the sku; those without a stock figure count as in stock."""

    def read(item: Column) -> Column:
        made = F.transform(
            elements(item, list_paths),
            lambda v: F.struct(sku(v).alias("sku"), price(v).alias("price"), stock(v).alias("stock"), image(v).alias("image_url"), attrs(item, v).alias("attrs")),
        )
        label = lambda v: F.array_join(F.transform(v["attrs"], lambda a: F.concat(a["name"], F.lit(": "), a["value"])), ", ")
        return F.transform(
            F.filter(made, lambda v: v["sku"].isNotNull()),
            lambda v: F.struct(
                v["sku"].alias("sku"), F.coalesce(F.nullif(label(v), F.lit("")), v["sku"]).alias("name"), v["price"].alias("price"), v["stock"].alias("stock"),
                F.coalesce(v["stock"] > 0, F.lit(True)).alias("in_stock"), v["image_url"].alias("image_url"), v["attrs"].alias("attrs"),
            ),
        )

    return read


def listings(answers: DataFrame, document: str, mapping: Mapping) -> DataFrame:
    """The listings in a column of saved answers, one row for each item, with the columns of LISTING and no others."""
    answer = F.col(document)
    items = answers.where(F.coalesce(mapping.accepted(answer), F.lit(True))).select(F.explode(elements(answer, list(mapping.items))).alias("_item"))
    made = items.select(*(make(F.col("_item")).alias(name) for name, make in mapping.fields.items()))
    made = made.withColumns(mapping.derived()).withColumn("site", F.lit(mapping.site))
    made = made.withColumn("moq", F.greatest(F.lit(1), F.coalesce("moq", F.lit(1)))) if "moq" in made.columns else made.withColumn("moq", F.lit(1))
    empty = lambda kind: F.array().cast(kind) if kind.startswith("array") else F.lit(None).cast(kind)
    columns = [(F.coalesce(F.col(n).cast(kind), empty(kind)) if n in made.columns else empty(kind)).alias(n) for n, kind in LISTING.items()]
    return made.where(F.col("site_product_id").isNotNull() & F.col("title").isNotNull()).select(*columns)


def _over_tiers(reduce: Callable[[Column], Column], part: str) -> Column:
    return reduce(F.transform(F.col("tiers"), lambda t: t[part]))


def compiled(site: str, preset: dict, currency: str = "CNY", url: str | None = None, trust_answer_url: bool = True) -> Mapping:
    """A preset (items_path and item as the YAML has them: candidate paths for each field, lists for specs, tiers, variants) as a mapping.

    `url` is a template with {id}; it stands in for a link that the answer lacks, or for all with trust_answer_url=False,
    as for sources that give their own tokens in links. Range prices come from tiers, then from variants.
    """
    item = preset["item"]
    paths = lambda spec, name: [p] if isinstance(p := spec.get(name) or [], str) else list(p)
    of = lambda make, name, spec=item: make(*p) if (p := paths(spec, name)) else constant(None)
    ids = of(text, "id")
    made = templated((url or "").replace("{id}", "{}"), ids) if url else constant(None)
    link = first(of(text, "url"), made) if trust_answer_url else first(made, of(text, "url"))
    fields: dict[str, Field] = {
        "site_product_id": ids, "title": of(untagged, "title"), "url": link, "price_min": of(number, "price"), "price_max": of(number, "price_max"),
        "moq": of(whole, "moq"), "seller_name": of(text, "seller"), "seller_url": of(text, "seller_url"), "shipping_from": of(text, "location"),
        "orders_count": of(whole, "sales"), "rating": of(number, "rating"), "review_count": of(whole, "reviews"), "description": of(text, "description"),
        "category_path": of(text, "category"), "currency": lambda doc: F.upper(F.coalesce(of(text, "currency")(doc), F.lit(currency))),
        "image_urls": lambda doc: F.filter(F.transform(elements(doc, paths(item, "images") + paths(item, "image")), lambda u: F.coalesce(F.when(u.startswith("{"), json_field(u, ["url"])), u)), lambda u: u != ""),
    }
    if specs := item.get("specs"):
        fields["specs"] = named(each(*paths(specs, "list"), name=of(text, "key", specs), value=of(text, "value", specs)))
    if tiers := item.get("tiers"):
        fields["tiers"] = ladder(each(*paths(tiers, "list"), min_qty=of(whole, "min_qty", tiers), max_qty=of(whole, "max_qty", tiers), price=of(number, "price", tiers)))
    if skus := item.get("variants"):
        value = {"id": text(skus.get("value_id_key", "valueId")), "value": text(skus.get("value_name_en_key", "valueNameEn"), skus.get("value_name_key", "valueName"))}
        group_name = text(skus.get("prop_name_en_key", "propNameEn"), skus.get("prop_name_key", "propName"))

        def groups(doc: Column) -> Column:
            within = lambda g: F.transform(elements(g, [skus.get("prop_values_key", "valuesList")]), lambda v: F.struct(value["id"](v).alias("id"), group_name(g).alias("name"), value["value"](v).alias("value")))
            return F.filter(F.flatten(F.transform(elements(doc, paths(skus, "properties_list")), within)), lambda v: v["id"].isNotNull() & v["value"].isNotNull())

        named_options = skus.get("value_ref") and skus.get("properties_list")
        attrs = options(lambda v: elements(v, paths(skus, "value_ref")), groups) if named_options else lambda i, v: F.array().cast(f"array<{PAIR}>")
        fields["variants"] = variants(paths(skus, "list"), attrs, of(text, "sku", skus), of(number, "price", skus), of(whole, "stock", skus), of(text, "image", skus))
    return Mapping(site, tuple(paths(preset, "items_path")), fields, lambda: ranged("tiers" in fields, "variants" in fields))


def ranged(tiers: bool, skus: bool) -> dict[str, Column]:
    """Least quantity and price range by the ladder where there is one, else prices that are missing or zero by the variants."""
    low, high, moq = F.col("price_min"), F.col("price_max"), F.col("moq")
    if skus:
        prices = F.filter(F.transform("variants", lambda v: v["price"]), lambda p: p > 0)
        low, high = F.coalesce(F.nullif(low, F.lit(0.0)), F.array_min(prices), low), F.coalesce(F.nullif(high, F.lit(0.0)), F.array_max(prices), high)
    if tiers:
        low, high, moq = F.coalesce(_over_tiers(F.array_min, "price"), low), F.coalesce(_over_tiers(F.array_max, "price"), high), F.coalesce(_over_tiers(F.array_min, "min_qty"), moq)
    return {"price_min": low, "price_max": high, "moq": moq}
