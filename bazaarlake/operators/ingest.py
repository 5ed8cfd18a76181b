"""What a raw listing goes through: field rules, identifiers, children, supplier, costs, category, history, and the ledger of its run."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bazaarlake.functions import text, units
from bazaarlake.operators.search import CATEGORIES, HINTS, category_scores
from bazaarlake.sources.catalog import OFFERS_SQL, Catalog, first_per_key

#: Words that are no brand; days after which a listing's details are read again; characters of an error that a ledger keeps.
PLACEHOLDERS = ["none", "n/a", "na", "null", "generic", "no brand", "nobrand", "oem", "unbranded", "other", "others", "brand", "no", "-", "unknown"]
DETAIL_DAYS, ERROR_CHARS = 7, 4000
STICKY = ["description", "category_path", "payload", "detail_at", "shipping_usd"]  # an update without them leaves them
CURRENCIES, NOW = ["USD", "CNY", "EUR", "XXX"], "1998-08-01"


def plausible_brand(brand: Column, site_words: Column) -> Column:
    """Null for placeholders, single letters and a site naming itself."""
    bare = F.trim(brand)
    own = F.array_contains(site_words, F.replace(F.lower(bare), F.lit(" "), F.lit("")))
    return F.when((F.length(bare) >= 2) & ~F.lower(bare).isin(PLACEHOLDERS) & ~F.coalesce(own, F.lit(False)), bare)


def plausible_mpn(mpn: Column, listing_id: Column) -> Column:
    """Null for short ones, placeholders, numbers alone and the listing's own id."""
    bare = F.trim(mpn)
    return F.when((F.length(bare) >= 3) & ~F.lower(bare).isin(PLACEHOLDERS) & (bare != listing_id.cast("string")) & ~bare.rlike(r"^\d+$"), bare)


def needs_detail(detail_at: Column, now: Column, days: int = DETAIL_DAYS) -> Column:
    return detail_at.isNull() | (detail_at < now - F.expr(f"INTERVAL {days} DAYS"))


def absolute_url(base: Column, href: Column) -> Column:
    """Protocol-relative, root-relative and relative addresses made whole; null for none."""
    root = F.regexp_extract(base, r"^([a-z]+://[^/]+)", 1)
    h = F.trim(href)
    return F.when(h.isNull() | (h == ""), None).when(h.rlike("^https?://"), h).when(h.startswith("//"), F.concat(F.lit("https:"), h)).when(h.startswith("/"), F.concat(root, h)).otherwise(F.concat_ws("/", F.regexp_replace(root, "/$", ""), h))


REQUIRED = ("site_key", "listing_id", "url", "title")


def checked(raw: DataFrame, required: tuple[str, ...] = REQUIRED) -> tuple[DataFrame, DataFrame]:
    """Good rows, and bad ones with a reason for the quarantine: a row without site, id, address or title stops nobody else's."""
    missing = F.array_compact(F.array(*(F.when(F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == "", F.lit(f"no {c}")) for c in required)))
    marked = raw.withColumn("reason", F.array_join(missing, ", "))
    return marked.filter("reason = ''").drop("reason"), marked.filter("reason <> ''")


def normalised(raw: DataFrame, home_currency: str = "USD", fold: Callable[[Column], Column] = text.nfkc) -> DataFrame:
    """Field rules of a listing: a price of zero or less is none, a ceiling only above the price, MOQ 1 at least, lengths cut, free shipping costs 0."""
    positive = lambda c: F.when(F.col(c) > 0, F.col(c))
    currency = F.upper(F.coalesce(F.nullif(F.col("currency"), F.lit("")), F.lit(home_currency)))
    shipping = F.when(F.col("shipping_cost").isNotNull(), units.to_usd(F.col("shipping_cost"), F.coalesce(F.col("shipping_currency"), currency))).when(F.col("shipping_free"), 0.0)
    out = raw.withColumns({
        "url": F.substring("url", 1, 1024), "title": F.substring(F.coalesce("title", F.lit("")), 1, 512), "shipping_usd": shipping, "currency": currency, "price_min": positive("price_min"), "price_max": positive("price_max"),
        "moq": F.greatest(F.lit(1), F.coalesce("moq", F.lit(1))), "moq_unit": F.coalesce(F.nullif(F.col("moq_unit"), F.lit("")), F.lit("piece")), "gtin": text.normalize_gtin(F.col("gtin")), "brand": text.truncate(F.col("brand"), 120, fold), "mpn": text.truncate(F.col("mpn"), 160, fold), "model": text.truncate(F.col("model"), 160, fold),
    })
    return out.withColumn("price_max", F.when(F.col("price_min").isNull() | (F.col("price_max") > F.col("price_min")), F.col("price_max")))


def harvested(listings: DataFrame) -> DataFrame:
    """Brand, model, part number and code that a listing lacks, from its attributes (by normalised name); the code at last from its title."""
    spec = lambda key: F.nullif(F.trim(F.try_element_at("specs", F.lit(key))), F.lit(""))
    model = F.coalesce("model", F.substring(spec("model"), 1, 160))
    codes = [text.normalize_gtin(spec(k)) for k in ("upc", "ean", "gtin", "barcode")]
    took_model = F.col("model").isNull() & spec("model").isNotNull()
    return listings.withColumns({
        "mpn": F.coalesce("mpn", F.when(took_model, F.substring(spec("model"), 1, 160))), "model": model, "brand": F.coalesce("brand", F.substring(spec("brand"), 1, 120)), "gtin": F.coalesce("gtin", *codes, text.find_gtin(F.col("title"))),
    })


def spec_rows(specs: DataFrame) -> DataFrame:
    """Attributes (listing_id, key, value, position): the first of each normalised name, names and values cut."""
    rows = specs.withColumn("key_norm", F.substring(text.spec_key(F.col("key")), 1, 200)).filter("key_norm <> ''")
    return first_per_key(rows, ["listing_id", "key_norm"], [F.asc("position")]).withColumns({"key": F.substring("key", 1, 200), "value": F.substring(F.coalesce("value", F.lit("")), 1, 1000)})


def spec_map(rows: DataFrame) -> DataFrame:
    """(listing_id, specs): lower-case values by normalised name, empty ones left out."""
    value = F.lower(F.trim("value"))
    return rows.filter(value != "").groupBy("listing_id").agg(F.map_from_entries(F.collect_list(F.struct("key_norm", value.alias("value")))).alias("specs"))


def variant_rows(variants: DataFrame) -> DataFrame:
    """Variants (listing_id, sku, name, price, currency, in_stock, position): the first of each sku, for which the name stands in; without either none."""
    sku = F.substring(F.trim(F.coalesce(F.nullif(F.col("sku"), F.lit("")), F.col("name"), F.lit(""))), 1, 160)
    return first_per_key(variants.withColumn("sku", sku).filter("sku <> ''"), ["listing_id", "sku"], [F.asc("position")])


def replaced(old: DataFrame, new: DataFrame, key: str = "listing_id") -> DataFrame:
    """Children after an update: those of a listing that brings any are replaced, others stay."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def supplier_rows(listings: DataFrame) -> DataFrame:
    """Suppliers by (site, normalised name) of listings in order of seen_at: latest years (0 is none) and rating, verified if ever, first address and country."""
    name = text.clean(F.col("seller_name"))
    rows = listings.withColumns({"name": F.substring(name, 1, 200), "name_norm": F.substring(F.lower(name), 1, 200)}).filter("name_norm <> ''")
    latest = lambda c, known: F.max_by(c, F.when(known, F.col("seen_at")))
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("seen_at")))
    return rows.groupBy("site_id", "name_norm").agg(
        F.min_by("name", "seen_at").alias("name"), latest("years", F.col("years") > 0).alias("years"), latest("rating", F.col("rating").isNotNull()).alias("rating"), F.bool_or("verified").alias("verified"),
        first("seller_url").alias("url"), first("country").alias("country"), F.min("seen_at").alias("first_seen"), F.max("seen_at").alias("last_seen"),
    )


def costed(listings: DataFrame, variants: DataFrame, tiers: DataFrame) -> DataFrame:
    """Unit price and landed cost in dollars: in-stock variants set price and ceiling; a ladder sets what is paid at the MOQ (its lowest step if none is
    reached) and the currency; landed is the unit price times MOQ plus disclosed shipping. An unknown currency gives null."""
    sold = F.col("in_stock") & (F.col("price") > 0)
    of_variants = variants.groupBy("listing_id").agg(F.min(F.when(sold, F.col("price"))).alias("v_low"), F.max(F.when(sold, F.col("price"))).alias("v_high"))
    steps = tiers.join(listings.select("listing_id", F.col("moq").alias("at_moq")), "listing_id")
    step = F.struct("min_qty", "price", "currency")
    ladder = steps.groupBy("listing_id").agg(F.max(F.when(F.col("min_qty") <= F.col("at_moq"), step)).alias("reached"), F.min(step).alias("lowest"))
    rows = listings.join(of_variants, "listing_id", "left").join(ladder, "listing_id", "left").withColumn("tier", F.coalesce("reached", "lowest"))
    has = F.col("v_low").isNotNull()
    rows = rows.withColumns({"price_max": F.when(has, F.when(F.col("v_high") > F.col("v_low"), F.col("v_high"))).otherwise(F.col("price_max")), "price_min": F.coalesce("v_low", "price_min")})
    rows = rows.withColumns({"unit": F.coalesce("tier.price", "price_min"), "currency": F.coalesce("tier.currency", "currency")})
    rows = rows.withColumn("price_usd", units.to_usd(F.col("unit"), F.col("currency")))
    landed = F.col("price_usd") * F.greatest(F.lit(1), F.col("moq")) + F.coalesce("shipping_usd", F.lit(0.0))
    return rows.withColumn("landed_usd", landed).drop("v_low", "v_high", "reached", "lowest", "tier", "unit")


def appended_history(before: DataFrame, after: DataFrame, at: Column) -> DataFrame:
    """History rows of listings that are new or whose price or landed cost differs (null-safe) from what it was."""
    old = before.select("listing_id", F.col("price_usd").alias("was"), F.col("landed_usd").alias("was_landed"), F.lit(True).alias("known"))
    rows = after.join(old, "listing_id", "left")
    return rows.filter(F.col("known").isNull() | ~F.col("price_usd").eqNullSafe(F.col("was")) | ~F.col("landed_usd").eqNullSafe(F.col("was_landed"))).select("listing_id", "price_usd", "landed_usd", at.alias("ts"))


def categorised(listings: DataFrame, known: DataFrame, categories: list, hints: list) -> tuple[DataFrame, DataFrame]:
    """listings (id, site_id, raw_path, title) with their category, and the map of (site_id, raw_path) with what is new.

    A path's first listing decides for all later ones of the site; listings without a path are judged by their title alone."""
    path = text.clean(F.col("raw_path"))
    rows = listings.withColumn("raw_path", path)
    haystack = text.normalize_title(F.concat_ws(" ", "raw_path", "raw_path", "title"))
    judged = lambda df: df.withColumn("haystack", haystack).withColumn("c", category_scores(F.col("haystack"), categories, hints)).withColumns({"category": F.col("c.category"), "confidence": F.coalesce("c.confidence", F.lit(0.0))}).drop("c", "haystack")
    bare = judged(rows.filter("raw_path = ''"))
    pathed = rows.filter("raw_path <> ''")
    first = first_per_key(pathed, ["site_id", "raw_path"], [F.asc("id")]).join(known.select("site_id", "raw_path"), ["site_id", "raw_path"], "left_anti")
    table = known.select("site_id", "raw_path", "category", "confidence").unionByName(judged(first).select("site_id", "raw_path", "category", "confidence"))
    return bare.unionByName(pathed.join(table, ["site_id", "raw_path"], "left").select(*bare.columns)), table


def finished_runs(ledger: DataFrame, ends: DataFrame) -> DataFrame:
    """The ledger after runs ended: counters and error (cut) of ends (run_id, finished_at, ok, seen, new, updated, error) go into their rows."""
    e = ends.select("run_id", *(F.col(c).alias(f"_{c}") for c in ends.columns if c != "run_id"))
    rows = ledger.join(e, "run_id", "left")
    pick = lambda c: F.coalesce(F.substring("_error", 1, ERROR_CHARS), "error") if c == "error" else F.coalesce(f"_{c}", c)
    return rows.select(*(pick(c).alias(c) if f"_{c}" in rows.columns else F.col(c) for c in ledger.columns))


def crawl_totals(ledger: DataFrame) -> DataFrame:
    """Sums of the counters over all runs."""
    return ledger.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ledger.columns if c in ("seen", "new", "updated", "failed", "skipped")))


def _orders(catalog: Catalog) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Orders as raw listings: lines are variants, and ladders of every other order."""
    key = F.col("o_orderkey")
    currency = F.element_at(F.array(*map(F.lit, CURRENCIES)), (key % len(CURRENCIES) + 1).cast("int"))
    listings = catalog.table("orders").select(key.alias("listing_id"), currency.alias("currency"), F.col("o_totalprice").alias("price_min"), F.lit(None).cast("double").alias("price_max"), (key % 30).cast("int").alias("moq"), F.when(key % 3 == 0, 5.0).alias("shipping_usd"))
    line = catalog.table("lineitem")
    variants = line.select(F.col("l_orderkey").alias("listing_id"), F.col("l_extendedprice").alias("price"), (F.col("l_returnflag") != "R").alias("in_stock"))
    tiers = line.filter("l_orderkey % 2 = 0").select(F.col("l_orderkey").alias("listing_id"), F.col("l_quantity").cast("int").alias("min_qty"), F.col("l_extendedprice").alias("price"), F.lit("CNY").alias("currency"))
    return listings, variants, tiers


def listing_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = costed(*_orders(Catalog(spark, sf_dir)))
    return out.select("listing_id", "currency", "price_min", "price_max", "price_usd", "landed_usd")


def supplier_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers of the listings that lines stand for, each with what was last known."""
    line, supplier = Catalog(spark, sf_dir).table("lineitem"), Catalog(spark, sf_dir).table("supplier")
    rows = line.join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).select(
        F.col("s_nationkey").alias("site_id"), F.concat(F.lit("  "), "s_name", F.lit(" ")).alias("seller_name"), F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity", "l_tax", "l_discount").alias("seen_at"), (F.col("l_quantity").cast("int") % 9).alias("years"),
        F.when(F.col("l_tax") > 0, F.col("l_tax") * 100).alias("rating"), (F.col("l_discount") > 0.09).alias("verified"), F.when(F.col("l_linenumber") > 1, F.col("l_orderkey").cast("string")).alias("seller_url"), F.lit(None).cast("string").alias("country"),
    )
    return supplier_rows(rows).select("site_id", "name_norm", "years", "rating", "verified", "url")


def category_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Category of every product through its site's path, whose first product decides; every ninth has no path."""
    rows = Catalog(spark, sf_dir).products().select(F.col("product_id").alias("id"), (F.col("product_id") % 3).alias("site_id"), F.when(F.col("product_id") % 9 != 0, F.substring_index("path", "/", 1)).alias("raw_path"), "title")
    known = spark.createDataFrame([], "site_id long, raw_path string, category string, confidence double")
    found, _ = categorised(rows, known, CATEGORIES, HINTS)
    return found.select(F.col("id").alias("product_id"), "category", "confidence")


def detail_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Active offers whose details are due."""
    rows = Catalog(spark, sf_dir).active_offers().withColumn("detail_at", F.when(F.col("supplier_id") % 4 != 0, F.col("last_seen")))
    return rows.filter(needs_detail(F.col("detail_at"), F.lit(NOW).cast("timestamp"), 30)).select("product_id", "supplier_id")


def crawl_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of all crawls; a run's counters stand in from its event."""
    seen = F.coalesce(F.col("value").cast("int"), F.lit(0)).cast("long")
    rows = Catalog(spark, sf_dir).table("events").select(seen.alias("seen"), F.when(F.col("event_type") == "signup", seen).otherwise(0).alias("new"), (F.col("event_type") == "error").cast("long").alias("failed"))
    return crawl_totals(rows)


QUERIES = {f.__name__: f for f in (listing_costs, supplier_upsert, category_map, detail_batch, crawl_sums)}
_RATE = "CASE currency " + " ".join(f"WHEN '{c}' THEN {units.FALLBACK_RATES[c]}::DOUBLE" for c in CURRENCIES if c in units.FALLBACK_RATES) + " END"
_SEEN = "l_shipdate {0}, l_orderkey {0}, l_linenumber {0}, l_partkey {0}, l_extendedprice {0}, l_quantity {0}, l_tax {0}, l_discount {0}"
_HAY = "CASE WHEN p_partkey % 9 <> 0 THEN lower(p_type) || ' ' || lower(p_type) || ' ' ELSE '' END || p_name"
_CASES = {slug: " + ".join(f"CASE WHEN contains(hay, '{k}') THEN {1.0 + 0.35 * k.count(' ')} ELSE 0 END" for k in found) for slug, found in CATEGORIES}
_HINT = "CASE " + " ".join(f"WHEN {' OR '.join(f'contains(hay, {h!r})' for h in found)} THEN '{slug}'" for slug, found in HINTS) + " END"
ORACLES = {
    "listing_costs": f"""WITH o AS (SELECT o_orderkey AS k, {CURRENCIES!r}[o_orderkey % 4 + 1] AS ccy, o_totalprice AS p, CAST(o_orderkey % 30 AS INT) AS moq, CASE WHEN o_orderkey % 3 = 0 THEN 5.0 END AS ship FROM orders),
v AS (SELECT l_orderkey AS k, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem WHERE l_returnflag <> 'R' AND l_extendedprice > 0 GROUP BY 1),
t AS (SELECT l_orderkey AS k, max({{'q': l_quantity::INT, 'p': l_extendedprice}}) FILTER (l_quantity::INT <= moq) AS reached, min({{'q': l_quantity::INT, 'p': l_extendedprice}}) AS lowest FROM lineitem JOIN o ON k = l_orderkey WHERE l_orderkey % 2 = 0 GROUP BY 1),
r AS (SELECT k AS listing_id, CASE WHEN t.k IS NOT NULL THEN 'CNY' ELSE ccy END AS currency, coalesce(lo, p) AS price_min, CASE WHEN hi > lo THEN hi END AS price_max, coalesce(coalesce(reached, lowest).p, lo, p) AS unit, moq, ship FROM o LEFT JOIN v USING (k) LEFT JOIN t USING (k))
SELECT listing_id, currency, price_min, price_max, round(unit / {_RATE}, 4) AS price_usd, round(unit / {_RATE}, 4) * greatest(1, moq) + coalesce(ship, 0.0) AS landed_usd FROM r""",
    "supplier_upsert": f"SELECT s_nationkey AS site_id, lower(s_name) AS name_norm, last(l_quantity::INT % 9 ORDER BY {_SEEN.format('')}) FILTER (l_quantity::INT % 9 > 0) AS years, last(l_tax * 100 ORDER BY {_SEEN.format('')}) FILTER (l_tax > 0) AS rating, bool_or(l_discount > 0.09) AS verified, first(l_orderkey::VARCHAR ORDER BY {_SEEN.format('')}) FILTER (l_linenumber > 1) AS url FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1, 2",
    "category_map": f"WITH h AS (SELECT p_partkey AS id, p_partkey % 3 AS site, CASE WHEN p_partkey % 9 <> 0 THEN p_type ELSE p_partkey::VARCHAR END AS path, {_HAY} AS hay FROM part), f AS (SELECT site, path, first(hay ORDER BY id) AS hay FROM h GROUP BY 1, 2), s AS ({' UNION ALL '.join(f'SELECT site, path, hay, {n} AS rank, {slug!r} AS category, ({q})::DOUBLE AS score FROM f' for n, (slug, q) in enumerate(_CASES.items()))}), b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY site, path ORDER BY score DESC, rank) AS rn FROM s) WHERE rn = 1) SELECT id AS product_id, CASE WHEN score >= 1 THEN category ELSE {_HINT.replace('hay', 'b.hay')} END AS category, CASE WHEN score >= 1 THEN least(1.0::DOUBLE, score / 3.0::DOUBLE) WHEN {_HINT.replace('hay', 'b.hay')} IS NOT NULL THEN 0.35::DOUBLE ELSE 0.0::DOUBLE END AS confidence FROM h JOIN b USING (site, path)",
    "detail_batch": f"WITH {OFFERS_SQL} SELECT product_id, supplier_id FROM offers WHERE is_active AND (supplier_id % 4 = 0 OR last_seen < TIMESTAMP '{NOW}' - INTERVAL 30 DAY)",
    "crawl_sums": "SELECT sum(coalesce(trunc(value), 0))::BIGINT AS seen, coalesce(sum(coalesce(trunc(value), 0)) FILTER (event_type = 'signup'), 0)::BIGINT AS new, count(*) FILTER (event_type = 'error') AS failed FROM events",
}
