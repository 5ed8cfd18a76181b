"""Ladders, landed costs, break-even quantities, freight, duty, bills of materials and trust."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bazaarlake.functions import units
from bazaarlake.sources.catalog import OFFERS_SQL, Catalog

#: The quantity ladder, the freight and trust constants, and sample tables of weights, duties and orders.
LADDER = [1, 5, 10, 25, 50, 100, 250, 500, 1000, 2500, 5000]
BASE_FEE, PER_KG, LEAST_FREIGHT, DIVISOR, FALLBACK_KG = 4.0, 9.0, 6.0, 5000.0, 0.5
WEIGHTS = [("promo", 0.25), ("standard", 1.5), ("promo/brand#12", 0.75), ("economy", 0.125)]
DUTIES = [("promo", 0.0625), ("standard", 0.125), ("promo/brand#12", 0.25), ("economy/brand#3", 0.5)]
BOM = [("red bolt", 3), ("old anvil", 600), ("no such part", 5), ("blue widget", 25)]
SUSPICIOUS_DISCOUNT = 0.5

LANDED_SQL = "price_usd * greatest(qty, coalesce(moq, 1)) + coalesce(shipping, 0.0)"


def tiers(catalog: Catalog, dealt: bool = False) -> DataFrame:
    """Price ladder of each offer: least unit price by quantity; `dealt` by offer, for those who gather an offer's steps."""
    line = catalog.table("lineitem")
    line = line.repartition("l_partkey", "l_suppkey") if dealt else line
    return line.groupBy(F.col("l_partkey").alias("product_id"), F.col("l_suppkey").alias("supplier_id"), F.col("l_quantity").cast("int").alias("min_qty")).agg(F.min(F.col("l_extendedprice") / F.col("l_quantity")).alias("price"))


TIERS_SQL = "tiers AS (SELECT l_partkey AS product_id, l_suppkey AS supplier_id, CAST(l_quantity AS INTEGER) AS min_qty, min(l_extendedprice / l_quantity) AS price FROM lineitem GROUP BY 1, 2, 3)"


def tier_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ladders with closed bounds: a tier ends below the next one, the last is open."""
    w = Window.partitionBy("product_id", "supplier_id").orderBy("min_qty")
    return tiers(Catalog(spark, sf_dir)).withColumn("max_qty", F.lead("min_qty").over(w) - 1)


def tier_at_moq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As-of join: the price of the largest tier that the MOQ reaches, else of the lowest tier. Both sides share their key, so it's one aggregation over a co-partitioned join."""
    catalog = Catalog(spark, sf_dir)
    joined = catalog.offers().select("product_id", "supplier_id", "moq").join(tiers(catalog), ["product_id", "supplier_id"])
    best = joined.groupBy("product_id", "supplier_id", "moq").agg(F.max_by("price", F.when(F.col("min_qty") <= F.col("moq"), F.col("min_qty"))).alias("at"), F.min_by("price", "min_qty").alias("lowest"))
    return best.select("product_id", "supplier_id", F.coalesce("at", "lowest").alias("price"))


def landed_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cost of a first order: unit price times MOQ, plus shipping where disclosed."""
    return Catalog(spark, sf_dir).active_offers().select("product_id", "supplier_id", F.expr("price_usd * greatest(1, moq) + coalesce(shipping, 0.0)").alias("landed_usd"))


def at_quantities(offers: DataFrame) -> DataFrame:
    """Priced offers at each quantity of the ladder (a constant) with their landed cost."""
    return offers.filter("price_usd > 0").withColumn("qty", F.explode(F.array(*map(F.lit, LADDER)))).withColumn("landed", F.expr(LANDED_SQL))


AT_SQL = f"quoted AS (SELECT *, {LANDED_SQL} AS landed FROM (SELECT o.*, r_name = 'AMERICA' AS is_baseline, unnest({LADDER}) AS qty FROM offers o JOIN nation ON n_nationkey = site_id JOIN region ON r_regionkey = n_regionkey WHERE is_active AND price_usd > 0) q)"


def landed_at(qty: int) -> Column:
    return F.expr(LANDED_SQL.replace("qty", str(qty)))


def ladder_winner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cheapest supplier of each product at each quantity; ties by price, then supplier. One aggregation holds all
    quantities side by side, so offers aren't multiplied by the ladder before the shuffle."""
    priced = Catalog(spark, sf_dir).active_offers().filter("price_usd > 0")
    best = priced.groupBy("product_id").agg(*(F.min(F.struct(landed_at(q).alias("landed"), "price_usd", "supplier_id")).alias(f"at_{q}") for q in LADDER))
    rungs = F.array(*(F.struct(F.lit(q).alias("qty"), F.col(f"at_{q}.supplier_id").alias("supplier_id"), F.col(f"at_{q}.landed").alias("landed")) for q in LADDER))
    return best.select("product_id", F.explode(rungs).alias("r")).select("product_id", "r.*")


def break_even(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each product and bulk offer the first ladder quantity at which it beats the cheapest single-unit offer, which a window
    over the product puts beside every offer: one shuffle, no self-join."""
    catalog = Catalog(spark, sf_dir)
    offers = catalog.active_offers().filter("price_usd > 0").join(F.broadcast(catalog.sites().select("site_id", "is_baseline")), "site_id")  # sites: 25 rows at any scale
    cheapest = F.min(F.struct(landed_at(1).alias("landed"), "price_usd", "supplier_id", "moq", "shipping")).over(Window.partitionBy("product_id"))
    bulk = offers.withColumn("ref", cheapest).filter("moq > 1 AND NOT is_baseline AND supplier_id <> ref.supplier_id")
    at_reference = lambda q: F.expr(LANDED_SQL.replace("price_usd", "ref.price_usd").replace("moq", "ref.moq").replace("shipping", "ref.shipping").replace("qty", str(q)))
    first = F.coalesce(*(F.when(landed_at(q) < at_reference(q), q) for q in LADDER))
    return bulk.select("product_id", "supplier_id", first.alias("qty")).filter("qty IS NOT NULL")


def crossovers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """break_even() with what the bulk offer saves at that quantity, to the cent."""
    catalog = Catalog(spark, sf_dir)
    offers = catalog.active_offers().filter("price_usd > 0").join(F.broadcast(catalog.sites().select("site_id", "is_baseline")), "site_id")  # sites: 25 rows at any scale
    cheapest = F.min(F.struct(landed_at(1).alias("landed"), "price_usd", "supplier_id", "moq", "shipping")).over(Window.partitionBy("product_id"))
    bulk = offers.withColumn("ref", cheapest).filter("moq > 1 AND NOT is_baseline AND supplier_id <> ref.supplier_id")
    reference = lambda q: F.expr(LANDED_SQL.replace("price_usd", "ref.price_usd").replace("moq", "ref.moq").replace("shipping", "ref.shipping").replace("qty", str(q)))
    first = F.coalesce(*(F.when(landed_at(q) < reference(q), F.struct(F.lit(q).alias("qty"), units.rounded(reference(q) - landed_at(q)).alias("saving"))) for q in LADDER))
    return bulk.select("product_id", "supplier_id", first.alias("c")).filter("c IS NOT NULL").select("product_id", "supplier_id", "c.qty", "c.saving")


def cost_per_unit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each priced offer at each quantity: landed cost, cost of a wanted unit, and units bought beyond the wanted ones."""
    rows = at_quantities(Catalog(spark, sf_dir).active_offers())
    return rows.select("product_id", "supplier_id", "qty", "landed", (F.col("landed") / F.greatest(F.lit(1), F.col("qty"))).alias("effective"), F.greatest(F.lit(0), F.coalesce("moq", F.lit(1)) - F.col("qty")).alias("overage"))


def baseline_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cheapest single unit at home and elsewhere, for products that have both."""
    catalog = Catalog(spark, sf_dir)
    at = at_quantities(catalog.active_offers().join(F.broadcast(catalog.sites().select("site_id", "is_baseline")), "site_id")).filter("qty = 1")
    both = at.groupBy("product_id").agg(F.min(F.when(F.col("is_baseline"), F.col("landed"))).alias("home"), F.min(F.when(~F.col("is_baseline"), F.col("landed"))).alias("elsewhere"))
    return both.filter("home IS NOT NULL AND elsewhere IS NOT NULL").withColumn("delta", F.col("home") - F.col("elsewhere"))


def longest_prefix(paths: DataFrame, table: list[tuple[str, float]], column: str, default: float) -> DataFrame:
    """paths (path, ...) with the value of the longest prefix of path in a constant table: a first match in order of length."""
    value: Column | None = None
    for prefix, x in sorted(table, key=lambda t: -len(t[0])):
        hit = (F.col("path") == prefix) | F.col("path").startswith(prefix + "/")
        value = F.when(hit, F.lit(x)) if value is None else value.when(hit, F.lit(x))
    return paths.withColumn(column, value.otherwise(F.lit(default)))


def _prefix_sql(table: list[tuple[str, float]], default: float) -> str:
    rows = ", ".join(f"('{p}', {v})" for p, v in table)
    return f"coalesce((SELECT v FROM (VALUES {rows}) t(p, v) WHERE path = p OR path LIKE p || '/%' ORDER BY length(p) DESC LIMIT 1), {default})"


def freight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Courier cost by the greater of actual and volumetric weight. The part's size stands for each edge in cm."""
    items = longest_prefix(Catalog(spark, sf_dir).products(), WEIGHTS, "kg", FALLBACK_KG)
    chargeable = F.greatest("kg", F.col("size") * F.col("size") * F.col("size") / DIVISOR)
    return items.select("product_id", chargeable.alias("chargeable_kg"), F.greatest(BASE_FEE + chargeable * PER_KG, F.lit(LEAST_FREIGHT)).alias("usd"))


def duty_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return longest_prefix(Catalog(spark, sf_dir).products(), DUTIES, "rate", 0.0).select("product_id", "rate", (F.col("list_price") * F.col("rate")).alias("duty_usd"))


def bom_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line of a bill of materials with its cheapest offer at the order quantity and the overage its MOQ forces; unmatched lines stay."""
    catalog = Catalog(spark, sf_dir)
    lines = spark.createDataFrame(BOM, "title string, qty int")
    hits = catalog.products().select("product_id", "title").join(F.broadcast(lines), "title")  # a bill, not a table
    priced = hits.join(catalog.active_offers().filter("price_usd > 0"), "product_id").withColumn("total", F.expr(LANDED_SQL))
    best = priced.groupBy("title").agg(F.min(F.struct("total", "product_id", "supplier_id", "moq")).alias("b"))
    out = lines.join(best, "title", "left")
    return out.select("title", "qty", F.col("b.total").alias("total"), F.col("b.product_id").alias("product_id"), F.col("b.supplier_id").alias("supplier_id"), F.greatest(F.lit(0), F.col("b.moq") - F.col("qty")).alias("overage"))


def peer_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each offer the upper median of its product's other prices (those equal to its own left out), if there are two.

    Ranks within the product give it without gathering lists: removing a block of equal prices shifts the
    median by the block's size where the block lies before it."""
    offers = Catalog(spark, sf_dir).active_offers().filter("price_usd > 0").select("product_id", "supplier_id", "price_usd")
    of_product = Window.partitionBy("product_id")
    ranked = offers.withColumn("rn", F.row_number().over(of_product.orderBy("price_usd", "supplier_id")) - 1).withColumn("n", F.count("*").over(of_product))
    block = Window.partitionBy("product_id", "price_usd")
    ranked = ranked.withColumn("first", F.min("rn").over(block)).withColumn("same", F.count("*").over(block))
    want = F.expr("(n - same) div 2 + CASE WHEN (n - same) div 2 < first THEN 0 ELSE same END")
    prices = ranked.select(F.col("product_id").alias("peer_product"), F.col("rn").alias("peer_rn"), F.col("price_usd").alias("peer_price"))
    targets = ranked.withColumn("want", F.when(F.expr("n - same >= 2"), want))
    joined = targets.join(prices, (F.col("product_id") == F.col("peer_product")) & (F.col("want") == F.col("peer_rn")), "left")
    return joined.select("product_id", "supplier_id", F.col("peer_price").alias("peer_median"))


def trust_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Level of each supplier by the number of reasons against it. Rating and sales stand in from balance and key."""
    catalog = Catalog(spark, sf_dir)
    rows = catalog.table("supplier").join(F.broadcast(catalog.sites()), F.col("s_nationkey") == F.col("site_id"))  # 25 sites at any scale
    rows = rows.select("s_suppkey", "needs_agent", F.when(F.col("s_acctbal") > 0, F.col("s_acctbal") / 2000).alias("rating"), (F.col("s_suppkey") % 40).alias("reviews"))
    reasons = F.array_compact(F.array(
        F.when((F.col("rating") <= 5) & (F.col("rating") < 4.3), "low rating").when((F.col("rating") > 5) & (F.col("rating") < 97), "feedback"),
        F.when(F.col("reviews") < 10, "no sales history"),
        F.when(F.col("needs_agent"), "no protection"),
        F.when(F.col("rating").isNull() & (F.col("reviews") == 0), "no reputation"),
    ))
    only = F.array_contains(reasons, "no reputation") & (F.size(reasons) == 1)
    level = F.when(F.size(reasons) >= 3, "risk").when(only, "unknown").when(F.size(reasons) > 0, "caution").otherwise("ok")
    return rows.select("s_suppkey", level.alias("level"), F.size(reasons).alias("reasons"))


QUERIES = {f.__name__: f for f in (tier_ladder, tier_at_moq, landed_cost, ladder_winner, break_even, crossovers, cost_per_unit, baseline_delta, freight, duty_prefix, bom_cost, peer_median, trust_levels)}
_PRODUCTS = "(SELECT p_partkey AS product_id, lower(p_type) || '/' || lower(p_brand) AS path, p_size AS size, p_retailprice AS list_price FROM part)"
_BOM = ", ".join(f"('{t}', {q})" for t, q in BOM)
ORACLES = {
    "tier_ladder": f"WITH {TIERS_SQL} SELECT *, lead(min_qty) OVER (PARTITION BY product_id, supplier_id ORDER BY min_qty) - 1 AS max_qty FROM tiers",
    "tier_at_moq": f"WITH {OFFERS_SQL}, {TIERS_SQL} SELECT o.product_id, o.supplier_id, coalesce(arg_max(price, min_qty) FILTER (min_qty <= moq), arg_min(price, min_qty)) AS price FROM offers o JOIN tiers t ON t.product_id = o.product_id AND t.supplier_id = o.supplier_id GROUP BY 1, 2",
    "landed_cost": f"WITH {OFFERS_SQL} SELECT product_id, supplier_id, price_usd * greatest(1, moq) + coalesce(shipping, 0.0) AS landed_usd FROM offers WHERE is_active",
    "ladder_winner": f"WITH {OFFERS_SQL}, {AT_SQL} SELECT product_id, qty, supplier_id, landed FROM (SELECT *, row_number() OVER (PARTITION BY product_id, qty ORDER BY landed, price_usd, supplier_id) AS rn FROM quoted) WHERE rn = 1",
    "break_even": f"WITH {OFFERS_SQL}, {AT_SQL}, ref AS (SELECT product_id, first(supplier_id ORDER BY landed, price_usd, supplier_id) AS s FROM quoted WHERE qty = 1 GROUP BY 1), r AS (SELECT q.product_id, qty, supplier_id, landed FROM quoted q JOIN ref ON q.product_id = ref.product_id AND supplier_id = s) SELECT a.product_id, a.supplier_id, min(a.qty) AS qty FROM quoted a JOIN r ON a.product_id = r.product_id AND a.qty = r.qty WHERE a.moq > 1 AND NOT a.is_baseline AND a.supplier_id <> r.supplier_id AND a.landed < r.landed GROUP BY 1, 2",
    "crossovers": f"WITH {OFFERS_SQL}, {AT_SQL}, ref AS (SELECT product_id, first(supplier_id ORDER BY landed, price_usd, supplier_id) AS s FROM quoted WHERE qty = 1 GROUP BY 1), r AS (SELECT q.product_id, qty, supplier_id, landed FROM quoted q JOIN ref ON q.product_id = ref.product_id AND supplier_id = s) SELECT a.product_id, a.supplier_id, min(a.qty) AS qty, round_even(arg_min(r.landed - a.landed, a.qty), 2) AS saving FROM quoted a JOIN r ON a.product_id = r.product_id AND a.qty = r.qty WHERE a.moq > 1 AND NOT a.is_baseline AND a.supplier_id <> r.supplier_id AND a.landed < r.landed GROUP BY 1, 2",
    "cost_per_unit": f"WITH {OFFERS_SQL}, {AT_SQL} SELECT product_id, supplier_id, qty, landed, landed / greatest(1, qty) AS effective, greatest(0, coalesce(moq, 1) - qty) AS overage FROM quoted",
    "baseline_delta": f"WITH {OFFERS_SQL}, {AT_SQL} SELECT *, home - elsewhere AS delta FROM (SELECT product_id, min(landed) FILTER (is_baseline) AS home, min(landed) FILTER (NOT is_baseline) AS elsewhere FROM quoted WHERE qty = 1 GROUP BY 1) WHERE home IS NOT NULL AND elsewhere IS NOT NULL",
    "freight": f"SELECT product_id, chargeable_kg, greatest({BASE_FEE} + chargeable_kg * {PER_KG}, {LEAST_FREIGHT})::DOUBLE AS usd FROM (SELECT product_id, greatest({_prefix_sql(WEIGHTS, FALLBACK_KG)}::DOUBLE, size * size * size / {DIVISOR}::DOUBLE) AS chargeable_kg FROM {_PRODUCTS})",
    "duty_prefix": f"SELECT product_id, rate, list_price * rate AS duty_usd FROM (SELECT *, {_prefix_sql(DUTIES, 0.0)}::DOUBLE AS rate FROM {_PRODUCTS})",
    "bom_cost": f"WITH {OFFERS_SQL}, lines AS (SELECT * FROM (VALUES {_BOM}) t(title, qty)), p AS (SELECT title, qty, o.*, {LANDED_SQL} AS total, row_number() OVER (PARTITION BY title ORDER BY {LANDED_SQL}, product_id, supplier_id, moq) AS rn FROM lines JOIN part ON p_name = title JOIN offers o ON product_id = p_partkey WHERE is_active AND price_usd > 0) SELECT l.title, l.qty, total, product_id, supplier_id, greatest(0, moq - l.qty) AS overage FROM lines l LEFT JOIN p ON p.title = l.title AND rn = 1",
    "peer_median": f"WITH {OFFERS_SQL}, o AS (SELECT product_id, supplier_id, price_usd FROM offers WHERE is_active AND price_usd > 0), c AS (SELECT a.product_id, a.supplier_id, list(b.price_usd ORDER BY b.price_usd) FILTER (b.price_usd IS NOT NULL) AS l FROM o a LEFT JOIN o b ON a.product_id = b.product_id AND a.price_usd <> b.price_usd GROUP BY 1, 2) SELECT product_id, supplier_id, CASE WHEN len(l) >= 2 THEN l[len(l) // 2 + 1] END AS peer_median FROM c",
    "trust_levels": "WITH b AS (SELECT s_suppkey, r_name = 'ASIA' AS agent, CASE WHEN s_acctbal > 0 THEN s_acctbal / 2000 END AS rating, s_suppkey % 40 AS reviews FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey), c AS (SELECT s_suppkey, coalesce((rating <= 5 AND rating < 4.3) OR (rating > 5 AND rating < 97), false)::INT + (reviews < 10)::INT + agent::INT AS substantive, (rating IS NULL AND reviews = 0)::INT AS bare FROM b) SELECT s_suppkey, CASE WHEN substantive + bare >= 3 THEN 'risk' WHEN substantive = 0 AND bare = 1 THEN 'unknown' WHEN substantive > 0 THEN 'caution' ELSE 'ok' END AS level, substantive + bare AS reasons FROM c",
}
