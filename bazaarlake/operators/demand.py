"""Searches as demand: which of them may start a crawl, what their ledger says, and price, stock and new-site watches in batch form."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bazaarlake.functions import text, units
from bazaarlake.operators.monitoring import events
from bazaarlake.sources.catalog import OFFERS_SQL, Catalog


@dataclass(frozen=True)
class Policy:
    """When a search may start a crawl. The defaults."""

    enabled: bool = True
    min_results: int = 5
    cooldown_hours: int = 24
    max_queue: int = 20
    min_chars: int = 3
    per_client_hourly: int = 6

    @classmethod
    def of(cls, settings: dict | None) -> Policy:
        """Defaults overlaid by the settings that are named."""
        known = {f.name for f in fields(cls)}
        return cls(**{k: v for k, v in (settings or {}).items() if k in known and v is not None})


def overlaid(defaults: dict, block: dict | None) -> dict:
    """A site's settings: the defaults, key by key replaced by its own block, nested ones too."""
    out = dict(defaults)
    for key, value in (block or {}).items():
        out[key] = overlaid(out[key], value) if isinstance(value, dict) and isinstance(out.get(key), dict) else value
    return out


def outcome(keyword: Column, results: Column, inflight: Column, queued: Column, crawled_hours_ago: Column, started_in_hour: Column, client: Column, policy: Policy) -> Column:
    """What becomes of a request, by the first rule that holds. Callers without a name are never throttled; only what would start counts against a caller."""
    if not policy.enabled:
        return F.lit("off")
    throttled = client.isNotNull() & (client != "") & F.lit(policy.per_client_hourly > 0) & (started_in_hour >= policy.per_client_hourly)
    return (
        F.when(F.length(keyword) < policy.min_chars, "too_short").when(results >= policy.min_results, "have_results").when(inflight, "pending").when(queued >= policy.max_queue, "busy")
        .when(F.coalesce(crawled_hours_ago < policy.cooldown_hours, F.lit(False)), "cooldown").when(throttled, "throttled").otherwise("queued")
    )


def ledger(requests: DataFrame, crawls: DataFrame) -> DataFrame:
    """The state of every search. requests (keyword, display, ts, status), crawls (keyword, ts, found, error): requests are counted; a
    crawl's end stamps last_crawled whether it failed or not, so a blocked source isn't asked again at once."""
    asked = requests.groupBy("keyword").agg(F.min_by("display", "ts").alias("display"), F.count("*").alias("requests"), F.max("ts").alias("last_requested"), F.max_by("status", "ts").alias("asked_status"))
    done = crawls.groupBy("keyword").agg(F.max("ts").alias("last_crawled"), F.count("*").alias("crawls"), F.max_by("found", "ts").alias("offers_found"), F.max_by(F.substring("error", 1, 500), "ts").alias("last_error"))
    rows = asked.join(done, "keyword", "left")
    after = F.coalesce(F.col("last_crawled") >= F.col("last_requested"), F.lit(False))
    status = F.when(after, F.when(F.col("last_error").isNotNull(), "failed").otherwise("done")).otherwise(F.col("asked_status"))
    return rows.select("keyword", "display", "requests", "last_requested", "last_crawled", F.coalesce("crawls", F.lit(0)).alias("crawls"), F.coalesce("offers_found", F.lit(0)).alias("offers_found"), "last_error", status.alias("status"))


def demand_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ledger of the conversations' searches: each user turn asks, each answer of an assistant is a crawl of the same conversation's first words."""
    said = Catalog(spark, sf_dir).table("conversations").select(F.concat(F.lit("conversation "), "conv_id").alias("keyword"), "turn", "role", F.length("text").alias("size"))
    requests = said.filter("role = 'user'").select("keyword", F.col("keyword").alias("display"), F.col("turn").alias("ts"), F.lit("queued").alias("status"))
    crawls = said.filter("role = 'assistant'").select("keyword", F.col("turn").alias("ts"), "size", F.when(F.col("size") % 7 == 0, "timeout").alias("error")).withColumnRenamed("size", "found")
    return ledger(requests, crawls).select("keyword", "requests", "crawls", "offers_found", "last_error", "status")


def search_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcome of each event as a request: results stand in from its value, the keyword from its type, its client from its user.

    A row's place in the queue and its client's starts are those of the hour before it, as range frames give them."""
    hour = lambda *keys: Window.partitionBy(*keys).orderBy(F.unix_micros("ts"), "event_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = events(Catalog(spark, sf_dir)).select("event_id", "user_id", "ts", text.keyword(F.col("event_type")).alias("keyword"), F.col("value").cast("int").alias("results"))
    own = Window.partitionBy("user_id").orderBy(F.unix_micros("ts")).rangeBetween(-3_600_000_000, -1)
    rows = rows.withColumn("recent", F.count("*").over(own)).withColumn("last", F.max("ts").over(hour("user_id", "keyword")))
    ago = (F.unix_micros("ts") - F.unix_micros("last")) / 3.6e9
    found = outcome(F.col("keyword"), F.col("results"), F.lit(False), F.lit(0), ago, F.col("recent"), F.col("user_id").cast("string"), Policy(min_results=90, cooldown_hours=2, min_chars=5, per_client_hourly=1))
    return rows.select("event_id", found.alias("outcome"))


def watch_prices(offers: DataFrame, sites: DataFrame, watches: DataFrame) -> DataFrame:
    """Each watch with the best price of its product now (unit or landed, direct sites only if so asked), where it is, whether any offer
    is in stock, and the sites that sell it. watches: watch_id, product_id, use_landed, direct_only, target and state."""
    landed = F.expr("price_usd * greatest(moq, 1) + coalesce(shipping, 0.0)")
    rows = watches.join(offers, "product_id").join(F.broadcast(sites.select("site_id", "site_key", "needs_agent")), "site_id")  # tens of sites
    value = F.when(F.col("use_landed"), landed).otherwise(F.col("price_usd"))
    counts = (value > 0) & ~(F.col("direct_only") & F.col("needs_agent"))
    best = rows.groupBy("watch_id").agg(F.min(F.when(counts, F.struct(value.alias("price"), F.col("site_key").alias("site")))).alias("b"), F.bool_or("in_stock").alias("in_stock"), F.array_sort(F.collect_set("site_id")).alias("sites"))
    return watches.join(best, "watch_id").select(watches["*"], F.col("b.price").alias("price"), F.col("b.site").alias("site"), "in_stock", "sites")


def watch_step(now: DataFrame) -> DataFrame:
    """One pass over watches: now has watch_prices() and the state (last_price, last_in_stock, known_sites, baseline). Gives the new state and `fired`:
    new_site (not at the first check, which only learns the sites) before restock (only from known out of stock) before price (a fresh crossing). A
    watch without any price is left as it is."""
    known = F.coalesce("known_sites", F.array().cast("array<int>"))
    fresh = F.array_except(F.col("sites").cast("array<int>"), known)
    new_site = F.col("on_new_site") & (F.size(known) > 0) & (F.size(fresh) > 0)
    restock = F.col("on_restock") & F.col("in_stock") & F.coalesce(~F.col("last_in_stock"), F.lit(False))
    crossed = F.coalesce(F.col("price") <= F.col("target"), F.lit(False)) & ~F.coalesce(F.col("last_price") <= F.col("target"), F.lit(False))
    fired = F.when(F.col("price").isNotNull(), F.when(new_site, "new_site").when(restock, "restock").when(crossed, "price"))
    priced = F.col("price").isNotNull()
    # A new-site alert ends the pass before the stock is looked at.
    looked = priced & F.col("on_restock") & ~new_site
    return now.withColumn("fired", fired).select(
        "watch_id", "fired", "price", "site", F.col("last_price").alias("previous"), F.when(F.col("fired") == "new_site", fresh).alias("new_sites"), units.rounded(F.col("last_price") - F.col("price")).alias("drop"),
        F.when(priced, F.col("price")).otherwise(F.col("last_price")).alias("last_price"), F.when(looked, F.col("in_stock")).otherwise(F.col("last_in_stock")).alias("last_in_stock"),
        F.when(priced & F.col("on_new_site"), F.col("sites").cast("array<int>")).otherwise(F.col("known_sites").cast("array<int>")).alias("known_sites"), F.coalesce("baseline", "price").alias("baseline"),
    )


def alert_text(title: Column, fired: Column, price: Column, site: Column, target: Column, new_sites: Column) -> Column:
    """What an alert says."""
    money = F.format_string("$%.2f", price)
    wanted = F.when(target.isNotNull(), F.format_string(" (target $%.2f)", target)).otherwise("")
    name = F.substring(title, 1, 90)
    return F.when(fired == "new_site", F.concat(name, F.lit(" is now available on "), F.array_join(new_sites, ", "), F.lit(" as well -- best price "), money, F.lit(" on "), site)).when(fired == "restock", F.concat(name, F.lit(" is back in stock, "), money, F.lit(" on "), site)).when(fired.isNotNull(), F.concat(name, F.lit(" is "), money, F.lit(" on "), site, wanted))


def watch_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One pass over a watch of every product; kinds, targets and earlier states stand in from its key."""
    catalog, k = Catalog(spark, sf_dir), F.col("product_id")
    watches = catalog.products().select(
        k.alias("watch_id"), "product_id", (k % 2 == 0).alias("use_landed"), (k % 3 == 0).alias("direct_only"), (k % 4 == 1).alias("on_new_site"), (k % 4 == 2).alias("on_restock"), F.lit(3000.0).alias("target"),
        F.when(k % 5 != 0, (k % 7) * 1000.0).alias("last_price"), F.when(k % 3 == 1, False).when(k % 3 == 2, True).alias("last_in_stock"), F.when(k % 8 == 1, F.array(F.lit(1), F.lit(2))).alias("known_sites"), F.lit(None).cast("double").alias("baseline"),
    )
    out = watch_step(watch_prices(catalog.active_offers(), catalog.sites(), watches))
    return out.select("watch_id", "fired", "price", "previous", "drop", F.size("new_sites").alias("n_new_sites"), "last_in_stock")


QUERIES = {f.__name__: f for f in (demand_ledger, search_outcomes, watch_pass)}
_EVENTS = "r AS (SELECT event_id, user_id, ts, lower(trim(event_type)) AS keyword, CAST(trunc(value) AS INT) AS results, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 3600000000 PRECEDING AND 1 PRECEDING) AS recent, max(ts) OVER (PARTITION BY user_id, lower(trim(event_type)) ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM events)"
_WATCH = """w AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 5 <> 0 THEN (p_partkey % 7) * 1000.0::DOUBLE END AS previous, CASE p_partkey % 3 WHEN 1 THEN false WHEN 2 THEN true END AS was FROM part),
j AS (SELECT k, previous, was, in_stock, site_id, CASE WHEN k % 2 = 0 THEN price_usd * greatest(moq, 1) + coalesce(shipping, 0.0) ELSE price_usd END AS value, NOT (k % 3 = 0 AND r_name = 'ASIA') AS ok FROM w JOIN offers ON product_id = k JOIN nation ON n_nationkey = site_id JOIN region ON r_regionkey = n_regionkey WHERE is_active),
b AS (SELECT k, any_value(previous) AS previous, any_value(was) AS was, min(value) FILTER (value > 0 AND ok) AS price, bool_or(in_stock) AS stock, count(DISTINCT site_id) FILTER (site_id NOT IN (1, 2)) AS fresh FROM j GROUP BY 1),
a AS (SELECT *, k % 8 = 1 AND fresh > 0 AS new_site FROM b), f AS (SELECT *, CASE WHEN price IS NULL THEN NULL WHEN new_site THEN 'new_site' WHEN k % 4 = 2 AND stock AND coalesce(NOT was, false) THEN 'restock' WHEN price <= 3000 AND NOT coalesce(previous <= 3000, false) THEN 'price' END AS fired FROM a)"""
ORACLES = {
    "demand_ledger": "WITH s AS (SELECT 'conversation ' || conv_id AS keyword, turn, role, length(text) AS size FROM conversations), a AS (SELECT keyword, count(*) AS requests, max(turn) AS last_requested FROM s WHERE role = 'user' GROUP BY 1), c AS (SELECT keyword, count(*) AS crawls, max(turn) AS last_crawled, arg_max(size, turn) AS found, arg_max(coalesce(CASE WHEN size % 7 = 0 THEN 'timeout' END, ''), turn) AS err FROM s WHERE role = 'assistant' GROUP BY 1) SELECT keyword, requests, coalesce(crawls, 0) AS crawls, coalesce(found, 0) AS offers_found, nullif(err, '') AS last_error, CASE WHEN coalesce(last_crawled >= last_requested, false) THEN CASE WHEN err <> '' THEN 'failed' ELSE 'done' END ELSE 'queued' END AS status FROM a LEFT JOIN c USING (keyword)",
    "search_outcomes": f"WITH {_EVENTS} SELECT event_id, CASE WHEN length(keyword) < 5 THEN 'too_short' WHEN results >= 90 THEN 'have_results' WHEN coalesce((epoch_us(ts) - epoch_us(last)) / 3.6e9 < 2, false) THEN 'cooldown' WHEN recent >= 1 THEN 'throttled' ELSE 'queued' END AS outcome FROM r",
    "watch_pass": f"WITH {OFFERS_SQL}, {_WATCH} SELECT k AS watch_id, fired, price, previous, round_even(previous - price, 2) AS drop, CASE WHEN fired = 'new_site' THEN fresh END AS n_new_sites, CASE WHEN price IS NOT NULL AND k % 4 = 2 AND NOT new_site THEN stock ELSE was END AS last_in_stock FROM f",
}
