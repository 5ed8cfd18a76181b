"""Ledgers and event streams in batch form: source health, watches, throttling, event-time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bazaarlake.functions import text
from bazaarlake.sources.catalog import OFFERS_SQL, Catalog

#: Fixed values of the health and watch rules.
RECENT, BASELINE, DEGRADED = 5, 20, 0.35
TARGET, THROTTLE, SPLIT = 40.0, 1, "2024-01-02"


def events(catalog: Catalog) -> DataFrame:
    """Events with ts as an instant (the files carry it without a zone)."""
    return catalog.table("events").withColumn("ts", F.col("ts").cast("timestamp"))


def site_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status of each source from its last five runs against the fifteen before (the same runs if there are none)."""
    newest = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    runs = events(Catalog(spark, sf_dir)).withColumn("seen", F.coalesce(F.col("value").cast("int"), F.lit(0))).withColumn("rn", F.row_number().over(newest)).filter(F.col("rn") <= BASELINE)
    late = F.col("rn") <= RECENT
    of = runs.groupBy(F.col("user_id").alias("site")).agg(F.count("*").alias("runs"), F.count_if(late).alias("n"), F.sum(F.when(late, F.col("seen"))).alias("recent"), F.sum(F.when(~late, F.col("seen"))).alias("before"), F.count_if(late & (F.col("event_type") == "error")).alias("failures"))
    of = of.withColumn("recent_avg", F.col("recent") / F.col("n")).withColumn("baseline_avg", F.coalesce(F.col("before") / F.nullif(F.col("runs") - F.col("n"), F.lit(0)), F.col("recent_avg")))
    status = F.when(F.col("failures") >= F.expr("greatest(2, n div 2)"), "blocked").when((F.col("recent_avg") == 0) & (F.col("baseline_avg") > 0), "broken").when(F.col("recent_avg") == 0, "idle").when(F.col("runs") <= RECENT, "new").when(F.col("recent_avg") < F.col("baseline_avg") * DEGRADED, "degraded").otherwise("ok")
    return of.select("site", "failures", "recent_avg", "baseline_avg", status.alias("status"))


def statuses(sites: DataFrame, runs: DataFrame, active: DataFrame) -> DataFrame:
    """Status of every site, by the first rule that holds: disabled, idle (no runs), blocked, broken (nothing now, something before), nothing at all (idle
    without active offers, else broken), new, degraded, ok.

    sites (site, enabled: null is on), runs (site, run_id, started_at, seen, ok) that have finished, active (site, offers). The newest RECENT runs are held
    against the BASELINE - RECENT before; started_at ties go by run_id. Null counts are 0, a null ok is no failure."""
    newest = Window.partitionBy("site").orderBy(F.desc("started_at"), F.desc("run_id"))
    last = runs.withColumn("rn", F.row_number().over(newest)).filter(F.col("rn") <= BASELINE).withColumns({"late": F.col("rn") <= RECENT, "seen": F.coalesce("seen", F.lit(0))})
    of = last.groupBy("site").agg(F.count("*").alias("runs"), F.count_if("late").alias("n"), F.avg(F.when(F.col("late"), F.col("seen"))).alias("recent_avg"), F.avg(F.when(~F.col("late"), F.col("seen"))).alias("before"), F.count_if(F.col("late") & ~F.coalesce("ok", F.lit(True))).alias("failures"))
    rows = sites.join(of, "site", "left").join(active, "site", "left").withColumns({"baseline_avg": F.coalesce("before", "recent_avg", F.lit(0.0)), "recent_avg": F.coalesce("recent_avg", F.lit(0.0)), "failures": F.coalesce("failures", F.lit(0)), "offers": F.coalesce("offers", F.lit(0))})
    now, before = F.col("recent_avg"), F.col("baseline_avg")
    status = (
        F.when(~F.coalesce("enabled", F.lit(True)), "disabled").when(F.col("runs").isNull(), "idle").when(F.col("failures") >= F.expr("greatest(2, n div 2)"), "blocked").when((now == 0) & (before > 0), "broken")
        .when(now == 0, F.when(F.col("offers") == 0, "idle").otherwise("broken")).when(F.col("runs") <= RECENT, "new").when(now < before * DEGRADED, "degraded").otherwise("ok")
    )
    return rows.select("site", status.alias("status"), "failures", "recent_avg", "baseline_avg", "offers")


def site_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as sites, events as their runs: some disabled, some that never ran, some that find nothing, with or without offers."""
    catalog = Catalog(spark, sf_dir)
    k = F.col("s_suppkey")
    sites = catalog.table("supplier").select(k.alias("site"), (k % 17 != 0).alias("enabled"))
    seen = F.when(F.col("user_id") % 5 == 0, 0).otherwise(F.when(F.col("user_id") % 5 != 1, F.col("value").cast("int")).when(F.col("ts") < F.lit("2024-01-25").cast("timestamp"), 9).otherwise(0))
    ran = events(catalog).filter((F.col("user_id") % 11 != 0) & ((F.col("user_id") % 13 != 0) | (F.col("event_id") % 40 == 0)))
    runs = ran.select(F.col("user_id").alias("site"), F.col("event_id").alias("run_id"), F.col("ts").alias("started_at"), seen.alias("seen"), (F.col("event_type") != "error").alias("ok"))
    active = catalog.active_offers().filter("supplier_id % 2 = 0").groupBy(F.col("supplier_id").alias("site")).agg(F.count("*").alias("offers"))
    return statuses(sites, runs, active)


def health_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources per status, zeros included."""
    every = spark.createDataFrame([(s,) for s in ("disabled", "idle", "blocked", "broken", "new", "degraded", "ok")], "status string")
    return every.join(site_health(spark, sf_dir).groupBy("status").agg(F.count("*").alias("n")), "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n"))


def watch_crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices that reach the target from above; the first price fires if it is there already."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    ticks = events(Catalog(spark, sf_dir)).withColumn("previous", F.lag("value").over(w))
    return ticks.filter((F.col("value") <= TARGET) & ~F.coalesce(F.col("previous") <= TARGET, F.lit(False))).select("event_id", "user_id", "value", "previous")


def new_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per user what occurs since the split and never did before."""
    since = F.col("ts") >= F.lit(SPLIT).cast("timestamp")
    sets = events(Catalog(spark, sf_dir)).groupBy("user_id").agg(F.collect_set(F.when(since, F.col("event_type"))).alias("now"), F.collect_set(F.when(~since, F.col("event_type"))).alias("known"))
    return sets.select("user_id", F.explode(F.array_except("now", "known")).alias("event_type"))


def demand_hourly_throttle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests over the hourly limit of their client: a range frame over the hour before each."""
    hour = Window.partitionBy("user_id").orderBy(F.unix_micros("ts")).rangeBetween(-3_600_000_000, 0)
    return events(Catalog(spark, sf_dir)).withColumn("in_hour", F.count("*").over(hour)).filter(F.col("in_hour") > THROTTLE).select("event_id", "user_id", "in_hour")


def demand(catalog: Catalog) -> DataFrame:
    """Searches asked for: what users say, whole, under its key, with a number of offers found (the turn stands in for it)."""
    asked = catalog.table("conversations").filter("role = 'user'").select(text.keyword(F.col("text")).alias("keyword"), F.col("turn").alias("found"))
    return asked.groupBy("keyword").agg(F.count("*").alias("requests"), F.max("found").alias("offers_found"))


def demand_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Most requested searches."""
    return demand(Catalog(spark, sf_dir)).orderBy(F.desc("requests"), "keyword").limit(25)


def failed_demand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Most requested searches that found nothing."""
    return demand(Catalog(spark, sf_dir)).filter("offers_found = 0").orderBy(F.desc("requests"), "keyword").limit(25)


def tumbling_event_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(Catalog(spark, sf_dir)).groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def sliding_event_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(Catalog(spark, sf_dir)).groupBy(F.window("ts", "1 hour", "30 minutes").alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "n")


def session_event_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(Catalog(spark, sf_dir)).groupBy(F.session_window("ts", "6 hours").alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


QUERIES = {f.__name__: f for f in (site_health, site_status, health_summary, watch_crossings, new_sites, demand_hourly_throttle, demand_report, failed_demand, tumbling_event_counts, sliding_event_counts, session_event_counts)}
_HEALTH = f"""r AS (SELECT user_id, event_type, coalesce(CAST(trunc(value) AS INT), 0) AS seen, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events),
g AS (SELECT user_id AS site, count(*) AS runs, count(*) FILTER (rn <= {RECENT}) AS n, sum(seen) FILTER (rn <= {RECENT}) AS recent, sum(seen) FILTER (rn > {RECENT}) AS before, count(*) FILTER (rn <= {RECENT} AND event_type = 'error') AS failures FROM r WHERE rn <= {BASELINE} GROUP BY 1),
h AS (SELECT *, recent / n AS recent_avg, coalesce(before / nullif(runs - n, 0), recent / n) AS baseline_avg FROM g),
health AS (SELECT site, failures, recent_avg, baseline_avg, CASE WHEN failures >= greatest(2, n // 2) THEN 'blocked' WHEN recent_avg = 0 AND baseline_avg > 0 THEN 'broken' WHEN recent_avg = 0 THEN 'idle' WHEN runs <= {RECENT} THEN 'new' WHEN recent_avg < baseline_avg * {DEGRADED} THEN 'degraded' ELSE 'ok' END AS status FROM h)"""
_DEMAND = r"WITH d AS (SELECT lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS keyword, count(*) AS requests, max(turn) AS offers_found FROM conversations WHERE role = 'user' GROUP BY 1)"
ORACLES = {
    "site_health": f"WITH {_HEALTH} SELECT * FROM health",
    "site_status": f"""WITH {OFFERS_SQL}, e AS (SELECT user_id AS site, event_type <> 'error' AS ok, CASE WHEN user_id % 5 = 0 THEN 0 WHEN user_id % 5 <> 1 THEN coalesce(trunc(value), 0) WHEN ts < TIMESTAMP '2024-01-25' THEN 9 ELSE 0 END AS seen, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events WHERE user_id % 11 <> 0 AND (user_id % 13 <> 0 OR event_id % 40 = 0)),
a AS (SELECT site, count(*) AS runs, least(count(*), {RECENT}) AS n, avg(seen) FILTER (rn <= {RECENT}) AS now, avg(seen) FILTER (rn > {RECENT}) AS before, count(*) FILTER (rn <= {RECENT} AND NOT ok) AS failures FROM e WHERE rn <= {BASELINE} GROUP BY 1),
o AS (SELECT supplier_id AS site, count(*) AS offers FROM offers WHERE is_active AND supplier_id % 2 = 0 GROUP BY 1),
j AS (SELECT s_suppkey AS site, runs, n, coalesce(failures, 0) AS failures, coalesce(now, 0.0::DOUBLE) AS recent_avg, coalesce(before, now, 0.0::DOUBLE) AS baseline_avg, coalesce(offers, 0) AS offers FROM supplier LEFT JOIN a ON a.site = s_suppkey LEFT JOIN o ON o.site = s_suppkey)
SELECT site, CASE WHEN site % 17 = 0 THEN 'disabled' WHEN runs IS NULL THEN 'idle' WHEN failures >= greatest(2, n // 2) THEN 'blocked' WHEN recent_avg = 0 AND baseline_avg > 0 THEN 'broken' WHEN recent_avg = 0 AND offers = 0 THEN 'idle' WHEN recent_avg = 0 THEN 'broken' WHEN runs <= {RECENT} THEN 'new' WHEN recent_avg < baseline_avg * {DEGRADED} THEN 'degraded' ELSE 'ok' END AS status, failures, recent_avg, baseline_avg, offers FROM j""",
    "health_summary": f"WITH {_HEALTH} SELECT s.status, count(site) AS n FROM (VALUES ('disabled'), ('idle'), ('blocked'), ('broken'), ('new'), ('degraded'), ('ok')) s(status) LEFT JOIN health h ON h.status = s.status GROUP BY 1",
    "watch_crossings": f"SELECT event_id, user_id, value, previous FROM (SELECT *, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous FROM events) WHERE value <= {TARGET} AND NOT coalesce(previous <= {TARGET}, false)",
    "new_sites": f"SELECT DISTINCT user_id, event_type FROM events e WHERE ts >= TIMESTAMP '{SPLIT}' AND NOT EXISTS (SELECT 1 FROM events k WHERE k.user_id = e.user_id AND k.event_type = e.event_type AND k.ts < TIMESTAMP '{SPLIT}')",
    "demand_hourly_throttle": f"SELECT event_id, user_id, in_hour FROM (SELECT *, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS in_hour FROM events) WHERE in_hour > {THROTTLE}",
    "demand_report": f"{_DEMAND} SELECT * FROM d ORDER BY requests DESC, keyword LIMIT 25",
    "failed_demand": f"{_DEMAND} SELECT * FROM d WHERE offers_found = 0 ORDER BY requests DESC, keyword LIMIT 25",
    "tumbling_event_counts": "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "sliding_event_counts": "SELECT start, count(*) AS n FROM (SELECT time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE * k AS start FROM events, (VALUES (0), (1)) t(k)) GROUP BY 1",
    "session_event_counts": "SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS opens FROM events)) GROUP BY user_id, s",
}
