"""Raw listings into the catalog, as one commit a batch: listings with their specs, variants and tiers, suppliers, price history, quarantine.

A listing's versions are taken in order of seen_at, with its present row in front: sticky fields and children that a version
doesn't bring come from the one before, costs follow from both, and a version that is new or changes price or landed cost
adds a point to the history. So the result depends on the versions alone and not on how a stream cuts them into batches; in batches
that come late, versions no newer than the listing's last are left out, so a source read twice (a new checkpoint, a second stream)
loses and doubles nothing.

Listings and suppliers are dealt to buckets by key, and a batch rewrites those that it touches; history and quarantine only grow.
All of a batch's files are named by one line of a log, with the query and number of the batch: readers see a batch whole or not
at all, and a replay finds its line and stops. One writer at a time.

Rows without site, id, address, title or seen_at go to the quarantine with the reasons; of versions of a listing with one seen_at a
fixed one counts; null fields are kept as the rules of `operators.ingest` say; empty arrays count as absent."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bazaarlake.functions import text, units
from bazaarlake.functions.parsing import nfkc_each
from bazaarlake.operators import ingest
from bazaarlake.sources.catalog import Catalog
from bazaarlake.sources.mappings import bound
from bazaarlake.sources.tables import shared_dir, stored
from bazaarlake.streaming.bucket_store import BucketStore, fields_of

KEY = ["site_key", "listing_id"]
SPEC, VARIANT, TIER = "struct<key: string, value: string, key_norm: string, position: int>", "struct<sku: string, name: string, price: double, currency: string, in_stock: boolean, position: int>", "struct<min_qty: int, max_qty: int, price: double, currency: string>"
RAW = (
    "site_key string, listing_id string, url string, title string, seen_at timestamp, currency string, price_min double, price_max double, moq int, moq_unit string, shipping_cost double, shipping_currency string, shipping_free boolean, "
    "brand string, model string, mpn string, gtin string, seller_name string, seller_url string, years int, verified boolean, rating double, country string, description string, category_path string, payload string, detailed boolean, in_stock boolean, "
    "specs array<struct<key: string, value: string, position: int>>, variants array<struct<sku: string, name: string, price: double, currency: string, in_stock: boolean, position: int>>, tiers array<struct<min_qty: int, max_qty: int, price: double, currency: string>>"
)
LISTING = (
    "site_key string, listing_id string, url string, title string, currency string, price_min double, price_max double, moq int, moq_unit string, shipping_usd double, brand string, model string, mpn string, gtin string, "
    "seller_name string, seller_url string, years int, verified boolean, rating double, country string, description string, category_path string, payload string, detail_at timestamp, in_stock boolean, "
    f"specs array<{SPEC}>, variants array<{VARIANT}>, tiers array<{TIER}>, price_usd double, landed_usd double, first_seen timestamp, last_seen timestamp, versions long"
)
HISTORY = "site_key string, listing_id string, ts timestamp, price_usd double, landed_usd double, moq int, in_stock boolean"
SUPPLIER_FACTS = {"years": "int", "rating": "double", "url": "string", "country": "string", "name": "string"}
SUPPLIER = "site_key string, name_norm string, verified boolean, first_seen timestamp, last_seen timestamp, " + ", ".join(f"{c} struct<at: timestamp, {c}: {t}>" for c, t in SUPPLIER_FACTS.items())
QUARANTINE = f"{RAW}, reason string"
#: Part of the store: its columns and, where a batch rewrites buckets, their keys. A batch's listings lie among the versions that led to them (see `timeline`).
PARTS = {"listings": (f"{LISTING}, old boolean, changed boolean, last boolean", KEY), "suppliers": (SUPPLIER, ["site_key", "name_norm"]), "history": (HISTORY, None), "quarantine": (QUARANTINE, None)}
#: An update without them leaves them.
STICKY = ["description", "category_path", "payload", "detail_at", "shipping_usd", "specs", "variants", "tiers"]


def filled(array: Column) -> Column:
    """Null for an empty array."""
    return F.when(F.size(array) > 0, array)


def firsts(children: Column, key: str, kind: str) -> Column:
    """Of structs of the kind, the first by position of each key, by position; null for none. They are sorted by key, so that a listing of many is not compared pair by pair."""
    keyed = F.array_sort(F.transform(children, lambda c: F.struct(c[key].alias("k"), c["position"].alias("position"), c.alias("c"))))
    once = bound(keyed, lambda a: F.filter(a, lambda x, i: (i == 0) | (F.get(a, i - 1)["k"] != x["k"])))
    placed = F.array_sort(F.transform(once, lambda x: F.struct(x["position"].alias("position"), x["c"].alias("c"))))
    return filled(F.transform(placed, lambda x: x["c"]).cast(f"array<{kind}>"))


def versions(good: DataFrame) -> DataFrame:
    """Raw listings by the field rules: children cleaned, first of each name or sku; `pick` decides between versions of one seen_at. Only
    rows with letters outside ASCII have their compatibility forms folded, which takes a turn in Python."""
    rows = good.withColumns({"pick": F.xxhash64(*(F.col(c) for c in good.columns)), "names": F.transform("specs", lambda s: s["key"])})
    folds = F.concat_ws(" ", "brand", "mpn", "model", "names").rlike(r"[^\x00-\x7F]")
    plain = ingest.normalised(rows.filter(~folds), fold=text.as_is)
    return cleaned(plain).unionByName(cleaned(ingest.normalised(rows.filter(folds)).withColumn("names", nfkc_each("names"))))


def cleaned(rows: DataFrame) -> DataFrame:
    """Normalised listings with their other texts cut and their children cleaned; names: the attributes' names, folded."""
    rows = rows.withColumns({"detail_at": F.when(F.col("detailed"), F.col("seen_at")), "tiers": filled(F.array_sort("tiers"))})
    rows = rows.withColumns({"description": F.substring(F.nullif(F.col("description"), F.lit("")), 1, 20000), "category_path": F.substring(F.nullif(F.col("category_path"), F.lit("")), 1, 512), "payload": F.nullif(F.col("payload"), F.lit(""))})
    rows = rows.withColumn("names", F.transform("names", lambda k: F.substring(text.spec_key(k, text.as_is), 1, 200)))
    spec = lambda s, i: F.struct(F.substring(s["key"], 1, 200).alias("key"), F.substring(F.coalesce(s["value"], F.lit("")), 1, 1000).alias("value"), F.get("names", i).alias("key_norm"), s["position"].alias("position"))
    specs = F.filter(F.transform("specs", spec), lambda s: s["key_norm"] != "")
    sku = lambda v: F.substring(F.trim(F.coalesce(F.nullif(v["sku"], F.lit("")), v["name"], F.lit(""))), 1, 160)
    variant = lambda v: F.struct(sku(v).alias("sku"), *(v[c].alias(c) for c in ("name", "price", "currency", "in_stock", "position")))
    variants = F.filter(F.transform("variants", variant), lambda v: v["sku"] != "")
    return rows.withColumns({"specs": F.when(F.size("specs") > 0, firsts(specs, "key_norm", SPEC)), "variants": F.when(F.size("variants") > 0, firsts(variants, "sku", VARIANT))}).drop("names")


def timeline(state: DataFrame, fresh: DataFrame, bucket: Column) -> DataFrame:
    """All rows of state (listings as they stand) and those of fresh (versions) that are newer, one of each seen_at, in order of each listing, with what every
    version leaves: `old` marks the rows of state, `changed` the versions that add to the history, `last` the final row of a listing, which alone
    keeps its texts and children. The rows meet once, in the order of their buckets (bucket: of a listing's key)."""
    new = fresh.withColumns({"old": F.lit(False), "price_usd": F.lit(None).cast("double"), "landed_usd": F.lit(None).cast("double"), "first_seen": F.col("seen_at"), "last_seen": F.col("seen_at"), "versions": F.lit(1).cast("long")})
    columns = [*fields_of(LISTING), "old", "pick"]
    rows = state.withColumns({"old": F.lit(True), "pick": F.lit(0).cast("long")}).select(*columns).unionByName(new.select(*columns)).withColumn("bucket", bucket)
    order = Window.partitionBy("bucket", *KEY).orderBy(F.desc("old"), "last_seen", "pick")
    known = F.coalesce(F.col("last_seen") <= F.max(F.when(F.col("old"), F.col("last_seen"))).over(order), F.lit(False))
    again = F.lag("last_seen").over(order).eqNullSafe(F.col("last_seen"))
    rows = rows.withColumns({"known": known, "again": again}).filter("old OR NOT (known OR again)").drop("known", "again")
    rows = rows.withColumns({c: F.last(c, ignorenulls=True).over(order) for c in STICKY} | {"first_seen": F.min("first_seen").over(order), "versions": F.sum("versions").over(order)})
    found = F.transform(F.filter("specs", lambda s: F.trim(s["value"]) != ""), lambda s: F.struct(s["key_norm"].alias("k"), F.lower(F.trim(s["value"])).alias("v")))
    by_name = F.map_from_entries(F.coalesce(found, F.array().cast("array<struct<k: string, v: string>>")))
    read = ingest.harvested(rows.withColumn("by_name", by_name).withColumnsRenamed({"specs": "spec_list", "by_name": "specs"}))
    read = read.drop("specs").withColumnsRenamed({"spec_list": "specs"})
    sold = F.transform(F.filter("variants", lambda v: v["in_stock"] & (v["price"] > 0)), lambda v: v["price"])
    low, high = F.array_min(sold), F.array_max(sold)
    step = lambda ts: F.transform(ts, lambda t: F.struct(t["min_qty"].alias("min_qty"), t["price"].alias("price"), t["currency"].alias("currency")))
    tier = F.coalesce(F.array_max(step(F.filter("tiers", lambda t: t["min_qty"] <= F.col("moq")))), F.array_min(step(F.col("tiers"))))
    keep = lambda c, value: F.when(F.col("old"), F.col(c)).otherwise(value)
    out = read.withColumns({"low": low, "high": high, "tier": tier})
    out = out.withColumns({"price_max": keep("price_max", F.when(F.col("low").isNotNull(), F.when(F.col("high") > F.col("low"), F.col("high"))).otherwise(F.col("price_max"))), "price_min": keep("price_min", F.coalesce("low", "price_min")), "currency": keep("currency", F.coalesce("tier.currency", "currency"))})
    out = out.withColumn("price_usd", keep("price_usd", units.to_usd(F.coalesce("tier.price", "price_min"), F.col("currency"))))
    out = out.withColumn("landed_usd", keep("landed_usd", F.round(F.col("price_usd") * F.greatest(F.lit(1), F.col("moq")) + F.coalesce("shipping_usd", F.lit(0.0)), 4)))
    was = lambda c: F.lag(c).over(order)
    moved = was("old").isNull() | ~F.col("price_usd").eqNullSafe(was("price_usd")) | ~F.col("landed_usd").eqNullSafe(was("landed_usd"))
    out = out.withColumns({"changed": ~F.col("old") & moved, "last": F.lead("old").over(order).isNull()}).drop("low", "high", "tier", "pick")
    return out.withColumns({c: F.when(F.col("last"), F.col(c)) for c in ("description", "category_path", "payload", "specs", "variants", "tiers")})


def suppliers_of(rows: DataFrame) -> DataFrame:
    """Suppliers of versions: the latest known years (0 is none) and rating, the first known address, country and name, each with its time, so that later batches merge in any order.
    Rows are gathered by the name as it is written, and only what is left is cleaned."""
    given = rows.withColumns({"url": F.nullif(F.col("seller_url"), F.lit("")), "years": F.when(F.col("years") > 0, F.col("years")), "name": F.coalesce("seller_name", F.lit(""))})
    fact = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.col("last_seen").alias("at"), F.col(c).alias(c)))
    written = merged_suppliers(given.select("site_key", F.col("name").alias("name_norm"), F.coalesce("verified", F.lit(False)).alias("verified"), F.col("last_seen").alias("first_seen"), "last_seen", *(fact(c).alias(c) for c in SUPPLIER_FACTS)))
    name = written.withColumn("clean", text.clean(F.col("name_norm")))
    named = name.withColumns({"name": F.struct(F.col("name.at").alias("at"), F.substring("clean", 1, 200).alias("name")), "name_norm": F.substring(F.lower("clean"), 1, 200)}).drop("clean")
    return merged_suppliers(named.filter("name_norm <> ''"))


def merged_suppliers(rows: DataFrame) -> DataFrame:
    pick = {c: (F.max if c in ("years", "rating") else F.min)(c).alias(c) for c in SUPPLIER_FACTS}
    return rows.groupBy("site_key", "name_norm").agg(F.bool_or("verified").alias("verified"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), *pick.values())


class CatalogStore(BucketStore):
    """The catalog under path; `ingest` takes a batch in, `read` gives a part as the last commit left it."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 16):
        super().__init__(spark, path, PARTS, buckets)

    def read(self, part: str) -> DataFrame:
        """listings, suppliers, history or quarantine; specs, variants or tiers as rows of their listings."""
        return super().read(part) if part in PARTS else self.read("listings").select(*KEY, F.explode(part).alias("c")).select(*KEY, "c.*")

    def rows(self, part: str, folders: list[str]) -> DataFrame:
        found = super().rows(part, folders)
        return found.filter("coalesce(last, true)").select(*fields_of(LISTING)) if part == "listings" else found  # files of former batches may lack the mark

    def _not_held(self, bad: DataFrame, log: list) -> DataFrame:
        """Bad rows, each once, without those that the quarantine has."""
        one = bad.withColumn("row_key", F.xxhash64(*bad.columns)).dropDuplicates(["row_key"])
        held = self.rows("quarantine", sorted(self.folders(log, "quarantine").values()))
        return one.join(held.select(F.xxhash64(*bad.columns).alias("row_key")), "row_key", "left_anti").drop("row_key")

    def ingest(self, raw: DataFrame, batch: int | None = None, query: str = "") -> bool:
        """Take raw listings (RAW) in; False for a batch of the query that was taken in before. Without a number, the next one of the query."""
        log = self.log()
        if (named := self.next_batch(log, query, batch)) is None:
            return False
        batch, folder = named
        given = stored(raw.withColumn("seen_at", F.col("seen_at").cast("timestamp")), "ingest-raw")
        good, bad = ingest.checked(given, ("site_key", "listing_id", "url", "title", "seen_at"))
        rows = timeline(self.present("listings", good, log), versions(good), self.bucket("listings"))
        files = self.write("listings", rows, folder)
        taken = super().rows("listings", [f for _, _, f in files]).filter("NOT old")
        found = stored(suppliers_of(taken), "ingest-suppliers")
        same, rest = self.touched("suppliers", found, log)
        files += self.write("suppliers", rest.unionByName(merged_suppliers(same.unionByName(found))), folder)
        files += self.write("history", taken.filter("changed").select(*KEY, F.col("last_seen").alias("ts"), "price_usd", "landed_usd", "moq", "in_stock"), folder)
        files += self.write("quarantine", self._not_held(bad.select(*fields_of(QUARANTINE)), log), folder)
        self.commit(log, query, batch, files)
        return True

    def each_batch(self, query: str):
        """What foreachBatch calls: query names the stream and its checkpoint."""
        return lambda raw, batch: self.ingest(raw, batch, query) and None


def sample_raw(catalog: Catalog) -> DataFrame:
    """Order lines as raw listings of a product at a supplier: a version a day, so that listings come again and again, with fields and children only some versions bring."""
    line, supplier, nation = catalog.table("lineitem"), catalog.table("supplier"), catalog.table("nation")
    newest = F.max(F.struct("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_tax", "l_discount", "l_returnflag", "l_linestatus"))
    rows = line.groupBy("l_partkey", "l_suppkey", F.to_date("l_shipdate").alias("day")).agg(newest.alias("l")).select("l_partkey", "l_suppkey", "day", "l.*")
    rows = rows.join(supplier, F.col("s_suppkey") == F.col("l_suppkey")).join(nation, F.col("n_nationkey") == F.col("s_nationkey"))
    k, none = F.col("l_orderkey"), lambda t: F.lit(None).cast(t)
    moq = (F.col("l_quantity") % 10).cast("int")
    price = F.col("l_extendedprice")
    tier = lambda low, share: F.struct(F.lit(low).alias("min_qty"), none("int").alias("max_qty"), (price * share).alias("price"), F.lit("CNY").alias("currency"))
    variant = lambda sku, share, on: F.struct(F.lit(sku).alias("sku"), F.lit(sku).alias("name"), (price * share).alias("price"), F.lit("USD").alias("currency"), on.alias("in_stock"), F.lit(0).alias("position"))
    given = {
        "site_key": F.lower("n_name"), "listing_id": F.concat_ws("-", "l_partkey", "l_suppkey"), "url": F.concat(F.lit("https://shop.test/"), "l_partkey"), "title": F.when(k % 23 != 0, F.concat(F.lit("item "), "l_partkey")), "seen_at": F.col("day").cast("timestamp"),
        "currency": F.when(F.col("l_suppkey") % 3 == 0, "EUR").when(F.col("l_suppkey") % 3 == 1, ""), "price_min": F.when(k % 11 == 0, 0.0).otherwise(price), "price_max": price * 1.5, "moq": moq, "shipping_cost": F.when(F.col("l_tax") > 0.06, F.round(price * F.col("l_tax"), 2)), "shipping_free": F.col("l_tax") == 0,
        "seller_name": F.concat(F.lit(" "), "s_name"), "years": moq, "rating": F.when(F.col("l_discount") > 0.05, F.col("l_discount")), "verified": F.col("l_discount") >= 0.1, "description": F.when(F.col("l_linenumber") == 1, F.concat(F.lit("text "), "l_orderkey")), "detailed": F.col("l_linenumber") == 1, "in_stock": F.col("l_returnflag") != "R",
        "specs": F.when(k % 5 == 0, F.array(F.struct(F.lit("Model Number:").alias("key"), F.concat(F.lit("M"), "l_orderkey").alias("value"), F.lit(0).alias("position")))), "variants": F.when(k % 7 == 0, F.array(variant("a", 0.9, F.lit(True)), variant("b", 1.1, F.col("l_returnflag") != "R"))), "tiers": F.when(k % 4 == 0, F.array(tier(1, 0.8), tier(5, 0.7))),
    }
    kinds = dict(f.split(" ", 1) for f in _split_schema(RAW))
    return rows.select(*(given.get(c, none("string")).cast(kinds[c]).alias(c) for c in kinds))


def _split_schema(schema: str) -> list[str]:
    """The fields of a DDL schema, commas within types left alone."""
    out, depth = [""], 0
    for c in schema:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append("")
        elif out[-1] or c != " ":
            out[-1] += c
    return out


def ingested_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every listing after all its versions came in three batches out of order within each, with the points of its history."""
    store = CatalogStore(spark, f"{shared_dir(spark)}/catalog-{uuid.uuid4().hex}")
    raw = sample_raw(Catalog(spark, sf_dir))
    for low, high in zip(("1000-01-01", "1994-01-01", "1997-01-01"), ("1994-01-01", "1997-01-01", "9000-01-01"), strict=True):
        store.ingest(raw.filter((F.col("seen_at") >= low) & (F.col("seen_at") < high)), query="sample")
    points = store.read("history").groupBy(*KEY).agg(F.count("*").alias("points"))
    out = store.read("listings").join(points, KEY)
    return out.select(*KEY, "currency", "price_min", "price_max", "price_usd", "landed_usd", "shipping_usd", "model", "description", "versions", F.coalesce(F.size("tiers"), F.lit(0)).alias("tiers"), F.coalesce(F.size("variants"), F.lit(0)).alias("variants"), "points")


QUERIES = {f.__name__: f for f in (ingested_catalog,)}
_VERSIONS = """w AS (SELECT l_partkey, l_suppkey, l_shipdate::DATE AS day, max({'k': l_orderkey, 'n': l_linenumber, 'q': l_quantity, 'p': l_extendedprice, 't': l_tax, 'd': l_discount, 'r': l_returnflag}) AS l FROM lineitem GROUP BY 1, 2, 3),
v AS (SELECT lower(n_name) AS site_key, l_partkey || '-' || l_suppkey AS listing_id, day, l.k AS k, CASE l_suppkey % 3 WHEN 0 THEN 'EUR' ELSE 'USD' END AS ccy, CASE WHEN l.k % 11 <> 0 THEN l.p END AS low, l.p * 1.5::DOUBLE AS high, greatest(1, (l.q % 10)::INT) AS moq, l.p AS p,
  CASE WHEN l.t > 0.06 THEN round(round(l.p * l.t, 2) / CASE l_suppkey % 3 WHEN 0 THEN 0.92::DOUBLE ELSE 1.0::DOUBLE END, 4) WHEN l.t = 0 THEN 0.0::DOUBLE END AS ship, CASE WHEN l.n = 1 THEN 'text ' || l.k END AS d, l.k % 5 = 0 AS specs, l.k % 7 = 0 AS variants, l.k % 4 = 0 AS tiers, l.r <> 'R' AS stocked
  FROM w JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey WHERE l.k % 23 <> 0)"""
ORACLES = {
    "ingested_catalog": f"""WITH {_VERSIONS},
c AS (SELECT *, last_value(ship IGNORE NULLS) OVER o AS shipping_usd, last_value(d IGNORE NULLS) OVER o AS description, last_value(CASE WHEN specs THEN 'm' || k END IGNORE NULLS) OVER o AS m,
  last_value(CASE WHEN variants THEN {{'lo': p * 0.9::DOUBLE, 'hi': CASE WHEN stocked THEN p * 1.1::DOUBLE ELSE p * 0.9::DOUBLE END}} END IGNORE NULLS) OVER o AS s, last_value(CASE WHEN tiers THEN p END IGNORE NULLS) OVER o AS tp FROM v WINDOW o AS (PARTITION BY site_key, listing_id ORDER BY day)),
x AS (SELECT *, coalesce(s.lo, low) AS price_min, CASE WHEN s IS NOT NULL THEN CASE WHEN s.hi > s.lo THEN s.hi END WHEN low IS NULL OR high > low THEN high END AS price_max, CASE WHEN tp IS NULL THEN ccy ELSE 'CNY' END AS currency FROM c),
y AS (SELECT *, round(CASE WHEN tp IS NULL THEN price_min WHEN moq >= 5 THEN tp * 0.7::DOUBLE ELSE tp * 0.8::DOUBLE END / CASE currency WHEN 'CNY' THEN 7.15::DOUBLE WHEN 'EUR' THEN 0.92::DOUBLE ELSE 1.0::DOUBLE END, 4) AS price_usd FROM x),
z AS (SELECT *, round(price_usd * moq + coalesce(shipping_usd, 0.0::DOUBLE), 4) AS landed_usd FROM y),
h AS (SELECT *, row_number() OVER r = 1 OR price_usd IS DISTINCT FROM lag(price_usd) OVER r OR landed_usd IS DISTINCT FROM lag(landed_usd) OVER r AS changed, row_number() OVER (PARTITION BY site_key, listing_id ORDER BY day DESC) AS back FROM z WINDOW r AS (PARTITION BY site_key, listing_id ORDER BY day)),
n AS (SELECT site_key, listing_id, count(*) AS versions, count(*) FILTER (changed) AS points FROM h GROUP BY 1, 2)
SELECT site_key, listing_id, currency, price_min, price_max, price_usd, landed_usd, shipping_usd, m AS model, description, versions, CASE WHEN tp IS NULL THEN 0 ELSE 2 END AS tiers, CASE WHEN s IS NULL THEN 0 ELSE 2 END AS variants, points FROM h JOIN n USING (site_key, listing_id) WHERE back = 1""",
}
