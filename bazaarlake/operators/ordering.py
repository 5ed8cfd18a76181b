"""How to order an offer: directly or through forwarding agents, with all-in estimates; and text translated from a dictionary."""

from __future__ import annotations

from urllib.parse import quote_plus

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bazaarlake.functions import similarity, text
from bazaarlake.operators import matching
from bazaarlake.operators.economics import BASE_FEE, FALLBACK_KG, LEAST_FREIGHT, PER_KG, WEIGHTS, _prefix_sql, longest_prefix
from bazaarlake.sources.catalog import OFFERS_SQL, Catalog

#: Service fee and domestic shipping of an agent order; sample agents (key, home, link template, sites, place) and dictionary.
SERVICE_FEE, DOMESTIC_USD = 0.06, 1.50
AGENTS = [
    ("north", "https://www.north.example", "https://north.example/buy?url={url}", ["china", "japan"], 1),
    ("south", "https://south.example", "https://south.example/item/{id}", ["china", "india", "indonesia"], 2),
    ("own", "https://www.vietnam.example", "https://vietnam.example/{id}", ["vietnam"], 3),
]
#: The forwarders' addresses of an item by its source's address ({url}), id ({id}) and site ({site}, {mark}); the address where there
#: is no id, if another; what goes before a referral code; and what stands for the site.
FORWARDERS = [
    ("superbuy", "https://www.superbuy.com/en/page/buy/?url={url}", None, "&partnercode=", None),
    ("wegobuy", "https://www.wegobuy.com/en/page/buy/?from=search-input&url={url}", None, "&partnercode=", None),
    ("cssbuy", "https://www.cssbuy.com/{mark}{id}", "https://www.cssbuy.com/?url={url}", "?promotionCode=", {"1688": "item-micro-", "tmall": "item-tmall-", "taobao": "item-"}),
    ("sugargoo", "https://www.sugargoo.com/index/item/index.html?tp={site}&searchlink={url}", None, "&memberId=", None),
    ("hagobuy", "https://www.hagobuy.com/item/details?url={url}", None, "&affcode=", None),
    ("usfans", "https://www.usfans.com/?url={url}", None, "&ref=", None),
    ("cnfans", "https://cnfans.com/product?id={id}&platform={mark}&productUrl={url}&productPwd=", None, "&ref=", {"1688": "ALI_1688", "tmall": "TAOBAO", "taobao": "TAOBAO"}),
    ("greetbuy", "https://www.greetbuy.com/?url={url}", None, "&ref=", None),
    ("buckydrop", "https://www.buckydrop.com/en/sourcing?url={url}", None, "&ref=", None),
    ("parcelup", "https://parcelup.com/shop/?url={url}", None, "&ref=", None),
]
SAMPLE_REFS = {"superbuy": "r1", "cssbuy": "r2", "cnfans": "r3"}
DICTIONARY = [("red plate", "assiette rouge"), ("old anvil", "vieille enclume"), ("blue bolt", "boulon bleu")]


def bare_host(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.parse_url(url, F.lit("HOST"))), r"^www\.", "")


def item_id(url: Column) -> Column:
    """The numeric id in an item's address; empty if there is none."""
    return F.coalesce(F.nullif(F.regexp_extract(url, r"[?&]id=(\d+)", 1), F.lit("")), F.regexp_extract(url, r"/(?:offer/)?(\d+)\.html?", 1))


def sourced_id(url: Column, site_key: Column) -> Column:
    """The id a forwarder asks for, by the source's own form of address; null if there is none."""
    found = lambda pattern: F.nullif(F.regexp_extract(url, pattern, 1), F.lit(""))
    return F.when(site_key == "1688", found(r"/offer/(\d+)\.html")).otherwise(F.coalesce(found(r"[?&]id=(\d+)"), found(r"/(\d{9,})\.htm")))


def form_encoded(value: Column) -> Column:
    """A form's value: like Spark's url_encode, but a tilde stays and a star doesn't."""
    return F.replace(F.replace(F.url_encode(value), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def forwarder_addresses(offers: DataFrame, refs: dict[str, str] | None = None) -> DataFrame:
    """offers (url, site_key, anything else) to one row a forwarder: agent, link, place. A referral code is added where refs has the agent's, but not
    to the address that stands in where an item has no id; a null url gives a null link."""
    site, key, url = F.col("site_key"), sourced_id(F.col("url"), F.col("site_key")), form_encoded(F.col("url"))

    def link(agent: str, template: str, without_id: str | None, before: str, marks: dict[str, str] | None) -> Column:
        ref = (refs or {}).get(agent)
        full = F.lit(template + (before + quote_plus(ref) if ref else ""))
        out = full if without_id is None else F.when(key.isNull(), without_id).otherwise(full)
        mark = F.coalesce(*(F.when(site == s, m) for s, m in (marks or {}).items()), F.lit(""))
        for placeholder, value in (("{mark}", mark), ("{site}", F.coalesce(site, F.lit(""))), ("{id}", F.coalesce(key, F.lit(""))), ("{url}", url)):
            if placeholder in template + (without_id or ""):
                out = F.replace(out, F.lit(placeholder), value)
        return out

    links = [F.struct(F.lit(f[0]).alias("agent"), link(*f).alias("link"), F.lit(place).alias("place")) for place, f in enumerate(FORWARDERS)]
    return offers.select("*", F.inline(F.array(*links)))


def forwarder_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every product's addresses at the forwarders; its source, and with it the form of its address, stands in from its key (the last form has no id)."""
    k = F.col("product_id")
    site = F.element_at(F.array(*map(F.lit, ("1688", "taobao", "tmall"))), (k % 3 + 1).cast("int"))
    url = F.when(k % 3 == 0, F.concat(F.lit("https://detail.1688.com/offer/"), k, F.lit(".html"))).when(k % 3 == 1, F.concat(F.lit("https://item.taobao.com/item.htm?id="), k)).otherwise(F.concat(F.lit("https://detail.tmall.com/shop~/"), k, F.lit(".htm")))
    offers = Catalog(spark, sf_dir).products().select("product_id", site.alias("site_key"), url.alias("url"))
    return forwarder_addresses(offers, SAMPLE_REFS).select("product_id", "agent", "link", "place")


def ordering_links(offers: DataFrame, agents: DataFrame) -> DataFrame:
    """offers (offer_key, url, site_key, needs_agent) to one row a link: direct where no agent is needed; the agent whose own page
    the offer already is, alone; else every agent that supports the site, in order of place. agents is a small table of settings."""
    direct = offers.filter("NOT needs_agent").select("offer_key", F.lit("direct").alias("agent"), "url", F.lit(0).alias("place"))
    a = agents.select("agent", bare_host(F.col("home")).alias("home"), "template", F.explode("sites").alias("site_key"), "place")
    through = offers.filter("needs_agent").join(F.broadcast(a), "site_key")
    through = through.withColumn("own", bare_host(F.col("url")) == F.col("home"))
    hosted = through.filter("own").select("offer_key").distinct()
    link = F.replace(F.replace("template", F.lit("{url}"), F.url_encode("url")), F.lit("{id}"), item_id(F.col("url")))
    wrapped = through.join(hosted, "offer_key", "left_anti").select("offer_key", "agent", link.alias("url"), "place")
    return direct.unionByName(through.filter("own").select("offer_key", "agent", "url", "place")).unionByName(wrapped)


def agent_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog = Catalog(spark, sf_dir)
    rows = catalog.active_offers().join(F.broadcast(catalog.sites()), "site_id")  # 25 sites at any scale
    url = F.concat(F.lit("https://www."), F.replace("site_key", F.lit(" "), F.lit("-")), F.lit(".example/item?id="), F.col("product_id"))
    offers = rows.select(F.concat_ws("-", "product_id", "supplier_id").alias("offer_key"), url.alias("url"), "site_key", "needs_agent")
    return ordering_links(offers, spark.createDataFrame(AGENTS, "agent string, home string, template string, sites array<string>, place int"))


def agent_notice(name: Column, needs_agent: Column) -> Column:
    """What an item's page says where its site doesn't sell abroad; null where it does."""
    said = F.concat(name, F.lit(" sells within its own country only: it neither ships abroad nor takes most foreign cards. Order through a forwarding agent, who buys the item and sends it on; the agent's fee, domestic shipping and international freight come on top of the price."))
    return F.when(needs_agent, said)


def agent_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The notice on every site's offers, with the offers it stands on."""
    catalog = Catalog(spark, sf_dir)
    counts = catalog.active_offers().groupBy("site_id").agg(F.count("*").alias("offers"))
    return counts.join(catalog.sites(), "site_id").select("site_key", "offers", agent_notice(F.initcap("site_key"), F.col("needs_agent")).isNotNull().alias("warned"))


def agent_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Goods, service fee, domestic shipping and estimated freight of one unit."""
    items = longest_prefix(Catalog(spark, sf_dir).products(), WEIGHTS, "kg", FALLBACK_KG)
    freight = F.greatest(BASE_FEE + F.col("kg") * PER_KG, F.lit(LEAST_FREIGHT))
    return items.select("product_id", (F.col("list_price") + F.col("list_price") * SERVICE_FEE + DOMESTIC_USD + freight).alias("total_usd"))


def translated(rows: DataFrame, column: str, dictionary: DataFrame, provider: str) -> DataFrame:
    """rows with the column translated where the cache has its text under the provider's key; only distinct texts are looked up, others stay."""
    key = F.sha2(F.concat(F.lit(provider + "\x1f"), F.col(column)), 256)
    texts = rows.select(column).filter(F.col(column).isNotNull()).distinct().withColumn("key", key)
    known = texts.join(dictionary.select("key", "translation"), "key").select(column, "translation")
    return rows.join(known, column, "left").withColumn(column, F.coalesce("translation", column)).drop("translation")


def translate_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles translated from a cache keyed by provider and whole text; what it lacks stays."""
    words = spark.createDataFrame(DICTIONARY, "source string, translation string")
    dictionary = words.select(F.sha2(F.concat(F.lit("sample\x1f"), F.col("source")), 256).alias("key"), "translation")
    return translated(Catalog(spark, sf_dir).products().select("product_id", "title"), "title", dictionary, "sample")


def match_explain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every signal behind a pair's score, for the pairs of one brand and title and their next ones: no blocking, so any pair can be asked for."""
    catalog = Catalog(spark, sf_dir)
    titles = catalog.products().select("product_id", "title")
    pairs = matching.same_title_pairs(catalog).select("low_id", "high_id")
    both = pairs.join(titles.withColumnsRenamed({"product_id": "low_id", "title": "title_a"}), "low_id").join(titles.withColumnsRenamed({"product_id": "high_id", "title": "title_b"}), "high_id")
    a, b = text.normalize_title(F.col("title_a")), text.normalize_title(F.col("title_b"))
    ratio, overlap = similarity.token_set_ratio_udf(a, b) / 100, text.jaccard(text.title_tokens(F.col("title_a")), text.title_tokens(F.col("title_b")))
    none = F.lit(None).cast("double")
    out = both.select("low_id", "high_id", ratio.alias("token_ratio"), overlap.alias("jaccard")).withColumn("title_signal", 0.6 * F.col("token_ratio") + 0.4 * F.col("jaccard"))
    return out.withColumn("score", matching.score(none, F.col("title_signal"), none, F.lit(0), F.lit(False), F.lit(False))).withColumn("decision", matching.decide(F.col("score")))


QUERIES = {f.__name__: f for f in (agent_links, agent_notices, forwarder_links, agent_total, translate_titles, match_explain)}
_LINKED = f"""WITH {OFFERS_SQL}, s AS (SELECT n_nationkey AS site_id, lower(n_name) AS site_key, r_name = 'ASIA' AS needs_agent FROM nation JOIN region ON r_regionkey = n_regionkey),
o AS (SELECT product_id || '-' || supplier_id AS offer_key, 'https://www.' || replace(site_key, ' ', '-') || '.example/item?id=' || product_id AS url, replace(site_key, ' ', '-') || '.example' AS host, product_id, site_key, needs_agent FROM offers JOIN s USING (site_id) WHERE is_active),
a AS (SELECT agent, regexp_replace(replace(home, 'https://', ''), '^www\\.', '') AS home, template, unnest(sites) AS site_key, place FROM (VALUES {', '.join(f"('{k}', '{h}', '{t}', {s}, {p})" for k, h, t, s, p in AGENTS)}) t(agent, home, template, sites, place)),
j AS (SELECT o.*, agent, template, place, host = home AS own, bool_or(host = home) OVER (PARTITION BY offer_key) AS hosted FROM o JOIN a USING (site_key) WHERE needs_agent)"""
_SOURCED = """p AS (SELECT p_partkey AS product_id, p_partkey % 3 AS form, p_partkey::VARCHAR AS id FROM part),
u AS (SELECT product_id, form, id, CASE form WHEN 0 THEN '1688' WHEN 1 THEN 'taobao' ELSE 'tmall' END AS site, url_encode(CASE form WHEN 0 THEN 'https://detail.1688.com/offer/' || id || '.html' WHEN 1 THEN 'https://item.taobao.com/item.htm?id=' || id ELSE 'https://detail.tmall.com/shop~/' || id || '.htm' END) AS e FROM p),
l AS (SELECT product_id, unnest([
{'agent': 'superbuy', 'link': 'https://www.superbuy.com/en/page/buy/?url=' || e || '&partnercode=r1', 'place': 0}, {'agent': 'wegobuy', 'link': 'https://www.wegobuy.com/en/page/buy/?from=search-input&url=' || e, 'place': 1},
{'agent': 'cssbuy', 'link': CASE form WHEN 0 THEN 'https://www.cssbuy.com/item-micro-' || id || '?promotionCode=r2' WHEN 1 THEN 'https://www.cssbuy.com/item-' || id || '?promotionCode=r2' ELSE 'https://www.cssbuy.com/?url=' || e END, 'place': 2},
{'agent': 'sugargoo', 'link': 'https://www.sugargoo.com/index/item/index.html?tp=' || site || '&searchlink=' || e, 'place': 3}, {'agent': 'hagobuy', 'link': 'https://www.hagobuy.com/item/details?url=' || e, 'place': 4}, {'agent': 'usfans', 'link': 'https://www.usfans.com/?url=' || e, 'place': 5},
{'agent': 'cnfans', 'link': 'https://cnfans.com/product?id=' || CASE form WHEN 2 THEN '' ELSE id END || '&platform=' || CASE form WHEN 0 THEN 'ALI_1688' ELSE 'TAOBAO' END || '&productUrl=' || e || '&productPwd=&ref=r3', 'place': 6},
{'agent': 'greetbuy', 'link': 'https://www.greetbuy.com/?url=' || e, 'place': 7}, {'agent': 'buckydrop', 'link': 'https://www.buckydrop.com/en/sourcing?url=' || e, 'place': 8}, {'agent': 'parcelup', 'link': 'https://parcelup.com/shop/?url=' || e, 'place': 9}]) AS x FROM u)"""
ORACLES = {
    "agent_notices": f"WITH {OFFERS_SQL} SELECT lower(n_name) AS site_key, count(*) AS offers, any_value(r_name) = 'ASIA' AS warned FROM offers JOIN nation ON n_nationkey = site_id JOIN region ON r_regionkey = n_regionkey WHERE is_active GROUP BY 1",
    "forwarder_links": f"WITH {_SOURCED} SELECT product_id, x.agent AS agent, x.link AS link, x.place AS place FROM l",
    "agent_links": f"{_LINKED} SELECT offer_key, 'direct' AS agent, url, 0 AS place FROM o WHERE NOT needs_agent UNION ALL SELECT offer_key, agent, CASE WHEN own THEN url ELSE replace(replace(template, '{{url}}', url_encode(url)), '{{id}}', product_id::VARCHAR) END, place FROM j WHERE own OR NOT hosted",
    "agent_total": f"SELECT p_partkey AS product_id, p_retailprice + p_retailprice * {SERVICE_FEE}::DOUBLE + {DOMESTIC_USD}::DOUBLE + greatest({BASE_FEE}::DOUBLE + {_prefix_sql(WEIGHTS, FALLBACK_KG)}::DOUBLE * {PER_KG}::DOUBLE, {LEAST_FREIGHT}::DOUBLE) AS total_usd FROM (SELECT *, lower(p_type) || '/' || lower(p_brand) AS path FROM part)",
    "translate_titles": f"SELECT p_partkey AS product_id, coalesce(t, p_name) AS title FROM part LEFT JOIN (VALUES {', '.join(map(str, DICTIONARY))}) d(s, t) ON s = p_name",
}
