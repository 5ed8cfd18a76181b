"""Full-text search: an inverted index of seven fields as a table, concepts with synonyms and phrases, BM25 with field weights,
structured search over it, suggestions; categories by keywords; text views."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from bazaarlake.functions import text
from bazaarlake.operators import browse
from bazaarlake.operators.bm25 import FIELDS, K1, B, index_fields
from bazaarlake.operators.text_index import TEXTS, TextIndex, files_key
from bazaarlake.sources.catalog import OFFERS_SQL, Catalog
from bazaarlake.sources.tables import shared_dir, stored

#: Groups of interchangeable search terms.
SYNONYMS = [
    ["earbud", "earbuds", "earphone", "earphones", "headphone", "headphones", "headset", "tws", "airpod", "airpods"],
    ["wireless", "bluetooth", "bt"], ["charger", "charging", "adapter", "psu", "power supply"],
    ["powerbank", "power bank", "battery pack", "portable charger"], ["hub", "dock", "docking station", "splitter"],
    ["laptop", "notebook"], ["phone", "smartphone", "mobile", "cellphone"], ["torch", "flashlight"], ["led", "l.e.d"],
    ["drone", "quadcopter", "uav", "fpv"], ["camera", "cam", "webcam"], ["dashcam", "dash cam", "car dvr", "driving recorder"],
    ["watch", "smartwatch", "wristwatch"], ["screwdriver", "driver bit", "bit set"], ["drill", "driver", "impact driver"],
    ["case", "cover", "shell", "housing"], ["cable", "cord", "lead", "wire"], ["ssd", "solid state drive"],
    ["hdd", "hard drive", "hard disk"], ["usb-c", "usbc", "type-c", "typec", "type c"],
    ["sneaker", "sneakers", "trainers", "running shoes"], ["backpack", "rucksack", "knapsack"],
    ["3d printer", "3dprinter", "fdm printer"], ["filament", "pla", "petg", "abs filament"],
    ["soldering", "solder", "solder iron"], ["multimeter", "dmm", "volt meter", "voltmeter"],
    ["cctv", "surveillance", "security camera", "ip camera"], ["projector", "beamer"],
    ["keyboard", "keeb", "mechanical keyboard"], ["mouse", "mice"], ["speaker", "speakers", "soundbar"], ["microphone", "mic"],
]
#: The sample vocabulary's groups, categories and queries. The categories' keywords are a parameter of category_scores().
SAMPLE_SYNONYMS = [["bolt", "screw", "fastener"], ["widget", "gadget"], ["red plate", "crimson dish"]]
CATEGORIES = [("fasteners", ["bolt", "screw", "nut"]), ("tools", ["anvil", "hammer", "wrench"]), ("kitchen", ["plate", "pan", "red plate"]), ("parts", ["gear", "widget", "valve"])]
HINTS = [("metal", ["anvil", "iron"]), ("small", ["cog", "ring"])]
HINT_CONFIDENCE = 0.35
QUERY, PHRASE_QUERY, PART_QUERY, PREFIX, SUGGESTIONS = "red screw", "crimson dish", "ER#000000007", "re", 8
_CJK = re.compile("[㐀-鿿぀-ヿ가-힯]")


def catalog_fields(catalog: Catalog) -> DataFrame:
    """The seven fields of the sample catalog: an offer's raw title is the product's with the supplier's name."""
    suppliers = catalog.table("supplier").select(F.col("s_suppkey").alias("supplier_id"), "s_name")
    listed = catalog.table("lineitem").select(F.col("l_partkey").alias("product_id"), F.col("l_suppkey").alias("supplier_id")).distinct()
    titles = catalog.products().select("product_id", "title")
    offers = listed.join(suppliers, "supplier_id").join(titles, "product_id").select("product_id", F.concat_ws(" ", "title", "s_name").alias("title_raw"))
    kind = F.substring_index("path", "/", 1)
    products = catalog.products().select(
        "product_id", "title", "brand", F.concat(F.upper(F.substring(kind, 1, 2)), F.lit("-"), "size").alias("model"), F.lit(None).cast("string").alias("mpn"), F.lit(None).cast("string").alias("gtin"),
        F.create_map(F.lit("size"), F.col("size").cast("string"), F.lit("type"), kind).alias("specs"), "path",
    )
    return index_fields(products, offers)


def catalog_index(catalog: Catalog) -> TextIndex:
    """The index of the sample catalog in the shared folder: built when the tables' files are new, opened otherwise."""
    spark = catalog.spark
    key = files_key(spark, [f"{catalog.sf_dir}/{t}.parquet" for t in ("part", "supplier", "lineitem")])
    index = TextIndex(spark, f"{shared_dir(spark)}/catalog-index-whole-{key}")
    if index.state() is None:
        index.upsert(catalog_fields(catalog))
    return index


def expand(query: str, groups: list[list[str]] = SYNONYMS) -> list[list[str]]:
    """The query's concepts: phrases of the synonym groups first, longest first, then its words; each with its synonyms (of all groups that have it)."""
    left, out = " ".join(query.lower().split()), []
    alike = lambda term: sorted({t for g in groups if term in g for t in g} | {term})
    for phrase in sorted({t for g in groups for t in g if " " in t}, key=lambda t: (-len(t), t)):
        while phrase in left:
            left = left.replace(phrase, " ", 1)
            out.append(alike(phrase))
    bare = [w.strip(",.;:!?\"'()") for w in left.split()]
    return [*out, *(alike(w) for w in bare if w)]


def concepts_of(query: str, groups: list[list[str]] = SYNONYMS) -> list[list[str]]:
    """What must be found: every concept, by any of its terms; a term of one word is a prefix, of several a phrase. A query with
    Chinese, Japanese or Korean signs is cut into these, without synonyms."""
    safe = lambda t: " ".join(re.findall(r"[^\W_]+", t))
    if _CJK.search(query):
        return [[w] for w in safe(re.sub(f"({_CJK.pattern})", r" \1 ", query)).lower().split()]
    return [kept for terms in expand(query, groups) if (kept := sorted({s for t in terms if (s := safe(t))}))]


def like_any(products: DataFrame, query: str, columns: list[str]) -> DataFrame:
    """Products with the query as a substring of any of the columns, whatever its case and signs, score 0: for queries that the index has no hit for."""
    found = F.lit(False)
    for c in columns:
        found |= F.coalesce(F.contains(F.lower(F.col(c)), F.lower(F.lit(query))), F.lit(False))
    return products.filter(found).select("product_id", F.lit(0.0).alias("score")).distinct()


def search_products(index: TextIndex, query: str, groups: list[list[str]] = SYNONYMS) -> DataFrame:
    """Ranked products of a query in a TextIndex; the substring search only where the index finds none."""
    found = stored(index.scores(concepts_of(query, groups)), "search-found")
    if not query.strip() or not found.isEmpty():
        return found
    return like_any(index.members(), query.strip(), TEXTS)


def query_products(catalog: Catalog, query: str = "", path: str = "", site_ids: list[int] | None = None, direct_only: bool = False, max_moq: int | None = None, brand: str = "", min_price: float | None = None, max_price: float | None = None, sort: str = "relevance", groups: list[list[str]] = SYNONYMS, index: TextIndex | None = None) -> DataFrame:
    """All active products that a search and its filters leave, with `place` columns for browse.page(): the score orders a query
    sorted by relevance, otherwise the sort does; without either, most offers first. Count it before paging."""
    out = browse.listing(catalog)
    if query:
        out = out.join(search_products(index or catalog_index(catalog), query, groups), "product_id")
    if path:
        out = out.filter(browse.in_subtree(F.col("path"), path))
    if site_ids or direct_only or max_moq is not None:
        out = browse.with_offer(out, catalog.active_offers(), site_ids, direct_only, max_moq, catalog.sites())
    if brand:
        out = out.filter(F.lower("brand") == brand.lower())
    if min_price is not None:
        out = out.filter(F.col("best_price_usd") >= min_price)
    if max_price is not None:
        out = out.filter(F.col("best_price_usd") <= max_price)
    return out


def result_order(query: str, sort: str) -> list[Column]:
    if sort in browse.SORTS:
        return browse.sort_order(sort)
    return [F.desc("score"), F.asc("product_id")] if query else [F.desc("offer_count"), F.desc("product_id")]


def bm25_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best products of a query, from the stored index, ranges that can't reach them left unread."""
    return catalog_index(Catalog(spark, sf_dir)).top(concepts_of(QUERY, SAMPLE_SYNONYMS), 20)


def phrase_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query whose synonym is a phrase: words that stand together, in any field."""
    return catalog_index(Catalog(spark, sf_dir)).scores(concepts_of(PHRASE_QUERY, SAMPLE_SYNONYMS))


def substring_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query that the index has no word for: products with it as a part of a word, signs and case as they come."""
    return search_products(catalog_index(Catalog(spark, sf_dir)), PART_QUERY)


def index_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every term of the stored index: in how many products it stands, and how often, by field."""
    index = catalog_index(Catalog(spark, sf_dir))
    return index.terms().groupBy("field", "term").agg(F.count("*").alias("products"), F.sum("times").alias("times"))


def structured_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query, filters, order of relevance and first page."""
    found = query_products(Catalog(spark, sf_dir), QUERY, direct_only=True, max_moq=40, min_price=20.0, max_price=50000.0, groups=SAMPLE_SYNONYMS)
    return browse.page(found, result_order(QUERY, "relevance"), 1).select(*browse.CARD, "score")


def default_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A listing without a query: most offers first, newest product first among these."""
    return browse.page(query_products(Catalog(spark, sf_dir)), result_order("", "relevance"), 1).select(*browse.CARD)


def suggestions(index: TextIndex, prefix: str, k: int = SUGGESTIONS) -> DataFrame:
    """(suggestion, product_id): titles of the k best products for a prefix of two letters or more by unweighted BM25, each title once whatever its case."""
    concepts = concepts_of(prefix.strip(), []) if len(prefix.strip()) > 1 else []
    best = index.top(concepts, k, dict.fromkeys(FIELDS, 1.0))
    named = best.join(index.members().select("product_id", F.trim("title").alias("suggestion")), "product_id").filter("suggestion <> ''")
    return named.groupBy(F.lower("suggestion").alias("key")).agg(F.min(F.struct((-F.col("score")).alias("place"), "product_id", "suggestion")).alias("first")).select("first.suggestion", "first.product_id")


def suggest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suggestions(catalog_index(Catalog(spark, sf_dir)), PREFIX)


def expand_udf(groups: list[list[str]]):
    @F.pandas_udf(ArrayType(ArrayType(StringType())))
    def concepts(query: pd.Series) -> pd.Series:
        return query.map(lambda q: expand(q or "", groups))

    return concepts


def expand_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every title as a query, expanded to its concepts."""
    rows = Catalog(spark, sf_dir).products().select("product_id", expand_udf(SAMPLE_SYNONYMS)("title").alias("concepts"))
    return rows.select("product_id", F.array_join(F.transform("concepts", lambda c: F.array_join(c, "|")), " & ").alias("concepts"))


def category_scores(haystack: Column, categories: list[tuple[str, list[str]]], hints: list[tuple[str, list[str]]] = ()) -> Column:
    """Category and confidence of a text: the keywords it contains weigh 1, and 0.35 more for each space of theirs; the first of the
    heaviest wins if it weighs 1 at least, else the first whose hint is there; null without any."""
    weighed = [sum((F.when(F.contains(haystack, F.lit(k)), 1.0 + 0.35 * k.count(" ")).otherwise(0.0) for k in keywords), F.lit(0.0)) for _, keywords in categories]
    best = F.array_max(F.array(*(F.struct(w.alias("score"), F.lit(-n).alias("rank"), F.lit(slug).alias("category")) for n, ((slug, _), w) in enumerate(zip(categories, weighed, strict=True)))))
    kind = "struct<category: string, confidence: double>"
    out = F.when(best["score"] >= 1, F.struct(best["category"].alias("category"), F.least(F.lit(1.0), best["score"] / 3.0).alias("confidence")).cast(kind))
    for slug, found in hints:
        hit = F.lit(False)
        for h in found:
            hit |= F.contains(haystack, F.lit(h))
        out = out.when(hit, F.struct(F.lit(slug).alias("category"), F.lit(HINT_CONFIDENCE).alias("confidence")).cast(kind))
    return out


def category_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The category whose keywords weigh most in a title (phrases more than words), the first on ties, with a confidence; else a hint's."""
    rows = Catalog(spark, sf_dir).products().select("product_id", category_scores(F.lower("title"), CATEGORIES, HINTS).alias("c"))
    return rows.filter("c IS NOT NULL").select("product_id", "c.category", "c.confidence")


def normalized_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text, whole, in the normal form of titles."""
    return Catalog(spark, sf_dir).table("documents").select("doc_id", F.md5(text.normalize_title(F.col("text"))).alias("normalized_md5"))


#: One sign of each script, so that every language occurs.
SCRIPT_SIGNS = ["か", "汉", "한", "д", ""]


def detected_langs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages by script, of the texts with a sign of some script appended."""
    marked = F.concat("text", F.element_at(F.array(*map(F.lit, SCRIPT_SIGNS)), (F.col("doc_id") % len(SCRIPT_SIGNS) + 1).cast("int")))
    return Catalog(spark, sf_dir).table("documents").groupBy(text.detect_lang(marked).alias("guess")).agg(F.count("*").alias("n"))


def model_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = text.model_codes(F.col("text"))
    return Catalog(spark, sf_dir).table("benchmark").select("item_id", F.array_join(F.array_sort(codes), ",").alias("codes"))


def sha_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Catalog(spark, sf_dir).products().select("product_id", text.hash_key(F.col("title"), F.col("brand")).alias("key"))


def json_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Catalog(spark, sf_dir).table("events").groupBy("event_type").agg(F.sum(F.get_json_object("props", "$.k").cast("long")).alias("k"))


def html_title_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.regexp_extract("html", r"(?is)<title>(.*?)</title>", 1)
    return Catalog(spark, sf_dir).table("pages").select("page_id", title.alias("title"), F.regexp_count("html", F.lit(r"<a\s")).cast("long").alias("links"))


def item_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bare host and first run of digits of a page's address."""
    host = F.regexp_replace(F.lower(F.regexp_extract("url", r"^[a-z]+://([^/]+)", 1)), r"^www\.", "")
    return Catalog(spark, sf_dir).table("pages").select("page_id", host.alias("host"), F.regexp_extract("url", r"(\d+)", 1).alias("item"))


QUERIES = {f.__name__: f for f in (bm25_top, phrase_search, substring_search, index_terms, structured_search, default_order, suggest, expand_query, category_score, normalized_titles, detected_langs, model_codes, sha_key, json_path, html_title_links, item_ids)}
_FIELDS_SQL = f"""raw AS (SELECT p_partkey AS product_id, p_name AS title, string_agg(p_name || ' ' || s_name, ' ') AS title_raw, any_value(p_brand) AS brand, any_value(upper(p_type[1:2]) || '-' || p_size) AS model, any_value('size ' || p_size || ' type ' || lower(p_type)) AS specs, any_value(lower(p_type) || '/' || lower(p_brand)) AS path
  FROM part LEFT JOIN (SELECT DISTINCT l_partkey, s_name FROM lineitem JOIN supplier ON s_suppkey = l_suppkey) ON l_partkey = p_partkey GROUP BY 1, 2),
f AS ({' UNION ALL '.join(f"SELECT product_id, '{c}' AS field, {w}::DOUBLE AS w, {'model' + chr(32) + '||' + chr(32) + repr(' ') + ' || brand' if c == 'identifiers' else c} AS content FROM raw" for c, w in FIELDS.items())}),
t AS (SELECT product_id, field, w, regexp_extract_all(lower(content), '[\\p{{L}}\\p{{N}}]+') AS words FROM f WHERE content IS NOT NULL),
i AS (SELECT product_id, field, w, unnest(words) AS term FROM t), len AS (SELECT product_id, count(*) AS l FROM i GROUP BY 1), c AS (SELECT count(*) AS docs, sum(l) AS words FROM len)"""
_SCORE = f"sum(CAST(round(ln(1 + (docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * (tf * ({K1 + 1})) / (tf + {K1}::DOUBLE * (1 - {B}::DOUBLE + {B}::DOUBLE * l * docs / c.words)), 6) AS DECIMAL(18,6)))::DOUBLE"


def _bm25_sql(concepts: list[list[str]], weight: str = "w") -> str:
    """CTEs up to ranked (product_id, score) for concepts of single words."""
    case = " ".join(f"WHEN {' OR '.join(f'starts_with(term, {t!r})' for t in terms)} THEN {n}" for n, terms in enumerate(concepts))
    return f"{_FIELDS_SQL}, m AS (SELECT product_id, CASE {case} END AS concept, sum({weight}) AS tf FROM i GROUP BY 1, 2 HAVING concept IS NOT NULL), d AS (SELECT concept, count(*) AS df FROM m GROUP BY 1), ranked AS (SELECT product_id, {_SCORE} AS score FROM m JOIN d USING (concept) JOIN len USING (product_id), c GROUP BY 1 HAVING count(*) = {len(concepts)})"


_STOP = ", ".join(f"'{w}'" for w in text.STOPWORDS)
_CLEAN = r"trim(regexp_replace({}, '[\s]+', ' ', 'g'))"
_SCORES = {slug: " + ".join(f"CASE WHEN contains(lower(p_name), '{k}') THEN {1.0 + 0.35 * k.count(' ')} ELSE 0 END" for k in found) for slug, found in CATEGORIES}
_HINTED = "CASE " + " ".join(f"WHEN {' OR '.join(f'contains(lower(p_name), {h!r})' for h in found)} THEN '{slug}'" for slug, found in HINTS) + " END"
_GROUP = "CASE w " + " ".join(f"WHEN '{t}' THEN '{'|'.join(sorted(g))}'" for g in SAMPLE_SYNONYMS for t in g if " " not in t) + " ELSE w END"
_PHRASES = [" " + "  ".join(t.split()) + " " for t in concepts_of(PHRASE_QUERY, SAMPLE_SYNONYMS)[0]]
_TIMES = " + ".join(f"(length(s) - length(replace(s, '{p}', ''))) // {len(p)}" for p in _PHRASES)
ORACLES = {
    "bm25_top": f"WITH {_bm25_sql(concepts_of(QUERY, SAMPLE_SYNONYMS))} SELECT product_id, score FROM ranked ORDER BY score DESC, product_id LIMIT 20",
    "phrase_search": f"WITH {_FIELDS_SQL}, p AS (SELECT product_id, w, ' ' || array_to_string(t.words, '  ') || ' ' AS s FROM t), m AS (SELECT product_id, 0 AS concept, sum(w * ({_TIMES})) AS tf FROM p GROUP BY 1 HAVING tf > 0), d AS (SELECT concept, count(*) AS df FROM m GROUP BY 1) SELECT product_id, {_SCORE} AS score FROM m JOIN d USING (concept) JOIN len USING (product_id), c GROUP BY 1",
    "substring_search": f"WITH {_FIELDS_SQL} SELECT product_id, 0.0::DOUBLE AS score FROM raw WHERE contains(lower(concat_ws(chr(31), title, title_raw, brand, model)), lower('{PART_QUERY}'))",
    "index_terms": f"WITH {_FIELDS_SQL} SELECT field, term, count(DISTINCT product_id) AS products, count(*) AS times FROM i GROUP BY 1, 2",
    "structured_search": f"{browse.LISTING_SQL}, {_bm25_sql(concepts_of(QUERY, SAMPLE_SYNONYMS))} SELECT {', '.join(browse.CARD)}, score FROM listing JOIN ranked USING (product_id) WHERE best_price_usd BETWEEN 20 AND 50000 AND EXISTS (SELECT 1 FROM offers o JOIN nation ON n_nationkey = o.site_id JOIN region ON r_regionkey = n_regionkey WHERE o.product_id = listing.product_id AND is_active AND r_name <> 'ASIA' AND moq <= 40) ORDER BY score DESC, product_id LIMIT {browse.PAGE}",
    "default_order": f"{browse.LISTING_SQL} SELECT {', '.join(browse.CARD)} FROM listing ORDER BY offer_count DESC, product_id DESC LIMIT {browse.PAGE}",
    "suggest": f"WITH {_bm25_sql([[PREFIX]], '1.0::DOUBLE')}, b AS (SELECT product_id, score, p_name AS suggestion FROM ranked JOIN part ON p_partkey = product_id ORDER BY score DESC, product_id LIMIT {SUGGESTIONS}) SELECT first(suggestion ORDER BY score DESC, product_id) AS suggestion, first(product_id ORDER BY score DESC, product_id) AS product_id FROM b GROUP BY lower(suggestion)",
    "expand_query": f"SELECT p_partkey AS product_id, CASE WHEN contains(p_name, 'red plate') THEN 'crimson dish|red plate' ELSE array_to_string(list_transform(string_split(lower(p_name), ' '), lambda w: {_GROUP}), ' & ') END AS concepts FROM part",
    "category_score": "WITH s AS (" + " UNION ALL ".join(f"SELECT p_partkey AS product_id, p_name, {n} AS rank, '{slug}' AS category, ({q})::DOUBLE AS score FROM part" for n, (slug, q) in enumerate(_SCORES.items())) + f"), b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY score DESC, rank) AS rn FROM s) WHERE rn = 1) SELECT product_id, CASE WHEN score >= 1 THEN category ELSE {_HINTED} END AS category, CASE WHEN score >= 1 THEN least(1.0::DOUBLE, score / 3.0::DOUBLE) ELSE {HINT_CONFIDENCE}::DOUBLE END AS confidence FROM b WHERE score >= 1 OR {_HINTED} IS NOT NULL",
    "normalized_titles": "SELECT doc_id, md5(array_to_string(list_filter(regexp_split_to_array(regexp_replace(lower(" + _CLEAN.format("replace(coalesce(text, ''), '…', '...')") + r"), '[^\p{L}\p{N}_\s.+#-]', ' ', 'g'), '\s+'), lambda w: length(w) > 1 AND w NOT IN (" + _STOP + ")), ' ')) AS normalized_md5 FROM documents",
    "detected_langs": f"WITH m AS (SELECT text || {SCRIPT_SIGNS!r}[doc_id % {len(SCRIPT_SIGNS)} + 1] AS text FROM documents) SELECT CASE WHEN coalesce(text, '') = '' THEN 'und' " + " ".join(f"WHEN regexp_matches(text, '{s}') THEN '{lang}'" for lang, s in text.SCRIPTS) + " ELSE 'en' END AS guess, count(*) AS n FROM m GROUP BY 1",
    "model_codes": "SELECT item_id, coalesce(array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(upper(" + _CLEAN.format("text") + f"), '{text.MODEL_CODE}', 1), lambda c: regexp_replace(c, '[-\\s_]', '', 'g')))), ','), '') AS codes FROM benchmark",
    "sha_key": "SELECT p_partkey AS product_id, sha256(p_name || chr(31) || p_brand || chr(31)) AS key FROM part",
    "json_path": "SELECT event_type, CAST(sum(CAST(regexp_extract(props, '\"k\": *([0-9]+)', 1) AS BIGINT)) AS BIGINT) AS k FROM events GROUP BY 1",
    "html_title_links": r"SELECT page_id, regexp_extract(html, '(?is)<title>(.*?)</title>', 1) AS title, CAST(len(regexp_extract_all(html, '<a\s')) AS BIGINT) AS links FROM pages",
    "item_ids": r"SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/]+)', 1)), '^www\.', '') AS host, regexp_extract(url, '(\d+)', 1) AS item FROM pages",
}
