"""Secret scans with corpus-wide ownership frequency, in DataFrame functions only.

Each text is scanned for credentials of the base kinds and for long random-looking tokens. The hashes of
all candidates' values are then counted over the corpus by distinct repositories and owners: a value that
several repositories of several owners hold is a widely copied example, one that only its owner has, in
however many repositories, looks live. Where the table names no owner, repositories alone decide. Base spans
are all reported, with their verdict; a token is reported only when it looks live and overlaps no base span.

A text's matches are put between marks and the text is split there; the parts become rows, and running sums
of their lengths in a window give the places, so the work is linear in the matches however many a text has.
Counts are pre-aggregated by (value, repository, owner) before they are counted by value, and values are
looked up with hot ones apart, so a value that a third of the rows share is no task's burden.

Defined results: null text counts as empty; empty texts have no spans; rows with the same doc_id and text
are one document; a null doc_id or repository is a value like any other; an empty table gives no rows;
other columns are ignored, and pass through `redact`. Texts are scanned whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bazaarlake.llm.common import documents, lookup, prepare, stored

ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: kind: pattern of the spans, in the order of the report. Runs too short are left out by the patterns
#: where that gives the same spans, and afterwards for assignments, whose short matches consume text.
KINDS = {"assign": ASSIGN, "access": "AKIA[A-Z0-9]{14,}", "hex": "[0-9a-f]{16,}", "token": r"[A-Za-z0-9_-]{24,}"}
ORDER = list(KINDS)
BASE_KINDS = 3
VALUE_CHARS = 12  # of an assignment's value
EXAMPLE_REPOSITORIES, EXAMPLE_OWNERS = 3, 2  # a value in so many repositories, of so many owners, is an example
MARK, STAND_IN = "\ue000", "\ue001"
MASK, BLOCK_CHARS = "[SECRET]", 4096  # texts are masked by blocks of so many characters


def _parts(text: Column, ord_: int) -> Column:
    """The text split at both ends of the kind's matches, which are the parts of odd index; null without any."""
    pattern = KINDS[ORDER[ord_]]
    return F.when(text.rlike(pattern), F.split(F.regexp_replace(text, pattern, f"{MARK}$0{MARK}"), MARK, -1))


def _report(spans: Column) -> Column:
    """kind:start:end of the spans by start, then kind, joined by commas."""
    names = F.array(*map(F.lit, ORDER))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", names[s["ord"]], s["start"], s["end"])), ",")


def _text(docs: DataFrame) -> Column:
    return F.coalesce(docs["text"], F.lit(""))


def candidates(docs: DataFrame, repository: str, owner: str | None) -> DataFrame:
    """doc_id, text_key, repository, owner, span (start, ord, end) and hash of the value, for every base span and every token apart from those."""
    text = _text(docs)
    safe = F.when(F.contains(text, F.lit(MARK)), F.translate(text, MARK, STAND_IN)).otherwise(text)  # no pattern has either character
    rows = docs.select(docs["doc_id"].alias("doc_id"), F.xxhash64(text).alias("text_key"), docs[repository].cast("string").alias("repository"), (docs[owner] if owner else F.lit(None)).cast("string").alias("owner"), F.monotonically_increasing_id().alias("row"), safe.alias("safe"))
    ids = ["doc_id", "text_key", "repository", "owner", "row"]
    kinds = F.filter(F.array(*(F.struct(F.lit(o).alias("ord"), _parts(F.col("safe"), o).alias("parts")) for o in range(len(ORDER)))), lambda k: k["parts"].isNotNull())
    split = rows.select(*ids, F.explode(kinds).alias("kind")).select(*ids, "kind.ord", F.posexplode("kind.parts").alias("k", "part"))
    inside = F.col("k") % 2 == 1
    split = split.select(*ids, "ord", "k", F.length("part").cast("long").alias("size"), F.when(inside, F.col("part")).alias("value")).repartition("row")
    before = Window.partitionBy("row", "ord").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    placed = split.withColumn("start", F.coalesce(F.sum("size").over(before), F.lit(0).cast("long"))).filter("value IS NOT NULL").withColumn("end", F.col("start") + F.col("size"))
    secret = F.when(F.col("ord") == 0, F.regexp_extract("value", ASSIGN, 2)).otherwise(F.col("value"))
    mixed = F.col("value").rlike("[A-Z]") & F.col("value").rlike("[a-z]") & F.col("value").rlike("[0-9]")
    is_base = F.col("ord") < BASE_KINDS
    placed = placed.withColumn("secret", secret).filter(F.when(F.col("ord") == 0, F.length("secret") >= VALUE_CHARS).otherwise(is_base | mixed))
    earlier = Window.partitionBy("row").orderBy("start", "ord").rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy("row").orderBy(F.desc("start"), F.desc("ord")).rowsBetween(Window.unboundedPreceding, -1)
    reach, onset = F.max(F.when(is_base, F.col("end"))).over(earlier), F.min(F.when(is_base, F.col("start"))).over(later)
    near = placed.withColumn("reach", reach).withColumn("onset", onset)
    apart = is_base | (F.coalesce(F.col("reach") <= F.col("start"), F.lit(True)) & F.coalesce(F.col("onset") >= F.col("end"), F.lit(True)))
    span = F.struct("start", "ord", "end").alias("span")
    return near.filter(apart).select("doc_id", "text_key", "repository", "owner", span, F.unhex(F.sha2("secret", 256)).alias("hash"))


def verdicts(found: DataFrame, counted: DataFrame, owned: bool) -> DataFrame:
    """found's doc_id, text_key and span with `live`, by the repositories and, if owned, the owners that hold the value in counted; tokens that don't look live are left out."""
    held = counted.groupBy("hash", "repository", "owner").agg(F.count("*").alias("n"))
    known = lambda c: F.coalesce(F.col(c), F.lit(""))
    of_value = stored(held.groupBy("hash").agg(F.count_distinct(known("repository")).alias("repositories"), F.count_distinct(known("owner")).alias("owners"), F.sum("n").alias("rows")), "secret-owners")
    total = of_value.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    judged = lookup(found.drop("repository", "owner"), of_value, "hash", "rows", total)
    live = F.col("repositories") < EXAMPLE_REPOSITORIES
    if owned:
        live |= F.col("owners") < EXAMPLE_OWNERS
    return judged.withColumn("live", live).filter(F.col("live") | (F.col("span.ord") < BASE_KINDS)).select("doc_id", "text_key", "span", "live")


def scan(docs: DataFrame, repository: str = "source", owner: str | None = None) -> DataFrame:
    """One row per row of docs: counts of the base kinds, digest of the base spans, all spans, and those that look live."""
    found = stored(candidates(docs, repository, owner), "secret-candidates")
    judged = verdicts(found, found, owner is not None).groupBy(F.col("doc_id").alias("judged_id"), F.col("text_key").alias("judged_key")).agg(F.collect_set("span").alias("all"), F.collect_set(F.when(F.col("live"), F.col("span"))).alias("live"))
    rows = docs.select(docs["doc_id"].alias("doc_id"), F.xxhash64(_text(docs)).alias("text_key"))
    joined = rows.join(judged, rows["doc_id"].eqNullSafe(judged["judged_id"]) & (rows["text_key"] == judged["judged_key"]), "left")
    of_kind = lambda o: F.filter("all", lambda s: s["ord"] == o)
    sizes = [F.coalesce(F.size(of_kind(o)), F.lit(0)).cast("long").alias(f"n_{ORDER[o]}") for o in range(BASE_KINDS)]
    base = F.coalesce(_report(F.filter("all", lambda s: s["ord"] < BASE_KINDS)), F.lit(""))
    return joined.withColumn("all", F.when(F.size("all") > 0, F.col("all"))).select("doc_id", *sizes, F.sha2(base, 256).alias("base_sha256"), F.coalesce(_report(F.col("all")), F.lit("")).alias("spans"), F.coalesce(_report(F.col("live")), F.lit("")).alias("live_spans"))


def _masked(block: Column, cuts: Column) -> Column:
    """The block with what the cuts (start, first, end) cover masked once, where a cut begins."""

    def step(acc: Column, s: Column) -> Column:
        covered = s["start"] < acc["at"]  # overlaps what is masked already
        between = F.concat(acc["out"], F.substring(block, acc["at"] + 1, s["start"] - acc["at"]), F.when(s["first"], MASK).otherwise(""))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(covered, acc["out"]).otherwise(between).alias("out"))

    first = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    return F.aggregate(F.array_sort(cuts), first, step, lambda acc: F.concat(acc["out"], F.substring(block, acc["at"] + 1, F.lit(BLOCK_CHARS))))


def redact(docs: DataFrame, repository: str = "source", owner: str | None = None, corpus: DataFrame | None = None) -> DataFrame:
    """docs, all their columns, with the live-looking values in text masked; examples stay.

    corpus: documents whose values count for ownership besides those of docs, for instance the corpus before
    copies were dropped from it, without which a widely copied example would look live."""
    found = stored(candidates(docs, repository, owner), "secret-candidates")
    counted = found if corpus is None else found.unionByName(candidates(corpus, repository, owner))
    live = verdicts(found, counted, owner is not None).filter("live").select("doc_id", "text_key", F.col("span.start").alias("start"), F.col("span.end").alias("end")).distinct()
    block = F.explode(F.sequence(F.expr(f"start div {BLOCK_CHARS}"), F.expr(f"(end - 1) div {BLOCK_CHARS}")))
    pieces = live.withColumn("block", block).withColumn("low", F.col("block") * BLOCK_CHARS)
    cut = F.struct(F.greatest(F.col("start") - F.col("low"), F.lit(0)).cast("int").alias("start"), (F.col("start") >= F.col("low")).alias("first"), F.least(F.col("end") - F.col("low"), F.lit(BLOCK_CHARS)).cast("int").alias("end"))
    of_block = pieces.groupBy("doc_id", "text_key", F.col("block").cast("int").alias("block")).agg(F.collect_list(cut).alias("cuts"))
    of_text = of_block.groupBy(F.col("doc_id").alias("live_id"), F.col("text_key").alias("live_key")).agg(F.map_from_entries(F.collect_list(F.struct("block", "cuts"))).alias("blocks"))
    joined = docs.join(of_text, docs["doc_id"].eqNullSafe(of_text["live_id"]) & (F.xxhash64(_text(docs)) == of_text["live_key"]), "left")
    blocks = F.regexp_extract_all(docs["text"], F.lit(rf"(?s).{{1,{BLOCK_CHARS}}}"), 0)
    masked = F.array_join(F.transform(blocks, lambda b, k: F.when(F.map_contains_key(of_text["blocks"], k), _masked(b, of_text["blocks"][k])).otherwise(b)), "")
    text = F.when(of_text["blocks"].isNull(), docs["text"]).otherwise(masked).alias("text")
    at = docs.columns.index("text")
    return joined.select(*(text if i == at else docs[c] for i, c in enumerate(docs.columns)))


def secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query op9: the secrets of every document."""
    prepare(spark)
    return scan(documents(spark, sf_dir))


def _any_case(pattern: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in pattern)


_SQL_ASSIGN = _any_case("(password|passwd|secret|token|api_?key)") + r"""["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
_SQL_KINDS = [_SQL_ASSIGN, *list(KINDS.values())[1:]]
_SQL_REPORT = "coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, ord){}, '')"
SECRET_SCAN_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(source, '') AS source FROM documents),
m AS ({' UNION ALL '.join(f"SELECT doc_id, source, {o} AS ord, '{ORDER[o]}' AS kind, regexp_split_to_array(text, '{p}') AS outer_parts, regexp_extract_all(text, '{p}') AS hits FROM d WHERE regexp_matches(text, '{p}')" for o, p in enumerate(_SQL_KINDS))}),
p AS (SELECT doc_id, source, ord, kind, unnest(hits) AS value, unnest(outer_parts[:len(hits)]) AS before, generate_subscripts(hits, 1) AS k FROM m),
s AS (SELECT doc_id, source, ord, kind, value, CAST(sum(length(before) + length(value)) OVER (PARTITION BY doc_id, ord ORDER BY k) AS BIGINT) AS e FROM p),
c AS (SELECT *, e - length(value) AS s, CASE WHEN ord = 0 THEN regexp_extract(value, '{_SQL_ASSIGN}', 2) ELSE value END AS secret FROM s),
f AS (SELECT * FROM c WHERE CASE ord WHEN 0 THEN length(secret) >= {VALUE_CHARS} WHEN 3 THEN regexp_matches(value, '[A-Z]') AND regexp_matches(value, '[a-z]') AND regexp_matches(value, '[0-9]') ELSE true END),
g AS (SELECT * FROM f WHERE ord < 3 OR NOT EXISTS (SELECT 1 FROM f b WHERE b.doc_id = f.doc_id AND b.ord < 3 AND b.s < f.e AND f.s < b.e)),
v AS (SELECT *, count(DISTINCT source) OVER (PARTITION BY secret) < {EXAMPLE_REPOSITORIES} AS live FROM g),
r AS (SELECT doc_id, count(*) FILTER (ord = 0) AS n_assign, count(*) FILTER (ord = 1) AS n_access, count(*) FILTER (ord = 2) AS n_hex,
  sha256({_SQL_REPORT.format(' FILTER (ord < 3)')}) AS base_sha256, {_SQL_REPORT.format('')} AS spans, {_SQL_REPORT.format(' FILTER (live)')} AS live_spans FROM v WHERE live OR ord < 3 GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, coalesce(base_sha256, sha256('')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(live_spans, '') AS live_spans
FROM d LEFT JOIN r USING (doc_id)
"""
