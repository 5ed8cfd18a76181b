"""Set-similarity join by prefix filter: pairs of sets with a Jaccard similarity of at least a threshold, without looking at pairs
that only share frequent tokens.

A set's tokens are ordered from the rarest of the corpus to the most frequent. Two sets that are similar enough share a token among
the first few of each (as many as the threshold leaves), so sets meet on these alone, and only if their sizes and the places of the
shared token leave room for enough common tokens; a pair is taken at its first shared token and verified on the whole sets. Sets
with the same tokens are one set while they are compared. A token with many rows is split into blocks of BLOCK_ROWS, and pairs of
blocks meet, so no task holds a frequent token's rows.

Empty sets and null keys are similar to nothing; repeated tokens count once, null ones not at all; of keys with one set all are in the result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bazaarlake.sources.tables import stored

BLOCK_ROWS = 4000


def needed(a: Column, b: Column, threshold: float) -> Column:
    """Common tokens that sets of a and b tokens need: the least whole number with c / (a + b - c) >= threshold."""
    return F.ceil(F.lit(threshold) / (1 + threshold) * (a + b) - 1e-9)


def named_sets(sets: DataFrame) -> DataFrame:
    """key, tokens (sorted) and set_id, the name that equal sets share."""
    clean = F.array_sort(F.array_distinct(F.filter("tokens", lambda t: t.isNotNull())))
    rows = sets.filter("key IS NOT NULL").select("key", clean.alias("tokens")).filter(F.size("tokens") > 0)
    return rows.withColumn("set_id", F.md5(F.array_join("tokens", "\x1f")))


def prefixes(rows: DataFrame, threshold: float) -> DataFrame:
    """Of each distinct set (set_id, tokens): ranked, its tokens with their frequency, the rarest first; n, how many; first, how many of them it may meet a similar set by."""
    tokens = rows.select("set_id", F.explode("tokens").alias("token"))
    df = tokens.groupBy("token").agg(F.count("*").alias("df"))
    ranked = tokens.join(df, "token").groupBy("set_id").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("ranked"))
    n = F.size("ranked")
    return ranked.withColumns({"n": n, "first": n - F.ceil(F.lit(threshold) * n - 1e-9).cast("int") + 1})


def to_verify(sets: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) of distinct sets, a < b, that pass prefix, size and position filters, with their sizes and tokens. sets: (set_id, ranked, n, first)."""
    posted = sets.select("set_id", "n", "ranked", F.slice("ranked", 1, F.col("first")).alias("prefix"), F.posexplode(F.slice("ranked", 1, F.col("first"))).alias("at", "t")).withColumn("token", F.col("t.token"))
    size = posted.groupBy("token").agg(F.count("*").alias("rows")).filter("rows > 1").withColumn("blocks", F.ceil(F.col("rows") / BLOCK_ROWS).cast("int")).select("token", "blocks")
    dealt = posted.drop("t").join(size, "token").withColumn("block", F.pmod(F.xxhash64("set_id"), F.col("blocks")).cast("int"))
    cell = lambda low, high: F.struct(low.alias("low"), high.alias("high"))
    mine = F.col("block")
    # A row goes to the cells of its block with each other one: as the first of the pair or as the second.
    others = F.sequence(F.lit(0), F.col("blocks") - 1)
    placed = dealt.select("*", F.explode(F.transform(others, lambda o: cell(F.least(mine, o), F.greatest(mine, o)))).alias("cell"))
    a, b = placed.alias("a"), placed.alias("b")
    own_cell = (F.col("a.cell.low") == F.col("a.cell.high")) | (F.col("a.block") != F.col("b.block"))
    na, nb = F.col("a.n"), F.col("b.n")
    room = 1 + F.least(na - F.col("a.at") - 1, nb - F.col("b.at") - 1)
    meet = (F.col("a.token") == F.col("b.token")) & (F.col("a.cell") == F.col("b.cell")) & (F.col("a.set_id") < F.col("b.set_id")) & own_cell
    sized = (na >= F.lit(threshold) * nb - 1e-9) & (nb >= F.lit(threshold) * na - 1e-9) & (room >= needed(na, nb, threshold))
    shared = F.array_intersect("a.prefix", "b.prefix")
    first = F.get(shared, 0)["token"] == F.col("a.token")
    return a.join(b, meet & sized & first).select(F.col("a.set_id").alias("a"), F.col("b.set_id").alias("b"), na.alias("na"), nb.alias("nb"), F.col("a.ranked").alias("a_ranked"), F.col("b.ranked").alias("b_ranked"))


def similar_pairs(sets: DataFrame, threshold: float) -> DataFrame:
    """low_key, high_key, jaccard of all pairs of sets (key, tokens) with at least the threshold."""
    if not 0 < threshold <= 1:
        raise ValueError("the threshold lies above 0 and up to 1")
    rows = stored(named_sets(sets), "set-rows")
    distinct = stored(prefixes(rows.select("set_id", "tokens").dropDuplicates(["set_id"]), threshold), "set-prefixes")
    common = F.size(F.array_intersect("a_ranked", "b_ranked"))
    found = to_verify(distinct, threshold).withColumn("common", common).filter(F.col("common") >= needed(F.col("na"), F.col("nb"), threshold))
    found = stored(found.select("a", "b", (F.col("common") / (F.col("na") + F.col("nb") - F.col("common"))).alias("jaccard")), "set-pairs")
    keys = rows.select("key", "set_id")
    ends = found.join(keys.select(F.col("set_id").alias("a"), F.col("key").alias("x")), "a").join(keys.select(F.col("set_id").alias("b"), F.col("key").alias("y")), "b").select("x", "y", "jaccard")
    twins = keys.alias("p").join(keys.alias("q"), (F.col("p.set_id") == F.col("q.set_id")) & (F.col("p.key") < F.col("q.key"))).select(F.col("p.key").alias("x"), F.col("q.key").alias("y"), F.lit(1.0).alias("jaccard"))
    return ends.unionByName(twins).select(F.least("x", "y").alias("low_key"), F.greatest("x", "y").alias("high_key"), "jaccard")
