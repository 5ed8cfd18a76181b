"""Connected components of a graph held as a table of edges, by alternating large and small stars.

Defined results: edges with a null end and loops link nothing and give no row; repeated edges count once; an empty
table gives no rows; other columns are ignored."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bazaarlake.llm.common import HOT_SHARE, lookup, stored


HOT_DEGREE = 1_000  # a node with as many neighbours, and a large share of all, is looked up apart


def _stars(edges: DataFrame, large: bool, rows: int | None) -> DataFrame:
    """Join each node's neighbours (the larger ones, or the smaller ones and itself) to the least of its neighbourhood.

    rows: how many neighbours there are, at most, if some nodes have so many that they must be looked up apart."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    around = both if large else both.filter(F.col("b") < F.col("a"))
    least = around.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("least"), F.count("*").alias("neighbours"))
    if rows is None:
        joined = around.join(least, "a")
    else:
        least = stored(least, "component-least")
        joined = lookup(around, least, "a", "neighbours", rows)
    if large:
        return joined.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("least").alias("b")).filter(F.col("a") != F.col("b"))
    out = joined.select(F.col("b").alias("a"), F.col("least").alias("b")).unionByName(least.select("a", F.col("least").alias("b")))
    return out.filter(F.col("a") != F.col("b")).distinct()


def _state(edges: DataFrame) -> tuple[bool, int, int]:
    """Whether every node either points to one other or is pointed to; the number of edges; the most edges of a node."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("points")), F.struct(F.col("b").alias("node"), F.lit(0).alias("points")))).alias("e")).select("e.*")
    nodes = ends.groupBy("node").agg(F.sum("points").alias("points"), F.count("*").alias("degree"))
    odd = (F.col("points") > 1) | ((F.col("points") > 0) & (F.col("degree") > F.col("points")))
    left, n, most = nodes.agg(F.count_if(odd), F.coalesce(F.sum("points"), F.lit(0)), F.coalesce(F.max("degree"), F.lit(0))).first()
    return left == 0, n, most


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of links (a, b); a component's name is its least node.

    Each round is written to the shared folder, so a lost executor costs a round's tasks at most. The
    number of rounds grows as the logarithm of the longest path."""
    edges = stored(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter(F.col("a") != F.col("b")).distinct(), "component-edges")
    while True:
        done, n, most = _state(edges)
        if done:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        if most > HOT_DEGREE and most * HOT_SHARE > n:
            edges = stored(_stars(stored(_stars(edges, True, 2 * n), "component-edges"), False, n), "component-edges")
        else:
            edges = stored(_stars(_stars(edges, True, None), False, None), "component-edges")
