"""Products with so many offers that their texts are long are indexed whole."""

from collections import Counter

import duckdb
import pytest

from bazaarlake.operators import search


@pytest.fixture(scope="module")
def long_dir(tmp_path_factory):
    """Two products with 700 offers each, some 20,000 characters of raw titles, and two with one."""
    folder = tmp_path_factory.mktemp("long")
    con = duckdb.connect()
    con.sql("CREATE TABLE part AS SELECT * FROM (VALUES (1, 'red bolt'), (2, 'red plate'), (3, 'red bolt'), (4, 'old red plate')) p(p_partkey, p_name), (SELECT 'Brand#7' AS p_brand, 'LARGE' AS p_type, 5 AS p_size, 9.0::DOUBLE AS p_retailprice)")
    con.sql("CREATE TABLE supplier AS SELECT range AS s_suppkey, 'Supplier#' || lpad(range::VARCHAR, 9, '0') AS s_name, 0 AS s_nationkey FROM range(700)")
    con.sql("CREATE TABLE lineitem AS SELECT p_partkey AS l_partkey, s_suppkey AS l_suppkey FROM part, supplier WHERE p_partkey < 3 OR s_suppkey = 0")
    for t in ("part", "supplier", "lineitem"):
        con.sql(f"COPY {t} TO '{folder}/{t}.parquet'")
    return con, str(folder)


@pytest.mark.parametrize("name", ["bm25_top", "index_terms", "phrase_search"])
def test_long_fields_are_indexed_to_their_end(spark, long_dir, name):
    con, folder = long_dir
    df = search.QUERIES[name](spark, folder)
    want = con.sql(search.ORACLES[name])
    tidy = lambda rows, at: Counter(tuple(round(r[i], 9) if isinstance(r[i], float) else r[i] for i in at) for r in rows)
    assert tidy(df.collect(), range(len(df.columns))) == tidy(want.fetchall(), [want.columns.index(c) for c in df.columns])
