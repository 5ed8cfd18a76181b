"""Every registered query that has oracle SQL equals it on the smallest tables."""

import math
from collections import Counter

import duckdb
import pytest

from bazaarlake.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    if isinstance(value, bool) or hasattr(value, "isoformat"):
        return str(value)
    return round(float(value), 9) if hasattr(value, "__float__") and not isinstance(value, str) else str(value)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, sf_dir, duck, name):
    df = registry.QUERIES[name](spark, sf_dir)
    want = duck.sql(registry.ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    order = [want.columns.index(c) for c in df.columns]
    assert Counter(tuple(map(plain, r)) for r in df.collect()) == Counter(tuple(plain(r[i]) for i in order) for r in want.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
