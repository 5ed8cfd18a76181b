"""Scalar expectations of the parsers and text functions."""

import pytest

from bazaarlake.functions import parsing, text
from bazaarlake.functions.similarity import common_subsequence, token_set_ratio

PRICES = [
    ("US $12.34", (12.34, None, "USD")), ("$5.99", (5.99, None, "USD")), ("$1.20 - $3.40", (1.2, 3.4, "USD")), ("￥12.50", (12.5, None, "CNY")),
    ("¥10.00-¥15.00", (10.0, 15.0, "CNY")), ("$1,234.56", (1234.56, None, "USD")), ("12,34 €", (12.34, None, "EUR")), ("129.00 MAD", (129.0, None, "MAD")),
    ("US $2.10/Piece", (2.1, None, "USD")), ("Negotiable", (None, None, "USD")), (None, (None, None, "USD")), ("500 pieces", (None, None, "USD")),
    ("US $2.10 - 4.50", (2.10, 4.50, "USD")), ("US $2.26 - 3.14/Piece", (2.26, 3.14, "USD")), ("US$3.99", (3.99, None, "USD")), ("HK$ 45.00", (45.0, None, "HKD")),
    ("A$ 12.00", (12.0, None, "AUD")), ("$1234.56", (1234.56, None, "USD")),
]


@pytest.mark.parametrize("raw, want", PRICES)
def test_price(raw, want):
    assert parsing.parse_price(raw) == want


def test_price_default_currency_does_not_override_a_mark():
    assert parsing.parse_price("US $5.00", "MAD") == (5.0, None, "USD")


@pytest.mark.parametrize("raw, want", [("Min. Order: 500 Pieces", (500, "piece")), ("MOQ: 100 sets", (100, "set")), ("Min. Order: 1,000 pieces", (1000, "piece")), ("5 pcs / lot", (5, "piece")), ("起批 2 件", (2, "piece")), ("Free shipping", (1, "piece")), (None, (1, "piece"))])
def test_moq(raw, want):
    assert parsing.parse_moq(raw) == want


def test_tiers():
    found = parsing.parse_tiers("1 - 99 Pieces $2.30  100 - 999 Pieces $2.10  >=1000 Pieces $1.90")
    assert [(t["min_qty"], t["max_qty"], t["price"]) for t in found] == [(1, 99, 2.3), (100, 999, 2.1), (1000, None, 1.9)]


def test_json_helpers():
    data = {"a": {"b": [{"c": 1}, {"c": 0}]}}
    assert parsing.dig(data, "a.b[1].c") == 0 and parsing.dig(data, "a.b[].c") == [1, 0] and parsing.dig(data, "a.x") is None
    assert parsing.array_paths(data) == ["a.b"]
    page = '<script type="application/ld+json">{"@graph": [{"@type": "Product", "name": "x"}]}</script><script>var a</script>'
    assert [n.get("@type") for n in parsing.json_ld_nodes(page)] == [None, "Product"]
    assert parsing.json_ld_nodes(None) == []


def test_similarity():
    assert common_subsequence("abcbdab", "bdcaba") == 4 and common_subsequence("", "a") == 0
    assert token_set_ratio("a b c", "c a b") == 100 and token_set_ratio("", "a") == 0
    assert 0 < token_set_ratio("wireless earbuds pro", "wired earbuds") < 100


def test_text_columns(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(1, "2024 New Hot Sale Free Shipping Wireless Bluetooth Earbuds"), (2, "无线蓝牙耳机"), (3, "ワイヤレスイヤホン"), (4, "Hub PD 100W"), (5, "ESP32-WROOM-32 board"), (6, ""), (7, None)], "id int, t string")
    out = {r["id"]: r for r in rows.select("id", text.normalize_title(F.col("t")).alias("n"), text.detect_lang(F.col("t")).alias("l"), text.model_codes(F.col("t")).alias("m"), text.segment_cjk(F.col("t")).alias("s"), text.truncate(F.col("t"), 8).alias("cut")).collect()}
    assert out[1]["n"] == "wireless bluetooth earbuds" and [out[i]["l"] for i in (1, 2, 3, 6, 7)] == ["en", "zh", "ja", "und", "und"]
    assert out[4]["m"] == ["PD100W"] and out[5]["m"] == ["ESP32WROOM32"] and out[2]["s"] == "无 线 蓝 牙 耳 机" and len(out[1]["cut"]) <= 8


def test_gtin_and_conflicts(spark):
    from pyspark.sql import functions as F

    got = [r[0] for r in spark.createDataFrame([("012345678905",), ("012345678900",), ("12345",), ("ABC-DEF",), (None,)], "v string").select(text.normalize_gtin(F.col("v"))).collect()]
    assert got == ["00012345678905", None, None, None, None]
    pairs = spark.createDataFrame([(["PD100W"], ["PD100W"]), (["PD100W"], ["PD100"]), (["XT60"], ["XT90"]), ([], ["XT90"])], "a array<string>, b array<string>")
    assert [r[0] for r in pairs.select(text.codes_conflict(F.col("a"), F.col("b"))).collect()] == [False, False, True, False]


def test_udfs_take_nulls_and_empty_tables(spark):
    rows = spark.createDataFrame([("$5.99",), (None,)], "t string")
    assert [r[0]["price_min"] for r in rows.select(parsing.parse_price_udf("t")).collect()] == [5.99, None]
    assert rows.limit(0).select(parsing.parse_moq_udf("t"), parsing.parse_tiers_udf("t"), parsing.nfkc("t"), parsing.without_accents("t")).collect() == []
