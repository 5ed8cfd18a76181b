"""Readers of saved answers and pages, unit columns and merges."""

import json

from pyspark.sql import functions as F

from bazaarlake.functions import units
from bazaarlake.operators import curation, matching
from bazaarlake.sources import catalog, readers


def test_json_mapping(spark):
    doc = json.dumps({"data": {"list": [{"id": 1, "t": "", "title": "x", "p": {"v": 0}}, {"id": 2, "t": "y"}]}})
    rows = spark.createDataFrame([("s", doc), ("t", None), ("u", "{}")], "site string, body string")
    got = readers.mapped(rows, "body", "data.list", {"id": ["id"], "title": ["t", "title"], "price": ["p.v"]}).collect()
    assert [tuple(r) for r in got] == [("s", "1", "x", "0"), ("s", "2", "y", None)]


def test_embedded_json_and_items():
    page = '<script>window.rawData = {"a": "}", "b": [1]};</script><script>window.rawData = {bad};</script>'
    assert readers.embedded_json(page, "rawData") == ['{"a": "}", "b": [1]}'] and readers.embedded_json(None, "x") == []
    assert readers.find_items({"x": {"y": [{"id": 1}, {"id": 2}]}, "z": [1]}, {"id"}) == [{"id": 1}, {"id": 2}]
    assert readers.find_items({}, {"id"}) == []


def test_cards_once_each_and_first_selector_wins():
    page = '<ol><li class="item product"><a>A<br></a></li><li class="item product"><a>B</a></li></ol>'
    assert readers.select_cards(page, ["li.product, .item"]) == ["A", "B"]
    assert readers.select_cards(page, [".nope", ".product"]) == ["A", "B"]
    assert readers.select_cards(page, [".nope"]) == [] and readers.select_cards(None, ["li"]) == []


def test_card_udf(spark):
    rows = spark.createDataFrame([("<li>A</li>",), (None,)], "html string").select(readers.cards_udf(["li"])("html"), readers.embedded_json_udf("x=")("html"))
    assert [tuple(r) for r in rows.collect()] == [(["A"], []), ([], [])]


def test_units(spark):
    rows = spark.createDataFrame([("Weight: 500 g", "10 x 20 x 30 mm", "1.5K sold"), ("2kg", "0x1x2", "3万"), ("2 lb", "10*20*30", "1,234"), ("none", "400x1x1 cm", "")], "w string, d string, n string")
    got = rows.select(units.weight_kg(F.col("w")), units.dims_cm(F.col("d")), units.count_of(F.col("n"))).collect()
    assert [r[0] for r in got] == [0.5, 2.0, 2 * 0.45359237, None]
    assert [r[1] for r in got] == [[1.0, 2.0, 3.0], None, [10.0, 20.0, 30.0], None]
    assert [r[2] for r in got] == [1500.0, 30000.0, 1234.0, None]


def test_fx(spark):
    rows = spark.createDataFrame([(71.5, "CNY"), (10.0, "USD"), (10.0, None), (10.0, "XYZ"), (None, "USD")], "a double, c string")
    assert [r[0] for r in rows.select(units.to_usd(F.col("a"), F.col("c"))).collect()] == [10.0, 10.0, 10.0, None, None]
    assert spark.range(1).select(units.money_text(F.lit(2.5)), units.money_text(F.lit(100.0)), units.money_text(F.lit(None).cast("double"))).first()[:] == ("2.5", "100", "")


def test_detail_merge(spark):
    listed = spark.createDataFrame([(1, "a", 5.0), (2, None, None)], "id int, title string, price double")
    detail = spark.createDataFrame([(1, "b", 4.0), (2, "c", None)], "id int, title string, price double")
    assert sorted(map(tuple, curation.merge_detail(listed, detail, "id", ["price"]).collect())) == [(1, "a", 4.0), (2, "c", None)]


def test_score_rules(spark):
    lit = lambda x: F.lit(x).cast("double")
    cases = [
        ((0.9, 0.5, None, 0, False, False), 0.90), ((0.9, 0.2, 0.9, 2, False, False), 0.88), ((0.9, 0.2, None, 0, False, False), 0.5937),
        ((None, 0.5, None, 0, True, False), 0.62), ((None, 0.8, None, 0, False, True), 0.6), ((None, None, None, 0, False, False), 0.0),
    ]
    for (image, title, specs, overlap, shared, conflict), want in cases:
        got = spark.range(1).select(matching.score(lit(image), lit(title), lit(specs), F.lit(overlap), F.lit(shared), F.lit(conflict))).first()[0]
        assert abs(got - want) < 2e-3, (image, title, got)


def test_band_guarantee(spark):
    """Hashes within three bits share a band."""
    from bazaarlake.functions import similarity

    rows = spark.range(200).select((F.xxhash64("id")).alias("a"), F.xxhash64("id", F.lit(1)).alias("r"))
    flipped = F.expr("a ^ shiftleft(1L, CAST(pmod(r, 64) AS INT)) ^ shiftleft(1L, CAST(pmod(shiftrightunsigned(r, 8), 64) AS INT))")
    both = rows.select("a", flipped.alias("b")).select(similarity.hamming(F.col("a"), F.col("b")).alias("d"), F.size(F.array_intersect(similarity.bands(F.col("a")), similarity.bands(F.col("b")))).alias("shared"))
    assert both.filter("d > 3 OR shared = 0").count() == 0


def test_rotation_and_csv(spark, tmp_path):
    assert catalog.keep_newest_folders(["v2", "v1", "v3"], 2) == ["v1"] and catalog.keep_newest_folders([], 2) == []
    catalog.write_csv(spark.createDataFrame([(1, None), (2, "x")], "id int, t string").coalesce(1), str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 2


def test_numbers_go_up_over_ranges(spark):
    rows = spark.createDataFrame([(k * 7 % 101,) for k in range(101)], "id long").repartition(5)
    got = {r.id: r.n for r in catalog.numbered(rows, "id", 1000, "n").collect()}
    assert got == {k: 1000 + k for k in range(101)}
    assert catalog.numbered(rows.limit(0), "id", 1, "n").collect() == []


def test_details_without_children_leave_the_listings(spark):
    schema = "id int, specs array<string>, extra map<string,string>, title string"
    listed = spark.createDataFrame([(1, ["a"], {"k": "v"}, None), (2, [], None, "t"), (3, ["b"], None, "u")], schema)
    detail = spark.createDataFrame([(1, [], {}, "d"), (2, ["x"], {"y": "z"}, "w"), (3, ["c"], None, None)], schema)
    got = {r.id: (r.specs, r.extra, r.title) for r in curation.merge_detail(listed, detail, "id", ["specs", "extra"]).collect()}
    assert got == {1: (["a"], {"k": "v"}, "d"), 2: (["x"], {"y": "z"}, "t"), 3: (["c"], None, "u")}
