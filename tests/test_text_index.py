"""The stored index against scoring of all postings anew, through upserts, deletes and merges."""

import random
from collections import Counter

import pytest

from bazaarlake.operators import bm25, search, text_index
from bazaarlake.operators.text_index import TextIndex

SCHEMA = "product_id long, title string, title_raw string, brand string, model string, mpn string, identifiers string, specs string, path string"
CONCEPTS = [[["red"]], [["bl"], ["gear", "red bolt"]], [["x"]], [["anvil"], ["nowhere"]], [["red bolt", "cafe"]]]


def product(i, title, rng=None):
    extra = " ".join(rng.choice(["red", "blue", "gear", "bolt", "anvil", "x1"]) for _ in range(rng.randint(0, 6))) if rng else ""
    return (i, title, extra, "b", None, f"MP-{i}%_", "id", None, "tools/x")


def ranked(df):
    return [(r.product_id, r.score) for r in df.collect()]


def test_index_equals_full_scan_through_changes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(text_index, "RANGE", 10)
    monkeypatch.setattr(text_index, "SEED_RANGES", 2)
    rng = random.Random(2)
    index, now = TextIndex(spark, str(tmp_path / "index"), fanout=3), {}
    titles = ["red bolt", "blue bolt red", "Red Café bolt", "gear", "", "blue gear blue", "anvil x9"]
    for step in range(4):
        changed = {i: product(i, rng.choice(titles), rng) for i in rng.sample(range(90), 25)}
        index.upsert(spark.createDataFrame(list(changed.values()), SCHEMA))
        now |= changed
        if step % 2:
            gone = rng.sample(range(100), 12)
            index.delete(spark.createDataFrame([(i,) for i in gone], "product_id long"))
            now = {i: p for i, p in now.items() if i not in gone}
        if step == 3:
            fields = spark.createDataFrame(list(now.values()), SCHEMA)
            held = index.state()
            assert held.docs == len(now) and len(held.segments) < 4
            rows = bm25.postings(fields)
            lengths = fields.select("product_id").join(bm25.document_lengths(rows), "product_id", "left").fillna(0)
            assert held.words == rows.count()
            again = TextIndex(spark, index.location)
            for concepts in CONCEPTS:
                want = sorted(ranked(bm25.bm25(rows, concepts, lengths=lengths)), key=lambda r: (-r[1], r[0]))
                assert sorted(ranked(again.scores(concepts)), key=lambda r: (-r[1], r[0])) == want
                assert ranked(again.top(concepts, 5)) == want[:5]
    folders = {s.folder for s in index.state().segments}
    index.merge()
    assert len(index.state().segments) == 1 and index.state().segments[0].folder not in folders and not index.state().gone
    assert Counter(r.product_id for r in index.members().collect()) == Counter(now.keys())


def test_upsert_leaves_other_segments_alone(spark, tmp_path):
    index = TextIndex(spark, str(tmp_path / "index"))
    index.upsert(spark.createDataFrame([product(i, f"red gear {i}") for i in range(20)], SCHEMA))
    first = index.state().segments[0].folder
    index.upsert(spark.createDataFrame([product(3, "blue")], SCHEMA))
    assert [s.folder for s in index.state().segments][0] == first and len(index.state().segments) == 2
    assert {r.product_id for r in index.scores([["red"]]).collect()} == set(range(20)) - {3} and {r.product_id for r in index.scores([["blue"]]).collect()} == {3}


def test_ranges_that_cannot_reach_the_top_are_not_read(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(text_index, "RANGE", 10)
    monkeypatch.setattr(text_index, "SEED_RANGES", 1)
    index = TextIndex(spark, str(tmp_path / "index"))
    rows = [product(i, "red red red red" if i < 10 else "red " + "other " * 12) for i in range(200)]
    index.upsert(spark.createDataFrame(rows, SCHEMA))
    read = []
    score = TextIndex._score
    monkeypatch.setattr(TextIndex, "_score", lambda self, rows, *a: read.append(rows.select("block").distinct().count()) or score(self, rows, *a))
    assert [r[0] for r in ranked(index.top([["red"]], 5))] == [0, 1, 2, 3, 4]
    assert read == [1, 0]


def test_empty_index(spark, tmp_path):
    index = TextIndex(spark, str(tmp_path / "none"))
    assert index.state() is None and index.scores([["a"]]).collect() == [] and index.top([["a"]], 3).collect() == [] and index.members().collect() == []
    index.delete(spark.createDataFrame([(1,)], "product_id long"))
    index.upsert(spark.createDataFrame([], SCHEMA))
    assert index.state().docs == 0 and index.top([["a"]], 3).collect() == [] and search.suggestions(index, "re").collect() == []


def test_substring_search_takes_signs_as_they_are(spark, tmp_path):
    titles = {1: "path A\\B", 2: "now 50% off", 3: "ax_yb", 4: "plain", 5: "it's éclair\\"}
    index = TextIndex(spark, str(tmp_path / "index"))
    index.upsert(spark.createDataFrame([(i, t, None, None, None, f"MP-{i}%_", None, None, None) for i, t in titles.items()], SCHEMA))
    for query, found in [("a\\b", {1}), ("0%", {2}), ("x_y", {3}), ("P-4%_", {4}), ("'", {5}), ("%", {1, 2, 3, 4, 5}), ("  ", set()), ("CLAIR\\", {5})]:
        assert {r.product_id for r in search.search_products(index, query, []).collect()} == found


def test_rows_of_a_block_are_built_in_one_of_many_tasks(spark, tmp_path, monkeypatch):
    """Tasks follow the number of products; the texts are shuffled by block, not their words."""
    monkeypatch.setattr(text_index, "RANGE", 4)
    monkeypatch.setattr(text_index, "TASK_PRODUCTS", 8)
    fields = "product_id long, title string, title_raw string, brand string, model string, mpn string, identifiers string, specs string, path string"
    rows = [(k, f"hub m{k} hub", None, "acme", None, None, None, None, None) for k in range(80)]
    index = text_index.TextIndex(spark, f"file://{tmp_path}/index")
    index.upsert(spark.createDataFrame(rows, fields))
    assert spark.read.parquet(f"{index.location}/{index.state().segments[0].folder}/rows").inputFiles().__len__() > 4
    assert sorted((r.field, r.term, r.product_id, r.times) for r in index.terms().collect()) == sorted(x for k in range(80) for x in [("title", "hub", k, 2), ("title", f"m{k}", k, 1), ("brand", "acme", k, 1)])


def test_a_block_turns_its_products_to_terms_at_once(spark, tmp_path, monkeypatch):
    """The rows of a block come from its products' words whole, not from a row a word that is sorted and gathered twice."""
    monkeypatch.setattr(text_index, "RANGE", 4)
    plans = []
    write = TextIndex._write
    monkeypatch.setattr(TextIndex, "_write", lambda self, folder, members, rows, *a: plans.append(rows._jdf.queryExecution().toString()) or write(self, folder, members, rows, *a))
    rng = random.Random(5)
    texts = [None, "", "  - ", "Ünï cödé x x", "汉字 汉字 a"]
    rows = [(k, rng.choice(texts), rng.choice(texts), None, "b", None, rng.choice(texts), rng.choice(texts), "t/x") for k in range(-9, 30)]
    fields = spark.createDataFrame(rows, SCHEMA)
    index = TextIndex(spark, str(tmp_path / "index"))
    index.upsert(fields)
    assert len(plans) == 1 and "Generate" not in plans[0]
    held = [(r.field, r.term, p.product_id, tuple(p.positions), r.block) for r in index._rows(index.state()).collect() for p in r.postings]
    want = {}
    for r in bm25.postings(fields).collect():
        want.setdefault((r.field, r.term, r.product_id), []).append(r.pos)
    assert Counter(held) == Counter((f, t, i, tuple(sorted(p)), i // 4) for (f, t, i), p in want.items())
    for r in index._rows(index.state()).collect():
        assert r.n == len(r.postings) and r.most == max(len(p.positions) for p in r.postings) and [p.product_id for p in r.postings] == sorted(p.product_id for p in r.postings)
    assert index.state().words == sum(map(len, want.values())) == sum(m.len for m in index.members().collect())
