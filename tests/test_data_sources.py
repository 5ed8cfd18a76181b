"""Saved answers as a table and as a stream, and alerts that arrive once."""

import json
from collections import Counter

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from bazaarlake.sources import saved_site
from bazaarlake.streaming import alerts


def save(root, site, kind, topic, pages):
    for n, items in pages.items():
        folder = root / f"site={site}" / f"{kind}={topic}" / f"page={n}"
        folder.mkdir(parents=True)
        (folder / "part-0.json").write_text("".join(json.dumps({"id": i}) + "\n" for i in items))


def rows(df):
    return Counter((r.site_key, r.topic, r.page, r.at, json.loads(r.item)["id"]) for r in df.collect())


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "saved"
    save(root, "a", "keyword", "usb%2Fhub", {1: [1, 2], 2: [], 3: [3], 5: [9]})
    save(root, "a", "keyword", "lamp", {2: [8]})
    save(root, "b", "keyword", "lamp", {1: [4], 2: [5], 10: [7]})
    save(root, "b", "category", "tools", {1: [6]})
    (root / "stray").mkdir()
    return root


def test_pages_end_at_a_missing_one_but_not_at_an_empty_one(spark, tree):
    want = Counter([("a", "usb/hub", 1, 0, 1), ("a", "usb/hub", 1, 1, 2), ("a", "usb/hub", 3, 0, 3), ("b", "lamp", 1, 0, 4), ("b", "lamp", 2, 0, 5)])
    assert rows(saved_site.saved_site(spark, str(tree))) == want == rows(saved_site.saved_site(spark, f"file://{tree}"))
    assert rows(saved_site.saved_site(spark, str(tree), "category")) == Counter([("b", "tools", 1, 0, 6)])
    assert rows(saved_site.saved_site(spark, str(tree), max_pages=1)) == Counter({r: n for r, n in want.items() if r[2] == 1})
    assert rows(saved_site.saved_site(spark, str(tree / "nothing"))) == Counter()
    with pytest.raises(Exception, match="kind is one of"):
        saved_site.saved_site(spark, str(tree), "other").collect()


def test_filters_reach_the_listing(spark, tree):
    table = saved_site.saved_site(spark, str(tree))
    everything = rows(table)
    for condition in ("topic = 'lamp'", "site_key IN ('a', 'z')", "site_key = 'b' AND topic = 'usb/hub'", "topic = 'lamp' AND page > 1", "topic <> 'lamp'"):
        plain = spark.createDataFrame(list(everything.elements()), "site_key string, topic string, page int, at int, id long").filter(condition)
        assert rows(table.filter(condition)) == Counter(map(tuple, plain.collect()))
    reader = saved_site.SavedReader({"path": str(tree)})
    from pyspark.sql.datasource import EqualTo, GreaterThan

    left = list(reader.pushFilters([EqualTo(("topic",), "lamp"), GreaterThan(("page",), 1)]))
    assert [type(f) for f in left] == [GreaterThan] and {(p.site, p.topic) for p in reader.partitions()} == {("b", "lamp")}


def test_a_restarted_stream_goes_on(spark, tree, tmp_path):
    spark.dataSource.register(saved_site.SavedSite)

    def run():
        stream = spark.readStream.format("saved_site").load(str(tree))
        query = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).start(str(tmp_path / "out"))
        query.processAllAvailable()
        query.stop()
        return rows(spark.read.schema(saved_site.SCHEMA).parquet(str(tmp_path / "out")))

    assert run() == rows(saved_site.saved_site(spark, str(tree)))
    save(tree, "a", "keyword", "new", {1: [20]})
    (tree / "site=a" / "keyword=usb%2Fhub" / "page=4").mkdir()
    assert run() == rows(saved_site.saved_site(spark, str(tree))) and sum(run().values()) == 7


ALERT = "watch_id long, check_id long, text string"


def test_each_alert_arrives_once(spark, tmp_path):
    """A batch that fails midway, a restart, and a second stream over the same rows."""
    spark.dataSource.register(alerts.AlertOutbox)
    source, switch = tmp_path / "in", tmp_path / "works"
    spark.range(40).selectExpr("id AS watch_id", "id * 2 AS check_id", "concat('alert ', id) AS text").repartition(4).write.parquet(str(source))

    @F.udf("string")
    def fails_at_first(text):
        if text == "alert 33" and not switch.exists():
            raise RuntimeError("broken")
        return text

    def run(name):
        stream = spark.readStream.schema(ALERT).option("maxFilesPerTrigger", 2).parquet(str(source)).withColumn("text", fails_at_first("text"))
        query = stream.writeStream.format("alert_outbox").option("path", str(tmp_path / "out")).option("query", name).option("checkpointLocation", str(tmp_path / f"cp-{name}")).trigger(availableNow=True).start()
        query.awaitTermination(120)

    with pytest.raises(StreamingQueryException):
        run("one")
    switch.touch()
    run("one")
    run("one")
    run("two")
    got = Counter(r.watch_id for r in alerts.deliveries(spark, str(tmp_path / "out"), ALERT, ["watch_id", "check_id"]).collect())
    assert got == Counter(range(40))
    of_one = spark.read.schema(ALERT).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(str(tmp_path / "out" / "delivered" / "one"))
    assert Counter(r.watch_id for r in of_one.collect()) == Counter(range(40))


def test_commit_twice_and_abort(spark, tmp_path):
    writer = alerts.OutboxWriter({"path": str(tmp_path), "query": "q"})
    row = spark.createDataFrame([(1, 2, "t")], ALERT).first()
    first, again, dropped = writer.write(iter([row])), writer.write(iter([row])), writer.write(iter([row]))
    writer.commit([first, writer.write(iter([])), None], 0)
    writer.commit([again], 0)
    writer.abort([dropped], 1)
    assert [f.name for f in tmp_path.rglob("*.json")] == [first.file.rsplit("/", 1)[1]]
    with pytest.raises(ValueError):
        alerts.OutboxWriter({"path": "x", "query": "a/b"})
