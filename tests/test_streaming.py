"""Streams over files give what their batch forms give."""

import random

from pyspark.sql import functions as F

from bazaarlake.operators import demand
from bazaarlake.operators.monitoring import TARGET, watch_crossings
from bazaarlake.streaming import upsert, watches, windows


def drain(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(180)
    return df.sparkSession.table(name)


def stream(spark, sf_dir, tmp_path):
    source = spark.read.parquet(f"{sf_dir}/events.parquet")
    source.repartition(1).write.parquet(str(tmp_path / "events"))
    rows = spark.readStream.schema(source.schema).parquet(str(tmp_path / "events"))
    return rows.withColumn("ts", rows["ts"].cast("timestamp"))


def test_watch_alerts_equal_batch(spark, sf_dir, tmp_path):
    ticks = stream(spark, sf_dir, tmp_path).selectExpr("user_id AS product", "event_id", "ts", "value AS price")
    got = {r["event_id"] for r in drain(watches.crossings(ticks, TARGET), "alerts").collect()}
    assert got == {r["event_id"] for r in watch_crossings(spark, sf_dir).collect()} and got


def test_tumbling_counts_cover_all_rows(spark, sf_dir, tmp_path):
    table = drain(windows.tumbling_counts(stream(spark, sf_dir, tmp_path), late="60 days"), "tumbling", "update")
    last = table.groupBy("start", "event_type").agg({"n": "max"}).agg({"max(n)": "sum"}).first()[0]
    assert last == spark.read.parquet(f"{sf_dir}/events.parquet").count()


def test_upsert_is_idempotent_and_sticky(spark, tmp_path):
    table = upsert.VersionedTable(spark, str(tmp_path / "offers"), ["id"], ["at"], ["note"])
    first = spark.createDataFrame([(1, 1, 5.0, "a"), (1, 2, 6.0, "b"), (2, 1, 7.0, None)], "id int, at int, price double, note string")
    table.write(first, 0)
    table.write(first, 0)
    table.write(spark.createDataFrame([(1, 3, None, None), (3, 1, 1.0, "c")], "id int, at int, price double, note string"), 1)
    assert sorted(tuple(r) for r in table.read().collect()) == [(1, 3, None, "b"), (2, 1, 7.0, None), (3, 1, 1.0, "c")]


def test_watch_passes_equal_batch_steps(spark, tmp_path):
    dice, given = random.Random(7), []
    for n in range(5):
        for w in range(12):
            price = None if dice.random() < 0.15 else float(dice.choice([5, 10, 15]))
            sites = sorted(dice.sample(range(4), dice.randint(1, 3)))
            given.append((w, n, price, "s", dice.choice([True, False, None]), sites, None if w % 6 == 5 else 10.0, w % 2 == 0, w % 3 == 0))
    schema = "watch_id long, check_id long, price double, site string, in_stock boolean, sites array<int>, target double, on_new_site boolean, on_restock boolean"
    checks = spark.createDataFrame(given, schema).withColumn("ts", F.timestamp_seconds("check_id"))
    for part, half in enumerate(("check_id < 3", "check_id >= 3")):  # two triggers: state carries over
        checks.filter(half).repartition(2).write.parquet(str(tmp_path / "checks" / f"p={part}"))
    rows = spark.readStream.schema(checks.schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "checks" / "p=*"))
    got = {(r.watch_id, r.check_id, r.fired, r.previous, tuple(r.new_sites or ())) for r in drain(watches.passes(rows), "passes").collect()}
    state, want = {}, set()
    blank = (None, None, None, None)
    for n in range(5):
        now = [g + state.get(g[0], blank) for g in given if g[1] == n]
        step = demand.watch_step(spark.createDataFrame(now, schema + ", last_price double, last_in_stock boolean, known_sites array<int>, baseline double"))
        for r in step.collect():
            state[r.watch_id] = (r.last_price, r.last_in_stock, r.known_sites, r.baseline)
            if r.fired:
                want.add((r.watch_id, n, r.fired, r.previous, tuple(sorted(r.new_sites or ()))))
    assert got == want and {f for _, _, f, _, _ in want} == {"new_site", "restock", "price"}
