"""The demand gate as stream and as table against a replay of its whole past at every request."""

from collections import Counter

import pytest

from bazaarlake.operators.demand import Policy
from bazaarlake.sources.catalog import Catalog
from bazaarlake.streaming import gate


def replay(rows, policy):
    """Outcomes by looking back over all earlier events of the gate, nothing kept between requests."""
    out, past = [], {}
    for r in sorted(rows, key=lambda r: (r.ts, r.event_id)):
        seen = past.setdefault(r.gate, [])
        word = " ".join((r.keyword or "").split()).lower()
        found = None
        if r.kind == "request":
            own = [(t, k, o) for t, k, w, _, o in seen if w == word and (k != "request" or o == "queued")]
            ends = [n for n, (_, k, _) in enumerate(own) if k == "end"]
            asked = [n for n, (_, k, _) in enumerate(own) if k == "request"]
            words = {w for _, _, w, _, _ in seen}
            depth = 0
            for other in words:
                line = [(k, o) for _, k, w, _, o in seen if w == other and (k != "request" or o == "queued")]
                tail = line[max((n for n, (k, _) in enumerate(line) if k == "end"), default=-1) + 1 :]
                while tail and tail[0][0] != "request":
                    tail = tail[1:]
                depth += bool(tail) and not any(k == "start" for k, _ in tail)
            last = max((t for t, k, _ in own if k == "end"), default=None)
            started = sum(1 for t, _, _, c, o in seen if o == "queued" and c == r.client and (r.ts - t).total_seconds() < 3600)
            if not (policy.enabled if r.enabled is None else r.enabled):
                found = "off"
            elif len(word) < policy.min_chars:
                found = "too_short"
            elif (r.results or 0) >= policy.min_results:
                found = "have_results"
            elif asked and (not ends or asked[-1] > ends[-1]):
                found = "pending"
            elif depth >= policy.max_queue:
                found = "busy"
            elif last is not None and (r.ts - last).total_seconds() < 3600 * policy.cooldown_hours:
                found = "cooldown"
            elif r.client and started >= policy.per_client_hourly:
                found = "throttled"
            else:
                found = "queued"
            out.append((r.gate, r.event_id, found))
        seen.append((r.ts, r.kind, word, r.client, found))
    return Counter(out)


def test_outcomes_equal_replay(spark, sf_dir):
    rows = gate.sample_requests(Catalog(spark, sf_dir)).collect()
    want = replay(rows, gate.SAMPLE_POLICY)
    assert Counter(map(tuple, gate.gate_outcomes(spark, sf_dir).collect())) == want
    assert {o for _, _, o in want} == {"off", "too_short", "have_results", "pending", "busy", "cooldown", "throttled", "queued"}


def test_stream_keeps_its_state_between_triggers(spark, sf_dir, tmp_path):
    source = gate.sample_requests(Catalog(spark, sf_dir))
    rows = source.collect()
    middle = sorted(r.ts for r in rows)[len(rows) // 2]
    for part, half in enumerate((source.filter(source.ts < middle), source.filter(source.ts >= middle))):
        half.repartition(2).write.parquet(str(tmp_path / "in" / f"p={part}"))
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema(source.schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in" / "p=*"))
        query = gate.gated(stream, gate.SAMPLE_POLICY).writeStream.format("memory").queryName("gated").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
        query.awaitTermination(300)
    finally:
        spark.conf.unset(key)
    got = Counter((r.gate, r.event_id, r.outcome) for r in spark.table("gated").collect())
    assert got == replay(rows, gate.SAMPLE_POLICY)


def test_free_outcomes_spend_no_budget_and_names_are_bounded():
    policy, one = Policy(max_queue=50, per_client_hourly=2), gate.Gate()
    ask = lambda word, results=0, client="a", now=0: one.request(now, word, client, results, True, policy)
    assert ask("usb hub") == "queued"
    assert {ask("usb hub") for _ in range(6)} == {"pending"} and {ask("hdmi", 99) for _ in range(6)} == {"have_results"}
    assert ask("sd card") == "queued" and ask("psu 12v") == "throttled" and ask("psu 12v", client="b") == "queued" and ask("x y z", client=None) == "queued"
    assert ask("later", now=gate.HOUR) == "queued"
    many = gate.Gate()
    for k in range(gate.MAX_CLIENTS + 500):
        many.request(k, f"word {k}", f"c{k}", 0, True, Policy(max_queue=10**6, per_client_hourly=1))
    assert len(many.starts) == gate.MAX_CLIENTS and "c0" not in many.starts and f"c{gate.MAX_CLIENTS + 499}" in many.starts


def test_cooldown_follows_failed_crawls_and_expires():
    one, policy = gate.Gate(), Policy()
    assert one.request(0, "boom", None, 0, True, policy) == "queued"
    one.take(5, "end", "boom", None, 0, True, policy)
    assert one.request(6, "boom", None, 0, True, policy) == "cooldown"
    one.forget(24 * gate.HOUR + 5, policy)
    assert not one.crawled and one.request(24 * gate.HOUR + 5, "boom", None, 0, True, policy) == "queued"


@pytest.mark.parametrize("values", [(None, None, None, None), ("   ", "", None, False)])
def test_nulls_have_defined_outcomes(spark, values):
    keyword, client, results, enabled = values
    schema = "gate long, event_id long, ts timestamp, kind string, keyword string, client string, results int, enabled boolean"
    import datetime as dt

    rows = [(None, 1, dt.datetime(2024, 1, 1), "request", keyword, client, results, enabled), (None, 2, dt.datetime(2024, 1, 1), "what", "w", None, 1, None)]
    got = gate.outcomes(spark.createDataFrame(rows, schema), Policy()).collect()
    assert [(r.gate, r.event_id, r.outcome) for r in got] == [(None, 1, "off" if enabled is False else "too_short")]
