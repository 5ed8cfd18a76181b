"""Which searches may start a crawl, where an outcome depends on the outcomes before it: a gate with a queue, crawls in flight,
cooldowns and callers' budgets, as keyed state of a stream.

Every gate (one server, site group or tenant) is a key with a queue of its own. Its state is what can still matter: crawls queued or
running, keywords whose cooldown lasts, and callers that started something within the hour. What has expired goes with the next event
of the gate, or with a timer once the watermark has passed, so an idle gate keeps nothing.

Events (gate, event_id, ts, kind, keyword, client, results, enabled): a `request` gets an outcome; a `start` takes its keyword from the
queue into work; an `end`, failed or not, takes it out of flight and begins its cooldown. Within a trigger a gate's events are taken by
(ts, event_id). `enabled` is the switch the request came with; null leaves it to the policy. Rows with a null gate share one gate; a null
keyword is too short; null results count as none; unknown kinds do nothing. A caller without a name is never throttled. At most
`MAX_CLIENTS` callers are tracked a gate, beyond which the one that started longest ago is forgotten."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from bazaarlake.operators.demand import Policy
from bazaarlake.operators.monitoring import events
from bazaarlake.sources.catalog import Catalog
from bazaarlake.streaming.watches import in_order

MAX_CLIENTS = 4096  # fixed value
HOUR = 3_600_000_000
COLUMNS = ["ts", "event_id", "kind", "keyword", "client", "results", "enabled"]
OUT = "gate long, event_id long, ts timestamp, outcome string"
QUEUED, RUNNING = "queued", "running"


def micros(ts) -> int:
    return int(pd.Timestamp(ts).value // 1000)


class Gate:
    """The state of one gate, times in microseconds."""

    def __init__(self, flight: dict[str, str] | None = None, crawled: dict[str, int] | None = None, starts: dict[str, list[int]] | None = None):
        self.flight, self.crawled, self.starts = flight or {}, crawled or {}, starts or {}

    def request(self, now: int, keyword: str, client: str | None, results: int, enabled: bool, policy: Policy) -> str:
        if not enabled:
            return "off"
        if len(keyword) < policy.min_chars:
            return "too_short"
        if results >= policy.min_results:
            return "have_results"
        if keyword in self.flight:
            return "pending"
        if sum(s == QUEUED for s in self.flight.values()) >= policy.max_queue:
            return "busy"
        if (last := self.crawled.get(keyword)) is not None and now - last < policy.cooldown_hours * HOUR:
            return "cooldown"
        if client and policy.per_client_hourly > 0 and not self._charged(now, client, policy.per_client_hourly):
            return "throttled"
        self.flight[keyword] = QUEUED
        return QUEUED

    def _charged(self, now: int, client: str, hourly: int) -> bool:
        """Only what would start a crawl comes here and spends the caller's budget."""
        own = [t for t in self.starts.get(client, ()) if t > now - HOUR]
        if len(own) >= hourly:
            return False
        self.starts[client] = [*own, now]
        while len(self.starts) > MAX_CLIENTS:
            del self.starts[min(self.starts, key=lambda c: (self.starts[c][-1], c))]
        return True

    def take(self, now: int, kind: str, keyword: str, client: str | None, results: int, enabled: bool, policy: Policy) -> str | None:
        if kind == "request":
            return self.request(now, keyword, client, results, enabled, policy)
        if kind == "start" and keyword in self.flight:
            self.flight[keyword] = RUNNING
        if kind == "end":
            self.flight.pop(keyword, None)
            self.crawled[keyword] = max(now, self.crawled.get(keyword, now))
        return None

    def forget(self, now: int, policy: Policy) -> None:
        """Drop what has expired."""
        self.crawled = {k: t for k, t in self.crawled.items() if now - t < policy.cooldown_hours * HOUR}
        self.starts = {c: t for c, t in self.starts.items() if t[-1] > now - HOUR}

    def run(self, rows: Iterable[tuple], policy: Policy) -> Iterator[tuple]:
        """(event_id, ts, outcome) of the requests among rows, which have COLUMNS."""
        for ts, event_id, kind, keyword, client, results, enabled in rows:
            word = "" if keyword is None or pd.isna(keyword) else " ".join(keyword.split()).lower()
            caller = None if client is None or pd.isna(client) else client
            switch = policy.enabled if enabled is None or pd.isna(enabled) else bool(enabled)
            found = self.take(micros(ts), kind, word, caller, 0 if pd.isna(results) else int(results), switch, policy)
            if found:
                yield event_id, ts, found


class GateProcessor(StatefulProcessor):
    """A gate's state in three maps of the state store."""

    def __init__(self, policy: Policy):
        self.policy = policy

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.flight = handle.getMapState("flight", "keyword string", "state string")
        self.crawled = handle.getMapState("crawled", "keyword string", "at long")
        self.starts = handle.getMapState("starts", "client string", "at array<long>")

    def _held(self) -> Gate:
        read = lambda state: {k[0]: v[0] for k, v in state.iterator()}
        return Gate(read(self.flight), read(self.crawled), {c: list(t) for c, t in read(self.starts).items()})

    def _hold(self, before: Gate, after: Gate) -> None:
        for state, old, new in ((self.flight, before.flight, after.flight), (self.crawled, before.crawled, after.crawled), (self.starts, before.starts, after.starts)):
            for key in old.keys() - new.keys():
                state.removeKey((key,))
            for key, value in new.items():
                if old.get(key) != value:
                    state.updateValue((key,), (value,))

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803  names of the interface
        before, gate = self._held(), self._held()
        out, last = [], 0
        for event_id, ts, outcome in gate.run(self._watched(in_order(rows, COLUMNS), times := []), self.policy):
            out.append((key[0], event_id, ts, outcome))
        last = max(times, default=0)
        gate.forget(last, self.policy)
        self._hold(before, gate)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if gate.crawled or gate.starts:
            self.handle.registerTimer((last + max(HOUR, self.policy.cooldown_hours * HOUR)) // 1000 + 1)
        yield pd.DataFrame(out, columns=["gate", "event_id", "ts", "outcome"]).astype({"event_id": "int64"})

    @staticmethod
    def _watched(rows: Iterable[tuple], times: list[int]) -> Iterator[tuple]:
        for row in rows:
            times.append(micros(row[0]))
            yield row

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        before, gate = self._held(), self._held()
        gate.forget(expiredTimerInfo.getExpiryTimeInMs() * 1000, self.policy)
        self._hold(before, gate)
        return iter([])

    def close(self) -> None:
        pass


def gated(requests: DataFrame, policy: Policy, late: str = "1 hour") -> DataFrame:
    """Outcomes of a stream of events. Its state store must be RocksDB's (spark.sql.streaming.stateStore.providerClass)."""
    rows = requests.withWatermark("ts", late).groupBy("gate")
    return rows.transformWithStateInPandas(GateProcessor(policy), OUT, "Append", "EventTime")


def outcomes(requests: DataFrame, policy: Policy) -> DataFrame:
    """The same of a table: gates are dealt to tasks, and each task goes through its gates in order with one gate's state at a time."""
    schema: StructType = requests.select("gate", *COLUMNS).schema

    def step(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        gate, current = None, object()
        for frame in frames:
            out = []
            numbers = frame["gate"].astype("object").where(frame["gate"].notna(), None)
            for number, row in zip(numbers, zip(*(frame[c] for c in COLUMNS), strict=True), strict=True):
                if gate is None or number != current:
                    gate, current = Gate(), number
                out += [(number, *x) for x in gate.run([row], policy)]
                gate.forget(micros(row[0]), policy)
            made = pd.DataFrame(out, columns=["gate", "event_id", "ts", "outcome"])
            yield made.astype({"gate": "Int64", "event_id": "int64"})

    placed = requests.select(*schema.fieldNames()).repartition("gate").sortWithinPartitions("gate", "ts", "event_id")
    return placed.mapInPandas(step, OUT)


#: The sample: users of a gate; policy; keywords.
USERS_A_GATE, SAMPLE_POLICY, KEYWORDS = 30, Policy(min_results=60, cooldown_hours=12, max_queue=3, min_chars=3, per_client_hourly=1), 11


def sample_requests(catalog: Catalog) -> DataFrame:
    """Events as what reaches gates: sign-ups start a crawl of their keyword, errors end one, the others ask."""
    e = F.col("event_id")
    kind = F.when(F.col("event_type") == "signup", "start").when(F.col("event_type") == "error", "end").otherwise("request")
    keyword = F.when(e % 17 == 0, "ab").otherwise(F.concat(F.lit("Word  "), e % KEYWORDS))
    return events(catalog).select(
        F.floor(F.col("user_id") / USERS_A_GATE).alias("gate"), "event_id", F.col("ts").cast("timestamp").alias("ts"), kind.alias("kind"), keyword.alias("keyword"),
        F.when(e % 5 != 0, (e % 3).cast("string")).alias("client"), F.col("value").cast("int").alias("results"), F.when(e % 29 == 0, False).alias("enabled"),
    )


def gate_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The outcome of every request, in order of its gate."""
    return outcomes(sample_requests(Catalog(spark, sf_dir)), SAMPLE_POLICY).select("gate", "event_id", "outcome")


QUERIES = {"gate_outcomes": gate_outcomes}
ORACLES: dict[str, str] = {}
