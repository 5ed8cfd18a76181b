"""Watches as stateful streams: prices that reach a target from above, and the full pass with restock and new sites."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

ALERT = "product long, event_id long, ts timestamp, price double, previous double"
STATE = "price double"
OUT = ["product", "event_id", "ts", "price", "previous"]
FIRED = "watch_id long, check_id long, ts timestamp, fired string, price double, site string, previous double, new_sites array<int>"
WATCH_STATE = "last_price double, last_in_stock boolean, known_sites array<int>, baseline double"


def in_order(frames: Iterator[pd.DataFrame], columns: list[str]) -> Iterator[tuple]:
    """A trigger's rows of one key in the order of the first two columns: its chunks are sorted each and merged as columns, so a busy key costs
    these and no frames of rows."""
    runs = []
    for frame in frames:
        part = frame[columns].sort_values(columns[:2])
        runs.append(zip(*(part[c] for c in columns), strict=True))
    return heapq.merge(*runs, key=lambda r: r[:2])


def crossings(ticks: DataFrame, target: float) -> DataFrame:
    """ticks (product, event_id, ts, price), batch order within a trigger restored by (ts, event_id). The state is one number a product."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        previous = state.get[0] if state.exists else None
        rows = []
        for ts, event_id, price in in_order(frames, ["ts", "event_id", "price"]):
            if price <= target and not (previous is not None and previous <= target):
                rows.append((key[0], event_id, ts, price, previous))
            previous = price
        state.update((previous,))
        yield pd.DataFrame(rows, columns=OUT)

    return ticks.groupBy("product").applyInPandasWithState(step, ALERT, STATE, "append", GroupStateTimeout.NoTimeout)


def passes(checks: DataFrame) -> DataFrame:
    """What fires at each check of a watch, by the rules of `demand.watch_step`, which is the batch form.

    checks: watch_id, check_id, ts and, as `demand.watch_prices` gives them, price, site, in_stock, sites (array of int), with target,
    on_new_site and on_restock. They are taken in order of (ts, check_id) within a trigger. A check without price changes nothing; a null target
    never fires, a null stock neither; a null flag counts as off. The state is the last price and stock, the known sites and the first price."""
    columns = ["ts", "check_id", "price", "site", "in_stock", "sites", "target", "on_new_site", "on_restock"]
    known_or_none = lambda x: None if x is None or pd.isna(x) else x

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last_price, last_in_stock, known, baseline = state.get if state.exists else (None, None, None, None)
        known = None if known is None else [int(s) for s in known]
        rows = []
        for ts, check_id, price, site, in_stock, sites, target, on_new_site, on_restock in in_order(frames, columns):
            if pd.isna(price):
                continue
            stock, goal = known_or_none(in_stock), known_or_none(target)
            seen = [] if sites is None else [int(s) for s in sites]
            fresh = sorted(set(seen) - set(known or []))
            fired = None
            if known_or_none(on_new_site):
                fired = "new_site" if known and fresh else None
                known = seen
            if fired is None and known_or_none(on_restock):
                fired = "restock" if stock and last_in_stock is False else None
                last_in_stock = None if stock is None else bool(stock)
            crossed = goal is not None and price <= goal and not (last_price is not None and last_price <= goal)
            fired = fired or ("price" if crossed else None)
            if fired:
                rows.append((key[0], check_id, ts, fired, price, site, last_price, fresh if fired == "new_site" else None))
            last_price, baseline = float(price), float(price) if baseline is None else baseline
        state.update((last_price, last_in_stock, known, baseline))
        yield pd.DataFrame(rows, columns=["watch_id", "check_id", "ts", "fired", "price", "site", "previous", "new_sites"])

    return checks.groupBy("watch_id").applyInPandasWithState(step, FIRED, WATCH_STATE, "append", GroupStateTimeout.NoTimeout)
