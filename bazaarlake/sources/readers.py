"""Readers of saved API answers and pages: a mapping compiled to columns, and parsers where no column function reaches."""

from __future__ import annotations

import json
from collections.abc import Callable
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


def kept(value: Column, test: Callable[[Column], Column]) -> Column:
    """The value if it passes the test, else null; it is computed once, where a condition beside its result would read a document twice."""
    return F.get(F.filter(F.array(value), test), F.lit(0))


def json_field(document: Column, paths: list[str]) -> Column:
    """The first of several paths that leads to something: empty strings, lists and objects don't count, zero does."""
    tries = [F.get_json_object(document, "$." + p.replace("[]", "[*]")) for p in paths]
    return F.coalesce(*(kept(t, lambda x: ~x.isin("", "[]", "{}")) for t in tries), F.lit(None).cast("string"))


def mapped(rows: DataFrame, document: str, items: str, fields: dict[str, list[str]]) -> DataFrame:
    """One row for each item of the array at `items` in the JSON column, with the mapping's fields as columns."""
    array = F.from_json(F.get_json_object(document, "$." + items), ArrayType(StringType()))
    item = F.col("_item")
    return rows.select("*", F.explode(array).alias("_item")).select(*[c for c in rows.columns if c != document], *(json_field(item, p).alias(n) for n, p in fields.items()))


def balanced_json(text: str, start: int) -> str | None:
    """The JSON object or array that begins at start, by counting brackets outside strings."""
    depth, quoted, skip = 0, False, False
    for k in range(start, len(text)):
        c = text[k]
        if skip:
            skip = False
        elif quoted:
            skip, quoted = c == "\\", c != '"'
        elif c == '"':
            quoted = True
        elif c in "{[":
            depth += 1
        elif c in "}]":
            depth -= 1
            if not depth:
                return text[start : k + 1]
    return None


def embedded_json(html: str | None, marker: str) -> list[str]:
    """The JSON values assigned after a marker in a page's scripts; what doesn't parse is skipped."""
    out, at = [], 0
    while html and (at := html.find(marker, at)) >= 0:
        at += len(marker)
        opens = [k for k in (html.find("{", at), html.find("[", at)) if k >= 0]
        blob = balanced_json(html, min(opens)) if opens else None
        if blob:
            try:
                json.loads(blob)
                out.append(blob)
            except ValueError:
                pass
    return out


def find_items(value, keys: set[str], depth: int = 8) -> list[dict]:
    """The first list, breadth first, whose objects have one of the keys."""
    level = [value]
    for _ in range(depth):
        deeper = []
        for v in level:
            if isinstance(v, list) and v and all(isinstance(x, dict) for x in v) and keys & v[0].keys():
                return v
            deeper += v if isinstance(v, list) else list(v.values()) if isinstance(v, dict) else []
        level = deeper
    return []


class _Cards(HTMLParser):
    """Texts of the elements that match tag.class, each once, nested matches within the outer one."""

    def __init__(self, wanted: list[tuple[str, str]]):
        super().__init__()
        self.wanted, self.open, self.cards = wanted, 0, []

    def handle_starttag(self, tag, attrs):
        if self.open:
            self.open += tag not in VOID
        elif any((not t or t == tag) and (not c or c in dict(attrs).get("class", "").split()) for t, c in self.wanted):
            self.open = 1
            self.cards.append([])

    def handle_endtag(self, tag):
        self.open -= bool(self.open) and tag not in VOID

    def handle_data(self, data):
        if self.open and data.strip():
            self.cards[-1].append(data.strip())


def select_cards(html: str | None, selectors: list[str]) -> list[str]:
    """Texts of the cards of the first selector (or comma group) that matches: tag, .class or tag.class."""
    for selector in selectors:
        parser = _Cards([tuple(part.strip().partition(".")[::2]) for part in selector.split(",")])
        parser.feed(html or "")
        if parser.cards:
            return [" ".join(c) for c in parser.cards]
    return []


def cards_udf(selectors: list[str]):
    @F.pandas_udf(ArrayType(StringType()))
    def cards(html: pd.Series) -> pd.Series:
        return html.map(lambda h: select_cards(h, selectors))

    return cards


def embedded_json_udf(marker: str):
    @F.pandas_udf(ArrayType(StringType()))
    def blobs(html: pd.Series) -> pd.Series:
        return html.map(lambda h: embedded_json(h, marker))

    return blobs
