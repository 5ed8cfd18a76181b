"""Stateful parsers that no built-in expresses, as Arrow-batched pandas UDFs over plain functions."""

from __future__ import annotations

import json
import re
import unicodedata
from html.parser import HTMLParser
from typing import NamedTuple

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructType

#: Currency marks and codes with their ISO codes; units with their names.
CURRENCIES = {
    "us$": "USD", "$": "USD", "usd": "USD", "¥": "CNY", "￥": "CNY", "rmb": "CNY", "cny": "CNY", "元": "CNY", "€": "EUR", "eur": "EUR",
    "£": "GBP", "gbp": "GBP", "₽": "RUB", "rub": "RUB", "₩": "KRW", "krw": "KRW", "₹": "INR", "inr": "INR", "r$": "BRL", "brl": "BRL", "mad": "MAD", "dh": "MAD",
    "a$": "AUD", "aud": "AUD", "c$": "CAD", "cad": "CAD", "hk$": "HKD", "hkd": "HKD", "nt$": "TWD", "twd": "TWD", "s$": "SGD", "sgd": "SGD", "jpy": "JPY",
}
UNITS = {
    "pc": "piece", "pcs": "piece", "piece": "piece", "pieces": "piece", "件": "piece", "个": "piece", "只": "piece", "set": "set", "sets": "set", "套": "set",
    "unit": "unit", "units": "unit", "pair": "pair", "pairs": "pair", "bag": "bag", "bags": "bag", "袋": "bag", "box": "box", "boxes": "box", "箱": "carton",
    "carton": "carton", "cartons": "carton", "m": "meter", "meter": "meter", "meters": "meter", "kg": "kg", "kilogram": "kg", "kilograms": "kg",
    "ton": "ton", "tons": "ton", "roll": "roll", "rolls": "roll", "pack": "pack", "packs": "pack",
}

#: One word of a price or quantity text: a number with its separators, a currency mark, a word, any other sign.
_TOKEN = re.compile(r"(?P<number>\d+(?:[.,]\d+)*)|(?P<mark>(?:US\s?|HK|NT|[RACS])?\$|[¥￥€£₽₩₹元])|(?P<word>[^\W\d_]+)|(?P<sign>\S)", re.IGNORECASE)
_RANGE, _OPEN = {"-", "~", "–", "to"}, {"+", "以上"}
_LADDER_GAP = 24  # characters between a quantity and its price, at most


class Token(NamedTuple):
    kind: str  # number, mark, word or sign
    text: str
    start: int
    end: int


def tokens(text: str | None) -> list[Token]:
    """The text's tokens; a word that names a currency is a mark."""
    out = []
    for m in _TOKEN.finditer(text or ""):
        kind = "mark" if m.lastgroup == "word" and m[0].lower() in CURRENCIES else m.lastgroup
        out.append(Token(kind, m[0], *m.span()))
    return out


def currency_of(mark: str) -> str | None:
    return CURRENCIES.get("".join(mark.split()).lower())


def to_number(raw: str) -> float | None:
    """1,234.56, 1.234,56 and 12,34 alike. Of two kinds of separators the last is the decimal one; a repeated one groups, and so does a lone comma before three digits."""
    used = re.findall(r"[.,]", raw)
    decimal = None
    if len(set(used)) == 2 or used == ["."]:
        decimal = used[-1]
    elif used == [","] and not re.fullmatch(r"\d+,\d{3}", raw):
        decimal = ","
    whole, _, part = raw.rpartition(decimal) if decimal else (raw, "", "")
    digits = re.sub(r"[.,\s]", "", whole)
    return float(f"{digits}.{part or 0}") if digits.isdigit() else None


def priced(found: list[Token]) -> list[tuple[int, float, str | None]]:
    """Place, value and currency mark (None: bare) of each number. A mark belongs to the number after it, or else to the one before."""
    out, taken = [], -1
    for k, t in enumerate(found):
        if t.kind != "number":
            continue
        mark = None
        if k and found[k - 1].kind == "mark" and taken != k - 1:
            mark, taken = found[k - 1].text, k - 1
        if k + 1 < len(found) and found[k + 1].kind == "mark" and (mark is None or found[k + 1].text.isalpha()):
            mark, taken = found[k + 1].text, k + 1
        value = to_number(t.text)
        if value is not None:
            out.append((k, value, mark))
    return out


def parse_price(text: str | None, default: str = "USD") -> tuple[float | None, float | None, str]:
    """Least and greatest price (None if there is one only) and currency. A bare number counts only after a currency."""
    values, currency = [], None
    for _, value, mark in priced(tokens(text)):
        currency = currency or (mark and currency_of(mark))
        if mark or currency:
            values.append(value)
    if not values:
        return None, None, default
    least, most = min(values), max(values)
    return least, most if most > least else None, currency or default


def _unit(word: str) -> str | None:
    """The unit that a word names; Chinese units may have other signs after them."""
    return UNITS.get(word.lower()) or next((u for k, u in UNITS.items() if not k.isascii() and word.startswith(k)), None)


def _quantity(found: list[Token], k: int) -> tuple[int, int]:
    """The whole number at k (groups of three digits may stand apart) and the place after it."""
    digits, k = re.sub(r"\D", "", found[k].text), k + 1
    while k < len(found) and found[k].kind == "number" and len(found[k].text) == 3 and found[k].start == found[k - 1].end + 1:
        digits, k = digits + found[k].text, k + 1
    return int(digits), k


def parse_moq(text: str | None) -> tuple[int, str]:
    """Least order quantity and unit: an explicit minimum order wins over the first quantity with a unit."""
    found = tokens(text)
    least = named = unit = None
    for k, t in enumerate(found):
        if t.kind != "number":
            continue
        n, after = _quantity(found, k)
        lead = [x.text.lower() for x in found[max(0, k - 5) : k] if x.text not in ".:：()"]
        asked = lead[-1:] == ["moq"] or any(x.startswith(("起批", "起订")) for x in lead[-1:]) or "order" in lead[-2:] and any(x in ("min", "minimum") for x in lead)
        if least is None and asked:
            least = n
        if unit is None and after < len(found) and found[after].kind == "word" and (named_unit := _unit(found[after].text)):
            named, unit = n, named_unit
    return max(1, least if least is not None else named or 1), unit or "piece"


def parse_tiers(text: str | None, default: str = "USD") -> list[dict]:
    """Quantity breaks of a price ladder: a quantity or a range of them, then its price."""
    found, out = tokens(text), []
    prices = {k: (value, mark) for k, value, mark in priced(found) if mark}
    k = 0
    while k < len(found):
        if found[k].kind != "number" or k in prices:
            k += 1
            continue
        (low, after), high = _quantity(found, k), None
        if after + 1 < len(found) and found[after].text.lower() in _RANGE and found[after + 1].kind == "number" and after + 1 not in prices:
            high, after = _quantity(found, after + 1)
        begin = found[after - 1].end
        while after < len(found) and found[after].kind in ("word", "sign") and found[after].end - begin <= _LADDER_GAP:
            after += 1
        after += after < len(found) and found[after].kind == "mark"
        if after in prices:
            value, mark = prices[after]
            out.append({"min_qty": low, "max_qty": high, "price": value, "currency": currency_of(mark) or default})
            after += 1
        k = max(after, k + 1)
    return out


@F.pandas_udf(StructType().add("price_min", DoubleType()).add("price_max", DoubleType()).add("currency", StringType()))
def parse_price_udf(text: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([parse_price(t) for t in text], columns=["price_min", "price_max", "currency"]).astype({"price_min": "float64", "price_max": "float64"})


@F.pandas_udf(StructType().add("moq", IntegerType()).add("unit", StringType()))
def parse_moq_udf(text: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([parse_moq(t) for t in text], columns=["moq", "unit"])


@F.pandas_udf(ArrayType(StructType().add("min_qty", IntegerType()).add("max_qty", IntegerType()).add("price", DoubleType()).add("currency", StringType())))
def parse_tiers_udf(text: pd.Series) -> pd.Series:
    return text.map(parse_tiers)


@F.pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Compatibility forms folded; null stays null."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


@F.pandas_udf(ArrayType(StringType()))
def nfkc_each(texts: pd.Series) -> pd.Series:
    """The same for each text of an array."""
    return texts.map(lambda ts: None if ts is None else [None if t is None else unicodedata.normalize("NFKC", t) for t in ts])


@F.pandas_udf(StringType())
def without_accents(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else "".join(c for c in unicodedata.normalize("NFD", t) if not unicodedata.combining(c)))


class _JsonLd(HTMLParser):
    """Collects the contents of JSON-LD scripts."""

    def __init__(self):
        super().__init__()
        self.inside, self.found = False, []

    def handle_starttag(self, tag, attrs):
        self.inside = tag == "script" and dict(attrs).get("type", "").lower() == "application/ld+json"
        if self.inside:
            self.found.append("")

    def handle_endtag(self, tag):
        self.inside = False

    def handle_data(self, data):
        if self.inside:
            self.found[-1] += data


def json_ld_nodes(html: str | None) -> list[dict]:
    """All JSON-LD objects of a page, graphs and lists flattened; broken blocks are skipped."""
    parser, out = _JsonLd(), []
    parser.feed(html or "")
    for block in parser.found:
        try:
            stack = [json.loads(block)]
        except ValueError:
            continue
        while stack:
            node = stack.pop(0)
            if isinstance(node, list):
                stack = node + stack
            elif isinstance(node, dict):
                out.append(node)
                if isinstance(node.get("@graph"), list):
                    stack = node["@graph"] + stack
    return out


def dig(value, path: str):
    """a.b[0].c and fan-out a.b[].c into nested JSON; None where it leads nowhere."""
    many = False
    here = [value]
    for name, index in re.findall(r"([^.\[\]]+)|\[(\d*)\]", path):
        if name:
            here = [v[name] for v in here if isinstance(v, dict) and name in v]
        elif index:
            here = [v[int(index)] for v in here if isinstance(v, list) and int(index) < len(v)]
        else:
            many = True
            here = [x for v in here if isinstance(v, list) for x in v]
    return here if many else here[0] if here else None


def array_paths(value, depth: int = 6, most: int = 15) -> list[str]:
    """Dotted paths of the arrays of objects in nested JSON, shallow ones first."""
    found, level = [], [("", value)]
    for _ in range(depth):
        deeper = []
        for path, v in level:
            for k, x in v.items() if isinstance(v, dict) else ():
                at = f"{path}.{k}" if path else k
                if isinstance(x, list) and x and isinstance(x[0], dict):
                    found.append(at)
                deeper.append((at, x))
        level = deeper
    return found[:most]


@F.pandas_udf(ArrayType(StringType()))
def json_ld_udf(html: pd.Series) -> pd.Series:
    return html.map(lambda h: [json.dumps(n, ensure_ascii=False, sort_keys=True) for n in json_ld_nodes(h)])


@F.pandas_udf(StringType())
def money_text(amount: pd.Series) -> pd.Series:
    """Four decimals at most, no trailing zeros; null as empty. The binary value decides the last digit, which decimal columns don't see."""
    return amount.map(lambda x: "" if pd.isna(x) else f"{x:.4f}".rstrip("0").rstrip("."))
