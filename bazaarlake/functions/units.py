"""Currency, weight, size and count columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Units of a currency for one US dollar when no stored rate is known.
FALLBACK_RATES = {
    "USD": 1.0, "CNY": 7.15, "EUR": 0.92, "GBP": 0.79, "JPY": 152.0, "KRW": 1360.0, "RUB": 92.0, "INR": 83.5, "BRL": 5.4,
    "AUD": 1.51, "CAD": 1.36, "HKD": 7.82, "TWD": 32.3, "SGD": 1.34, "MAD": 9.9, "MXN": 17.5,
}
#: Kilograms and centimetres in a unit.
KILOGRAMS = {"kg": 1.0, "kgs": 1.0, "kilogram": 1.0, "kilograms": 1.0, "g": 0.001, "gram": 0.001, "grams": 0.001, "lb": 0.45359237, "lbs": 0.45359237, "pound": 0.45359237, "pounds": 0.45359237, "oz": 0.0283495, "ounce": 0.0283495, "ounces": 0.0283495}
CENTIMETRES = {"mm": 0.1, "cm": 1.0, "m": 100.0, "in": 2.54, "inch": 2.54, "inches": 2.54}
MAX_EDGE_CM = 300.0


def _lookup(table: dict[str, float], key: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), key)


def rate(currency: Column, stored: Column | None = None) -> Column:
    """A stored rate if it is known and not zero, else the fallback; a null currency is USD."""
    fallback = F.try_element_at(F.create_map(*(F.lit(x) for pair in FALLBACK_RATES.items() for x in pair)), F.upper(F.coalesce(currency, F.lit("USD"))))
    return fallback if stored is None else F.coalesce(F.nullif(stored, F.lit(0.0)), fallback)


def to_usd(amount: Column, currency: Column) -> Column:
    """Null for an unknown currency."""
    return F.round(amount / rate(currency), 4)


def count_of(text: Column) -> Column:
    """1.2K, 3M, 1.5万 and 1,234 as numbers."""
    number = F.regexp_replace(F.regexp_extract(text, r"([\d.,]+)", 1), ",", "")
    times = F.when(text.rlike(r"(?i)[\d.]\s*k"), 1e3).when(text.rlike(r"(?i)[\d.]\s*m"), 1e6).when(text.rlike(r"[\d.]\s*万"), 1e4).otherwise(1.0)
    return F.try_to_number(F.nullif(number, F.lit("")), F.lit("999999999.999")).cast("double") * times


def weight_kg(text: Column) -> Column:
    """The first weight in a text; null if it has none."""
    low = F.lower(text)
    shape = rf"(\d+(?:\.\d+)?)\s*({'|'.join(sorted(KILOGRAMS, key=len, reverse=True))})\b"
    return F.nullif(F.regexp_extract(low, shape, 1), F.lit("")).cast("double") * F.try_element_at(F.create_map(*(F.lit(x) for p in KILOGRAMS.items() for x in p)), F.regexp_extract(low, shape, 2))


def dims_cm(text: Column) -> Column:
    """Three edges in centimetres; null if one isn't positive or is implausibly long."""
    number = r"(\d+(?:\.\d+)?)"
    shape = rf"{number}\s*[x×*]\s*{number}\s*[x×*]\s*{number}\s*({'|'.join(sorted(CENTIMETRES, key=len, reverse=True))})?"
    unit = F.coalesce(F.nullif(F.regexp_extract(F.lower(text), shape, 4), F.lit("")), F.lit("cm"))
    edges = F.array(*(F.nullif(F.regexp_extract(F.lower(text), shape, k), F.lit("")).cast("double") * _lookup(CENTIMETRES, unit) for k in (1, 2, 3)))
    return F.when(F.forall(edges, lambda e: (e > 0) & (e <= MAX_EDGE_CM)), edges)


def of_specs(specs: Column, words: list[str], parse) -> Column:
    """The first value of a map of attributes that parses, of those whose name has one of the words."""
    named = F.filter(F.map_entries(specs), lambda e: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(F.lower(e["key"]), w)))
    return F.get(F.filter(F.transform(named, lambda e: parse(e["value"])), lambda x: x.isNotNull()), 0)


def spec_weight(specs: Column) -> Column:
    return of_specs(specs, ["weight"], weight_kg)


def spec_dims(specs: Column) -> Column:
    return of_specs(specs, ["dimension", "size", "package"], dims_cm)


def human_bytes(n: Column) -> Column:
    """A number of bytes with one decimal and its unit."""
    step = F.least(F.lit(4), F.floor(F.log(F.greatest(n.cast("double"), F.lit(1.0))) / F.log(F.lit(1024.0))).cast("int"))
    return F.format_string("%.1f %s", n / F.pow(F.lit(1024.0), step), F.element_at(F.array(*map(F.lit, ("B", "KB", "MB", "GB", "TB"))), step + 1))


def number_of(text: Column) -> Column:
    """The first number of a text, commas as decimal points, as lenient mappings read it ("1,234.56" gives 1.234); null without one."""
    return F.nullif(F.regexp_extract(F.replace(text, F.lit(","), F.lit(".")), r"(\d+(?:\.\d+)?)", 1), F.lit("")).cast("double")


def rounded(x: Column, digits: int = 2) -> Column:
    """To so many decimals, halves to even, by the binary value as most languages' floats do it (decimal rounding would lift 10.075 to 10.08)."""
    return F.rint(x * 10**digits) / 10**digits


def money_text(amount: Column) -> Column:
    """Four decimals at most, no trailing zeros; null as empty."""
    return F.when(amount.isNull(), "").otherwise(F.rtrim(F.rtrim(F.format_string("%.4f", amount), F.lit("0")), F.lit(".")))
