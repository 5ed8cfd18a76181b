"""Text functions as column expressions. All but the folding of compatibility forms stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from bazaarlake.functions.parsing import nfkc

#: Marketing words that say nothing about the product.
STOPWORDS = """new hot sale free shipping dropshipping dropship wholesale high quality best top cheap price factory direct oem
odm custom customized professional portable universal multi multifunctional fashion luxury premium original genuine brand
for with and the a an of in to pcs pc piece pieces set sets lot pack gift gifts 2023 2024 2025
2026 upgrade upgraded version style hight super mini""".split()
#: Script ranges of the language guess, in order of precedence.
SCRIPTS = [("ja", r"[\x{3040}-\x{30FF}]"), ("zh", r"[\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}]"), ("ko", r"[\x{AC00}-\x{D7AF}]"), ("ru", r"[\x{0400}-\x{04FF}]")]
#: What a title keeps besides letters, digits and white space; a model or part number; one CJK character.
PUNCTUATION = r"[^\p{L}\p{N}_\s.+#-]"
MODEL_CODE = r"\b([A-Z]{1,6}[-\s]?\d{2,6}(?:[A-Z0-9-]{0,12}[A-Z0-9])?)\b"
CJK = r"([\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{3040}-\x{30FF}\x{AC00}-\x{D7AF}])"


def as_is(text: Column) -> Column:
    """For texts that have no compatibility forms, or none any more."""
    return text


def clean(text: Column, fold: Callable[[Column], Column] = nfkc) -> Column:
    """Compatibility forms folded, white space collapsed and trimmed; null becomes empty."""
    return F.trim(F.regexp_replace(fold(F.coalesce(text, F.lit(""))), r"(?U)\s+", " "))


def title_words(title: Column) -> Column:
    words = F.split(F.regexp_replace(F.lower(clean(title)), PUNCTUATION, " "), r"\s+")
    return F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(STOPWORDS))


def normalize_title(title: Column) -> Column:
    return F.array_join(title_words(title), " ")


def title_tokens(title: Column) -> Column:
    return F.array_distinct(title_words(title))


def jaccard(a: Column, b: Column) -> Column:
    """Of two token sets; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def detect_lang(text: Column) -> Column:
    out = F.when(F.coalesce(text, F.lit("")) == "", "und")
    for lang, script in SCRIPTS:
        out = out.when(text.rlike(script), lang)
    return out.otherwise("en")


def needs_translation(text: Column) -> Column:
    return ~detect_lang(text).isin("en", "und")


def segment_cjk(text: Column) -> Column:
    return clean(F.regexp_replace(text, CJK, " $1 "))


def model_codes(text: Column) -> Column:
    """Distinct part numbers in order, without separators, so that spellings of one code agree."""
    found = F.regexp_extract_all(F.upper(clean(text)), F.lit(MODEL_CODE), 1)
    return F.array_distinct(F.transform(found, lambda c: F.regexp_replace(c, r"[-\s_]", "")))


def codes_conflict(a: Column, b: Column) -> Column:
    """Both state codes and no code of one is a prefix of one of the other."""
    agree = F.exists(a, lambda x: F.exists(b, lambda y: x.startswith(y) | y.startswith(x)))
    return (F.size(a) > 0) & (F.size(b) > 0) & ~agree


def normalize_gtin(value: Column) -> Column:
    """The 14-digit form if the length and the check digit are right, else null."""
    digits = F.regexp_replace(value.cast("string"), r"\D", "")
    g14 = F.lpad(digits, 14, "0")
    weighted = F.aggregate(F.sequence(F.lit(1), F.lit(13)), F.lit(0), lambda acc, i: acc + F.substring(g14, i, F.lit(1)).cast("int") * F.when(i % 2 == 1, 3).otherwise(1))
    right = (10 - weighted % 10) % 10 == F.substring(g14, 14, 1).cast("int")
    return F.when(F.length(digits).isin(8, 12, 13, 14), F.when(right, g14))  # no sum for other lengths or null


def find_gtin(text: Column) -> Column:
    """The first valid number of 8 or 12 to 14 digits in a text, in its 14-digit form."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\b(\d{8}|\d{12,14})\b"), 1)
    return F.get(F.filter(F.transform(found, normalize_gtin), lambda g: g.isNotNull()), 0)


#: Spellings of attribute names that mean the same.
SPEC_KEYS = {
    "brand name": "brand", "brands": "brand", "model number": "model", "model no": "model", "item no": "model", "product name": "name",
    "place of origin": "origin", "country of origin": "origin", "material quality": "material", "product material": "material",
    "size": "dimensions", "product size": "dimensions", "item size": "dimensions", "package size": "package dimensions",
    "net weight": "weight", "item weight": "weight", "gross weight": "gross weight", "power supply": "power", "rated power": "power",
    "input voltage": "voltage", "working voltage": "voltage", "battery capacity": "battery", "battery type": "battery type",
    "screen size": "display size", "display screen": "display", "connection": "connectivity", "interface type": "interface",
    "bluetooth version": "bluetooth", "waterproof grade": "ip rating", "protection level": "ip rating", "certification": "certifications",
    "warranty period": "warranty", "color": "color", "colour": "color",
}


def spec_key(key: Column, fold: Callable[[Column], Column] = nfkc) -> Column:
    """An attribute's name in one spelling."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(clean(key, fold)), r"[\s:：]+$", ""), PUNCTUATION, " "), r"\s+", " "))
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in SPEC_KEYS.items() for x in pair)), bare), bare)


def keyword(text: Column) -> Column:
    """A search's key: trimmed, white space collapsed, lower case."""
    return F.lower(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " ")))


def hash_key(*parts: Column) -> Column:
    """SHA-256 over the parts, each ended by a unit separator."""
    return F.sha2(F.concat(*(x for p in parts for x in (F.coalesce(p, F.lit("")), F.lit("\x1f")))), 256)


def truncate(text: Column, n: int, fold: Callable[[Column], Column] = nfkc) -> Column:
    """Cleaned, and cut to n characters with an ellipsis if longer; null stays null."""
    t = clean(text, fold)
    return F.when(text.isNull(), F.lit(None).cast("string")).when(F.length(t) <= n, t).otherwise(F.concat(F.rtrim(F.substring(t, 1, n - 1)), F.lit("…")))
