"""Scores of profiles in chunks: attributes that two sides state, and the best products of each listing profile among those of a chunk."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructType

from bazaarlake.functions.similarity import token_set_ratio
from bazaarlake.operators.matching import CODE_BONUS, CONFLICT, WEIGHTS

#: Attributes that say nothing, agreement of values with one number, ratio of words that agrees.
NOISE_KEYS = ["description", "name", "keywords", "packing", "origin"]
NUMBER_AGREES, RATIO_AGREES = 0.9, 0.85
KINDS = [(coded, pictured) for coded in (False, True) for pictured in (False, True)]  # of a listing: has codes, has pictures
BEST = "asker string, profile string, kind int, worst double, product_id long"
_NUMBER = re.compile(r"\d+(?:\.\d+)?")


@lru_cache(maxsize=1 << 16)
def value_agreement(x: str, y: str) -> float:
    """Of two values: equal 1, the same first number 0.9, else a high enough ratio of words."""
    if x == y:
        return 1.0
    m, n = _NUMBER.search(x), _NUMBER.search(y)
    if m and n and m[0] == n[0]:
        return NUMBER_AGREES
    ratio = token_set_ratio(x, y) / 100
    return ratio if ratio > RATIO_AGREES else 0.0


def _comparable(entries) -> dict[str, str]:
    stated = {str(k).strip().lower(): str(v).strip().lower() for k, v in entries if v is not None}
    return {k: stated[k] for k in sorted(stated) if k not in NOISE_KEYS}


@F.pandas_udf(StructType().add("agreement", DoubleType()).add("overlap", IntegerType()))
def spec_agreement(keys_a: pd.Series, values_a: pd.Series, keys_b: pd.Series, values_b: pd.Series) -> pd.DataFrame:
    """Mean agreement over the attributes that both state."""
    out = []
    for ka, va, kb, vb in zip(keys_a, values_a, keys_b, values_b, strict=True):
        a, b = _comparable(zip(ka, va, strict=True)), _comparable(zip(kb, vb, strict=True))
        shared, total = [k for k in a if k in b], 0.0
        for k in shared:
            total += value_agreement(a[k], b[k])
        out.append((total / len(shared) if shared else 0.0, len(shared)))
    return pd.DataFrame(out, columns=["agreement", "overlap"]).astype({"agreement": "float64", "overlap": "int32"})


def agreements(a: list[dict[str, str]], b: list[dict[str, str]]) -> tuple[np.ndarray, np.ndarray]:
    """spec_agreement() of each of a with each of b: values are compared once an attribute."""
    total, overlap = np.zeros((len(a), len(b))), np.zeros((len(a), len(b)), np.int64)
    for key in sorted({k for x in a for k in x} & {k for y in b for k in y}):
        i, j = (np.flatnonzero([key in x for x in side]) for side in (a, b))
        xs, ys = ({v: n for n, v in enumerate(dict.fromkeys(side[k][key] for k in at))} for side, at in ((a, i), (b, j)))
        values = np.array([[value_agreement(x, y) for y in ys] for x in xs])
        total[np.ix_(i, j)] += values[np.ix_([xs[a[k][key]] for k in i], [ys[b[k][key]] for k in j])]
        overlap[np.ix_(i, j)] += 1
    return total / np.maximum(overlap, 1), overlap


def rounded(values: np.ndarray) -> np.ndarray:
    """To four digits as Spark rounds: half up, by the shortest decimal form."""
    distinct, at = np.unique(values, return_inverse=True)
    return np.array([float(Decimal(repr(v)).quantize(Decimal("0.0001"), ROUND_HALF_UP)) for v in distinct.tolist()])[at].reshape(values.shape)


def plain_scores(title: float | None, specs: np.ndarray, overlap: np.ndarray, shared: np.ndarray, conflict: np.ndarray, unlike: bool) -> np.ndarray:
    """matching.score() without an image, or with images that are unlike."""
    image = WEIGHTS["image"] if unlike else 0.0
    total = image + (0.0 if title is None else WEIGHTS["title"]) + np.where(overlap > 0, WEIGHTS["specs"], 0.0)
    base = ((0.0 if title is None else title * WEIGHTS["title"]) + np.where(overlap > 0, specs * WEIGHTS["specs"], 0.0)) / np.where(total > 0, total, 1.0)
    with_code = np.minimum(1.0, base + np.where(shared, CODE_BONUS, 0.0))
    return np.where(total > 0, rounded(with_code * np.where(conflict, CONFLICT, 1.0)), 0.0)


def code_relations(a: list[tuple], b: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    """Whether each of a shares a code with each of b, and whether both have codes and none of one begins one of the other."""
    xs, ys = ({c: n for n, c in enumerate(dict.fromkeys(side))} for side in (a, b))
    shared = np.array([[not set(x).isdisjoint(y) for y in ys] for x in xs])
    conflict = np.array([[bool(x) and bool(y) and not any(p.startswith(q) or q.startswith(p) for p in x for q in y) for y in ys] for x in xs])
    at = np.ix_([xs[x] for x in a], [ys[y] for y in b])
    return shared[at], conflict[at]


def best_in_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow over pairs of chunks (asker, title, as, bs): for each profile of as and kind of listing the best score (BEST), ties the smallest product."""
    for batch in batches:
        for cell in batch.to_pylist():
            mine, others = cell["as"], cell["bs"]
            specs, overlap = agreements(*([_comparable((e["key"], e.get("value")) for e in json.loads(p["stated"])) for p in side] for side in (mine, others)))
            shared, conflict = code_relations(*([tuple(p["codes"]) for p in side] for side in (mine, others)))
            plain, unlike = (plain_scores(cell["title"], specs, overlap, shared, conflict, seen) for seen in (False, True))
            firsts = sorted((f["product_id"], f["coded"], f["pictured"], n) for n, p in enumerate(others) for f in p["firsts"])
            products, coded, pictured, at = map(np.array, zip(*firsts, strict=True))
            each = np.arange(len(mine))
            for kind, (has_code, has_picture) in enumerate(KINDS):
                score = np.where(pictured, unlike[:, at], plain[:, at]) if has_picture else plain[:, at]
                score = np.where(coded, 0.0, score) if has_code else score
                best = score.argmax(axis=1)  # the first of the greatest
                yield pa.RecordBatch.from_arrays([
                    pa.array([cell["asker"]] * len(mine), pa.string()), pa.array([p["profile"] for p in mine], pa.string()), pa.array(np.full(len(mine), kind, np.int32)), pa.array(-score[each, best]), pa.array(products[best].astype(np.int64)),
                ], ["asker", "profile", "kind", "worst", "product_id"])
