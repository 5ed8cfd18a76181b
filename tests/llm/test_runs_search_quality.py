"""Periodic runs, ranked search and quality rules against brute force."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st

from bazaarlake.llm import lexical_search, periodic_runs, quality_rules
from test_operators import SPACE, counted, empty, hard, sha  # noqa: F401


def words_of(text):
    return [w for w in SPACE.split(text or "") if w]


def naive_runs(words):
    """(start, end, period) of every run, by its definition."""
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        start = 0
        for i in range(n - q + 1):
            if i == n - q or words[i] != words[i + q]:
                if i + q - start >= max(12, 2 * q) and i > start:
                    found.setdefault((start, i + q), q)
                start = i + 1
    return sorted((s, q, e) for (s, e), q in found.items())


def naive_report(doc_id, text):
    words = words_of(text)
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = naive_runs(words)
    gone = {i for s, q, e in runs for i in range(s + q, e)}
    best = min(runs, key=lambda r: (r[0] - r[2], r[0], r[1]), default=None)
    four = (best[0], best[2] - best[0], best[1], 1000 * (best[2] - best[0]) // best[1]) if best else (None,) * 4
    return (doc_id, len(runs), *four, sha("".join(f"{s},{e - s},{q}\n" for s, q, e in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


RUN_COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_periodic_runs(spark, hard):  # noqa: F811
    folder, rows = hard
    assert counted(periodic_runs.periodic_run_detection(spark, folder), *RUN_COLUMNS) == Counter(naive_report(i, t) for i, t in rows)


def test_lag_ranges_of_long_texts(spark, monkeypatch):
    monkeypatch.setattr(periodic_runs, "LONG_BYTES", 100)
    monkeypatch.setattr(periodic_runs, "RANGE_CELLS", 500)
    monkeypatch.setattr(periodic_runs, "CELLS_A_WORD", 5)
    rng = random.Random(3)
    texts = [" ".join(rng.choice("ab") for _ in range(n)) for n in (60, 200, 300)] + ["x " * 150, " ".join("abcdefghijklmno" * 20), "a b", None, " ".join(str(rng.random()) for _ in range(300))]
    rows = [(i, t or "") for i, t in enumerate(texts)] * 2 + [(0, "a " * 80), (None, "b " * 90), (None, "b " * 90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = periodic_runs.periodic_runs(docs, periodic_runs.planted, digests=True)
    assert counted(got, *RUN_COLUMNS) == Counter(naive_report(i, t) for i, t in rows)
    shown = {(r.doc_id, r.n_runs, r.runs, r.collapsed) for r in periodic_runs.periodic_runs(spark.createDataFrame([(7, "so so " + "la di " * 8 + "da")], "doc_id long, text string")).collect()}
    assert shown == {(7, 1, "2,16,2\n", "so so la di da")}


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=90), st.integers(1, 5))
def test_stretches_equal_definition(letters, parts):
    ids = np.array(letters, np.int32)
    found = np.concatenate([periodic_runs.stretches(ids, periodic_runs.cut(len(ids), k, parts), periodic_runs.cut(len(ids), k + 1, parts)) for k in range(parts)])
    assert [tuple(r) for r in periodic_runs.smallest_periods(found).tolist()] == [(s, e, q) for s, q, e in naive_runs(letters)]


@pytest.mark.parametrize("n", [0, 1, 2, 3, 17, 1000, 12345])
@pytest.mark.parametrize("parts", [1, 2, 7, 50])
def test_lag_ranges_cover_every_lag_once(n, parts):
    cuts = [periodic_runs.cut(n, k, parts) for k in range(parts + 1)]
    assert cuts[0] == 1 and cuts[-1] == n // 2 + 1 and all(a <= b for a, b in zip(cuts, cuts[1:], strict=False))


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def naive_search(rows, items, k=10):
    docs = [(i, Counter(t)) for i, x in rows if (t := terms(x))]
    n_docs, total = len(docs), sum(sum(c.values()) for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    texts, out = {}, []
    for item, text in items:
        texts.setdefault(item, set()).add(text or "")
    for item, own in texts.items():
        asked = Counter(t for x in own for t in terms(x))
        scores = []
        for i, c in docs:
            m = 25 + (75 * sum(c.values()) * n_docs) // total
            score = sum(q * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m)) for t, q in asked.items() if c[t])
            if score > 0:
                scores.append((-score, i is None, i))
        out += [(item, r, i, -s) for r, (s, _, i) in enumerate(sorted(scores)[:k], 1)]
    return Counter(out)


@pytest.mark.parametrize("group_items", [2, 512])
def test_ranked_search(spark, hard, monkeypatch, group_items):  # noqa: F811
    monkeypatch.setattr(lexical_search, "GROUP_ITEMS", group_items)
    folder, rows = hard
    rng = random.Random(2)
    words = [w for _, t in rows for w in words_of(t)]
    asked = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 30))) for _ in range(12)]
    items = [(i, t) for i, t in enumerate(asked)] + [(3, asked[4]), (3, asked[3]), (5, asked[5]), (50, None), (51, "nowhere-to-be-found"), (52, "stupid STUPID moron"), (None, "one two")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    index = lexical_search.LexicalIndex.build(docs)
    again = lexical_search.LexicalIndex(spark, index.location)
    for k in (1, 10):
        got = lexical_search.search(again, spark.createDataFrame(items, "item_id long, text string"), k)
        assert counted(got, "item_id", "rank", "doc_id", "score") == naive_search(rows, items, k)


def test_blocks_are_read_without_a_shuffle(spark, hard):  # noqa: F811
    _, rows = hard
    index = lexical_search.LexicalIndex.build(spark.createDataFrame(rows, "doc_id long, text string").repartition(6))
    plan = lexical_search._candidates(index, [(0, b"one", 5), (1, b"stupid", 7)], 10)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan and "Exchange hashpartitioning" not in plan and "impacts" not in plan


def test_bounds_enclose_every_score():
    tf, n = np.arange(1, 400), np.arange(1, 4000, 10)
    exact = lexical_search.exact_impacts(tf, n[: len(tf)], 1000, 50_000)
    byte = -(-exact // lexical_search.STEP)
    assert exact.max() < lexical_search.SCALE and byte.max() <= 255 and (byte * lexical_search.STEP >= exact).all() and (byte * lexical_search.STEP - lexical_search.STEP < exact).all()


def naive_quality(doc_id, text):
    words, data = words_of(text), text.encode()
    grams = Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
    repeated = len({k + d for k in range(len(words) - 4) if grams[tuple(words[k : k + 5])] > 1 for d in range(5)})
    lines = [x for x in text.split("\n") if words_of(x)]
    failed = len(words) < 10 or 100 * repeated > 20 * len(words)
    ratio = lambda b: len(zstandard.ZstdCompressor(level=3).compress(b)) / len(b)

    def bad(b):
        band = [x for x in quality_rules.BANDS if x[0] <= len(b)]
        return bool(band) and not band[-1][1] <= ratio(b) <= band[-1][2]

    chunks = [data[k : k + 4096] for k in range(0, len(data), 4096)]
    kept = not failed and not bad(data) and sum(len(c) for c in chunks if bad(c)) <= 0.25 * len(data)
    return doc_id, len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), repeated, failed, kept


QUALITY_COLUMNS = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]


def test_quality_rules(spark, hard):  # noqa: F811
    folder, rows = hard
    assert counted(quality_rules.quality_rules(spark, folder), *QUALITY_COLUMNS) == Counter(naive_quality(i, t) for i, t in rows)


def test_compression_bands_reject_repeats_and_noise(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("aeiou") + rng.choice("lmnrst") for _ in range(rng.randint(1, 4)))
    page = " ".join(word() for _ in range(3000))
    noise = " ".join("".join(chr(rng.randint(33, 126)) for _ in range(12)) for _ in range(500))
    template = " ".join(f"item number {k} costs just {k * 7 % 100} today" for k in range(300))
    rows = [(1, page), (2, noise), (3, template), (4, page[:9000] + " " + noise[:6000]), (5, page[:9000] + " " + noise[:900]), (6, "déjà vu # | a\n a\n a\nb\n\n\n" + page[:200])]
    got = {r.doc_id: r for r in quality_rules.quality(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i: r.kept for i, r in got.items()} == {1: True, 2: False, 3: False, 4: False, 5: True, 6: True}
    assert {i: tuple(r)[:8] for i, r in got.items()} == {i: naive_quality(i, t) for i, t in rows}


def test_quality_on_labels(spark, sf_dir):
    """Few documents that are labelled good fail, and those that do fail by the base rules."""
    good = spark.read.parquet(f"{sf_dir}/labels.parquet").filter("quality = 1").select("doc_id")
    judged = quality_rules.quality_rules(spark, sf_dir).join(good, "doc_id").filter("NOT base_failed")
    assert judged.filter("NOT kept").count() == 0
