"""Document fingerprints by locally consistent parsing.

A text's bytes are parsed into phrases, those phrases into phrases of phrases, and so on. At each level
runs of equal names become one, deterministic coin tossing (each name compared with its left neighbour,
repeated until few labels remain) gives neighbours distinct small labels, and the labels' local maxima
begin phrases; a phrase's name is a hash of its members' names. Borders depend only on a few neighbours,
so equal substrings have the same interior phrases wherever they stand. The phrase names of the levels
from FIRST_LEVEL on go into a min-wise sketch of BINS values, which is the fingerprint; the likeness of
two fingerprints is the share of bins that agree, an estimate of the phrase sets' Jaccard similarity.

The parse stops at LAST_LEVEL: names above it stand for whole paragraphs and seldom recur, so long texts
are compared by phrases of LAST_LEVEL at most.

The next document, in descending order of doc_id, is found in ranges of the sorted order (by doc_id, then the
text's first HEAD_CHARS characters, then its hash): rows are dealt to ranges of about equal counts, and the
first row of each range also goes to the range before, so that each task sees its rows in order plus the one
after them. Equal rows that fill several ranges are dealt over these in turn. Texts move once.

Defined results: null text counts as empty; the empty text's fingerprint has only empty bins and is like
itself (1) and unlike all others (0); rows with equal doc_ids follow each other in order of their texts (by
HEAD_CHARS characters, then by hash), null doc_ids come last; a single document is its own next; an empty table
gives no rows; other columns are ignored. Texts are used whole."""

from __future__ import annotations

import hashlib
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bazaarlake.llm.common import documents, mix64, prepare, stored, task_count, texts, utf8_list

BINS, FIRST_LEVEL, LAST_LEVEL = 128, 2, 5
DOCS_A_TASK = 4_000
EMPTY = np.uint16(0xFFFF)
CHUNK_BYTES = 2 << 20
HEAD_CHARS, CUT_SAMPLE = 64, 20  # of a text for its place among rows of one doc_id; rows looked at to place a cut
_LOWEST = -(2**63)


def _toss_table(bits: int) -> np.ndarray:
    """Label of a symbol given its left neighbour, both below 2**bits: twice the lowest bit in which they differ, plus that bit of the symbol."""
    left, own = np.meshgrid(np.arange(1 << bits), np.arange(1 << bits), indexing="ij")
    low = (left ^ own) & -(left ^ own)
    place = np.bitwise_count(np.where(low, low - 1, 0))
    return (2 * place + ((own >> place) & 1)).astype(np.uint8).ravel()


_T8, _T7, _T4 = _toss_table(8), _toss_table(7), _toss_table(4)


def _toss(names: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Labels below 8, distinct for neighbours; first marks the names that begin a text."""
    if names.dtype == np.uint8:
        left = np.append(np.uint8(0), names[:-1])
        left[first] = ~names[first]
        labels = _T8[(left.astype(np.int32) << 8) | names]
    else:
        left = np.append(np.uint64(0), names[:-1])
        left[first] = ~names[first]
        differ = left ^ names
        place = np.bitwise_count((differ & (~differ + np.uint64(1))) - np.uint64(1))
        labels = ((place << 1) | ((names >> place.astype(np.uint64)) & np.uint64(1)).astype(np.uint8)).astype(np.uint8)
    for table, bits in ((_T7, 7), (_T4, 4)):
        left = np.append(np.uint8(0), labels[:-1])
        left[first] = labels[first] ^ 1
        labels = table[(left.astype(np.int32) << bits) | labels]
    return labels


def _level(names: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of the phrases, and where each text begins among them. begins: where each (not empty) text begins."""
    first = np.zeros(len(names), bool)
    first[begins] = True
    starts = np.flatnonzero(first | np.append(True, names[1:] != names[:-1]))
    runs = np.diff(np.append(starts, len(names)))
    names, first = names[starts], first[starts]
    labels = _toss(names, first)
    last = np.append(first[1:], True)  # a text's last symbol has no right neighbour and is no peak
    peak = np.append(True, labels[1:] > labels[:-1]) & np.append(labels[:-1] >= labels[1:], False) & ~last
    # A peak that is a text's second symbol would leave a lone first one.
    cut = first | (peak & ~np.append(False, first[:-1]))
    at = np.flatnonzero(cut)
    sizes = np.diff(np.append(at, len(names)))
    offset = np.arange(len(names)) - np.repeat(at, sizes)
    member = mix64(names.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + runs.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + offset.astype(np.uint64) * np.uint64(0xA24BAED4963EE407) + np.uint64(1))
    return mix64(np.add.reduceat(member, at)), np.flatnonzero(first[at])


def fingerprints(raw: list[bytes]) -> np.ndarray:
    """One row of BINS values for each text."""
    out = np.full((len(raw), BINS), EMPTY, np.uint16)
    owners = np.flatnonzero(np.fromiter(map(len, raw), np.int64, len(raw)))
    if not len(owners):
        return out
    sizes = np.fromiter((len(raw[i]) for i in owners), np.int64, len(owners))
    names, begins = np.frombuffer(b"".join(raw), np.uint8), np.cumsum(sizes) - sizes
    flat = np.full(len(raw) * BINS, 0xFFFF, np.uint32)
    for level in range(1, LAST_LEVEL + 1):
        names, begins = _level(names, begins)
        if level >= FIRST_LEVEL:
            owner = np.repeat(owners, np.diff(np.append(begins, len(names))))
            value = ((names >> np.uint64(32)) % np.uint64(0xFFFF)).astype(np.uint32)
            np.minimum.at(flat, owner * BINS + (names % np.uint64(BINS)).astype(np.int64), value)
    return flat.reshape(len(raw), BINS).astype(np.uint16)


def in_chunks(raw: list[bytes]) -> np.ndarray:
    """fingerprints() of texts by a few MB at a time, to bound memory."""
    out, part, size = [], [], 0
    for text in raw:
        if part and size + len(text) > CHUNK_BYTES:
            out.append(fingerprints(part))
            part, size = [], 0
        part.append(text)
        size += len(text)
    return np.concatenate([*out, fingerprints(part)])


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of the bins that either fills in which the two agree, row by row; 1 for two empty texts."""
    filled = ((a != EMPTY) | (b != EMPTY)).sum(axis=1)
    same = ((a == b) & (a != EMPTY)).sum(axis=1)
    return np.where(filled == 0, 1.0, same / np.maximum(filled, 1))


def as_hex(rows: np.ndarray) -> list[str]:
    data = rows.astype(">u2").tobytes().hex()
    return [data[i : i + 4 * BINS] for i in range(0, len(data), 4 * BINS)]


def _plain(key) -> tuple:
    return tuple(bytes(x) if isinstance(x, bytearray) else x for x in key)


def _place(cuts: list[tuple], key: tuple) -> tuple[int, int]:
    """First and last range that may hold key; several only if key fills whole ranges."""
    low, high = bisect_left(cuts, key), bisect_right(cuts, key)
    return low, high if high > low + 1 else low


def _dealer(cuts: list[tuple], ahead: dict[tuple, list[int]]):
    """UDF of the ranges that a row goes to, as range + 1, or as -(range + 1) where it is the row ahead of the range.

    Rows of a key that fills several ranges are equal. Each task sends its first one to the last of these and its
    others to them in turn; so the last one is never without, and a task run again gives the same rows to each
    range. Of equal rows a task sends only the first one ahead."""

    @F.pandas_udf("array<int>")
    def ranges(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        seen, own = Counter(), TaskContext.get().partitionId() * 7919
        for place, head, hashed in batches:
            out = []
            for key in zip(place.tolist(), head.tolist(), hashed.tolist(), strict=True):
                low, high = _place(cuts, key)
                if low == high and key not in ahead:
                    out.append([low + 1])
                    continue
                turn = seen[key]
                seen[key] += 1
                to = low + (own + turn) % (high - low + 1) if turn else high
                out.append([to + 1, *(-(r + 1) for r in ahead.get(key, ()) if not turn)])
            yield pd.Series(out)

    return ranges


def with_next(docs: DataFrame) -> DataFrame:
    """(range, ahead, again, doc_id, text), in order within partitions: each range's rows by descending doc_id, then (ahead) the
    one that follows them; again: the range's last row is followed by its equal, so none is ahead."""
    spark = docs.sparkSession
    key = [F.bitwise_not(F.coalesce("doc_id", F.lit(_LOWEST))).alias("place"), F.substring("text", 1, HEAD_CHARS).cast("binary").alias("head"), F.xxhash64("text").alias("hashed")]
    names = ["place", "head", "hashed"]
    keys = stored(docs.select(*key), "fingerprint-keys")
    total = keys.count()
    parts = task_count(spark, total, DOCS_A_TASK)
    # The cuts come from a few rows for each, CUT_SAMPLE * parts short keys.
    sample = sorted(_plain(r) for r in keys.sample(min(1.0, CUT_SAMPLE * parts / max(1, total)), seed=1).collect())
    cuts = [sample[k * len(sample) // parts] for k in range(1, parts)] if sample else []

    @F.pandas_udf("struct<low int, high int>")
    def span_of(place: pd.Series, head: pd.Series, hashed: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_place(cuts, k) for k in zip(place.tolist(), head.tolist(), hashed.tolist(), strict=True)], columns=["low", "high"]).astype("int32")

    spans = keys.select(F.struct(*names).alias("key"), span_of(*names).alias("span"))
    ends = spans.groupBy("span").agg(F.min("key").alias("first"), F.max("key").alias("last")).collect()  # as many rows as ranges
    # A key of several ranges counts for the last one; the others that hold nothing else are followed by equal rows.
    lows, highs = {}, {}
    for (_, r), first, last in ends:
        lows[r], highs[r] = min(lows.get(r, _plain(first)), _plain(first)), max(highs.get(r, _plain(last)), _plain(last))
    again = [r for (low, high), *_ in ends for r in range(low, high) if r not in lows]
    order, ahead = sorted(lows), {}
    for r, after in zip(order, [*order[1:], *order[:1]], strict=True):
        if highs[r] == lows[after]:
            again.append(r)
        else:
            ahead.setdefault(lows[after], []).append(r)
    rows = docs.select("doc_id", "text", *key)
    dealt = rows.select("doc_id", "text", *names, F.explode(_dealer(cuts, ahead)(*names)).alias("to"))
    dealt = dealt.select((F.abs("to") - 1).alias("range"), (F.col("to") < 0).alias("ahead"), *names, "doc_id", "text")
    dealt = dealt.repartitionById(parts, F.col("range")).sortWithinPartitions("range", "ahead", *names)
    return dealt.select("range", "ahead", F.col("range").isin(again).alias("again"), "doc_id", "text")


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compare each row of with_next() with the one after it."""
    held = None  # the last row, whose next has not come yet: range, doc_id, text, fingerprint, ahead, again
    skip = None  # the range whose first row ahead has been used
    for batch in batches:
        if not batch.num_rows:
            continue
        ranges, aheads, agains, ids, strings = (batch.column(i).to_pylist() for i in range(5))
        raw = utf8_list(batch)
        use = []
        for k, (r, ahead) in enumerate(zip(ranges, aheads, strict=True)):
            if ahead:
                if skip == r:
                    continue
                skip = r
            use.append(k)
        if not use:
            continue
        prints = in_chunks([raw[k] for k in use])
        rows = [(ranges[k], ids[k], strings[k], prints[j], aheads[k], agains[k]) for j, k in enumerate(use)]
        seen = [held, *rows] if held is not None else rows
        pairs = [(a, b if a[0] == b[0] else a) for a, b in zip(seen, seen[1:], strict=False) if not a[4] and (a[0] == b[0] or a[5])]
        held = seen[-1]
        if pairs:
            yield _compared(pairs)
    if held is not None and held[5] and not held[4]:
        yield _compared([(held, held)])


def _compared(pairs: list[tuple]) -> pa.RecordBatch:
    edited, sizes = [], []
    for (_, _, text, *_), (_, _, after, *_) in pairs:
        n = len(text)
        sizes.append(n)
        edited.append((text[: n - n // 3] + after[: n // 3]).encode())
    own, after = (np.stack([p[i][3] for p in pairs]) for i in (0, 1))
    changed = in_chunks(edited)
    return pa.RecordBatch.from_arrays(
        [pa.array([a[1] for a, _ in pairs], pa.int64()), pa.array(sizes, pa.int64()), pa.array([hashlib.sha256(t).hexdigest() for t in edited]), pa.array(as_hex(own)), pa.array(as_hex(changed)), pa.array(likeness(own, changed)), pa.array(likeness(own, after))],
        ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    )


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint of each row of docs; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(as_hex(in_chunks(utf8_list(batch))))], ["doc_id", "fingerprint"])

    return texts(docs).mapInArrow(run, "doc_id long, fingerprint string")


def document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query op10: fingerprints of each document and its edited text, and their likenesses."""
    prepare(spark)
    return with_next(texts(documents(spark, sf_dir))).mapInArrow(_pairs, SCHEMA)
