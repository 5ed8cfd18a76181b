"""Periodic runs of words, by a vectorised scan of every lag.

A text's words become an array of ids, which is compared with itself shifted by each lag up to half its
length (a run repeats its period at least twice); stretches of equality that are long enough are runs. Two
lags that give the same stretch are multiples of its smallest period, which is kept. Before a lag is compared
whole, one position in every `lag` is looked at with its neighbours: a stretch long enough covers such a
position and three words beside it, so a lag without any can't hold a run, and a text without repeats
costs n log n comparisons instead of n * n.

Texts of up to LONG_BYTES are scanned where they are read. A longer text is dealt out as ranges of its lags
with about equally many comparisons, as many ranges as its length asks for, and the stretches found by
different tasks meet by text; so no task holds a long text's whole scan.

Defined results: words are split at ASCII white space; null and empty texts have no words, no runs and an
empty collapsed text; rows that share doc_id and text are scanned alike and each gets its row; a null doc_id is
an id like any other (the query's edit leaves such a text as it is); an empty table gives no rows; other columns
are ignored."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bazaarlake.llm.common import arrow_map, documents, prepare, ragged_arange, stored, texts, utf8_list

LEAST_WORDS, LEAST_POWER = 12, 2  # words of a run; times that it repeats its period
LONG_BYTES = 1 << 16
#: Comparisons of a lag range: as many at least, and for each word of its text, which every range reads anew.
RANGE_CELLS, CELLS_A_WORD = 1 << 28, 2048
PAIRS_AT_ONCE = 1 << 21
BESIDE = 3  # words beside a looked-at position; a stretch has at least LEAST_WORDS / 2 equal words

Edit = Callable[[int | None, list[bytes]], list[bytes]]


def word_ids(words: list[bytes]) -> np.ndarray:
    names: dict[bytes, int] = {}
    return np.fromiter((names.setdefault(w, len(names)) for w in words), np.int32, len(words))


def least_stretch(lags: np.ndarray) -> np.ndarray:
    """Positions in a row at which a text must equal itself shifted by the lag."""
    return np.maximum((LEAST_POWER - 1) * lags, LEAST_WORDS - lags)


def likely_lags(ids: np.ndarray, lags: np.ndarray) -> np.ndarray:
    """The lags for which some looked-at position and the words beside it match: all that hold a run, and few others."""
    n, steps = len(ids), least_stretch(lags)
    looks = -(-(n - lags) // steps)
    padded = np.concatenate([np.full(BESIDE, -1, np.int32), ids, np.full(BESIDE, -2, np.int32)])
    found, ends, first = [], np.cumsum(looks), 0
    while first < len(lags):
        done = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, done + PAIRS_AT_ONCE, "right")))
        at = ragged_arange(looks[first:last]) * np.repeat(steps[first:last], looks[first:last]) + BESIDE
        lag = np.repeat(lags[first:last], looks[first:last])
        hit = padded[at] == padded[at + lag]
        at, lag = at[hit], lag[hit]
        before, after = np.ones(len(at), bool), np.ones(len(at), bool)
        for k in range(1, BESIDE + 1):
            before &= padded[at - k] == padded[at - k + lag]
            after &= padded[at + k] == padded[at + k + lag]
        found.append(np.unique(lag[before | after]))
        first = last
    return np.concatenate(found) if found else lags[:0]


def stretches(ids: np.ndarray, low: int, high: int) -> np.ndarray:
    """Rows (start, end, lag) of the maximal stretches that repeat with a lag in [low, high)."""
    out = [np.zeros((0, 3), np.int64)]
    for lag in likely_lags(ids, np.arange(low, high)).tolist():
        same = np.zeros(len(ids) - lag + 2, np.int8)
        same[1:-1] = ids[:-lag] == ids[lag:]
        edges = np.flatnonzero(np.diff(same))
        starts, ends = edges[::2], edges[1::2]
        kept = ends - starts >= least_stretch(np.array(lag))
        if kept.any():
            starts, ends = starts[kept], ends[kept]
            out.append(np.stack([starts, ends + lag, np.full(len(starts), lag)], axis=1))
    return np.concatenate(out)


def smallest_periods(found: np.ndarray) -> np.ndarray:
    """One row for each stretch, with its smallest lag, by start, then period."""
    found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
    first = np.ones(len(found), bool)
    first[1:] = (found[1:, :2] != found[:-1, :2]).any(axis=1)
    found = found[first]
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def cut(n: int, part: int, parts: int) -> int:
    """The first lag of a part, when the lags 1 to n // 2 are split into parts of about equally many comparisons."""
    if part >= parts:
        return n // LEAST_POWER + 1
    # lags below q take about q * n - q * q / 2 comparisons, all of them 3 / 8 * n * n
    return 1 + int(n * (1 - (1 - 0.75 * part / parts) ** 0.5))


def _hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def report(words: list[bytes], runs: np.ndarray) -> tuple:
    """n_runs, the longest run's start, length, period and exponent, all runs as lines, and the text with each run's first period only."""
    lines = "".join(f"{s},{e - s},{q}\n" for s, e, q in runs.tolist())
    if not len(runs):
        return 0, None, None, None, None, lines, b" ".join(words)
    lengths = runs[:, 1] - runs[:, 0]
    start, end, period = runs[lengths.argmax()].tolist()  # runs go by start, then period
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 1], -1)
    kept = np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()
    return len(runs), start, end - start, period, 1000 * (end - start) // period, lines, b" ".join([words[k] for k in kept])


COLUMNS = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long"
KINDS = [pa.int64()] * 6


def _rows(ids: list, reports: list[tuple], digests: bool) -> pa.RecordBatch:
    cols = [list(c) for c in zip(*reports, strict=True)] if reports else [[]] * 7
    runs = [_hex(x.encode()) for x in cols[5]] if digests else cols[5]
    collapsed = [_hex(x) for x in cols[6]] if digests else [x.decode() for x in cols[6]]
    arrays = [pa.array(c, k) for c, k in zip([ids, *cols[:5]], KINDS, strict=True)]
    names = ["runs_sha256", "collapsed_sha256"] if digests else ["runs", "collapsed"]
    return pa.RecordBatch.from_arrays([*arrays, pa.array(runs, pa.string()), pa.array(collapsed, pa.string())], ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", *names])


def _same(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    return words


def periodic_runs(docs: DataFrame, edit: Edit = _same, digests: bool = False) -> DataFrame:
    """One row per row of docs (doc_id, text): n_runs; start, length, period and exponent_milli of the longest run (null
    without any); `runs`, lines start,length,period of all; `collapsed`, the text without what runs repeat. With digests, the
    last two as SHA-256. edit is applied to a text's words first."""
    schema = f"{COLUMNS}, {'runs_sha256 string, collapsed_sha256 string' if digests else 'runs string, collapsed string'}"

    def whole(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, out = batch.column(0).to_pylist(), []
        for doc_id, text in zip(ids, utf8_list(batch), strict=True):
            words = edit(doc_id, text.split())
            out.append(report(words, smallest_periods(stretches(word_ids(words), 1, len(words) // LEAST_POWER + 1))))
        return _rows(ids, out, digests)

    def part(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows, at = [np.zeros((0, 3), np.int64)], []
        for k, (doc_id, text, no, parts) in enumerate(zip(batch.column(0).to_pylist(), utf8_list(batch), batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True)):
            words = edit(doc_id, text.split())
            rows.append(stretches(word_ids(words), cut(len(words), no, parts), cut(len(words), no + 1, parts)))
            at += [k] * len(rows[-1])
        found = np.concatenate(rows)
        of = pa.array(at, pa.int64())
        return pa.RecordBatch.from_arrays([batch.column(0).take(of), batch.column(2).take(of), *(pa.array(found[:, c]) for c in range(3))], ["doc_id", "text_key", "first", "end", "lag"])

    def joined(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, out = batch.column(0).to_pylist(), []
        for doc_id, text, runs in zip(ids, utf8_list(batch), batch.column(2).to_pylist(), strict=True):
            found = np.array([(r["first"], r["end"], r["lag"]) for r in runs or ()], np.int64).reshape(-1, 3)
            out.append(report(edit(doc_id, text.split()), smallest_periods(found)))
        return _rows(ids, out, digests)

    is_long = F.octet_length("text") > LONG_BYTES
    short = arrow_map(docs.filter(~is_long), schema, lambda: whole)
    long = docs.filter(is_long).select("doc_id", "text", F.xxhash64("text").alias("text_key"))
    n = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("double")
    parts = F.greatest(F.lit(1), F.ceil(n * n * 0.375 / F.greatest(F.lit(float(RANGE_CELLS)), n * CELLS_A_WORD))).cast("int")
    ranges = long.dropDuplicates(["doc_id", "text_key"]).withColumn("parts", parts).select("doc_id", "text", "text_key", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "parts")
    found = arrow_map(ranges.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "doc_id long, text_key long, first long, end long, lag long", lambda: part)
    runs = stored(found, "run-stretches").groupBy("doc_id", "text_key", "first", "end").agg(F.min("lag").alias("lag"))
    of_text = runs.groupBy(F.col("doc_id").alias("run_id"), F.col("text_key").alias("run_key")).agg(F.collect_list(F.struct("first", "end", "lag")).alias("runs"))
    with_runs = long.join(of_text, F.col("doc_id").eqNullSafe(F.col("run_id")) & (F.col("text_key") == F.col("run_key")), "left").select("doc_id", "text", "runs")
    return short.unionByName(arrow_map(with_runs, schema, lambda: joined))


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The contract's edit: in every tenth document by the CRC of its id, the words from the a-th on repeat p of them."""
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + k % p] for k in range(n - a)]


def periodic_run_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query op11: the runs of every document, after the contract's edit."""
    prepare(spark)
    return periodic_runs(texts(documents(spark, sf_dir)), planted, digests=True)


#: CRC-32 of a decimal id (polynomial 0xEDB88320, bits reversed), byte by byte.
_CRC = """list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
  lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, z: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END))"""
PERIODIC_RUNS_SQL = rf"""
WITH w AS MATERIALIZED (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words, xor({_CRC}, 4294967295) AS h FROM documents),
a AS (SELECT doc_id, words, len(words) AS n, h, (h // 10) % greatest(len(words), 1) AS a, 3 + (h // 10) % 8 AS d FROM w),
e AS MATERIALIZED (SELECT doc_id, n, unnest(range(n)) AS i, CASE WHEN h % 10 = 0 AND unnest(range(n)) >= a THEN words[1 + a + (unnest(range(n)) - a) % (1 + (n - a) // d)] ELSE words[1 + unnest(range(n))] END AS word FROM a),
m AS (SELECT x.doc_id, y.i - x.i AS q, x.i, x.i - row_number() OVER (PARTITION BY x.doc_id, y.i - x.i ORDER BY x.i) AS island FROM e x JOIN e y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND 2 * (y.i - x.i) <= x.n),
s AS (SELECT doc_id, q, min(i) AS s, max(i) + 1 + q AS t FROM m GROUP BY doc_id, q, island HAVING count(*) >= greatest(q, 12 - q)),
r AS MATERIALIZED (SELECT doc_id, s, t, min(q) AS q FROM s GROUP BY doc_id, s, t),
b AS (SELECT doc_id, count(*) AS n_runs, first(s ORDER BY t - s DESC, s, q) AS start, first(t - s ORDER BY t - s DESC, s, q) AS length, first(q ORDER BY t - s DESC, s, q) AS period, string_agg(s || ',' || (t - s) || ',' || q || chr(10), '' ORDER BY s, q) AS lines FROM r GROUP BY doc_id),
g AS (SELECT DISTINCT doc_id, unnest(range(s + q, t)) AS i FROM r),
c AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS collapsed FROM e ANTI JOIN g USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, 1000 * length // period AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(collapsed, '')) AS collapsed_sha256
FROM w LEFT JOIN b USING (doc_id) LEFT JOIN c USING (doc_id)
"""
