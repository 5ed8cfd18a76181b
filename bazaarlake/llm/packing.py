"""Best-fit packing by patterns and non-negative least squares.

Pieces are tokenised and cut where they are read. Only the histogram of piece lengths (at most `capacity`
rows, whatever the corpus) comes to the driver. There, patterns of two to four lengths that fill a
sequence exactly are enumerated, non-negative least squares fits their repeat counts to the histogram,
the counts are rounded down, and the residual histogram is packed best-fit decreasing. The plan says for
each length which ranks go to which run of sequences; a piece finds its place by its rank among the
pieces of its length. Ranks are taken in salted groups with offsets, as many groups for a length as its share
of the pieces fills shuffle partitions, so a length that a third of the pieces share is no task's burden.

Defined results: a null or empty text is the end id alone; null and repeated doc_ids are packed like
others; repeated rows are packed as often as they occur; an empty table gives no rows; other columns are
ignored. Texts are tokenised whole."""

from __future__ import annotations

import os
import zlib
from array import array
from bisect import bisect_left, insort
from collections import defaultdict
from functools import lru_cache
from itertools import count as numbers

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bazaarlake.llm.common import arrow_map, documents, prepare, ragged_arange, stored, texts

CAPACITY, END_ID = 4096, 1
CACHE_WORDS, CACHE_CHARS = 250_000, 64


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself where it is printable, else the next free one from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


class WordTokens:
    """Ids of texts by a tokenizer that drops white space and works within its gaps, with a bounded word cache.

    Such a tokenizer (its normaliser and pre-tokenizer treat white space as a border) gives a text the ids
    of its white-space separated words in turn, so each distinct word of a batch is looked up once, and
    encoded only if the cache lacks it; the texts' ids are gathered from the words' by index."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.letters = byte_letters()
        self.newer: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    @staticmethod
    def _stem(word: str) -> str:
        """The word without a last full stop or comma that follows an ASCII letter: the two are separate to the tokenizer."""
        return word[:-1] if word[-1:] in (".", ",") and "a" <= word[-2:-1] <= "z" else word

    def _coded(self, words: list[str]) -> list[bytes]:
        """The ids of distinct words. What the newer half of the cache lacks is taken over from the older or encoded."""
        if len(self.newer) > CACHE_WORDS:
            self.older, self.newer = self.newer, {}
        newer, older = self.newer, self.older
        out = list(map(newer.get, words))
        fresh = []
        for k in [k for k, ids in enumerate(out) if ids is None]:
            word = words[k]
            out[k] = ids = older.get(word)
            if ids is None:
                fresh.append(k)
            else:
                newer[word] = ids
        stems = [w for w in {*(self._stem(words[k]) for k in fresh), ".", ","} if w not in newer]
        # A word of lower-case Latin letters is one pre-token whatever the normaliser does: straight to the merges.
        model, letters = self.tokenizer.model, self.letters
        lacking = stems
        for word in lacking:
            if word.isalpha() and max(word) < "\u0180" and word == word.lower():
                coded = word if word.isascii() else "".join([letters[b] for b in word.encode()])
                newer[word] = array("I", [t.id for t in model.tokenize(coded)]).tobytes()
        stems = [w for w in stems if w not in newer]
        for at in range(0, len(stems), 20_000):
            part = stems[at : at + 20_000]
            for word, coded in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True):
                newer[word] = array("I", coded.ids).tobytes()
        for k in fresh:
            word = words[k]
            if (ids := newer.get(word)) is None:
                newer[word] = ids = newer[word[:-1]] + newer[word[-1]]
            out[k] = ids
        for word in [w for w in (*(words[k] for k in fresh), *lacking) if len(w) > CACHE_CHARS]:
            newer.pop(word, None)
        return out

    def ids(self, strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, end to end, and where each text's begin (and the last one's end)."""
        # A-Z may be lower-cased before the split where that can't matter: combining marks may compose with one case only, and special tokens are lower-case.
        plain = pa.array([b"\xcc" not in t and b"\xcd" not in t and b"<|" not in t for t in strings.cast(pa.binary()).to_pylist()], pa.bool_())
        lists = pc.ascii_split_whitespace(pc.if_else(plain, pc.ascii_lower(strings), strings))
        borders = lists.offsets.to_numpy()
        words = lists.values.slice(borders[0], borders[-1] - borders[0]).dictionary_encode()
        coded = self._coded(words.dictionary.to_pylist())
        sizes = np.fromiter(map(len, coded), np.int64, len(coded)) // 4
        flat, begins = np.frombuffer(b"".join(coded), "<u4"), np.cumsum(sizes) - sizes
        at = words.indices.to_numpy()
        counts = sizes[at]
        ends = np.append(0, np.cumsum(counts))
        return flat[np.repeat(begins[at], counts) + ragged_arange(counts)], ends[borders - borders[0]]


@lru_cache(maxsize=1)
def word_tokens(path: str) -> WordTokens:
    return WordTokens(path)


def cut_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, deal (any number, to spread equal pieces by) and, if asked for, the ids themselves."""
    tail = np.array([end_id], "<u4").tobytes()

    def make():
        tokens, turn = word_tokens(path), numbers()

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            cols: list[list] = [[], [], [], [], [], [], []]
            ids, ends = tokens.ids(batch.column(1))
            for doc_id, begin, end in zip(batch.column(0).to_pylist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                view = memoryview(ids[begin:end].tobytes() + tail)
                for k, at in enumerate(range(0, len(view), 4 * capacity)):
                    part = view[at : at + 4 * capacity]
                    for col, x in zip(cols, (doc_id, k, at // 4, len(part) // 4, crc := zlib.crc32(part), crc + next(turn), np.frombuffer(part, "<u4").astype(np.int32) if keep_ids else None), strict=True):
                        col.append(x)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "deal", "ids"][: 6 + keep_ids]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k, _ in zip(cols, kinds, names, strict=False)], names)

        return step

    return arrow_map(texts(docs), "doc_id long, piece int, start long, length long, ids_crc32 long, deal long" + ", ids array<int>" * keep_ids, make)


def exact_patterns(counts: dict[int, int], capacity: int) -> list[tuple[int, ...]]:
    """Patterns of two to four lengths that sum to the capacity, a bounded number for each largest length."""
    common = sorted(counts, key=lambda n: (-counts[n], n))[:12]
    found = set()
    for a in counts:
        if counts.get(capacity - a):
            found.add(tuple(sorted((a, capacity - a), reverse=True)))
        for b in common:
            if counts.get(c := capacity - a - b):
                found.add(tuple(sorted((a, b, c), reverse=True)))
        for b in common[:3]:
            for c in common[3:6]:
                if counts.get(d := capacity - a - b - c):
                    found.add(tuple(sorted((a, b, c, d), reverse=True)))
    return sorted(found)


def fit_repeats(patterns: list[tuple[int, ...]], counts: dict[int, int], capacity: int, rounds: int = 400) -> np.ndarray:
    """Repeat counts x >= 0 that bring the patterns' histogram close to the given one in least squares (accelerated projected gradient)."""
    of = np.zeros((len(patterns), 4), np.int64)
    for k, p in enumerate(patterns):
        of[k, : len(p)] = p
    target = np.zeros(capacity + 1)
    for n, c in counts.items():
        target[n] = c

    def forward(x: np.ndarray) -> np.ndarray:
        y = np.bincount(of.ravel(), np.repeat(x, 4), capacity + 1)
        y[0] = 0
        return y

    def back(r: np.ndarray) -> np.ndarray:
        return r[of].sum(axis=1)

    x = np.ones(len(patterns))
    for _ in range(20):
        x = back(forward(x))
        norm = np.linalg.norm(x)
        x /= norm
    step = 1 / (1.1 * norm)
    x = y = np.zeros(len(patterns))
    t = 1.0
    for _ in range(rounds):
        fresh = np.maximum(0, y - step * back(forward(y) - target))
        t_next = (1 + (1 + 4 * t * t) ** 0.5) / 2
        x, y, t = fresh, fresh + (t - 1) / t_next * (fresh - x), t_next
    return x


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Bins (length -> times) with how often each is used; equal bins are handled together, so the work follows the number of lengths."""
    open_bins: dict[int, list[tuple[dict[int, int], int]]] = defaultdict(list)
    rooms: list[int] = []

    def put(room: int, items: dict[int, int], count: int) -> None:
        if count:
            if not open_bins[room]:
                insort(rooms, room)
            open_bins[room].append((items, count))

    for n in sorted(counts, reverse=True):
        left = counts[n]
        while left:
            at = bisect_left(rooms, n)
            if at == len(rooms):
                room, items, count = capacity, {}, left
            else:
                room = rooms[at]
                items, count = open_bins[room].pop()
                if not open_bins[room]:
                    rooms.pop(at)
            fit = room // n
            full = min(count, left // fit)
            left -= full * fit
            put(room - fit * n, items | {n: fit}, full)
            if full < count and left:
                put(room - left * n, items | {n: left}, 1)
                left, full = 0, full + 1
            if items:
                put(room, items, count - full)
    return [x for bins in open_bins.values() for x in bins]


def plan_sequences(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[dict[int, int], int]], int]:
    """Bins with how often each is used, and the number of sequences."""
    counts = {n: c for n, c in counts.items() if c}
    bins: list[tuple[dict[int, int], int]] = []
    if full := counts.pop(capacity, 0):
        bins.append(({capacity: 1}, full))
    if patterns := exact_patterns(counts, capacity):
        fitted = fit_repeats(patterns, counts, capacity)
        for k in np.argsort(-fitted, kind="stable"):
            times: dict[int, int] = {}
            for n in patterns[k]:
                times[n] = times.get(n, 0) + 1
            repeat = min([int(fitted[k]), *(counts.get(n, 0) // m for n, m in times.items())])
            if repeat:
                bins.append((times, repeat))
                for n, m in times.items():
                    counts[n] -= repeat * m
    bins += best_fit_decreasing({n: c for n, c in counts.items() if c}, capacity)
    return bins, sum(c for _, c in bins)


def placements(bins: list[tuple[dict[int, int], int]]) -> dict[str, np.ndarray]:
    """For each length and range of ranks: the first sequence, how many of the length a sequence holds, and their first offset."""
    rows, used, first = [], defaultdict(int), 0
    for times, count in bins:
        offset = 0
        for n, m in times.items():
            rows.append((n, used[n], first, m, offset))
            used[n] += m * count
            offset += n * m
        first += count
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return dict(zip(("length", "rank", "first", "times", "offset"), table.T.copy(), strict=True))


def ranked(pieces: DataFrame, counts: dict[int, int]) -> DataFrame:
    """rank: 0, 1, ... among the pieces of each length, without bringing the pieces of a frequent length together."""
    spark = pieces.sparkSession
    parts, total = int(spark.conf.get("spark.sql.shuffle.partitions")), max(1, sum(counts.values()))
    salts = spark.createDataFrame([(n, -(-c * parts // total)) for n, c in counts.items()], "length long, salts long")
    salted = pieces.join(F.broadcast(salts), "length").withColumn("salt", F.pmod("deal", "salts"))  # a row a length: `capacity` at most
    group = Window.partitionBy("length", "salt")
    own = salted.withColumn("own_rank", F.row_number().over(group.orderBy("doc_id", "piece", "ids_crc32")) - 1)
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = salted.groupBy("length", "salt").count().withColumn("before", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    return own.join(offsets, ["length", "salt"]).withColumn("rank", F.col("own_rank") + F.col("before"))


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """The pieces of docs with sequence_id and offset."""
    pieces = stored(cut_pieces(docs, path, capacity, end_id, keep_ids), "packing-pieces")
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most `capacity` rows
    bins, _ = plan_sequences(counts, capacity)
    at = placements(bins)
    key = (at["length"] << 44) | at["rank"]

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
            found = np.searchsorted(key, (length << 44) | rank, "right") - 1
            beyond, times = rank - at["rank"][found], at["times"][found]
            places = [at["first"][found] + beyond // times, at["offset"][found] + beyond % times * length]
            kept = [n for n in batch.schema.names if n != "rank"]
            return pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(n)) for n in kept), *map(pa.array, places)], [*kept, "sequence_id", "offset"])

        return step

    fields = [f for f in pieces.schema if f.name != "deal"]
    out = ranked(pieces, counts).select(*(f.name for f in fields), F.col("rank").cast("long").alias("rank"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", sequence_id long, offset long"
    return arrow_map(out, schema, make)


def best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query op4: where each piece of each document goes."""
    prepare(spark)
    return pack(documents(spark, sf_dir), default_tokenizer())
