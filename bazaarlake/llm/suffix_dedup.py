"""Repeated passages by sparse suffix arrays.

Suffixes are kept only where a content-selected minimiser begins: the least hash of GRAM consecutive
words in every window of MIN_WORDS words, so that any two copies of a passage of MIN_WORDS words keep the
same suffix. Suffixes whose first GRAM words occur in two documents are sorted by the words that follow,
each is compared with its neighbours of other documents, and the matches are extended to the right and
left; a second order, by the words before, finds partners whose common part lies mostly to the left. Where
several documents compete at a suffix, a passage's partner may lie nearest in neither order: the windows of MIN_WORDS words
that the neighbours' extents leave open are then compared by hash, so no passage is missed.
Windows reach far enough for consecutive matches to join, so long repeats come out whole.

Documents with the same words form a class: its members are whole-text repeats of each other and only one
of them goes through the suffix sort. The suffixes whose first words very many rows share are cut into
slices of their sorted order, and each slice is handed the nearest suffix of another document before and
after it, so no group lands in one task and every suffix meets its neighbours all the same.

Defined results: words are split at ASCII white space, A-Z lower-cased; texts of fewer than MIN_WORDS
words (null and empty ones too) have no repeats; a null doc_id is ignored; rows with one doc_id are one
document, never its own partner; words are compared by 32 bits of their hashes in suffixes, so a span is too long by a word
with chance 2**-32 a comparison; an empty table gives no rows; other columns are ignored."""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bazaarlake.llm.common import arrow_map, documents, lookup, mix64, prepare, stored, task_count, texts, utf8_list
from bazaarlake.llm.minhash_dedup import word_array

MIN_WORDS, GRAM = 50, 8
WINDOW = MIN_WORDS - GRAM + 1
LEFT, RIGHT = MIN_WORDS - GRAM, MIN_WORDS
HOT_ROWS, SLICE_SAMPLE = 20_000, 32  # rows of a first-words group before its order is cut into slices of about as many; rows looked at to place a cut
SUFFIXES_A_TASK = 20_000
_P = np.random.default_rng(7).integers(0, 2**63, GRAM, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def minimisers(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and positions of the selected GRAM-word starts."""
    n = len(words) - GRAM + 1
    if n < WINDOW:
        return words[:0], np.zeros(0, np.int64)
    grams = words[:n] * _P[0]
    for k in range(1, GRAM):
        grams += words[k : n + k] * _P[k]
    grams = mix64(grams)
    least = np.lib.stride_tricks.sliding_window_view(grams, WINDOW).argmin(axis=1)
    at = np.unique(least + np.arange(len(least)))
    return grams[at], at


def suffix_starts(docs: DataFrame) -> DataFrame:
    """doc_id, words_key (digest of the words), n_words and the selected starts."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys, sizes, grams, places = [], [], [], []
        for text in utf8_list(batch):
            words = word_array(text)
            g, at = minimisers(words)
            keys.append(_words_key(words))
            sizes.append(len(words))
            grams.append(g.view(np.int64))
            places.append(at.astype(np.int32))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(grams, pa.list_(pa.int64())), pa.array(places, pa.list_(pa.int32()))], ["doc_id", "words_key", "n_words", "grams", "places"])

    return arrow_map(docs, "doc_id long, words_key binary, n_words long, grams array<long>, places array<int>", lambda: step)


def _words_key(words: np.ndarray) -> bytes:
    return hashlib.blake2b(words.tobytes(), digest_size=16).digest()


def suffixes(wanted: DataFrame) -> DataFrame:
    """(doc_id, text, starts, words_key of the text that the starts belong to) to one row a start: gram, rows (of its group), doc_id, pos, right (words from there on) and left (words before, backwards)."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        cols: list[list] = [[], [], [], [], [], []]
        for doc_id, text, starts, key in zip(batch.column(0).to_pylist(), utf8_list(batch), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            words = word_array(text)
            if _words_key(words) != key:  # another row with this doc_id
                continue
            words = (words >> np.uint64(32)).astype(">u4")
            data, back = words.tobytes(), words[::-1].tobytes()
            for s in starts:
                pos = s["pos"]
                before = 4 * (len(words) - pos)
                for col, x in zip(cols, (s["gram"], s["rows"], doc_id, pos, data[4 * pos : 4 * (pos + RIGHT)], back[before : before + 4 * LEFT]), strict=True):
                    col.append(x)
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["gram", "rows", "doc_id", "pos", "right", "left"])

    return arrow_map(wanted, "gram long, rows long, doc_id long, pos int, right binary, left binary", lambda: step)


def _common(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """Number of words at the front that two lists of word strings have in common, row by row."""
    out = np.zeros(len(a), np.int64)
    for k, (x, y) in enumerate(zip(a, b, strict=True)):
        if x == y:
            out[k] = len(x) // 4
            continue
        n = min(len(x), len(y)) // 4
        differ = np.flatnonzero(np.frombuffer(x, ">u4", n) != np.frombuffer(y, ">u4", n))
        out[k] = differ[0] if len(differ) else n
    return out


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compare sorted suffixes with the nearest ones of other documents on both sides. Of each match, both sides' suffixes with the words in
    common ahead and behind, and the partner; and of suffixes that no match shows it for, their most words in common ahead and behind, no partner."""
    held: list[pa.Table] = []  # the last suffix of the run before the open one (if any), and the open run: at most a group or slice
    anchor, last = 0, None  # rows of held before the open run; gram, slice and doc_id of the open run
    for batch in chain(batches, [None]):
        if batch is not None:
            if not batch.num_rows:
                continue
            held.append(pa.Table.from_batches([batch]))
            edge = [tuple(batch.column(c)[k].as_py() for c in ("gram", "slice", "doc_id")) for k in (0, batch.num_rows - 1)]
            if last == edge[0] == edge[1] and np.ptp(batch.column("doc_id").to_numpy()) == 0:
                continue
        if not held:
            return
        table = pa.concat_tables(held).combine_chunks()
        gram, part, doc, pos = (table.column(c).to_numpy() for c in ("gram", "slice", "doc_id", "pos"))
        opens = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (gram[1:] != gram[:-1]) | (part[1:] != part[:-1])))
        run = np.repeat(opens, np.diff(np.append(opens, len(doc))))
        end = np.repeat(np.append(opens[1:], len(doc)), np.diff(np.append(opens, len(doc))))
        closed = np.arange(anchor, opens[-1] if batch is not None else len(doc))
        # Every suffix with the last one of the run before its document's run and with the first one of the run after
        # it; a run's last suffix meets the latter as that one's neighbour before.
        inner = closed[closed < end[closed] - 1]
        a, b = np.concatenate([run[closed] - 1, inner]), np.concatenate([closed, end[inner]])
        ok = (a >= 0) & (b < len(doc))
        a, b = a[ok], b[ok]
        ok = (gram[a] == gram[b]) & (part[a] == part[b])
        a, b = a[ok], b[ok]
        if len(a):
            right, left = (table.column(c).to_pylist() for c in ("right", "left"))
            ahead = _common([right[i] for i in a], [right[i] for i in b])
            behind = _common([left[i] for i in a], [left[i] for i in b])
            of, mate, ahead, behind = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([ahead, ahead]), np.concatenate([behind, behind])
            far, back = np.full(len(doc), -1), np.full(len(doc), -1)
            np.maximum.at(far, of, ahead)
            np.maximum.at(back, of, behind)
            match = (ahead + behind >= MIN_WORDS) & (ahead >= GRAM)
            told = np.zeros(len(doc), bool)
            told[of[match & (ahead == far[of]) & (behind == back[of])]] = True
            rest = np.flatnonzero((far >= 0) & ~told)
            rows = np.concatenate([of[match], rest])
            mates = pa.array(np.concatenate([doc[mate[match]], rest]), mask=np.arange(len(rows)) >= match.sum())
            columns = [gram[rows], doc[rows], pos[rows], np.concatenate([ahead[match], far[rest]]).astype(np.int32), np.concatenate([behind[match], back[rest]]).astype(np.int32)]
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns), mates], ["gram", "doc_id", "pos", "ahead", "behind", "partner_id"])
        anchor, last = int(opens[-1] > 0), (gram[-1], part[-1], doc[-1])
        held = [pa.concat_tables([table.take([opens[-1] - 1]), table.slice(opens[-1])]) if anchor else table]


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The spans of the matches that _compared() finds."""
    for batch in _compared(batches):
        batch = batch.filter(batch.column("partner_id").is_valid())
        if batch.num_rows:
            doc, pos, ahead, behind = (batch.column(c).to_numpy().astype(np.int64) for c in ("doc_id", "pos", "ahead", "behind"))
            yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(pos - behind), pa.array(pos + ahead), batch.column("partner_id")], ["doc_id", "start_word", "end_word", "partner_id"])


def _beyond(ends: list[tuple]) -> dict[int, tuple]:
    """slice: the nearest suffix of another document that lies beyond its edge in the slices already passed.

    ends: (slice, edge towards the passed slices, edge towards the coming ones, nearest to the latter of its gram
    and another document within the slice or None), in the order of passing."""
    out: dict[int, tuple] = {}
    near = other = None  # the last suffix passed, and the last one of its gram and another document
    for n, edge, far, far_other in ends:
        if near and near[0] == edge[0] and (found := near if near[3] != edge[3] else other):
            out[n] = found
        if not far_other and near and near[0] == far[0]:  # the slice has one document only of that gram
            far_other = near if near[3] != far[3] else other
        near, other = far, far_other
    return out


def slices(hot: DataFrame, n_rows: int, order: list[str]) -> DataFrame:
    """hot with `slice`, the place in the sorted order cut into slices of about HOT_ROWS rows, and to each slice also the nearest suffixes of other documents before and after it."""
    spark = hot.sparkSession
    plain = lambda r: None if r is None else tuple(bytes(x) if isinstance(x, bytearray) else x for x in r)
    n_slices = -(-n_rows // HOT_ROWS)
    looked_at = hot.filter(F.pmod(F.xxhash64("gram", "doc_id", "pos"), F.lit(max(1, HOT_ROWS // SLICE_SAMPLE))) == 0)
    sample = sorted(plain(r) for r in looked_at.select(*order).collect())
    cuts = [sample[k * len(sample) // n_slices] for k in range(1, n_slices)] if sample else []

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            keys = zip(*(c.to_pylist() for c in batch.columns), strict=True)
            return pa.RecordBatch.from_arrays([*batch.columns, pa.array([bisect_right(cuts, k) for k in keys], pa.int32())], [*order, "slice"])

        return step

    kinds = {"gram": "long", "doc_id": "long", "pos": "int", "right": "binary", "left": "binary"}
    schema = ", ".join(f"{c} {kinds[c]}" for c in order)
    cut = stored(arrow_map(hot.select(*order), f"{schema}, slice int", make), "suffix-slices")
    key = F.struct(*order)
    ends = sorted((r["slice"], plain(r["low"]), plain(r["high"])) for r in cut.groupBy("slice").agg(F.min(key).alias("low"), F.max(key).alias("high")).collect())
    edges = F.broadcast(spark.createDataFrame([(n, low[0], low[3], high[0], high[3]) for n, low, high in ends], "slice int, low_gram long, low_doc long, high_gram long, high_doc long"))
    after_low = F.when((F.col("gram") == F.col("low_gram")) & (F.col("doc_id") != F.col("low_doc")), key)
    before_high = F.when((F.col("gram") == F.col("high_gram")) & (F.col("doc_id") != F.col("high_doc")), key)
    within = {r["slice"]: (plain(r["low"]), plain(r["high"])) for r in cut.join(edges, "slice").groupBy("slice").agg(F.min(after_low).alias("low"), F.max(before_high).alias("high")).collect()}
    before = _beyond([(n, low, high, within[n][1]) for n, low, high in ends])
    after = _beyond([(n, high, low, within[n][0]) for n, low, high in reversed(ends)])
    handed = spark.createDataFrame([(*k, n) for beyond in (before, after) for n, k in beyond.items()], f"{schema}, slice int")
    return cut.unionByName(handed)


def compared(rows: DataFrame, toward: str) -> DataFrame:
    """What _compared() tells of the suffixes in the order by `toward` (right or left)."""
    is_hot = F.col("rows") > HOT_ROWS
    total, n_hot = rows.agg(F.count("*"), F.count_if(is_hot)).first()
    parts = task_count(rows.sparkSession, total, SUFFIXES_A_TASK)
    order = ["gram", toward, "left" if toward == "right" else "right", "doc_id", "pos"]
    placed = rows.filter(~is_hot).select(*order, F.lit(-1).alias("slice"))
    if n_hot:
        placed = placed.unionByName(slices(rows.filter(is_hot), n_hot, order))
    dealt = F.when(F.col("slice") < 0, F.xxhash64("gram")).otherwise(F.xxhash64("slice"))
    placed = placed.withColumn("dealt", dealt).repartition(parts, "dealt").sortWithinPartitions("dealt", "slice", *order).drop("dealt")
    return placed.mapInArrow(_compared, "gram long, doc_id long, pos int, ahead int, behind int, partner_id long")


def spans_of(found: DataFrame) -> DataFrame:
    """doc_id, start_word, end_word, partner_id of the matches in compared()."""
    pos = F.col("pos").cast("long")
    return found.filter("partner_id IS NOT NULL").select("doc_id", (pos - F.col("behind")).alias("start_word"), (pos + F.col("ahead")).alias("end_word"), "partner_id")


def matches(rows: DataFrame, toward: str) -> DataFrame:
    """Spans of the suffixes' matches with their neighbours in the order by `toward` (right or left)."""
    return spans_of(compared(rows, toward))


def open_windows(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Spans of MIN_WORDS words that neighbours leave open, where several documents compete at a suffix.

    A suffix's neighbours share most with it, so a window that begins k words before it can only be repeated if k words behind and the
    others ahead are shared with some document each. Where no single neighbour has both, the windows themselves are compared: of all
    suffixes with those first words that could have one at that offset, the window's words by hash."""
    low, high = F.greatest(F.lit(0), MIN_WORDS - F.max("ahead")), F.least(F.lit(LEFT), F.max("behind"))
    match = F.when(F.col("partner_id").isNotNull(), F.struct((MIN_WORDS - F.col("ahead")).alias("low"), F.col("behind").alias("high")))
    reach = found.groupBy("gram", "doc_id", "pos").agg(low.alias("low"), high.alias("high"), F.collect_set(match).alias("matches")).filter("low <= high")
    offsets = F.sequence("low", "high")
    left_open = F.filter(offsets, lambda k: ~F.exists("matches", lambda m: (m["low"] <= k) & (k <= m["high"])))
    reach = stored(reach.select("gram", "doc_id", "pos", offsets.alias("offsets"), left_open.alias("open")), "suffix-reach")
    contested = reach.filter(F.size("open") > 0).select("gram", F.explode("open").alias("k")).groupBy("gram").agg(F.collect_set("k").alias("asked"))
    asked = reach.join(contested, "gram").select("gram", "doc_id", "pos", F.array_intersect("offsets", "asked").alias("offsets")).filter(F.size("offsets") > 0)
    wanted = asked.join(rows, ["gram", "doc_id", "pos"]).select("gram", "doc_id", "pos", "left", "right", F.explode("offsets").alias("k"))
    k = F.col("k")
    window = F.concat(F.expr("substring(left, 1, 4 * k)"), F.expr(f"substring(right, 1, 4 * ({MIN_WORDS} - k))"))
    keyed = stored(wanted.select("doc_id", F.col("pos").cast("long").alias("pos"), k, F.unhex(F.md5(F.concat(F.hex("gram"), F.lit(":"), k, F.lit(":"), F.hex(window)))).alias("window")), "suffix-windows")
    shared = keyed.groupBy("window").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last")
    both = keyed.join(stored(shared, "suffix-open"), "window")  # Spark splits the windows that very many suffixes share
    return both.select("doc_id", (F.col("pos") - F.col("k")).alias("start_word"), (F.col("pos") - F.col("k") + MIN_WORDS).alias("end_word"), F.when(F.col("doc_id") == F.col("first"), F.col("last")).otherwise(F.col("first")).alias("partner_id"))


def repeated_passages(docs: DataFrame) -> DataFrame:
    """doc_id, start_word, end_word, n_words, partner_id (a document that shares the passage, or part of it): maximal spans that other documents repeat. docs: (doc_id, text)."""
    spark = docs.sparkSession
    docs = docs.filter(F.col("doc_id").isNotNull())
    starts = stored(suffix_starts(docs), "suffix-starts")
    long_enough = starts.filter(F.col("n_words") >= MIN_WORDS)
    ids = long_enough.groupBy("words_key").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last"), F.count("*").alias("members"))
    classes = stored(ids, "suffix-classes")
    reps = long_enough.join(classes.select("words_key", F.col("rep").alias("doc_id")), ["words_key", "doc_id"], "left_semi")
    entries = stored(reps.select("doc_id", "words_key", F.explode(F.arrays_zip("grams", "places")).alias("e")).select("doc_id", "words_key", F.col("e.grams").alias("gram"), F.col("e.places").alias("pos")), "suffix-entries")
    shared = entries.groupBy("gram").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count("*").alias("rows")).filter("low < high")
    shared = stored(shared.select("gram", "rows"), "suffix-shared")
    total = shared.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    wanted = lookup(entries, shared, "gram", "rows", total).filter(F.col("rows").isNotNull())
    wanted = stored(wanted.groupBy("doc_id", "words_key").agg(F.collect_list(F.struct("gram", "rows", "pos")).alias("starts")), "suffix-wanted")
    rows = stored(suffixes(docs.join(wanted, "doc_id").select("doc_id", "text", "starts", "words_key")), "suffix-rows")
    seen = stored(compared(rows, "right"), "suffix-right").unionByName(stored(compared(rows, "left"), "suffix-left"))
    spans = spans_of(seen).unionByName(open_windows(rows, seen))
    in_order = Window.partitionBy("doc_id").orderBy("start_word", "end_word")
    before = F.max("end_word").over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    islands = spans.distinct().withColumn("opens", F.when(before.isNull() | (F.col("start_word") > before), 1).otherwise(0))
    islands = islands.withColumn("island", F.sum("opens").over(in_order.rowsBetween(Window.unboundedPreceding, 0)))
    merged = islands.groupBy("doc_id", "island").agg(F.min("start_word").alias("start_word"), F.max("end_word").alias("end_word"), F.min("partner_id").alias("partner_id")).drop("island")
    # Members of a class of several documents repeat each other whole; the others keep the spans found.
    several = classes.filter("rep < last").select("words_key", "rep", "last", "members")
    total = classes.agg(F.coalesce(F.sum("members"), F.lit(0))).first()[0]
    whole = lookup(long_enough.select("doc_id", "words_key", "n_words"), several, "words_key", "members", total).filter(F.col("rep").isNotNull())
    whole = whole.select("doc_id", F.lit(0).cast("long").alias("start_word"), F.col("n_words").alias("end_word"), F.when(F.col("doc_id") == F.col("rep"), F.col("last")).otherwise(F.col("rep")).alias("partner_id")).distinct()
    found = merged.join(several.select(F.col("rep").alias("doc_id")), "doc_id", "left_anti").unionByName(whole)
    return found.select("doc_id", "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"), "partner_id")


def suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query op3: every passage of at least MIN_WORDS words that documents share, as word positions."""
    prepare(spark)
    return repeated_passages(texts(documents(spark, sf_dir))).drop("partner_id")


SUFFIX_DEDUP_SQL = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents WHERE doc_id IS NOT NULL),
k AS (SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS k FROM w WHERE len(words) >= 50),
g AS (SELECT doc_id, k, md5(array_to_string(words[k:k + 49], ' ')) AS passage FROM k),
s AS (SELECT passage FROM g GROUP BY 1 HAVING count(DISTINCT doc_id) > 1),
p AS (SELECT doc_id, k - 1 AS start_word, k + 49 AS end_word FROM g SEMI JOIN s USING (passage)),
o AS (SELECT *, CASE WHEN start_word > max(end_word) OVER (PARTITION BY doc_id ORDER BY start_word ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS opens FROM p),
i AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY start_word) AS island FROM o)
SELECT doc_id, min(start_word) AS start_word, max(end_word) AS end_word, max(end_word) - min(start_word) AS n_words FROM i GROUP BY doc_id, island
"""
