"""Ranked lexical search over a two-level quantised inverted index.

The index is dealt by document: a block of documents has one row for each of its terms, with the places of
the documents that hold it, and for each its impact, once as a byte rounded upward (level one) and once
exact (level two). Both levels are columns of their own, so the first pass reads bytes alone.

A search adds up, block by block, an item's weights times the bytes: an upper bound of every document's
score and, as a byte is less than one step too high, a lower one. A block hands on the documents whose upper bound
reaches its own k-th greatest lower bound; of those the k-th greatest lower bound over all blocks is taken,
and every document whose upper bound reaches it is rescored from the exact impacts with 64-bit
integers. No document that could be among the k best is left out, so results equal a full scan.

Terms of the items are broadcast in groups of at most GROUP_ITEMS items and GROUP_TERMS terms, so a large item
table takes more passes and no larger broadcast. What goes between tasks are candidates, not postings.

Defined results: a document is a row; null and empty texts have no terms and are in no statistics; rows with one
doc_id are ranked each for itself; equal scores rank by doc_id, null last. Items that share an item_id are one
item with the terms of all their distinct texts; items without terms, or whose terms no document has, have no
rows. Empty tables give no rows; other columns are ignored."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bazaarlake.llm.common import arrow_map, documents, prepare, return_memory, shared_dir, stored, task_count, utf8_list

TOP, SCALE = 10, 1_000_000  # no impact reaches SCALE
STEP = -(-SCALE // 255)  # impact units of a byte's step
BLOCK_ROWS, BLOCK_BYTES = 4096, 16 << 20
GROUP_ITEMS, GROUP_TERMS = 512, 1 << 16
#: Bytes that are no part of a term become spaces, A-Z becomes a-z; all bytes of other characters stay.
FOLD = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 32 for b in range(256))
ROWS_A_BUCKET = 4 * BLOCK_ROWS
STATS = "n_documents long, n_terms long, buckets int"
BLOCK = "block long, term binary, places array<int>, bounds binary, impacts array<int>, ids array<long>"
NAMES = ["block", "term", "places", "bounds", "impacts", "ids"]
KINDS = [pa.int64(), pa.binary(), pa.list_(pa.int32()), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int64())]


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


def term_counts(docs: DataFrame) -> DataFrame:
    """n, the number of terms, for every row of docs (text)."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([len(terms_of(t)) for t in utf8_list(batch)], pa.int64())], ["n"])

    return arrow_map(docs.select("text"), "n long", lambda: step)


def exact_impacts(tf: np.ndarray, n: np.ndarray, n_documents: int, n_terms: int) -> np.ndarray:
    """The impact of tf occurrences in a document of n terms; n * n_documents * 75 stays below 2 ** 63 up to 10 ** 17."""
    m = 25 + (75 * n.astype(np.int64) * n_documents) // max(1, n_terms)
    return (1_000_000_000 * tf.astype(np.int64)) // (1000 * tf.astype(np.int64) + 8 * m)


class _Block:
    """Documents on their way into the index."""

    def __init__(self):
        self.rows, self.ids, self.terms, self.tokens, self.sizes, self.bytes = [], [], {}, [], [], 0

    def add(self, row: int, doc_id: int | None, text: bytes) -> None:
        terms = terms_of(text)
        if terms:
            names = self.terms
            self.tokens.append(np.fromiter((names.setdefault(t, len(names)) for t in terms), np.int64, len(terms)))
            self.rows.append(row)
            self.ids.append(doc_id)
            self.sizes.append(len(terms))
            self.bytes += len(text)

    def full(self) -> bool:
        return len(self.rows) >= BLOCK_ROWS or self.bytes >= BLOCK_BYTES

    def batch(self, n_documents: int, n_terms: int) -> pa.RecordBatch | None:
        if not self.rows:
            return None
        sizes, count = np.array(self.sizes, np.int64), len(self.rows)
        keys, tf = np.unique(np.concatenate(self.tokens) * count + np.repeat(np.arange(count), sizes), return_counts=True)
        term, place = np.divmod(keys, count)
        impacts = exact_impacts(tf, sizes[place], n_documents, n_terms).astype(np.int32)
        bounds = (-(-impacts // STEP)).astype(np.uint8)
        offsets = np.searchsorted(term, np.arange(len(self.terms) + 1)).astype(np.int32)
        spans = pa.array(offsets)
        columns = [
            pa.array(np.full(len(self.terms), self.rows[0])),
            pa.array(list(self.terms), pa.binary()),
            pa.ListArray.from_arrays(spans, pa.array(place.astype(np.int32))),
            pa.Array.from_buffers(pa.binary(), len(self.terms), [None, pa.py_buffer(offsets), pa.py_buffer(bounds)]),
            pa.ListArray.from_arrays(spans, pa.array(impacts)),
            pa.nulls(len(self.terms), pa.list_(pa.int64())),
        ]
        return pa.RecordBatch.from_arrays(columns, NAMES)

    def members(self) -> pa.RecordBatch:
        values = [self.rows[0], b"", None, None, None, self.ids]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, KINDS, strict=True)], NAMES)


class LexicalIndex:
    """The index at `location`: stats, and one table of all blocks, in buckets by block, so that a block's rows are read by one task
    without a shuffle. A row is a block and a term with its postings; the row of the empty term names the block's documents."""

    def __init__(self, spark: SparkSession, location: str):
        self.spark, self.location = spark, location.rstrip("/")
        self.n_documents, self.n_terms, buckets = spark.read.schema(STATS).json(f"{self.location}/stats").first()
        self.table = f"lexical_{uuid.uuid4().hex}"
        spark.sql(f"CREATE TABLE {self.table} ({BLOCK}) USING parquet CLUSTERED BY (block) SORTED BY (block, term) INTO {buckets} BUCKETS LOCATION '{self.location}/blocks'")

    @classmethod
    def build(cls, docs: DataFrame, location: str | None = None) -> LexicalIndex:
        """Index every row of docs (doc_id, text)."""
        spark = docs.sparkSession
        location = (location or f"{shared_dir(spark)}/lexical-{uuid.uuid4().hex}").rstrip("/")
        n = F.col("n")
        n_documents, n_terms = term_counts(docs).agg(F.count(F.when(n > 0, 1)), F.coalesce(F.sum(n), F.lit(0))).first()
        buckets = task_count(spark, n_documents, ROWS_A_BUCKET)
        spark.createDataFrame([(n_documents, n_terms, buckets)], STATS).coalesce(1).write.json(f"{location}/stats")
        index = cls(spark, location)
        numbered = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
        numbered.mapInArrow(_block_writer(n_documents, n_terms), BLOCK).write.insertInto(index.table)
        spark.catalog.refreshTable(index.table)
        return index

    def blocks(self, *columns: str) -> DataFrame:
        """The postings: block, term and the named columns (places, bounds, impacts)."""
        return self.spark.table(self.table).filter(F.col("term") != F.lit(b"")).select("block", "term", *columns)

    def members(self) -> DataFrame:
        """block, place, doc_id."""
        return self.spark.table(self.table).filter(F.col("term") == F.lit(b"")).select("block", F.posexplode("ids").alias("place", "doc_id"))


def _block_writer(n_documents: int, n_terms: int):
    def given(block: _Block) -> Iterator[pa.RecordBatch]:
        if (postings := block.batch(n_documents, n_terms)) is not None:
            yield postings
            yield block.members()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = _Block()
        for batch in batches:
            for row, doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), utf8_list(batch), strict=True):
                block.add(row, doc_id, text)
                if block.full():
                    yield from given(block)
                    block = _Block()
        yield from given(block)
        return_memory()

    return run


def item_terms(items: DataFrame) -> DataFrame:
    """item_id, term and its occurrences in the item's distinct texts."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        terms = [terms_of(t) for t in utf8_list(batch)]
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.repeat(np.arange(len(terms)), [len(t) for t in terms]))), pa.array([t for x in terms for t in x], pa.binary())], ["item_id", "term"])

    rows = items.select(items["item_id"].cast("long").alias("item_id"), F.coalesce(items["text"], F.lit("")).alias("text")).distinct()
    return arrow_map(rows, "item_id long, term binary", lambda: step).groupBy("item_id", "term").agg(F.count("*").alias("times"))


def weighted(index: LexicalIndex, terms: DataFrame) -> DataFrame:
    """terms with `weight`: the term's weight by its document frequency, times its occurrences; terms that no document has are left out."""
    wanted = terms.select("term").distinct()
    df = index.blocks("bounds").select("term", F.octet_length("bounds").cast("long").alias("n")).join(wanted, "term").groupBy("term").agg(F.sum("n").alias("df"))
    rarity = F.floor(F.lit(1000) * F.log((F.lit(2.0) * index.n_documents + 2) / (F.lit(2.0) * F.col("df") + 1))).cast("long")
    return terms.join(df, "term").select("item_id", "term", (F.col("times") * rarity).alias("weight")).filter("weight > 0")


def _candidates(index: LexicalIndex, group: list, k: int) -> DataFrame:
    """item, block, place, upper, lower of the documents that may be among the k best of their block; group: (item, term, weight) of a bounded group of items."""
    spark = index.spark
    names: dict[bytes, int] = {}
    at = np.array([(item, names.setdefault(term, len(names)), weight) for item, term, weight in group], np.int64)
    at = at[np.argsort(at[:, 1], kind="stable")]
    shared = spark.sparkContext.broadcast((at[:, 0].copy(), at[:, 2].copy(), np.searchsorted(at[:, 1], np.arange(len(names) + 1))))
    n_items = int(at[:, 0].max()) + 1
    known = F.broadcast(spark.createDataFrame(list(names.items()), "term binary, code int"))
    rows = index.blocks("places", "bounds").join(known, "term").select("block", "code", "places", "bounds")

    def bounded(block: pa.Table) -> pa.Table:
        items, weights, spans = shared.value
        block = block.combine_chunks()
        codes, lists = block["code"].to_numpy(), block["places"].combine_chunks()
        flat, bounds = lists.flatten().to_numpy(), np.frombuffer(b"".join(block["bounds"].to_pylist()), np.uint8).astype(np.int64)
        offsets = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))])
        size = int(flat.max()) + 1
        upper, met = np.zeros((n_items, size), np.int64), np.zeros((n_items, size), np.int64)
        for code, low, high in zip(codes.tolist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            of, w = items[spans[code] : spans[code + 1], None], weights[spans[code] : spans[code + 1], None]
            upper[of, flat[low:high]] += w * (STEP * bounds[low:high])
            met[of, flat[low:high]] += w
        lower = upper - (STEP - 1) * met  # a byte is less than one step too high
        least = np.partition(lower, size - k, axis=1)[:, size - k, None] if size > k else np.zeros((n_items, 1), np.int64)
        item, place = np.nonzero((upper > 0) & (upper >= least))
        return pa.table([pa.array(item.astype(np.int32)), pa.array(np.full(len(item), block["block"][0].as_py())), pa.array(place.astype(np.int32)), pa.array(upper[item, place]), pa.array(lower[item, place])], ["item", "block", "place", "upper", "lower"])

    return rows.groupBy("block").applyInArrow(bounded, "item int, block long, place int, upper long, lower long")


def _groups(terms: list) -> Iterator[list]:
    """The rows (item_id, term, weight), sorted by item, in groups that keep to GROUP_ITEMS items and, but for a longer item, GROUP_TERMS terms."""
    group, own, items = [], [], 0
    for row in [*terms, None]:
        if own and (row is None or row[0] != own[0][0]):
            if group and (items >= GROUP_ITEMS or len(group) + len(own) > GROUP_TERMS):
                yield group
                group, items = [], 0
            group, own, items = group + own, [], items + 1
        if row is not None:
            own.append(row)
    if group:
        yield group


def search(index: LexicalIndex, items: DataFrame, k: int = TOP) -> DataFrame:
    """item_id, rank, doc_id, score of the k best documents of every item (item_id, text)."""
    spark = index.spark
    terms = stored(weighted(index, item_terms(items)), "item-terms")
    n_items, n_terms = terms.agg(F.count_distinct(F.struct("item_id")), F.count("*")).first()
    parts, out = max(-(-n_items // GROUP_ITEMS), -(-n_terms // GROUP_TERMS), 1), None
    for part in range(parts):  # a bounded part of the items at a time
        rows = terms.filter(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == part).select("item_id", "term", "weight").collect()
        for group in _groups(sorted(rows, key=lambda r: (r[0] is not None, r[0], r[1]))):
            found = _search_group(index, group, k)
            out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")


def _search_group(index: LexicalIndex, group: list, k: int) -> DataFrame:
    spark = index.spark
    ids = list(dict.fromkeys(item for item, _, _ in group))
    code = {item: c for c, item in enumerate(ids)}
    rows = [(code[item], bytes(term), int(weight)) for item, term, weight in group]
    named = spark.createDataFrame(list(enumerate(ids)), "item int, item_id long")
    wanted = spark.createDataFrame(rows, "item int, term binary, weight long")
    found = stored(_candidates(index, rows, k), "search-candidates")
    by_lower = Window.partitionBy("item").orderBy(F.desc("lower"))
    kth = found.withColumn("r", F.row_number().over(by_lower)).filter(F.col("r") <= k).groupBy("item").agg(F.when(F.count("*") >= k, F.min("lower")).otherwise(0).alias("least"))
    survivors = stored(found.join(F.broadcast(kth), "item").filter(F.col("upper") >= F.col("least")).select("item", "block", "place"), "search-survivors")
    pairs = survivors.join(F.broadcast(wanted), "item")
    reached = survivors.select("block").distinct()
    exact = index.blocks("places", "impacts").join(F.broadcast(wanted.select("term").distinct()), "term", "left_semi").join(reached, "block", "left_semi")
    impact = F.get("impacts", F.array_position("places", F.col("place")).cast("int") - 1).cast("long")
    scored = pairs.join(exact, ["block", "term"]).select("item", "block", "place", (F.col("weight") * impact).alias("points")).filter("points IS NOT NULL")
    totals = scored.groupBy("item", "block", "place").agg(F.sum("points").alias("score")).filter("score > 0")
    with_ids = totals.join(index.members(), ["block", "place"]).join(F.broadcast(named), "item")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return with_ids.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query op12: the ten best documents of every benchmark item."""
    prepare(spark)
    docs = documents(spark, sf_dir)
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"], F.lit("")).alias("text"))
    return search(LexicalIndex.build(rows), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_SQL_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_SQL_TERMS = f"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_SQL_TERM}')"
LEXICAL_SEARCH_SQL = rf"""
WITH d AS (SELECT row_number() OVER (ORDER BY doc_id) AS r, doc_id, {_SQL_TERMS} AS terms FROM documents),
c AS (SELECT count(*) AS n_docs, CAST(sum(len(terms)) AS BIGINT) AS l FROM d WHERE len(terms) > 0),
t AS MATERIALIZED (SELECT r, doc_id, len(terms) AS n, unnest(terms) AS term FROM d),
p AS MATERIALIZED (SELECT r, doc_id, n, term, count(*) AS tf FROM t GROUP BY ALL),
f AS (SELECT term, CAST(floor(1000 * ln((2.0 * n_docs + 2) / (2.0 * count(*) + 1))) AS BIGINT) AS w FROM p, c GROUP BY term, n_docs),
q AS (SELECT item_id, unnest({_SQL_TERMS}) AS term FROM benchmark),
u AS (SELECT item_id, term, count(*) AS times FROM q GROUP BY ALL),
s AS (SELECT item_id, r, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // l)))) AS BIGINT) AS score FROM u JOIN f USING (term) JOIN p USING (term), c GROUP BY ALL),
k AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT * FROM k WHERE rank <= 10
"""
