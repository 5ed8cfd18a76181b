"""MinHash near-dedup with sequential Bayesian verification.

Documents with equal shingle sets form a class, and classes are compared. A class's signature has
BANDS x BAND_ROWS min-hashes; classes that share a band are candidates. Candidates' signatures are
compared batch by batch; after each batch a pair goes if the posterior probability (uniform prior) that
its similarity reaches THRESHOLD is below MISS. Pairs that survive are verified on their full sets, so
every link is exact. A link is lost in two ways only: its pair shares no band, with probability at most
(1 - THRESHOLD**BAND_ROWS)**BANDS, about 1e-5 at the threshold and less above it; or one of the HASHES / BATCH
looks at its signatures finds the threshold implausible, with a posterior of less than MISS at each look. (A lost
link splits a component only if no other path joins its ends.)

No bucket's pairs are emitted. A bucket's members are compared with its least member; then, in the
buckets that still hold several components, members of different components are compared inside a join
by their odd sketches. There a bucket is dealt into blocks of about BLOCK_MEMBERS, and each pair of blocks is a
group of its own, so no bucket, however large, is one task's burden. (An odd sketch has bit i set if
an odd number of the set's hashes fall on i, so two sketches differ in no more bits than the sets have
differing members, and a pair that differs in more than the threshold allows is ruled out with
certainty.) Members that are already connected need no comparison, and any two others in a bucket have
been compared, so components are exact.

Defined results: null or empty texts have an empty set and are linked with nothing; rows with one doc_id
are one document; a null doc_id gives a null component and is kept; an empty table gives no rows; other
columns are ignored, and pass through `clean`. Texts are shingled whole."""

from __future__ import annotations

import hashlib
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bazaarlake.llm.common import Memo, arrow_map, documents, lookup, mix64, prepare, right_sized, stored, texts, utf8_list
from bazaarlake.llm.components import connected_components

WORDS, THRESHOLD = 5, (75, 100)
BANDS, BAND_ROWS, BATCH = 30, 4, 24
MISS = 1e-6
HASHES = BANDS * BAND_ROWS
DOCS_A_TASK, PAIRS_A_TASK = 4_000, 5_000  # of Python tasks
ODD_LONGS = 32  # 64-bit words of an odd sketch
BLOCK_MEMBERS = 1_000
_BLOCK = 512
_rng = np.random.default_rng(20240229)
_A = _rng.integers(0, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 2**63, HASHES, dtype=np.uint64)
_P = _rng.integers(0, 2**63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BAND = _rng.integers(0, 2**63, (BANDS, BAND_ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@lru_cache(maxsize=1)
def word_hashes() -> Memo:
    return Memo(xxhash.xxh3_64_intdigest, 120_000)


def word_array(text: bytes) -> np.ndarray:
    """The 64-bit hashes of a text's words: A-Z lower-cased, split at ASCII white space."""
    words = text.lower().split()
    return np.fromiter(map(word_hashes().__getitem__, words), np.uint64, len(words))


def shingle_set(text: bytes) -> np.ndarray:
    """The sorted distinct hashes of a text's WORDS-word shingles; of all its words as one if there are fewer."""
    words = word_array(text)
    n = len(words)
    if n == 0:
        return words
    if n < WORDS:
        return mix64((words * _P[:n]).sum(keepdims=True, dtype=np.uint64) + np.uint64(n))
    total = words[: n - WORDS + 1] * _P[0]
    for k in range(1, WORDS):
        total += words[k : n - WORDS + 1 + k] * _P[k]
    return np.unique(mix64(total))


def signature(shingles: np.ndarray) -> np.ndarray:
    """The min-hashes of a set that isn't empty."""
    least = None
    for at in range(0, len(shingles), _BLOCK):
        part = np.multiply.outer(_A, shingles[at : at + _BLOCK])
        part += _B[:, None]
        low = part.min(axis=1)
        least = low if least is None else np.minimum(least, low)
    return mix64(least)


def features(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, set_key (null for empty sets), sig (16 bits a hash) and bands."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        cols: list[list] = [[], [], [], []]
        for text in utf8_list(batch):
            shingles = shingle_set(text)
            if len(shingles):
                full = signature(shingles)
                sig = full.astype(np.uint16)
                bands = mix64((full.reshape(BANDS, BAND_ROWS) * _BAND).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64))
                row = (len(shingles), hashlib.blake2b(shingles.tobytes(), digest_size=16).digest(), sig.tobytes(), bands.view(np.int64))
            else:
                row = (0, None, None, None)
            for col, x in zip(cols, row, strict=True):
                col.append(x)
        kinds = [pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64())]
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["doc_id", "n_shingles", "set_key", "sig", "bands"])

    return arrow_map(docs, "doc_id long, n_shingles long, set_key binary, sig binary, bands array<long>", lambda: step)


def odd_sketch(shingles: np.ndarray) -> np.ndarray:
    counts = np.bincount((shingles % np.uint64(64 * ODD_LONGS)).astype(np.int64), minlength=64 * ODD_LONGS)
    return np.packbits((counts & 1).astype(np.uint8)).view(np.int64)


def shingle_sets(docs: DataFrame) -> DataFrame:
    """doc_id, its set as bytes of sorted 64-bit hashes, its size and odd sketch."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingle_set(t) for t in utf8_list(batch)]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in sets], pa.binary()), pa.array(map(len, sets), pa.int64()), pa.array(map(odd_sketch, sets), pa.list_(pa.int64()))], ["doc_id", "shingles", "size", "odd"])

    return arrow_map(docs, "doc_id long, shingles binary, size long, odd array<long>", lambda: step)


@lru_cache(maxsize=8)
def least_matches(similarity: float, miss: float) -> list[int]:
    """For each number n of compared hashes, the fewest matches with which similarity is still plausible.

    With a uniform prior the posterior of the similarity is Beta(m + 1, n - m + 1), and its mass above t
    equals the chance of at most m successes in n + 1 trials of probability t."""
    out = []
    for n in range(HASHES + 1):
        mass, m = 0.0, 0
        for m in range(n + 2):
            mass += comb(n + 1, m) * similarity**m * (1 - similarity) ** (n + 1 - m)
            if mass >= miss:
                break
        out.append(m)
    return out


def plausible(pairs: DataFrame, sigs: DataFrame, rows: int) -> DataFrame:
    """The pairs (a, b) that the sequential comparison of signature batches leaves."""
    limits = least_matches(THRESHOLD[0] / THRESHOLD[1], MISS)
    left = sigs.select(F.col("doc_id").alias("a"), F.col("sig").alias("sig_a"))
    right = sigs.select(F.col("doc_id").alias("b"), F.col("sig").alias("sig_b"))

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        sig_a, sig_b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(-1, HASHES) for i in (2, 3))
        alive, matches = np.arange(batch.num_rows), np.zeros(batch.num_rows, np.int64)
        for at in range(0, HASHES, BATCH):
            matches[alive] += (sig_a[alive, at : at + BATCH] == sig_b[alive, at : at + BATCH]).sum(axis=1)
            alive = alive[matches[alive] >= limits[min(at + BATCH, HASHES)]]
            if not len(alive):
                break
        return batch.select([0, 1]).take(pa.array(alive))

    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "sig_a", "sig_b")
    return arrow_map(right_sized(joined, rows, PAIRS_A_TASK), "a long, b long", lambda: step)


def exact_links(pairs: DataFrame, sets: DataFrame, rows: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold."""
    left = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("set_a"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("set_b"))
    part, whole = THRESHOLD

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        linked = []
        for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            set_a, set_b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            at = np.searchsorted(set_b, set_a)
            at[at == len(set_b)] = 0
            common = int((set_b[at] == set_a).sum())
            linked.append(whole * common >= part * (len(set_a) + len(set_b) - common))
        return batch.select([0, 1]).filter(pa.array(linked))

    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "set_a", "set_b")
    return arrow_map(right_sized(joined, rows, PAIRS_A_TASK), "a long, b long", lambda: step)


class NearDuplicates:
    """Tables of one run: rows (features of all documents), labels (component of every linked class)."""

    def __init__(self, docs: DataFrame):
        """docs: (doc_id, text)."""
        spark = docs.sparkSession
        self.rows = stored(features(docs), "minhash-features")
        known = self.rows.filter(F.col("set_key").isNotNull() & F.col("doc_id").isNotNull())
        classes = known.groupBy("set_key").agg(F.min(F.struct("doc_id", "sig", "bands")).alias("rep"), F.count("*").alias("rows"))
        classes = stored(classes, "minhash-classes")
        self.classes = classes.select("set_key", F.col("rep.doc_id").alias("rep"), "rows")
        self.sigs = classes.select("rep.doc_id", "rep.sig")
        members = classes.select(F.explode("rep.bands").alias("bucket"), F.col("rep.doc_id").alias("doc_id"))
        buckets = members.groupBy("bucket").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("greatest"))
        buckets = stored(buckets.filter("least < greatest").drop("greatest"), "minhash-buckets")
        # Both sides are dealt out for this join alone, so Spark splits a hot bucket's members over tasks.
        self.members = stored(members.join(buckets, "bucket"), "minhash-members")
        wanted = docs.join(self.members.select("doc_id").distinct(), "doc_id", "left_semi")
        self.sets = stored(shingle_sets(right_sized(wanted, self.rows.count(), DOCS_A_TASK)), "minhash-sets")
        # 1: each bucket's members against its least one.
        first = self.members.filter("doc_id != least").select(F.col("doc_id").alias("a"), F.col("least").alias("b")).distinct()
        labels = stored(connected_components(self._verified(first)), "minhash-labels")
        # 2: what still lies in different components of one bucket. Components go on as stars.
        known = labels.filter("node != component").select(F.col("node").alias("a"), F.col("component").alias("b"))
        self.labels = stored(connected_components(known.unionByName(self._verified(self._across(labels)))), "minhash-labels")

    def _verified(self, pairs: DataFrame) -> DataFrame:
        pairs = stored(pairs, "minhash-pairs")
        kept = stored(plausible(pairs, self.sigs, pairs.count()), "minhash-plausible")
        links = stored(exact_links(kept, self.sets, kept.count()), "minhash-links")
        return links

    def _named(self, labels: DataFrame) -> DataFrame:
        """The buckets' members with their components."""
        named = self.members.join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left")
        return stored(named.select("bucket", "doc_id", F.coalesce("component", "doc_id").alias("component")), "minhash-named")

    def _across(self, labels: DataFrame) -> DataFrame:
        named = self._named(labels)
        mixed = named.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.ceil(F.count("*") / BLOCK_MEMBERS).cast("int").alias("blocks")).filter("low < high").select("bucket", "blocks")
        sketches = self.sets.select("doc_id", "size", *(F.col("odd")[k].alias(f"odd{k}") for k in range(ODD_LONGS)))
        members = named.join(mixed, "bucket").select("bucket", "blocks", "doc_id", "component").join(sketches, "doc_id")
        members = stored(members.withColumn("own", F.expr("CAST(pmod(xxhash64(doc_id), blocks) AS INT)")), "minhash-mixed")
        others = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
        a, b = members.withColumnRenamed("own", "row").withColumn("column", others).alias("a"), members.withColumnRenamed("own", "column").withColumn("row", others).alias("b")
        differing = " + ".join(f"bit_count(a.odd{k} ^ b.odd{k})" for k in range(ODD_LONGS))
        part, whole = THRESHOLD  # at similarity s, sets of sizes x and y differ in (x + y) (1 - s) / (1 + s) members
        near = F.expr(f"({differing}) * {whole + part} <= (a.size + b.size) * {whole - part}")
        met = (F.col("a.bucket") == F.col("b.bucket")) & (F.col("a.row") == F.col("b.row")) & (F.col("a.column") == F.col("b.column"))
        pairs = a.join(b, met & (F.col("a.component") < F.col("b.component")) & near)
        return pairs.select(F.col("a.doc_id").alias("a"), F.col("b.doc_id").alias("b")).distinct()

    def components(self) -> DataFrame:
        """doc_id, n_shingles, component_id of every row."""
        named = self.classes.join(self.labels.withColumnRenamed("node", "rep"), "rep", "left").select("set_key", F.coalesce("component", "rep").alias("component_id"), "rows")
        total = self.classes.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
        facts = self.rows.select("doc_id", "n_shingles", "set_key")
        linked = facts.filter(F.col("set_key").isNotNull() & F.col("doc_id").isNotNull())
        alone = facts.filter(F.col("set_key").isNull() | F.col("doc_id").isNull()).withColumn("component_id", F.col("doc_id"))
        out = lookup(linked, named, "set_key", "rows", total)
        return out.select("doc_id", "n_shingles", "component_id").unionByName(alone.select("doc_id", "n_shingles", "component_id"))


def clean(docs: DataFrame) -> DataFrame:
    """docs, all their columns, with one document of each component: the smallest doc_id."""
    found = NearDuplicates(texts(docs)).components()
    kept = found.filter(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias("kept_id")).distinct()
    stay = docs.join(kept, docs["doc_id"] == kept["kept_id"], "left_semi")
    return stay.unionByName(docs.filter(docs["doc_id"].isNull()))


def minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query op1: the near-duplicate component of every document."""
    prepare(spark)
    found = NearDuplicates(texts(documents(spark, sf_dir))).components()
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


MINHASH_DEDUP_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')] ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) END) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS size FROM s GROUP BY 1),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 75 * (x.size + y.size - common)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS reached FROM w UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.reached)
SELECT w.doc_id, coalesce(any_value(n.size), 0) AS n_shingles, min(reached) AS component_id, w.doc_id = min(reached) AS kept FROM w LEFT JOIN n USING (doc_id) JOIN r ON r.doc_id = w.doc_id GROUP BY w.doc_id
"""
