"""Line dedup with levelled sorted runs of line hashes.

A run is a table (key hash, first document) sorted by hash and dealt to buckets by it; a hash is in one
run only. Each batch of documents is reduced to its distinct keys, merge-anti-joined with the runs, and
what is new becomes a run of level 0. When a level has FANOUT runs they are merged into one of the next
level, so there are few runs whatever the number of batches. Batches go up in doc_id, so a key's first
document is the smallest that holds it. Lines whose key has an earlier document are dropped.

The runs lie in a folder with a log of which of them are current after each change, so a later session goes
on where an earlier one ended. One writer at a time.

Keys are the first 128 bits of SHA-256: at 10**12 lines the chance of any collision is about 10**-15.

Defined results: a null or empty text is one empty line; keys shorter than MIN_CHARS code points never
match; repeated lines within a key's first document all stay; rows repeated with the same doc_id are one
document, so none of their lines is dropped on account of the other, and each row loses its own lines only
where their texts differ; rows with a null doc_id are never first and keep all their lines; an empty table
gives no rows; other columns pass through `clean` untouched."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bazaarlake.llm.common import documents, let, log_rows, lookup, prepare, shared_dir, stored, texts
from bazaarlake.llm.digest_store import buckets_for

MIN_CHARS, FANOUT, BATCHES = 10, 4, 4
SPACES = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LOG = "version long, level int, folder string, buckets int"
ROW = ["doc_id", "text_key"]  # rows that share both are equal


def line_key(line) -> F.Column:
    """The line with ASCII white space stripped and A-Z lower-cased."""
    bare = F.btrim(line, F.lit(SPACES))
    return F.when(F.octet_length(bare) == F.length(bare), F.lower(bare)).otherwise(F.translate(bare, _UPPER, _LOWER))


def line_hashes(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, pos, hash) of the lines that may match."""
    keyed = docs.select("doc_id", F.xxhash64("text").alias("text_key"), F.split("text", "\n").alias("lines"))
    lines = keyed.select(*ROW, F.posexplode("lines").alias("pos", "line")).withColumn("key", line_key(F.col("line")))
    return lines.filter(F.length("key") >= MIN_CHARS).select(*ROW, "pos", F.substring(F.unhex(F.sha2("key", 256)), 1, 16).alias("hash"))


class LineRuns:
    """The levelled runs at `location`; opening the location again, in any session, goes on with them. `levels` names their tables."""

    def __init__(self, spark: SparkSession, buckets: int = 64, fanout: int = FANOUT, location: str | None = None):
        self.spark, self.buckets, self.fanout = spark, buckets, fanout
        self.location = (location or f"{shared_dir(spark)}/line-runs-{uuid.uuid4().hex}").rstrip("/")
        self.levels: list[list[str]] = []
        self.folders: dict[str, tuple[str, int]] = {}  # table: its folder and bucket count
        logged = log_rows(spark, f"{self.location}/log", LOG)
        self.version = max((r["version"] for r in logged), default=-1)
        for r in sorted(r for r in logged if r["version"] == self.version):
            self._at(r["level"]).append(self._opened(r["folder"], r["buckets"]))

    def _at(self, level: int) -> list[str]:
        while len(self.levels) <= level:
            self.levels.append([])
        return self.levels[level]

    def _opened(self, folder: str, buckets: int) -> str:
        table = f"line_run_{uuid.uuid4().hex}"
        self.spark.sql(f"CREATE TABLE {table} (hash BINARY, first_id BIGINT) USING parquet CLUSTERED BY (hash) SORTED BY (hash) INTO {buckets} BUCKETS LOCATION '{self.location}/{folder}'")
        self.folders[table] = folder, buckets
        return table

    def _write(self, rows: DataFrame) -> str:
        table = self._opened(f"run-{uuid.uuid4().hex}", self.buckets)
        rows.select("hash", "first_id").repartition(self.buckets, "hash").sortWithinPartitions("hash").write.insertInto(table)
        self.spark.catalog.refreshTable(table)
        return table

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(t) for level in self.levels for t in level]

    def rows(self) -> DataFrame | None:
        """hash, first_id of all runs."""
        out = None
        for run in self.runs():
            out = run if out is None else out.unionByName(run)
        return out

    def add(self, keys: DataFrame) -> None:
        """keys: (hash, first_id), one row a hash. Keys that a run has are left out, the others become a run."""
        for run in self.runs():
            keys = keys.join(run.select("hash").hint("merge"), "hash", "left_anti")
        self._place(0, self._write(keys))
        self.version += 1
        current = [(self.version, level, *self.folders[t]) for level, tables in enumerate(self.levels) for t in tables]
        self.spark.createDataFrame(current, LOG).coalesce(1).write.mode("append").json(f"{self.location}/log")

    def _place(self, level: int, table: str) -> None:
        self._at(level).append(table)
        if len(self.levels[level]) >= self.fanout:
            old, merged = self.levels[level], None
            for t in old:
                merged = self.spark.table(t) if merged is None else merged.unionByName(self.spark.table(t))
            fresh = self._write(merged)
            self.levels[level] = []
            for t in old:
                self.spark.sql(f"DROP TABLE {t}")  # its files stay for whoever still reads them
            self._place(level + 1, fresh)


def dropped_lines(docs: DataFrame, runs: LineRuns | None = None, batches: int = BATCHES) -> DataFrame:
    """doc_id, text_key and the positions of the lines that the row loses. docs: (doc_id, text); runs hold earlier batches' keys, if any."""
    spark = docs.sparkSession
    runs = runs or LineRuns(spark, buckets_for(docs))
    hashes = stored(line_hashes(docs.filter(F.col("doc_id").isNotNull())), "line-hashes")
    low, high, total = hashes.agg(F.min("doc_id"), F.max("doc_id"), F.count("*")).first()
    if low is None:
        return hashes.groupBy(*ROW).agg(F.collect_set("pos").alias("lost"))
    step = max(1, -(-(high - low + 1) // batches))
    for start in range(low, high + 1, step):
        own = hashes.filter(F.col("doc_id").between(start, min(start + step - 1, high)))
        runs.add(own.groupBy("hash").agg(F.min("doc_id").alias("first_id")))
    keys = hashes.groupBy("hash").agg(F.max("doc_id").alias("last_id"), F.count("*").alias("rows"))
    matched = keys.join(runs.rows(), "hash").filter(F.col("last_id") > F.col("first_id")).select("hash", "first_id", "rows")
    lost = lookup(hashes, stored(matched, "line-matches"), "hash", "rows", total).filter(F.col("doc_id") > F.col("first_id"))
    return lost.groupBy(*ROW).agg(F.collect_set("pos").alias("lost"))


def without_lost(text, lost) -> F.Column:
    """text without the lines at the positions in lost (null: none), in time linear in the number of lines."""

    def kept(both) -> F.Column:
        places = F.array_except(F.sequence(F.lit(0), F.size(both["lines"]) - 1), both["lost"])
        return F.array_join(F.transform(places, lambda k: both["lines"][k]), "\n")

    return F.when(lost.isNull(), text).otherwise(let(F.struct(F.split(text, "\n").alias("lines"), lost.alias("lost")), kept))


def clean(docs: DataFrame) -> DataFrame:
    """docs, all their columns, with repeated lines gone from text."""
    lost = dropped_lines(texts(docs)).withColumnsRenamed({"doc_id": "lost_from", "text_key": "lost_key"})
    at = docs.columns.index("text")
    joined = docs.join(lost, (docs["doc_id"] == lost["lost_from"]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == lost["lost_key"]), "left")
    text = F.when(lost["lost"].isNull(), docs["text"]).otherwise(without_lost(docs["text"], lost["lost"])).alias("text")
    return joined.select(*(text if i == at else docs[c] for i, c in enumerate(docs.columns)))


def line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query op8: every document's line counts and the digest of what stays."""
    prepare(spark)
    docs = texts(documents(spark, sf_dir))
    joined = docs.withColumn("text_key", F.xxhash64("text")).join(dropped_lines(docs), ROW, "left")
    return joined.select(
        "doc_id",
        F.size(F.split("text", "\n")).cast("long").alias("n_lines"),
        F.coalesce(F.size("lost"), F.lit(0)).cast("long").alias("n_dropped"),
        F.sha2(without_lost(F.col("text"), F.col("lost")), 256).alias("kept_sha256"),
    )


LINE_DEDUP_SQL = r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (SELECT doc_id, pos, line, translate(trim(line, chr(32) || chr(9) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key, min(doc_id) AS first_id FROM k WHERE length(key) >= 10 GROUP BY key),
m AS (SELECT k.doc_id, k.pos, k.line, coalesce(f.first_id < k.doc_id, false) AS lost FROM k LEFT JOIN f USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE lost) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT lost), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
